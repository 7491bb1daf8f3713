"""Near and farthest pairs against all pairs: same rows, and far fewer compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovox.operators import identity as N
from chronovox.operators import pruned as Q

VEC = "t int, name string, embedding array<double>"


def clustered(seed, n, centres, width, spread=0.05, tenants=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    c /= np.linalg.norm(c, axis=1)[:, None]
    v = c[rng.integers(0, centres, n)] + rng.normal(0, spread / np.sqrt(width), (n, width)) * rng.choice([1.0, 3.0], (n, 1))
    return [(0 if i % 4 else int(i % tenants), f"v{i:05d}", [float(x) for x in r]) for i, r in enumerate(v)]


def distances(rows):
    """{tenant: (names, matrix)}"""
    out = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        v = np.array([r[2] for r in own])
        v = v / np.linalg.norm(v, axis=1)[:, None]
        out[t] = [r[1] for r in own], 1 - v @ v.T
    return out


def brute_near(rows, limit):
    return sorted((t, *sorted((n[i], n[j]))) for t, (n, d) in distances(rows).items() for i, j in zip(*np.nonzero(np.triu(d <= limit, 1)), strict=True))


@pytest.mark.parametrize("limit", [0.02, 0.1, 0.25, 0.7, 1.3])
def test_near_pairs(spark, monkeypatch, limit):
    """Cells of one key and of several, tenants of all sizes; each pair once, by name."""
    monkeypatch.setattr(Q, "CELL_ROWS", 40)
    rows = clustered(1, 600, 30, 8, 0.3, 3)
    got = N.near_duplicate_profiles(spark.createDataFrame(rows, VEC), ["t"], limit)
    found = got.collect()
    assert sorted((r.t, r.a, r.b) for r in found) == brute_near(rows, limit)
    exact = {t: (dict(zip(n, range(len(n)), strict=True)), d) for t, (n, d) in distances(rows).items()}
    assert all(abs(r.distance - exact[r.t][1][exact[r.t][0][r.a], exact[r.t][0][r.b]]) < 1e-9 for r in found)


def test_few_pairs_are_compared(spark):
    """4,000 vectors about 200 directions of 32 dimensions: a small part of 8 million pairs."""
    rows = clustered(2, 4000, 200, 32)
    df = spark.createDataFrame(rows, VEC)
    unit = Q.unit_vectors(df, ["t"], "name").cache()
    limit = 0.1
    compared = Q.candidate_pairs(unit, ["t"], limit).count()
    want = len(brute_near(rows, limit))
    assert want <= compared < 4000 * 3999 / 2 / 15, (want, compared)
    assert N.near_duplicate_profiles(df, ["t"], limit).count() == want


def test_far_pairs(spark):
    """The farthest two of each group, clustered or spread, exactly; few pairs where cells can't be far apart."""
    rows = [(1, n, v) for _, n, v in clustered(3, 1200, 40, 16, 0.2)] + [(2, n, v) for _, n, v in clustered(4, 300, 300, 5)] + [(3, "a", [1.0, 0.0]), (3, "b", [1.0, 0.1]), (4, "a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, VEC)
    got = {r.t: r.max_distance for r in Q.farthest(df, ["t"], "name").collect()}
    d = distances([r for r in rows if r[0] < 3]) | {3: (["a", "b"], np.array([[0, 1 - 1 / np.sqrt(1.01)]]))}
    assert set(got) == {1, 2, 3} and all(abs(got[t] - d[t][1].max()) < 1e-9 for t in got)
    unit = Q.unit_vectors(df.where("t = 1"), ["t"], "name").cache()
    pairs, _ = Q.far_pairs(unit, ["t"])
    assert pairs.count() < 1200 * 1199 / 2 / 10


def test_odd_vectors(spark):
    """Null, zero, infinite, other widths, repeated names, ties, no rows."""
    rows = [(0, "a", [1.0, 0.0]), (0, "b", [1.0, 0.0]), (0, "c", None), (0, "d", [0.0, 0.0]), (0, "e", [1.0, 0.0, 0.0]), (0, "f", [1.0, 0.0, 0.1]), (0, "g", [float("inf"), 1.0]), (0, "a", [1.0, 0.01]), (None, "n", [1.0, 0.0]), (None, "m", [1.0, 0.0])]
    df = spark.createDataFrame(rows, VEC)
    got = sorted((r.a, r.b) for r in N.near_duplicate_profiles(df.where("t = 0"), ["t"], 0.1).collect())
    assert got == [("a", "b"), ("a", "b"), ("e", "f")]
    assert N.near_duplicate_profiles(df.where("false"), ["t"], 0.1).count() == 0 and Q.farthest(df.where("false"), ["t"], "name").count() == 0
    assert {r.t: r.max_distance for r in Q.farthest(df.where("name IN ('c', 'd', 'b', 'g')"), ["t"], "name").collect()} == {0: 1.0}
    same = spark.createDataFrame([(0, f"x{i}", [0.6, 0.8]) for i in range(50)], VEC)
    assert N.near_duplicate_profiles(same, ["t"], 0.0001).count() == 1225
    assert abs(Q.farthest(same, ["t"], "name").first().max_distance) < 1e-9


@pytest.mark.parametrize("limit", [0.7, 1.3])
def test_wide_angles_by_blocks(spark, monkeypatch, limit):
    """No table of candidate pairs at wide angles: blocks and tiles of a few vectors, each pair once, within its tenant."""
    monkeypatch.setattr(Q, "BLOCK", 70)
    monkeypatch.setattr(Q, "TILE", 16)
    monkeypatch.setattr(Q, "candidate_pairs", None)
    rows = clustered(5, 400, 400, 8, 0.3, 3)
    odd = [(None, "n", [1.0] * 8), (None, "m", [1.0] * 8), (0, "x", [1.0]), (0, "y", None)]
    got = Q.near_pairs(spark.createDataFrame(rows + odd, VEC), ["t"], "name", limit).collect()
    assert sorted((r.t, r.a, r.b) for r in got) == brute_near(rows, limit)


def test_farthest_by_blocks(spark, monkeypatch):
    """No table of pairs: blocks and tiles of a few vectors, several widths, one vector alone."""
    monkeypatch.setattr(Q, "BLOCK", 70)
    monkeypatch.setattr(Q, "TILE", 16)
    monkeypatch.setattr(Q, "far_pairs", None)
    rows = clustered(6, 400, 400, 8, 0.3, 3)
    odd = [(7, "x", [1.0]), (8, "x", [1.0]), (8, "y", [0.0, 1.0]), (8, "z", [1.0, 1.0])]
    got = {r.t: r.max_distance for r in Q.farthest(spark.createDataFrame(rows + odd, VEC), ["t"], "name").collect()}
    want = {t: d.max() for t, (_, d) in distances(rows).items()} | {8: 1 - np.sqrt(0.5)}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in got)
