"""Clusterings against one merge at a time, in one task and in rounds; long recordings in linear time."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronovox.operators import clustering as C
from chronovox.operators import intervals as I

KIND = "recording_id int, win_id int, embedding array<double>"


def frame(spark, v, recording=1):
    return spark.createDataFrame([(recording, i, [float(x) for x in r]) for i, r in enumerate(v)], KIND)


def plain_clusters(v, how, limit=np.inf, k=1):
    """Label of each row: the closest two clusters merge, again and again."""
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    d = 1 - u @ u.T
    groups = {i: [i] for i in range(len(v))}
    of = {"complete": np.max, "single": np.min, "average": np.mean}[how]
    between = np.where(np.triu(np.ones_like(d), 1) > 0, np.round(d, 12), np.inf)  # of clusters a < b, named by their smallest member
    while len(groups) > k:
        a, b = divmod(int(between.argmin()), len(v))
        if not between[a, b] < limit:
            break
        groups[a] += groups.pop(b)
        between[b], between[:, b] = np.inf, np.inf
        for c in groups:
            if c != a:
                between[min(a, c), max(a, c)] = round(float(of(d[np.ix_(groups[a], groups[c])])), 12)
    return {i: a for a, m in groups.items() for i in m}


def labels(df):
    return {r.win_id: r.cluster for r in df.collect()}


def chain(n):
    """Unit vectors on an arc whose steps grow: each joins the one cluster before it."""
    a = np.cumsum(0.002 + 0.00001 * np.arange(n))
    return np.stack([np.cos(a), np.sin(a), np.zeros(n)], axis=1)


@pytest.mark.parametrize("how", ["complete", "average", "single"])
@pytest.mark.parametrize("small", [C.SMALL, 5])
def test_exactly_k_clusters(spark, how, small):
    v = np.random.default_rng(3).normal(size=(22, 5))
    assert labels(C.agglomerate_k(frame(spark, v), 4, how, small=small)) == plain_clusters(v, how, k=4)


@pytest.mark.parametrize("how", ["complete", "average", "single"])
def test_long_chains(spark, how):
    v = chain(200)
    got = labels(C.agglomerate_k(frame(spark, v), 2, how))
    assert got == plain_clusters(v, how, k=2) and len(set(got.values())) == 2


@pytest.mark.parametrize("how", ["complete", "average", "single"])
@pytest.mark.parametrize("n", [60, 61])
def test_at_the_border_of_both_ways(spark, how, n):
    """Groups just below, at and above the size that one task takes, blocks of a few vectors, several groups."""
    v = np.random.default_rng(n).normal(size=(n, 4))
    df = frame(spark, v).unionByName(frame(spark, v[::-1], 2))
    got = {(r.recording_id, r.win_id): r.cluster for r in C.agglomerate_k(df, 5, how, small=60).collect()}
    assert got == {(1, i): c for i, c in plain_clusters(v, how, k=5).items()} | {(2, i): c for i, c in plain_clusters(v[::-1], how, k=5).items()}


@pytest.mark.parametrize("how", ["complete", "average", "single"])
def test_rounds_in_many_blocks(spark, monkeypatch, how):
    """Clusters larger than a block; what is kept between rounds is right: equal to one merge at a time."""
    monkeypatch.setattr(C, "BLOCK", 24)
    v = np.random.default_rng(7).normal(size=(64, 3))
    assert labels(C.agglomerate_k(frame(spark, v), 3, how, small=12)) == plain_clusters(v, how, k=3)


def test_long_recording(spark, monkeypatch):
    """One recording of 6,000 windows of 200 voices: the voices, and less compared than all clusters with all in each round."""
    rng = np.random.default_rng(8)
    voices = rng.normal(size=(200, 16))
    who = rng.integers(0, 200, 6_000)
    v = voices[who] + rng.normal(0, 0.03, (6_000, 16))
    df = spark.createDataFrame(pd.DataFrame({"recording_id": 1, "win_id": np.arange(6_000), "embedding": v.tolist()}), "recording_id int, win_id long, embedding array<double>")
    work, plain = [], C.search_average

    def counted(dirty, state, group, limit):
        work.append((dirty.count(), state.count()))
        return plain(dirty, state, group, limit)

    monkeypatch.setattr(C, "search_average", counted)
    got = labels(C.agglomerate(df, 0.1))
    first = {}
    for i, k in enumerate(who.tolist()):
        first.setdefault(k, i)
    assert all(got[i] == first[k] for i, k in enumerate(who.tolist()))
    assert len(work) > 2 and sum(a * b for a, b in work) < 0.8 * sum(b * b for _, b in work)


@pytest.mark.parametrize("how", ["complete", "average"])
@pytest.mark.parametrize(("tile", "deep"), [(1 << 22, 64), (700, 2)])
def test_rounds_in_one_task(monkeypatch, how, tile, deep):
    """The tree by vectors is that of one merge at a time, with copies, vectors of no length and clusters met in parts."""
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(C, "DEEP", deep)
    v = np.random.default_rng(12).normal(size=(160, 5))
    v[40:70], v[100:103] = v[3], 0.0
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for limit in (np.inf, 0.6):
        want = {(a, b): d for a, b, d in C.merge_tree(1.0 - u @ u.T, how, limit)}
        for small in (1, 9):
            a, b, d = C.tree_in_rounds(u, how, limit, small=small)
            got = dict(zip(zip(a.tolist(), b.tolist(), strict=True), d.tolist(), strict=True))
            assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in got)
            assert len(got) == 159 or limit < 1


@pytest.mark.parametrize("how", ["complete", "average"])
def test_large_groups_in_one_task(spark, monkeypatch, how):
    """Groups of more than SMALL windows, up to the size given, take no round over tasks and no matrix of theirs."""
    v = np.random.default_rng(13).normal(size=(3_000, 8))
    v[2_500:2_700] = v[7]
    rows = pd.DataFrame({"recording_id": 1, "win_id": np.arange(3_000), "embedding": v.tolist()})
    df = spark.createDataFrame(rows, "recording_id int, win_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(C, "merge_rounds", None)
    got = labels(C.agglomerate_k(df, 12, how, small=C.WHOLE))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    name = np.arange(3_000)
    for a, b, _ in C.merge_tree(1.0 - u @ u.T, how, np.inf, 12):
        name[name == b] = a
    assert got == dict(enumerate(name.tolist())) and len(set(got.values())) == 12


def test_chain_in_rounds(spark):
    v = chain(80)
    assert labels(C.agglomerate_k(frame(spark, v), 2, "single", small=5)) == plain_clusters(v, "single", k=2)


@pytest.mark.parametrize("small", [C.SMALL, 5])
def test_threshold(spark, small):
    v = np.random.default_rng(4).normal(size=(26, 5))
    df = frame(spark, v).unionByName(frame(spark, v[:3], 2)).unionByName(spark.createDataFrame([(1, 90, None), (1, 91, [0.0] * 5), (3, 1, None)], KIND))
    got = {(r.recording_id, r.win_id): r.cluster for r in C.agglomerate(df, 0.7, small=small).collect()}
    want = {(1, i): c for i, c in plain_clusters(v, "average", 0.7).items()} | {(2, i): c for i, c in plain_clusters(v[:3], "average", 0.7).items()}
    assert got == want


def test_nothing_and_few_windows(spark):
    none = spark.createDataFrame([], KIND)
    assert C.agglomerate(none).count() == 0 and C.agglomerate_k(none, 3).count() == 0
    two = frame(spark, np.eye(2))
    assert labels(C.agglomerate_k(two, 5)) == {0: 0, 1: 1}


def test_capped(spark):
    v = np.random.default_rng(5).normal(size=(20, 6))
    df = frame(spark, v)
    each = df.select("recording_id", "win_id", F.col("win_id").alias("cluster"))
    assert labels(C.cap_clusters(df, each, 6)) == plain_clusters(v, "average", k=6)
    assert labels(C.cap_clusters(df, each, 20)) == {i: i for i in range(20)}


def test_one_long_recording(spark):
    """Items that all lie before, between and after turns of one recording: owners by brute force, and no
    square in its length."""
    n = 40_000
    turns = spark.range(n).select(F.lit(1).alias("recording_id"), F.col("id").alias("seq"), (F.col("id") * 1.0 + 5).alias("start_s"), (F.col("id") + 5.8).alias("end_s"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("speaker"), F.lit(0.5).alias("speaker_confidence"), F.lit(False).alias("uncertain"))
    rng = random.Random(2)
    at = [(1, i, x, x + 0.2) for i in range(n) for x in [rng.uniform(0, n + 10)]]
    items = spark.createDataFrame(at, "recording_id int, seq long, start_s double, end_s double")
    began = time.time()
    got = {r.seq: r.s for r in I.asof_turn(items, turns).select("seq", F.col("turn.seq").alias("s")).collect()}
    took = time.time() - began
    assert got == {i: min(max(int(np.floor((a + b) / 2 - 5)), 0), n - 1) for _, i, a, b in at}
    known = turns.withColumn("speaker", F.when(F.col("seq") % 1000 == 0, F.col("speaker")))
    began = time.time()
    assert I.fill_nearest(known).where("speaker IS NULL").count() == 0
    assert max(took, time.time() - began) < 30


def plain_greedy(v, label, limit):
    label = list(label)
    while True:
        mean = {k: np.mean([x for x, m in zip(v, label, strict=True) if m == k], axis=0) for k in sorted(set(label))}
        cos = lambda a, b: 1 - mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b])  # noqa: B023, E731
        pair = next(((a, b) for a in mean for b in mean if a < b and cos(a, b) < limit), None)
        if pair is None:
            return label
        label = [pair[0] if m == pair[1] else m for m in label]


def test_greedy_merges_against_a_plain_one(spark):
    """The first close pair by number, means anew; recordings that stop early, one cluster, windows without a vector."""
    rng = np.random.default_rng(9)
    rows, labels, want = [], [], {}
    for rec in range(12):
        v = rng.normal(size=(30, 3)) + rng.choice([0, 1, 2])
        own = rng.integers(0, 1 + rec % 9, 30).tolist()
        rows += [(rec, i, [float(x) for x in r]) for i, r in enumerate(v)] + [(rec, 99, None)]
        labels += [(rec, i, k) for i, k in enumerate(own)] + [(rec, 99, own[0])]
        done = plain_greedy(v, own, 0.3)
        want |= {(rec, i): k for i, k in enumerate(done)} | {(rec, 99): done[0]}
    got = C.greedy_merge(spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "recording_id int, win_id int, cluster long"), 0.3)
    assert {(r.recording_id, r.win_id): r.cluster for r in got.collect()} == want and len(set(want.values())) > 1
