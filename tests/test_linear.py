"""Rules that go through a sequence: against plain restatements on random input, and long input in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chronovox.functions import text as X
from chronovox.operators import intervals as I

SEG = "recording_id int, seq long, start_s double, end_s double, speaker string"


# -- islands ----------------------------------------------------------------------------------------


def plain_islands(rows, least):
    rows, changed = [list(r) for r in sorted(rows, key=lambda r: (r[1], r[0]))], True
    while changed:
        changed = False
        for i in range(1, len(rows) - 1):
            name, side = rows[i][3], rows[i - 1][3]
            if name != "OVERLAP" and rows[i][2] - rows[i][1] < least and side == rows[i + 1][3] and name != side:
                rows[i][3], changed = side, True
        if changed:
            kept = rows[:1]
            for r in rows[1:]:
                if r[3] == kept[-1][3] and r[1] - kept[-1][2] <= 1.0:
                    kept[-1][2] = max(kept[-1][2], r[2])
                else:
                    kept.append(r)
            rows = kept
    return [tuple(r) for r in rows]


def test_islands_on_random_recordings(spark):
    rng, data = random.Random(1), {}
    for rec in range(120):
        t, rows = 0.0, []
        for i in range(rng.randint(1, 40)):
            t += rng.choice([0.0, 0.1, 0.5, 1.5])
            end = t + rng.choice([0.2, 0.4, 0.9, 1.0, 2.0])
            rows.append((i, round(t, 3), round(end, 3), rng.choice(["A", "B", "A", "B", "C", "OVERLAP", None])))
            t = end - rng.choice([0.0, 0.0, 0.3])
        data[rec] = rows
    df = spark.createDataFrame([(rec, *r) for rec, rows in data.items() for r in rows], SEG)
    out = I.absorb_islands(df)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.recording_id, []).append(tuple(r)[1:])
    for rec, rows in data.items():
        assert sorted(got[rec], key=str) == sorted(plain_islands(rows, 1.0), key=str), rec


def test_a_recording_is_cut_between_fixed_neighbours(spark):
    """Long segments of turns in turn: stretches stay short, however long the recording."""
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("recording_id"), F.col("id").alias("seq"), (F.col("id") * 2.0).alias("start_s"), (F.col("id") * 2.0 + F.when(F.col("id") % 10 == 5, 0.5).otherwise(1.5)).alias("end_s"), F.when(F.col("id") % 10 == 5, "C").when(F.col("id") % 10 == 6, "A").otherwise(F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int"))).alias("speaker"))
    began = time.time()
    got = I.absorb_islands(df)
    assert got.where("speaker = 'C'").count() == 0 and got.count() == n - n // 10
    assert time.time() - began < 30


# -- long turns -------------------------------------------------------------------------------------


def plain_pieces(start, end, most):
    out, todo = [], [(0, len(start) - 1)]
    while todo:
        lo, hi = todo.pop()
        if lo == hi or end[hi] - start[lo] <= most:
            out.append((lo + 1, hi + 1))
            continue
        gaps = [start[i + 1] - end[i] for i in range(lo, hi)]
        cut = lo + gaps.index(max(gaps)) if max(gaps) > 0 else lo
        todo += [(cut + 1, hi), (lo, cut)]
    return out


def test_pieces_on_random_turns(spark):
    rng = random.Random(2)
    turns, want = [], {}
    for rec in range(80):
        t, kids = 0.0, []
        for i in range(rng.randint(1, 30)):
            t += rng.choice([-0.5, 0.0, 0.0, 0.25, 0.5, 0.5, 1.0])
            kids.append((t, i, t + rng.choice([0.5, 4.0, 9.0])))
            t = kids[-1][2]
        most = 20.0
        want[rec] = plain_pieces([k[0] for k in kids], [k[2] for k in kids], most) if kids[-1][2] - kids[0][0] > most else [(1, len(kids))]
        turns.append((rec, kids[0][0], kids[-1][2], "A", [{"start_s": k[0], "seq": k[1], "end_s": k[2]} for k in kids]))
    df = spark.createDataFrame(turns, "recording_id int, start_s double, end_s double, speaker string, children array<struct<start_s: double, seq: long, end_s: double>>")
    got = {}
    for r in I.split_long_turns(df, 20.0).collect():
        got.setdefault(r.recording_id, []).append((r.seq + 1, r.seq + r.parts))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("gap", ["rising", "falling", "same", "none"])
def test_a_turn_of_many_children_in_linear_time(gap):
    n = 20_000
    step = {"rising": lambda i: i * 1e-4, "falling": lambda i: (n - i) * 1e-4, "same": lambda i: 0.5, "none": lambda i: 0.0}[gap]
    start, end, t = [], [], 0.0
    for i in range(n):
        start.append(t)
        end.append(t + 1.0)
        t += 1.0 + step(i)
    import numpy as np

    began = time.time()
    got = I.cut_pieces(np.array(start), np.array(end), 0.5)
    assert got == [(i, i) for i in range(1, n + 1)] and time.time() - began < 2
    small = I.cut_pieces(np.array(start[:200]), np.array(end[:200]), 15.0)
    assert small == plain_pieces(start[:200], end[:200], 15.0)


# -- repeats ----------------------------------------------------------------------------------------


def plain_cut(t):
    """Search, cut, mark, again from the beginning, with a pattern that tries every place."""
    pattern = re.compile(r"(.{4,120}?)(?:\1){2,}", re.S)
    if len(t) < 12:
        return t
    while True:
        m = pattern.search(t)
        if m is None:
            return t
        unit, a, b = m[1], m.start(), m.end()
        for k in range(len(unit) - 1, 3, -1):
            if t.endswith(unit[-k:], 0, a):
                a -= k
                break
        for k in range(len(unit) - 1, 3, -1):
            if t.startswith(unit[:k], b):
                b += k
                break
        t = re.sub(r"\[inaudible\](?:\s*\[inaudible\])+", X.MARK, f"{t[:a].rstrip()} {X.MARK} {t[b:].lstrip()}".strip())


def noisy(rng):
    out = []
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        unit = "".join(rng.choice("ab c") for _ in range(rng.randint(1, rng.choice([6, 30, 130]))))
        out.append(unit * rng.choice([1, 2, 3, 4, 9]) + unit[: rng.randint(0, len(unit))] if kind < 0.6 else rng.choice([X.MARK, f"{X.MARK} {X.MARK}", "  \n", "the end. ", "xyz" * rng.randint(1, 40), "déjà 日本 "]))
    return "".join(out)


def test_repeats_on_random_strings():
    rng = random.Random(3)
    for i in range(700):
        t = noisy(rng)
        assert X.cut_repeats(t) == plain_cut(t), (i, t)


@pytest.mark.parametrize("window", [40, 100])
def test_repeats_across_windows(monkeypatch, window):
    monkeypatch.setattr(X, "_WINDOW", window)
    rng = random.Random(4)
    for i in range(100):
        t = noisy(rng) + "".join(rng.choice("abcdefg ") for _ in range(300)) + noisy(rng)
        assert X.cut_repeats(t) == plain_cut(t), (i, t)


def test_a_megabyte_in_a_second(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    t = " ".join(word() for _ in range(180_000))[: 1 << 20]
    X.cut_repeats(t[:20_000])
    began = time.time()
    assert X.cut_repeats(t) == t
    assert time.time() - began < 2.5
    assert X.cut_repeats("a" * (1 << 20)) == X.MARK
    rows = [(1, None), (2, ""), (3, "short"), (4, "na na na na"), (5, "I say so so. " * 6)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    rng = random.Random(6)
    many = [noisy(rng) for _ in range(400)] + ["", "ab", "x" * 11, "y" * 12]
    found = {r.i: r.c for r in spark.createDataFrame(list(enumerate(many)), "i int, t string").coalesce(2).select("i", X._cut_repeats("t").alias("c")).collect()}
    assert all(found[i] == plain_cut(t) for i, t in enumerate(many))
    assert got[1] is None and got[2] == "" and got[3] == "short" and got[4] == "na" and got[5] == X.MARK
