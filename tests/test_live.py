"""Live recurrences: against a plain restatement on random frames, and streams against finished tables."""

import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovox.streaming import live as W

FRAMES = "session_id long, channel int, frame_idx long, rms double"


def plain_turns(levels, flush=True):
    """(first, end, reason, peak, mean) with the frames themselves kept, as a recorder would."""
    floor, ring, held, run, below, out = 0.0005, deque(maxlen=5), None, 0, 0, []

    def close(why):
        nonlocal held, run, below
        (first, frames, measured, voiced), held, run, below = held, None, 0, 0
        ring.clear()
        frames = frames[: max(1, len(frames) - 10 + 6)]
        if voiced * 32 >= 120:
            out.append((first, first + len(frames), why, max(measured), sum(measured) / len(measured)))

    for i, e in enumerate(levels):
        floor = 0.7 * floor + 0.3 * e if e < floor else 0.995 * floor + 0.005 * e
        floor = min(max(floor, 0.0005), 0.05)
        on = max(2.5 * floor, 0.0012)
        off = max(1.6 * floor, 0.0006, 0.6 * on)
        if held is None:
            ring.append((i, e))
            run = run + 1 if e >= on else 0
            if run == 2:
                onset = [x for j, x in ring if j >= i - 1]
                held, below = [ring[0][0], [x for _, x in ring], onset, sum(x >= off for x in onset)], 0
            continue
        held[1].append(e)
        held[2].append(e)
        held[3] += e >= off
        below = below + 1 if e < off else 0
        if len(held[1]) >= 937:
            close("max_turn")
        elif below >= 10:
            close("hangover")
    if held is not None and flush:
        close("flush")
    return out


def levels(seed, n=2500):
    rng, out = random.Random(seed), []
    while len(out) < n:
        loud = rng.choice([0.0, 0.0004, 0.001, 0.01, 0.05, 0.2])
        out += [loud * rng.uniform(0.5, 1.5) + rng.random() * rng.choice([1e-5, 5e-4]) for _ in range(rng.choice([1, 2, 3, 6, 12, 30, 80]))]
    return out[:n] if seed % 3 else out[: n - 1200] + [0.2 + 0.01 * rng.random() for _ in range(1200)]


def close_to(got, want):
    return len(got) == len(want) and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9) for a, b in zip(got, want, strict=True))


def test_turns_on_random_frames(spark):
    rows = [(s, 0, i, x) for s in range(12) for i, x in enumerate(levels(s))]
    got = W.detect_turns(spark.createDataFrame(rows, FRAMES)).orderBy("session_id", "first_frame").collect()
    for s in range(12):
        want = plain_turns(levels(s))
        assert want and close_to([tuple(r)[2:] for r in got if r.session_id == s], want), s
    assert {"max_turn", "hangover", "flush"} == {r.reason for r in got}


def run_stream(spark, tmp_path, df, make, parts):
    """All that a stream gives over `parts` files, one in a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, part in enumerate(parts):
        df.where(part).repartition(3).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"live_{random.getrandbits(40)}"
    q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_detector_stream(spark, tmp_path):
    rows = [(s, 0, i, x) for s in (1, 2) for i, x in enumerate(levels(s, 700))]
    df = spark.createDataFrame(rows, FRAMES).withColumn("recv_ts", F.timestamp_seconds(F.col("frame_idx") * 0.032 + 1000))
    want = sorted(tuple(r) for r in W.detect_turns(df).where("reason != 'flush'").collect())
    got = run_stream(spark, tmp_path, df, W.detect_turns_stream, ["frame_idx < 350", "frame_idx >= 350"])
    assert sorted(tuple(r) for r in got.where("reason != 'flush'").collect()) == want and want


def test_coalescer_stream_and_deadline(spark, tmp_path):
    rng, rows = random.Random(8), []
    for s in (1, 2, 3):
        t = 0.0
        for _ in range(40):
            a = t + rng.choice([0.2, 0.6, 0.95, 1.5, 4.0])
            t = a + rng.choice([0.4, 1.0, 5.0])
            rows.append((s, 0, round(a, 3), round(t, 3), t + rng.choice([0.0, 0.1, 0.9])))
    end = [(9, 0, 1e4, 1e4 + 1, 1e4)]  # a late session drives the watermark past all deadlines
    df = spark.createDataFrame(rows + end, "session_id long, channel int, start_s double, end_s double, recv double").withColumn("recv_ts", F.timestamp_micros((F.col("recv") * 1e6).cast("long")))
    batch = df.withColumn("recv_s", F.unix_micros("recv_ts") / 1e6)
    want = sorted(tuple(r) for r in W.coalesce_turns(batch).where("session_id < 9").collect())
    got = run_stream(spark, tmp_path, df.drop("recv"), W.coalesce_turns_stream, ["recv < 60 AND session_id < 9", "recv >= 60 AND session_id < 9", "session_id = 9"])
    assert sorted(tuple(r) for r in got.where("session_id < 9").collect()) == want
    # a turn that comes after the deadline does not join, however short the pause is
    late = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0), (1, 0, 1.5, 2.0, 2.5)], "session_id long, channel int, start_s double, end_s double, recv_s double")
    assert W.coalesce_turns(late).count() == 2 and W.coalesce_turns(late.drop("recv_s")).count() == 1


def test_guard_stream_and_faults(spark, tmp_path):
    rng = random.Random(9)
    rows = [(s, i, i % 2, x, x + 1.0, float(i)) for s in (1, 2) for i in range(60) for x in [i * 1.0 + rng.choice([0, 0, 0, -5.0, 40.0])]]
    df = spark.createDataFrame(rows, "session_id long, sequence long, channel int, start_s double, end_s double, elapsed_s double").withColumn("recv_ts", F.timestamp_seconds(F.col("elapsed_s") + 1000))
    whole = W.guard_timeline(df)
    want = sorted(tuple(r) for r in whole.collect())
    got = run_stream(spark, tmp_path, df, W.guard_timeline_stream, ["sequence < 30", "sequence >= 30"])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 120
    flags = [r for r in want if r[6]]
    told = {r.session_id: r for r in W.timeline_faults(whole).collect()}
    for s in (1, 2):
        assert told[s].regressions == sum(W.REGRESSION in r[6] for r in flags if r[0] == s)
        assert told[s].ahead == sum(W.AHEAD in r[6] for r in flags if r[0] == s) and len(told[s].details) == min(10, sum(r[0] == s for r in flags))


def test_guard_by_hand(spark):
    """Clamped to the channel's last end; far ahead of the session; both at once; no elapsed time."""
    rows = [(1, 0, 0, 0.0, 5.0, None), (1, 1, 0, 3.0, 6.0, None), (1, 2, 1, 30.0, 31.0, 5.0), (1, 3, 1, 12.0, 13.0, 5.0), (1, 4, 0, 4.97, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "session_id long, sequence long, channel int, start_s double, end_s double, elapsed_s double")
    got = [(r.start_s, r.end_s, r.flag) for r in W.guard_timeline(df).orderBy("sequence").collect()]
    assert got == [(0, 5, None), (5, 6, W.REGRESSION), (30, 31, W.AHEAD), (31, 13, W.REGRESSION), (6, 7, W.REGRESSION)]


# -- streams: names, late rows, counters ------------------------------------------------------------


def live_turns(spark, n=400):
    rng = np.random.default_rng(11)
    people = [(t, f"P{k}", [float(x) for x in rng.normal(size=5)], float(k % 3 * 60), 10.0, k == 4) for t in (0, 1) for k in range(5)] + [(2, "Lone", [1.0, 0.0, 0.0, 0.0, 0.0], 0.0, 5.0, False)]
    people.append((0, "Twin", [x + 0.05 for x in people[0][2]], 0.0, 10.0, False))
    rows = []
    for i in range(n):
        t = int(rng.integers(0, 4))
        near = [p for p in people if p[0] == t] or people
        v = np.array(near[int(rng.integers(0, len(near)))][2]) + rng.normal(0, rng.choice([0.02, 0.2, 1.0]), 5)
        rows.append((t, i, int(rng.integers(0, 3)), float(rng.choice([0.2, 0.5, 3.0, 30.0, 31.0])), None if i % 37 == 0 else [float(x) for x in v] if i % 41 else [], float(rng.choice([0.0, 110.0])), 1000.0 + i))
    turns = spark.createDataFrame(rows, "tenant_id int, turn_id long, channel int, duration_sec double, embedding array<double>, pitch_hz double, at double").withColumn("recv_ts", F.timestamp_seconds("at")).drop("at")
    return turns, spark.createDataFrame(people, "tenant_id int, name string, embedding array<double>, pitch_hz double, total_speech_sec double, pending boolean")


def test_names_on_a_stream_equal_those_on_a_table(spark, tmp_path):
    turns, people = live_turns(spark)
    want = sorted(map(str, W.attribute_live(turns, people, ["tenant_id"]).collect()))
    got = run_stream(spark, tmp_path, turns, lambda s: W.attribute_live(s, people, ["tenant_id"]), ["turn_id < 200", "turn_id >= 200"])
    assert sorted(map(str, got.collect())) == want and len(want) == 400
    reasons = {r.attribution_reason for r in W.attribute_live(turns, people, ["tenant_id"]).collect()}
    assert reasons == {None, "live_turn_too_short", "live_turn_too_long", "no_voiceprints", "live_match_failed", "live_match_weak", "live_match_ambiguous"}


def test_names_on_a_stream_by_shuffle_and_beyond_the_bound(spark, tmp_path, monkeypatch):
    turns, people = live_turns(spark, 60)
    want = sorted(map(str, W.attribute_live(turns, people, ["tenant_id"]).collect()))
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    got = run_stream(spark, tmp_path, turns, lambda s: W.attribute_live(s, people, ["tenant_id"]), ["turn_id < 30", "turn_id >= 30"])
    assert sorted(map(str, got.collect())) == want
    monkeypatch.setattr(W, "STREAM_BYTES", 10)
    with pytest.raises(ValueError, match="foreachBatch"):
        W.attribute_live(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), people, ["tenant_id"])


def test_live_gates_by_hand(spark):
    """The microphone needs no vector, but a proper length; a lone profile is infinitely far ahead."""
    people = spark.createDataFrame([(0, "Ann", [1.0, 0.0], 0.0, 5.0, False)], "t int, name string, embedding array<double>, pitch_hz double, total_speech_sec double, pending boolean")
    rows = [(0, 1, 0, 0.2, None), (0, 2, 0, 1.0, None), (0, 3, 1, 1.0, [1.0, 0.1]), (0, 4, 1, 1.0, [0.0, 1.0]), (7, 5, 1, 1.0, [1.0, 0.0]), (0, 6, 1, None, [1.0, 0.0])]
    got = {r.turn_id: r for r in W.attribute_live(spark.createDataFrame(rows, "t int, turn_id int, channel int, duration_sec double, embedding array<double>").withColumn("pitch_hz", F.lit(None).cast("double")), people, ["t"]).collect()}
    assert (got[1].attribution_reason, got[6].attribution_reason, got[5].attribution_reason) == ("live_turn_too_short", "live_turn_too_short", "no_voiceprints")
    assert (got[2].speaker, got[2].speaker_source, got[2].speaker_confidence) == ("You", "input_device", 1.0)
    assert got[3].speaker == "Ann" and got[3].speaker_margin == float("inf") and not got[3].uncertain
    assert got[4].attribution_reason == "live_match_weak" and got[4].speaker_match_dist == 0.9 and got[4].speaker is None


def split_stream(spark, tmp_path, df, make, parts):
    """(results, rejects) of a stream, each micro-batch one part."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put = lambda name: lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / name / str(n)))
    q = W.write_split(make(source), put("good"), put("late"), str(tmp_path / "cp"))
    q.awaitTermination()
    read = lambda name: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / name)).collect()
    return read("good"), read("late"), q


def test_late_frames_are_in_the_rejects_and_nowhere_else(spark, tmp_path):
    """Frames of a whole turn that come long after the watermark has passed them leave as they are."""
    loud = [(1, 0, i, 0.2 if 20 <= i < 60 else 0.0) for i in range(200)]
    late = [(1, 0, i, 0.2) for i in range(5, 15)]
    new = [(1, 0, i, 0.0) for i in range(200, 220)]
    at = lambda rows, t: spark.createDataFrame(rows, FRAMES).withColumn("recv_ts", F.timestamp_seconds(F.lit(t)))
    df = at(loud, 1000).unionByName(at(loud[:1], 1100).withColumn("session_id", F.lit(2).cast("long"))).unionByName(at(late, 1001)).unionByName(at(new, 1200))
    df = df.withColumn("part", F.when(F.unix_seconds("recv_ts") == 1001, 2).when(F.unix_seconds("recv_ts") == 1100, 1).when(F.unix_seconds("recv_ts") == 1200, 3).otherwise(0))
    good, gone, _ = split_stream(spark, tmp_path, df, lambda s: W.detect_turns_stream(s.drop("part"), rejects=True), ["part = 0", "part = 1", "part = 2", "part = 3"])
    want = [tuple(r) for r in W.detect_turns(at(loud + new, 0).drop("recv_ts")).collect()]
    assert [tuple(r) for r in good] == want and len(want) == 1
    told = sorted(json.loads(r.rejected)["frame_idx"] for r in gone)
    assert told == list(range(5, 15)) and {(r.session_id, r.channel, r.first_frame) for r in gone} == {(1, 0, None)}


def test_late_turns_of_the_coalescer_and_the_guard(spark, tmp_path):
    rows = [(1, 0, 0, 0.0, 1.0, 1.0, 1000), (2, 1, 0, 0.0, 1.0, 1.0, 5000), (1, 2, 0, 1.2, 2.0, 2.0, 1001), (1, 3, 0, 9000.0, 9001.0, 9001.0, 5001)]
    df = spark.createDataFrame(rows, "session_id long, sequence long, channel int, start_s double, end_s double, elapsed_s double, at long").withColumn("recv_ts", F.timestamp_seconds("at"))
    parts = ["at = 1000", "at = 5000", "at = 1001", "at = 5001"]
    good, gone, _ = split_stream(spark, tmp_path / "a", df, lambda s: W.coalesce_turns_stream(s.drop("at", "sequence", "elapsed_s"), rejects=True), parts)
    assert (1, 0, 0.0, 1.0, 1) in [tuple(r) for r in good] and all(r.end_s != 2.0 for r in good)
    assert [json.loads(r.rejected)["end_s"] for r in gone] == [2.0]
    good, gone, _ = split_stream(spark, tmp_path / "b", df, lambda s: W.guard_timeline_stream(s.drop("at"), rejects=True), parts)
    assert sorted(r.sequence for r in good) == [0, 1, 3] and [json.loads(r.rejected)["sequence"] for r in gone] == [2]


def test_session_counters_come_once_and_leave_no_state(spark, tmp_path):
    rng = random.Random(14)
    rows = [(s, rng.randint(0, 2), *x, rng.choice(["turn", "non_speech", "malformed", None]), 1000 + 10 * i) for s in range(12) for i in range(rng.randint(1, 30)) for x in [(None, None) if rng.random() < 0.1 else (float(i), i + rng.random())]]
    end = [(99, 0, 0.0, 1.0, "turn", 10**6), (99, 0, 0.0, 1.0, "turn", 3 * 10**6)]
    df = spark.createDataFrame(rows + end, "session_id long, channel int, start_s double, end_s double, kind string, at long").withColumn("recv_ts", F.timestamp_seconds("at"))
    want = {r.session_id: r for r in W.session_stats(df.where("session_id < 99")).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    good, gone, q = split_stream(spark, tmp_path, df, lambda s: W.session_stats_stream(s.drop("at"), rejects=True), ["session_id < 99 AND at < 1100", "session_id < 99 AND at >= 1100", "at = 1000000", "at = 3000000"])
    got = {r.session_id: r for r in good if r.session_id < 99}
    assert set(got) == set(want) and not gone and sum(r.session_id < 99 for r in good) == 12
    for s, r in want.items():
        assert tuple(got[s])[:6] == tuple(r)[:6] and (got[s].covered_sec or 0) == pytest.approx(r.covered_sec or 0) and got[s].reached_sec == r.reached_sec
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the last session's counters, time and timer
