"""Literal cases, and sequential rules against plain restatements on seeded random input."""

import random

import pytest
from pyspark.sql import functions as F

from chronovox.functions import text as X
from chronovox.functions import vectors as V
from chronovox.operators import attribution as A
from chronovox.operators import boundary as B
from chronovox.operators import clustering as C
from chronovox.operators import identity as N
from chronovox.operators import intervals as I
from chronovox.operators import store as S
from chronovox.streaming import live as W

SEG = "recording_id long, seq long, start_s double, end_s double, speaker string, speaker_confidence double, uncertain boolean, text string"


def segs(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), s, 0.9, False, f"w{i}") for i, (a, b, s) in enumerate(rows)], SEG)


TURNS = [(0, 10, "Speaker 1"), (10, 20, "Speaker 2")]


@pytest.mark.parametrize("t,own", [(-5, 0), (5, 0), (15, 1), (999, 1)])
def test_asof_clamps(spark, t, own):
    items = segs(spark, [(t, t, None)])
    assert I.asof_turn(items, segs(spark, TURNS)).select("turn.seq").collect()[0][0] == own


def test_asof_without_turns(spark):
    assert I.asof_turn(segs(spark, [(1, 2, None)]), segs(spark, TURNS).where("false")).select("turn").collect()[0][0] is None


def test_gap_goes_to_the_nearer(spark):
    got = I.speaker_for_span(segs(spark, [(4.5, 4.5, None), (5.5, 5.5, None)]), segs(spark, [(0, 4, "a"), (6, 10, "b")]))
    assert [r.speaker for r in got.orderBy("seq").collect()] == ["a", "b"]


def test_attribution_reasons(spark):
    got = A.attribute_spans(segs(spark, [(1, 5, None), (9.7, 10.6, None)]), segs(spark, TURNS)).orderBy("seq").collect()
    assert (got[0].speaker, got[0].reason, got[0].confidence) == ("Speaker 1", None, 0.9)
    assert got[1].speaker == "Speaker 2"
    none = A.attribute_spans(segs(spark, [(1, 5, None)]), segs(spark, TURNS).where("false")).collect()[0]
    assert (none.speaker, none.confidence, none.reason) == (None, 0.0, "no_turns")


def test_unknown_speakers_never_merge(spark):
    got = I.to_turns(segs(spark, [(0, 1, None), (1, 2, None), (2, 3, "a"), (3.5, 4, "a")])).orderBy("seq").collect()
    assert [(r.start_s, r.end_s, r.speaker) for r in got] == [(0, 1, None), (1, 2, None), (2, 4, "a")]


def test_split_long_turns_at_the_largest_gap(spark):
    rows = [(0, 50, "a"), (50.5, 90, "a"), (93, 130, "a"), (130, 170, "a")]
    got = I.split_long_turns(I.to_turns(segs(spark, rows), 5.0), 120.0).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(0, 90), (93, 170)]


def test_absorb_islands(spark):
    got = I.absorb_islands(segs(spark, [(0, 5, "a"), (5, 5.5, "b"), (5.5, 9, "a"), (9, 9.5, "OVERLAP"), (9.5, 12, "a")])).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.speaker) for r in got] == [(0, 9, "a"), (9, 9.5, "OVERLAP"), (9.5, 12, "a")]


def test_text_survives_suppression(spark):
    rows = segs(spark, [(0, 20, "a"), (20, 21, "b")])
    got = I.absorb_minority(rows).orderBy("seq").collect()
    assert [(r.speaker, r.original_speaker, r.text) for r in got] == [("a", None, "w0"), (None, "b", "w1")]


def test_resolve_overlaps_against_a_loop(spark):
    rng = random.Random(3)
    rows = sorted((round(rng.uniform(0, 30), 2), round(rng.uniform(0.1, 6), 2)) for _ in range(25))
    rows = [(a, a + d, f"s{i % 3}") for i, (a, d) in enumerate(rows)]
    done = []
    for a, b, s in rows:
        if done and a < done[-1][1]:
            p = done.pop()
            mid = (a + p[1]) / 2
            done += [x for x in ((p[0], mid, p[2]), (mid, b, s)) if x[1] > x[0]]
        elif b > a:
            done.append((a, b, s))
    got = [(r.start_s, r.end_s, r.speaker) for r in I.resolve_overlaps(segs(spark, rows)).orderBy("start_s", "seq").collect()]
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in sorted(done)]


def test_best_split_against_all_cuts(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(60):
        n = rng.randint(1, 7)
        o = [rng.randint(0, 1) for _ in range(n)]
        w = [round(rng.uniform(0.001, 1), 3) for _ in range(n)]
        rows += [(g, i, o[i], w[i]) for i in range(n)]
        cost = [sum(w[i] for i in range(k) if o[i]) + sum(w[i] for i in range(k, n) if not o[i]) for k in range(n + 1)]
        want[g] = min(range(n + 1), key=lambda k: (round(cost[k], 12), k))
    got = B.best_split(spark.createDataFrame(rows, "g int, pos int, owner int, weight double"), ["g"]).collect()
    assert {r.g: r.k for r in got} == want


def test_average_linkage_against_one_merge_at_a_time(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(24, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        d = {(i, j): 1 - v[a].sum(0) @ v[b].sum(0) / len(a) / len(b) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        (i, j), x = min(d.items(), key=lambda kv: kv[1])
        if x >= 0.6:
            break
        groups[i] += groups.pop(j)
    want = {k: min(g) for g in groups for k in g}
    df = spark.createDataFrame([(1, i, [float(x) for x in r]) for i, r in enumerate(v)], "recording_id int, win_id int, embedding array<double>")
    assert {r.win_id: r.cluster for r in C.agglomerate(df, 0.6).collect()} == want


def test_one_name_for_one_speaker(spark):
    c = spark.createDataFrame([(1, "S1", "P", 0.1, 0.1, 0.8, True), (1, "S2", "P", 0.2, 0.2, 0.6, True)], "recording_id int, speaker string, name string, distance double, emb_dist double, confidence double, clear boolean")
    far = spark.createDataFrame([], "recording_id int, a string, b string")
    assert [(r.speaker, r.name) for r in N.claim_names(c, ["recording_id"], far).collect()] == [("S1", "P")]
    near = spark.createDataFrame([(1, "S1", "S2")], "recording_id int, a string, b string")
    assert len(N.claim_names(c, ["recording_id"], near).collect()) == 2


def test_tenants_stay_apart(spark):
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (1, "c", [1.0, 0.01])], "tenant_id int, name string, embedding array<double>")
    assert [(r.a, r.b) for r in N.near_duplicate_profiles(p, ["tenant_id"]).collect()] == [("a", "c")]


def test_upsert_keeps_pending(spark):
    old = spark.createDataFrame([(1, "a", True, 1.0)], "tenant_id int, name string, pending boolean, total_speech_sec double")
    new = spark.createDataFrame([(1, "a", None, 2.0), (1, "b", None, 3.0)], old.schema)
    assert {(r.name, r.pending, r.total_speech_sec) for r in S.upsert_profiles(old, new).collect()} == {("a", True, 2.0), ("b", False, 3.0)}


def test_source_budget(spark):
    rows = [(1, "a", i, 6.0 + i, "f1", float(i)) for i in range(12)] + [(1, "a", 20, 2.0, "f1", 0.0), (1, "a", 21, 9.0, None, 0.0)]
    plan = S.plan_source_trim(spark.createDataFrame(rows, "tenant_id int, speaker_name string, id int, duration_sec double, source string, start_sec double")).collect()
    assert {(r.id, r.reason) for r in plan} == {(20, "too_short"), (0, "over_per_file_cap"), (1, "over_per_file_cap")}


def test_turn_detector(spark):
    frames = [0.0] * 16 + [0.2] * 31 + [0.0] * 16
    df = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(frames)], "session_id long, channel int, frame_idx long, rms double")
    got = W.detect_turns(df).collect()
    assert len(got) == 1 and got[0].reason == "hangover" and (got[0].end_frame - got[0].first_frame) * 0.032 >= 0.9


def test_coalescer_holds_and_releases(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 0, 2.5, 4.0), (1, 0, 8.0, 9.0), (1, 0, 9.5, 24.0)], "session_id long, channel int, start_s double, end_s double")
    assert sorted((r.start_s, r.end_s, r.parts) for r in W.coalesce_turns(df).collect()) == [(0, 4, 2), (8, 9, 1), (9.5, 24, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, 0, i, (0.2 if (i // 25) % 2 else 0.0) + rng.random() * 1e-4, i) for s in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "session_id long, channel int, frame_idx long, rms double, t long").withColumn("recv_ts", F.timestamp_seconds("t"))
    want = sorted(tuple(r) for r in W.detect_turns(df).where("reason = 'hangover'").collect())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = W.detect_turns_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("turns_live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("turns_live").where("reason = 'hangover'").collect())
    assert got == want


def test_text_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.clean_text(F.lit("so the the end"))) == "so the end"
    assert one(X.clean_text(F.lit("start " + "one two three " * 5 + "end"))).count("[inaudible]") == 1
    assert one(X.tokens_contain(F.lit("Speaker 10"), F.lit("Speaker 1"))) is False
    assert one(X.normalise_name(F.lit("Ａlice  SMITH"))) == "alice smith"
    assert one(X.parse_time(F.lit("1:02:03.5"))) == 3723.5
    assert one(V.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0


def test_g1_clusters_whole_recordings(spark):
    """Against plain average linkage, one merge at a time, over all windows of each recording."""
    import numpy as np

    from chronovox.plans import registry
    from chronovox.plans.derived import frame

    sf, limit = "/root/testdata/sf0.001", 0.75
    by = {}
    for r in frame(spark, sf, "windows").select("recording_id", "win_id", "embedding").collect():
        by.setdefault(r.recording_id, {})[r.win_id] = np.array(r.embedding) / np.linalg.norm(r.embedding)
    want = set()
    for k, v in by.items():
        c = {i: (x, 1, [i]) for i, x in v.items()}
        while True:
            ids = sorted(c)
            d, a, b = min(((round(1 - c[a][0] @ c[b][0] / (c[a][1] * c[b][1]), 12), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]), default=(9, 0, 0))
            if d >= limit:
                break
            (x, n, m), (y, o, l) = c[a], c.pop(b)
            c[a] = (x + y, n + o, m + l)
        want |= {(k, i, j) for j, (_, _, m) in c.items() for i in m}
    got = {(r.recording_id, r.win_id, r.cluster) for r in registry.QUERIES["g1_agglomerate"](spark, sf).collect()}
    assert got == want


def test_whole_tables_of_b11_and_d9(spark):
    from chronovox.plans import registry
    from chronovox.plans.derived import frame

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in frame(spark, sf, "profiles").collect():
        k = r.c_custkey
        want[k] = max(0.9 * (k % 100) / 128 + 0.1 * (min(abs(r.pitch_hz - 130) / 50, 1) if r.pitch_hz > 100 else 0) - (0.05 if k % 2 == 0 else 0), 0)
    got = {r.c_custkey: r.distance for r in registry.QUERIES["b11_match_distance_all"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - d) <= 0.5e-4 + 1e-12 for k, d in want.items())
    rows = registry.QUERIES["d9_cluster_balance_all"](spark, sf).collect()
    assert sum(r.size for r in rows) == frame(spark, sf, "windows").count() and {r.naming_block is None for r in rows} == {True, False}


def test_speaker_refs_meets_all_profiles(spark):
    """c15 hands over every profile; the upper labels' are under names that no speaker has."""
    from chronovox.plans import queries_identity as Q
    from chronovox.plans import registry

    seen, real = [], N.speaker_refs
    N.speaker_refs = lambda turns, profiles, windows: seen.append(profiles) or real(turns, profiles, windows)
    try:
        out = registry.QUERIES["c15_speaker_refs"](spark, "/root/testdata/sf0.001").collect()
    finally:
        N.speaker_refs = real
    assert Q.N is N and seen[0].count() == seen[0].select("label").distinct().count() > 5
    assert all(r.stored == (int(r.speaker[1:]) < 5) for r in out)


def test_halves_of_weighted_confidence(spark):
    """Means that are exactly a half go to the even number, whatever the last bits of their sums."""
    rng = random.Random(11)
    rows, want = [], {}
    while len(want) < 40:
        own = [(rng.randint(0, 20), rng.randint(1, 9)) for _ in range(rng.randint(2, 5))]
        top, size = sum(5 * c * w for c, w in own), sum(w for _, w in own)
        if 2 * top % (2 * size) == size:
            key = len(want)
            at = rng.uniform(0, 1000)
            rows += [(key, at, at + w / 10, c / 20) for c, w in own]
            want[key] = top // size + top // size % 2
    df = spark.createDataFrame(rows, "recording_id int, start_s double, end_s double, confidence double")
    assert {r.recording_id: r.confidence_pct for r in A.weighted_confidence(df, ["recording_id"]).collect()} == want


def test_sliding_windows_in_microseconds(spark):
    """Remainders of exactly the least length, ends that a window just reaches, by whole numbers; any length."""
    rng = random.Random(12)
    rows = [(i, rng.randrange(10**9), n) for i, n in enumerate([0, 10**5, 2 * 10**6, 400 * 10**6] + [10**5 * rng.randint(1, 200) + rng.choice([-1, 0, 0, 1]) for _ in range(200)])]
    want = []
    for i, lo, n in rows:
        for k in range(400):
            a, b = k * 1200000, min(k * 1200000 + 2000000, n)
            if k == 0 or b - a > 100000 and a + 800000 < n:
                want.append((i, (lo + a) / 1e6, (lo + b) / 1e6))
    df = spark.createDataFrame([(i, lo / 1e6, (lo + n) / 1e6) for i, lo, n in rows], "recording_id int, start_s double, end_s double")
    got = sorted((r.recording_id, r.w_start, r.w_end) for r in I.sliding_windows(df).collect())
    assert got == want


def test_batches_of_whole_texts(spark):
    """Texts come to Python in batches that don't grow with a partition; smaller ones stay as they are."""
    rows, key = [(i, "x" * 10) for i in range(1300)], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, most in (("10000", 500), ("0", 500), ("70", 70)):
            spark.conf.set(key, given)
            df = X.of_whole_texts(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1))
            sizes = [r.n for r in df.mapInPandas(lambda it: (f.assign(n=len(f))[["n"]].head(1) for f in it), "n int").collect()]
            assert sum(sizes) == 1300 and max(sizes) == most
    finally:
        spark.conf.set(key, before)
