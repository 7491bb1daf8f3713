"""Names, learning and the whole path: cases by hand and plain restatements."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from chronovox.functions.labels import collect_refusal
from chronovox.operators import attribution as A
from chronovox.operators import intervals as I
from chronovox.operators import speakers as P
from chronovox.operators import store as S
from chronovox.plans.diarize import diarize

SEG = "recording_id int, seq long, start_s double, end_s double, speaker string"
VEC = "embedding array<double>"


def unit(*x):
    v = np.array(x, float)
    return [float(c) for c in v / np.linalg.norm(v)]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- timelines and texts ------------------------------------------------------------------------------


def test_cover_timeline(spark):
    turns = spark.createDataFrame([(1, 0, 0.5, 2.0, "A"), (1, 1, 3.0, 5.0, "B"), (1, 2, 5.0005, 6.0, "A"), (1, 3, 5.5, 8.0, "B")], SEG)
    cuts = spark.createDataFrame([(1, 0, 2.2)], "recording_id int, seq long, cut double")
    got = rows(I.cover_timeline(turns, F.lit(9.0), cuts), "seq", "start_s", "end_s")
    assert got == [(0, 0.0, 2.2), (1, 2.2, 5.0), (2, 5.0005, 6.0), (3, 5.5, 9.0)]
    assert rows(I.cover_timeline(turns, F.lit(8.0)), "seq", "start_s", "end_s")[0] == (0, 0.0, 2.5)


def test_ghosts_go_to_the_nearest_or_to_nobody(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 30.0, "A"), (1, 1, 30.0, 32.0, "G"), (1, 2, 32.5, 60.0, "A"), (1, 3, 70.0, 71.0, "H"), (2, 0, 0.0, 1.0, "X"), (2, 1, 1.0, 5.0, "Y"), (2, 2, 5.0, 9.0, "Z"), (2, 3, 9.0, 13.0, "W"), (2, 4, 13.0, 16.5, "V")], SEG)
    t = t.withColumns({"alternatives": F.when(F.col("speaker") == "H", F.array(F.lit("G"), F.lit("Known"))).otherwise(F.array().cast("array<string>")), "speaker_confidence": F.lit(None).cast("double"), "uncertain": F.lit(False)})
    one = {r.seq: r.speaker for r in I.eliminate_ghosts(t, withhold=False).collect() if r.recording_id == 1}
    assert one == {0: "A", 1: "A", 2: "A", 3: "Known"}
    two = {r.speaker for r in I.eliminate_ghosts(t, withhold=False).collect() if r.recording_id == 2}
    assert "X" not in two and two <= {"Y", "Z", "W", "V", "Speaker 1"}
    closed = rows(I.eliminate_ghosts(t.where("recording_id = 1"), collapse=True), "seq", "start_s", "end_s")
    assert closed == [(0, 0.0, 30.0), (1, 30.0, 32.0), (2, 32.5, 60.0), (3, 70.0, 71.0)]  # a withheld row stays single
    joined = I.eliminate_ghosts(t.where("recording_id = 1"), withhold=False, collapse=True)
    assert rows(joined, "seq", "start_s", "end_s") == [(0, 0.0, 60.0), (3, 70.0, 71.0)]


def test_results_sum_their_tokens(spark):
    r = spark.createDataFrame(
        [(1, 0, 0.0, 1.0, "A", "One.", 3, 0.5), (1, 1, 1.5, 2.0, "A", "", 1, 0.1), (1, 2, 3.5, 4.0, "A", "two", 4, 0.2), (1, 3, 4.1, 5.0, "A", "line\n", 1, 0.0), (1, 4, 5.1, 6.0, "A", "three.", 1, 0.0), (1, 5, 6.5, 7.0, None, "x", 1, 0.0), (1, 6, 7.0, 8.0, None, "y", 1, 0.0)],
        SEG + ", text string, tokens int, inference_sec double",
    )
    got = A.merge_results(r, 3.0, 1.4).orderBy("seq").collect()
    assert [(x.seq, x.text, x.tokens, x.parts) for x in got] == [(0, "One.\n\ntwo line\nthree.", 10, 5), (5, "x", 1, 1), (6, "y", 1, 1)]
    assert abs(got[0].inference_sec - 0.8) < 1e-9


def plain_paragraphs(items, pauses, window=40, least=25):
    text, ends, pos = " ".join(t for _, t in items), [], 0
    for end, t in items:
        pos += len(t)
        ends.append((pos, end))
        pos += 1
    marks = {}
    for p in pauses:
        if len(ends) < 2:
            break
        at = min(ends[:-1], key=lambda b: abs(b[1] - p))[0]
        lo = max(0, at - window)
        region = text[lo : min(len(text), at + window)]
        stops = [lo + m.end() for m in re.finditer(r"[.!?…][\"”’)\]]?(?=\s|$)", region)]
        marks.setdefault(*((min(stops, key=lambda e: abs(e - at)), False) if stops else (at, True)))
    parts, prev = [], 0
    for i in sorted(marks):
        if i - prev < least or len(text) - i < least:
            continue
        chunk = text[prev:i].strip()
        if marks[i]:
            chunk = chunk.rstrip(",;:—–- ")
            chunk += "" if not chunk or chunk[-1] in ".!?…" else "."
        parts.append(chunk)
        prev = i
    return "\n\n".join(p for p in [*parts, text[prev:].strip()] if p)


def test_paragraph_text_against_a_plain_one(spark):
    rng = random.Random(4)
    items, pauses, want = [], [], {}
    for rec in range(25):
        t, mine = 0.0, []
        for i in range(rng.randint(1, 25)):
            t += rng.uniform(0.5, 3)
            mine.append((round(t, 2), " ".join("w" * rng.randint(1, 8) for _ in range(rng.randint(1, 9))) + rng.choice([".", ",", "", "!”", "…", " -", "?)"])))
            items.append((rec, i, round(t - 0.3, 2), round(t, 2), mine[-1][1]))
        at = sorted(round(rng.uniform(0, t + 1), 3) for _ in range(rng.randint(0, 5)))
        pauses += [(rec, p) for p in at]
        want[rec] = plain_paragraphs(mine, at)
    df = spark.createDataFrame(items, "recording_id int, seq long, start_s double, end_s double, text string")
    got = A.paragraph_text(df, spark.createDataFrame(pauses, "recording_id int, at double"))
    assert {r.recording_id: r.text for r in got.collect()} == want


def test_speaker_distances(spark):
    rng = random.Random(6)
    seg = [(r, i, a, a + rng.uniform(0.1, 4), rng.choice(["A", "B", "C", None])) for r in (1, 2) for i in range(30) for a in [rng.uniform(0, 60)]]
    who = [(1, "A"), (1, "C"), (2, "B"), (2, "nobody")]
    got = P.speaker_distances(spark.createDataFrame(seg, SEG), spark.createDataFrame(who, "recording_id int, candidate string"))
    for r in got.collect():
        own = [x for x in seg if x[0] == r.recording_id]
        mid = next((x[2] + x[3]) / 2 for x in own if x[1] == r.seq)
        d = [abs((x[2] + x[3]) / 2 - mid) for x in own if x[4] == r.candidate]
        assert (r.distance is None and not d) or abs(r.distance - min(d)) < 1e-9
    assert got.count() == 120


# -- profiles -----------------------------------------------------------------------------------------


def test_profiles_fold_and_sum(spark):
    p = spark.createDataFrame([(1, "A", 100.0, 1.0, 30.0), (1, "B", 200.0, 3.0, 10.0), (1, "C", 50.0, 1.0, 0.0)], "recording_id int, speaker string, pitch_hz double, energy_rms double, total_speech_sec double")
    m = spark.createDataFrame([(1, "B", "A"), (1, "C", "New")], "recording_id int, speaker string, into string")
    assert rows(P.merge_profile_stats(p, m, ["recording_id"]), "speaker", "pitch_hz", "energy_rms", "total_speech_sec") == [("A", 125.0, 1.5, 40.0), ("New", 50.0, 1.0, 0.0)]
    seg = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 2.0, 3.0, "A"), (1, 2, 3.0, 4.0, "OVERLAP"), (1, 3, 4.0, 5.0, None), (1, 4, 5.0, 6.0, "D")], SEG)
    assert rows(P.speaker_summary(seg, p), "speaker", "speech_sec", "segments") == [("A", 3.0, 2), ("D", 1.0, 1)]


def test_profile_speakers_by_frames(spark):
    frames = spark.createDataFrame([(1, i, 100.0 + i, 0.5, 0.9) for i in range(10)], "recording_id int, frame_idx long, pitch_hz double, rms double, speech_prob double")
    seg = spark.createDataFrame([(1, 0, 0.0, 3.0, "A"), (1, 1, 4.0, 6.0, "B"), (1, 2, 90.0, 91.0, "C")], SEG)
    got = {r.speaker: r for r in P.profile_speakers(frames, seg).collect()}
    assert (got["A"].pitch_hz, got["A"].frames, got["A"].total_speech_sec) == (101.5, 4, 3.0) and got["B"].pitch_hz == 105.0
    assert abs(got["A"].pitch_std - np.std([100, 101, 102, 103])) < 1e-9 and abs(got["A"].energy_rms - 0.5) < 1e-12 and got["C"].frames == 0


def test_register_and_refit(spark):
    s = spark.createDataFrame([(1, "A", 0.0, 2.0, [1.0, 0.0], 100.0), (1, "A", 5.0, 11.0, [0.0, 1.0], 200.0), (1, "A", 20.0, 21.0, [9.0, 9.0], 900.0), (1, "A", 30.0, 40.0, None, 1.0)], f"tenant_id int, name string, start_s double, end_s double, {VEC}, pitch_hz double")
    r = P.register(s, ["tenant_id", "name"]).first()
    assert (r.embedding, r.pitch_hz, r.total_speech_sec, r.sample_count) == ([0.25, 0.75], 175.0, 8.0, 2)
    assert P.register(s, ["tenant_id", "name"], single=True).first().embedding == [9.0, 9.0]
    snip = s.select("tenant_id", F.col("name").alias("speaker_name"), (F.col("end_s") - F.col("start_s")).alias("duration_sec"), "embedding", "pitch_hz")
    fit = S.refit_profiles(snip)
    f = fit.first()
    assert (f.sample_count, f.dropped, f.pitch_hz, f.total_speech_sec) == (2, 2, 175.0, 8.0) and np.allclose(f.embedding, unit(1, 3))
    old = spark.createDataFrame([(1, "A", [1.0, 1.0], 1.0, True, "p")], f"tenant_id int, name string, {VEC}, pitch_hz double, pending boolean, purity string")
    new = S.upsert_profiles(old, fit.drop("dropped")).first()
    assert new.pending and new.purity == "p" and new.pitch_hz == 175.0
    assert P.common_profiles(s, s.where("false"), ["name"]).count() == 0


def test_learning_summary(spark):
    one = lambda data, kind: spark.createDataFrame(data, kind)
    got = P.learning_summary(
        one([(1,), (1,)], "recording_id int"), one([(1, f"Speaker {i}", "impure_group") for i in range(12)], "recording_id int, cluster string, reason string"),
        one([(1, "A", "at_snippet_cap"), (1, "B", "not_registered"), (2, "C", "too_few_spans")], "recording_id int, speaker string, reason string"), one([(1, "uncertain"), (1, "uncertain"), (2, "overlap")], "recording_id int, reason string"), ["recording_id"],
    ).orderBy("recording_id").collect()
    assert got[0].snippets_added == 2 and len(got[0].not_learned) == 8 and [x.speaker for x in got[0].not_collected] == ["A"] and got[0].refused_reasons == {"uncertain": 2} and got[0].refused_total == 2
    assert got[1].snippets_added == 0 and got[1].not_learned is None and [x.reason for x in got[1].not_collected] == ["too_few_spans"]


def test_collecting(spark):
    """Trimmed to speech, longer clips replace shorter, ten of a recording, the cap, and why nothing was taken."""
    seg = [(0, 1, i, i * 20.0, i * 20.0 + 10.0, "Ann", 0.9 - i * 0.01) for i in range(12)] + [(0, 1, 50, 500.0, 506.0, "Ann", 0.99)]
    seg += [(0, 1, 20, 300.0, 310.0, "Bob", 0.9), (0, 1, 21, 320.0, 330.0, "Eve", 0.9), (0, 1, 22, 340.0, 350.0, "Eve", 0.9), (0, 1, 23, 360.0, 368.0, "Cap", 0.9), (0, 1, 24, 380.0, 388.0, "Cap", 0.9), (0, 1, 25, 400.0, 403.0, "Ann", 0.9), (0, 1, 26, 410.0, 420.0, "Speaker 1", 0.9)]
    df = spark.createDataFrame(seg, "tenant_id int, recording_id int, seq long, start_s double, end_s double, speaker string, speaker_confidence double").withColumns({"uncertain": F.lit(False), "speaker_margin": F.lit(None).cast("double")})
    people = spark.createDataFrame([(0, n, False) for n in ("Ann", "Bob", "Cap")], "tenant_id int, name string, pending boolean")
    old = spark.createDataFrame([(0, "Ann", 1, 0.0, 10.0, 7), (0, "Ann", 1, 20.0, 6.0, 8), (0, "Cap", 9, 0.0, 1300.0, 9)], "tenant_id int, speaker_name string, source int, start_sec double, duration_sec double, id long")
    quiet = spark.createDataFrame([(1, 0.0, 400.0), (1, 502.0, 600.0)], "recording_id int, s_start double, s_end double")
    got, told = S.collect_snippets(df, people, collect_refusal(), old, quiet)
    clips = {r.seq: r for r in got.collect()}
    assert set(clips) == set(range(1, 11)) and clips[1].replaces == 8 and clips[2].replaces is None and {r.place for r in clips.values()} == set(range(1, 11))
    why = {r.speaker_name: r for r in told.collect()}
    assert (why["Ann"].snippets, why["Ann"].added_sec, why["Ann"].over_per_file_cap, why["Ann"].too_short_after_trim, why["Ann"].skipped) == (10, 100.0, 1, 1, None)
    assert {n: why[n].skipped for n in ("Bob", "Eve", "Cap")} == {"Bob": "too_few_spans", "Eve": "not_registered", "Cap": "at_snippet_cap"}
    small, _ = S.collect_snippets(df, people, collect_refusal(), most=35.0, chunk=4.0, least=3.0)
    assert all(r.hi - r.lo <= 4.0 for r in small.collect()) and small.where("speaker_name = 'Ann'").count() == 9


def test_learning(spark):
    near, far = unit(1, 0.1), unit(-1, 1)
    spans = [(0, "V1", "s", i, i * 50.0, i * 50.0 + 40.0, near) for i in range(3)] + [(0, "V1", "s", 9, 0.4, 30.0, near), (0, "V2", "s", 10, 0.0, 20.0, near), (0, "V3", "s", 11, 0.0, 4.0, near), (0, "V3", "s", 12, 9.0, 14.0, near), (0, "V4", "s", 13, 0.0, 9.0, near), (0, "V4", "s", 14, 20.0, 29.0, far)]
    df = spark.createDataFrame(spans, f"tenant_id int, speaker_name string, source string, span_id long, start_s double, end_s double, {VEC}")
    clips, people, skipped = S.learn_profiles(df, most=85.0)
    assert rows(skipped, "speaker_name", "reason") == [("V2", "too_few_spans"), ("V3", "insufficient_speech"), ("V4", "impure_group")]
    assert rows(clips, "span_id", "lo", "hi") == [(0, 0.0, 30.0), (0, 30.0, 40.0), (1, 50.0, 80.0), (1, 80.0, 90.0), (2, 100.0, 105.0)]
    p = people.first()
    assert (p.name, p.pending, p.total_speech_sec, p.sample_count) == ("V1", True, 85.0, 5) and np.allclose(p.embedding, near)
    again, _, _ = S.learn_profiles(df.unionByName(df.withColumn("span_id", F.col("span_id") + 100)), most=85.0)
    assert again.count() == clips.count()


# -- names --------------------------------------------------------------------------------------------


def test_full_match(spark):
    people = spark.createDataFrame([(0, "Ann", unit(1, 0, 0), 0.0, 60.0), (0, "Bob", unit(0, 1, 0), 0.0, 60.0), (0, "Cy", unit(0, 0.9, 0.5), 0.0, 200.0)], f"tenant_id int, name string, {VEC}, pitch_hz double, total_speech_sec double")
    who = [(0, 1, "Speaker 1", unit(1, 0.3, 0)), (0, 1, "Speaker 2", unit(1, -0.6, 0)), (0, 1, "Speaker 3", unit(-1, -1, -1)), (0, 2, "Speaker 1", unit(1, 0.1, 0))]
    spk = spark.createDataFrame(who, f"tenant_id int, recording_id int, speaker string, {VEC}").withColumn("pitch_hz", F.lit(0.0))
    seg = spark.createDataFrame([(r, i, i * 1.0, i + 1.0, s) for i, (_, r, s, _) in enumerate(who)], SEG).withColumns({"speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(True)})
    blocked = spark.createDataFrame([(2,)], "recording_id int")
    got, mapping = P.match_known(seg, spk, people, ["tenant_id"], blocked)
    out = {r.seq: r for r in got.collect()}
    assert [out[i].speaker for i in range(4)] == ["Ann", "Ann", "Speaker 3", "Speaker 1"]
    assert out[0].speaker_confidence > 0.9 and not out[0].uncertain and out[0].speaker_margin > 0.3 and out[3].uncertain and mapping.count() == 2
    assert out[0].alternatives == [] and out[0].speaker_match_dist < 0.1


def test_second_pass(spark):
    """A voice is named by all of its speech; a second one takes the name only if it is close to the first."""
    people = spark.createDataFrame([(0, "Ann", unit(1, 0, 0, 0), 0.0, 60.0), (0, "Bob", unit(0, 1, 0, 0), 0.0, 60.0)], f"tenant_id int, name string, {VEC}, pitch_hz double, total_speech_sec double")
    voices = {"Speaker 1": unit(1, 0.5, 0, 0), "Speaker 2": unit(1, -0.6, 0.3, 0), "Speaker 3": unit(0, 0, 0, 1), "Speaker 4": unit(0, 0, 0.3, 1), "Speaker 5": unit(0, 1, 0.1, 0)}
    seg, win = [], []
    for k, (name, v) in enumerate(voices.items()):
        n = 1 if name == "Speaker 5" else 3 + (name == "Speaker 4")
        for i in range(n):
            a = k * 20.0 + i * 2
            seg.append((1, len(seg), a, a + 2.0, name))
            win.append((1, len(win), a, a + 2.0, v))
    df = spark.createDataFrame(seg, SEG).withColumns({"tenant_id": F.lit(0), "speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(False)})
    w = spark.createDataFrame(win, f"recording_id int, win_id long, start_s double, end_s double, {VEC}")
    stats = spark.createDataFrame([], "recording_id int, speaker string, pitch_hz double")
    got, into = P.second_pass(df, w, people, stats, ["tenant_id"])
    assert rows(into, "speaker", "into") == [("Speaker 1", "Ann"), ("Speaker 3", "Speaker 4")]
    # Speaker 2 is near enough to Ann, but not to her holder; Speaker 5 says too little
    assert rows(got, "speaker", "start_s", "end_s") == [("Ann", 0.0, 6.0), ("Speaker 2", 20.0, 26.0), ("Speaker 4", 40.0, 46.0), ("Speaker 4", 60.0, 68.0), ("Speaker 5", 80.0, 82.0)]
    off, none = P.second_pass(df, w, people, stats, ["tenant_id"], spark.createDataFrame([(1,)], "recording_id int"))
    assert rows(none, "speaker", "into") == [("Speaker 3", "Speaker 4")] and off.where("speaker = 'Ann'").count() == 0


def test_whole_path(spark):
    """Two people take turns of ten seconds; one is known.  A third, unknown, says little."""
    rng = np.random.default_rng(1)
    ann, eve, few = unit(1, 0, 0, 0), unit(0, 1, 0, 0), unit(0, 0, 1, 0)
    plan = [(ann, 110.0), (eve, 210.0)] * 3 + [(few, 160.0)]
    frames, win = [], []
    for rec in (1, 2):
        for i, (v, pitch) in enumerate(plan):
            n = 10 if i < 6 else 3
            for k in range(n):
                t = i * 10 + k
                frames.append((rec, t, 0.2 if k else 0.05, 0.9, pitch))
                if k < n - 1:
                    win.append((rec, len(win), len(win), float(t), t + 2.0, [float(x) for x in np.array(v) + rng.normal(0, 0.04, 4)]))
    f = spark.createDataFrame(frames, "recording_id int, frame_idx long, rms double, speech_prob double, pitch_hz double")
    w = spark.createDataFrame(win, f"recording_id int, win_id long, seq long, start_s double, end_s double, {VEC}")
    people = spark.createDataFrame([(0, "Ann", ann, 112.0, 100.0, False), (0, "Old", few, 160.0, 100.0, True)], f"tenant_id int, name string, {VEC}, pitch_hz double, total_speech_sec double, pending boolean")
    turns, who = diarize(f, w, people)
    got = turns.orderBy("recording_id", "start_s").collect()
    for rec in (1, 2):
        mine = [r for r in got if r.recording_id == rec]
        assert all(a.end_s <= b.start_s + 1e-9 for a, b in zip(mine, mine[1:], strict=False))
        at = lambda t: next((r.speaker for r in mine if r.start_s <= t < r.end_s), None)  # noqa: B023, E731
        assert [at(t) for t in (5, 25, 45)] == ["Ann"] * 3
        assert len({at(t) for t in (15, 35, 55)}) == 1 and at(15).startswith("Speaker ")
        assert at(61) is None  # a ghost's words stay, its name goes
        assert abs(next(r.end_s for r in mine if r.speaker == "Ann") - 10) <= 1.5
    assert {(r.recording_id, r.speaker) for r in who.collect() if r.speaker == "Ann"} == {(1, "Ann"), (2, "Ann")} and who.count() == 4
