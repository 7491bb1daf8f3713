"""Matching with packed profiles: top k, full matching and ghosts against plain restatements; hot tenants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovox.operators import identity as N
from chronovox.operators import intervals as I
from chronovox.operators import nearest as X
from chronovox.operators import speakers as P
from chronovox.thresholds import DEFAULTS as TH

VEC = "embedding array<double>"
SEG = "recording_id int, seq long, start_s double, end_s double, speaker string"


def half_even(x, n):
    return float(np.round(x, n))  # numpy rounds half to even, as bround does


def entries(v, pitch, people):
    """(distance, name, confidence, trained) of every profile, nearest first."""
    out = []
    for name, w, hz, sec in people:
        a, b = np.linalg.norm(v), np.linalg.norm(w)
        emb = 1 - float(np.dot(v, w)) / (a * b) if a > 1e-8 and b > 1e-8 else 1.0
        p = min(abs(pitch - hz) / 50, 1.0) if pitch > 0 and hz > 0 else 0.0
        d = half_even(max(0.9 * emb + 0.1 * p, 0.0), 4)
        out.append((d, name, half_even(max(0.0, 1 - d / 0.5), 4), sec))
    return sorted(out)


def is_clear(e):
    return len(e) < 2 or e[1][0] - e[0][0] >= TH.clear_gap or (e[0][3] > 2 * e[1][3] and e[0][0] < TH.embed_only)


def plain_match(segments, voices, people):
    """What each segment is called, its confidence and alternatives; one rule after the other, in place."""
    rows = [dict(s, conf=None, alt=[]) for s in segments]
    order = list(dict.fromkeys(r["speaker"] for r in sorted(rows, key=lambda r: (r["start"], r["seq"])) if r["speaker"] in voices))
    found = {s: entries(*voices[s], people) for s in order}
    sure = {}
    for s in order:
        e = found[s]
        if e and e[0][0] <= TH.accept and is_clear(e):
            for r in rows:
                if r["speaker"] == s:
                    r["speaker"], r["conf"] = e[0][1], half_even(e[0][2], 3)
            sure[e[0][1]] = e[0][2]
            alt = [x[1] for x in e[1:4] if x[2] >= TH.min_alternative]
            for r in rows:
                if alt and r["speaker"] == e[0][1]:
                    r["alt"] = alt
    by_name = {}
    for s in order:
        if found[s] and found[s][0][0] <= TH.accept:
            by_name.setdefault(found[s][0][1], []).append(s)
    for name, who in by_name.items():
        for s in who[1:]:
            for r in rows:
                if r["speaker"] == s:
                    r["speaker"], r["conf"] = name, half_even(sure[name], 3) if name in sure else None
    gone = set()
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a in gone or b in gone:
                continue
            da, db = ({x[1]: x[0] for x in found[s]} for s in (a, b))
            if len(da) >= 3 and max(abs(da[n] - db[n]) for n in da) < 0.05:
                gone.add(b)
                for r in rows:
                    if r["speaker"] == b:
                        r["speaker"] = a
    return [(r["seq"], r["speaker"], r["conf"], r["alt"]) for r in rows]


def frames(spark, segs, voices, people):
    """segs, voices: {recording: ...}; recordings of tenant number % 2; people: {tenant: ...}."""
    s = spark.createDataFrame([(rec, r["seq"], r["start"], r["start"] + r["len"], r["speaker"]) for rec, rows in segs.items() for r in rows], SEG)
    s = s.withColumns({"speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(True)})
    v = spark.createDataFrame([(rec % 2, rec, n, [float(x) for x in e], float(p)) for rec, all_ in voices.items() for n, (e, p) in all_.items()], f"tenant_id int, recording_id int, speaker string, {VEC}, pitch_hz double")
    p = spark.createDataFrame([(t, n, [float(x) for x in e], float(hz), float(sec)) for t, all_ in people.items() for n, e, hz, sec in all_], f"tenant_id int, name string, {VEC}, pitch_hz double, total_speech_sec double")
    return s, v, p


@pytest.mark.parametrize("block", [2, 128])
def test_full_match_on_random_recordings(spark, monkeypatch, block):
    """Clear winners, shared names, nameless twins, alternatives: as a plain restatement says, in one block or many."""
    rng = np.random.default_rng(block)
    pick = random.Random(block)
    base = {t: [(f"P{k}", rng.normal(size=4), pick.choice([0, 100, 140]), pick.choice([10, 30, 100])) for k in range(5 + 2 * t)] for t in (0, 1)}
    segs, voices = {}, {}
    for rec in range(30):
        own = {}
        for k in range(pick.randint(2, 6)):
            near = pick.choice(base[rec % 2])[1]
            twin = pick.choice(list(own.values()))[0] if own and pick.random() < 0.4 else None
            v = twin + rng.normal(0, 0.03, 4) if twin is not None else near + rng.normal(0, pick.choice([0.05, 0.4, 0.8, 3.0]), 4)
            own[f"Speaker {k + 1}"] = (v, pick.choice([0, 100, 130]))
        voices[rec] = own
        names = [pick.choice([*own, "Speaker 99"]) for _ in range(12)]
        segs[rec] = [{"seq": i, "start": 2.0 * i, "len": 1.0, "speaker": n} for i, n in enumerate(names)]
    monkeypatch.setattr(P, "packed_profiles", lambda p, keys: X.packed_profiles(p, keys, block))
    s, v, p = frames(spark, segs, voices, base)
    got, _ = P.match_known(s, v, p, ["tenant_id"])
    out = {}
    for r in got.collect():
        out.setdefault(r.recording_id, []).append((r.seq, r.speaker, r.speaker_confidence, r.alternatives))
    named = 0
    for rec in segs:
        want = plain_match(segs[rec], voices[rec], base[rec % 2])
        assert sorted(out[rec]) == sorted(want), rec
        named += sum(x[1].startswith("P") for x in want)
    assert named > 50


def test_ghosts_get_no_name_without_evidence(spark):
    """A short voice nearest to Ann, but no clear winner, is not called by the second nearest's name."""
    people = {0: [("Ann", [1, 0, 0], 0, 60), ("Ben", [1, 0.12, 0], 0, 60), ("Cy", [0, 0, 1], 0, 60)]}
    voices = {0: {"Speaker 1": ([1, 0.05, 0], 0), "Speaker 2": ([0, 0.1, 1], 0)}}
    segs = {0: [{"seq": 0, "start": 0.0, "len": 2.0, "speaker": "Speaker 1"}, {"seq": 1, "start": 5.0, "len": 40.0, "speaker": "Speaker 2"}]}
    s, v, p = frames(spark, segs, voices, people)
    got, mapping = P.match_known(s, v, p, ["tenant_id"])
    rows = {r.seq: r for r in got.collect()}
    assert rows[0].speaker == "Speaker 1" and rows[0].alternatives == [] and rows[1].speaker == "Cy"
    assert [(r.old_name, r.new_name) for r in mapping.collect()] == [("Speaker 2", "Cy")]
    names = {r.seq: r.speaker for r in I.eliminate_ghosts(got).collect()}
    assert names[0] is None and names[1] == "Cy"


def test_named_ghost_goes_to_its_alternative(spark):
    people = {0: [("Ann", [1, 0, 0], 0, 60), ("Ben", [1, 0.5, 0], 0, 60)]}
    voices = {0: {"Speaker 1": ([1, 0, 0], 0), "Speaker 2": ([1, 0.6, 0], 0)}}
    segs = {0: [{"seq": 0, "start": 0.0, "len": 2.0, "speaker": "Speaker 1"}, {"seq": 1, "start": 5.0, "len": 40.0, "speaker": "Speaker 2"}]}
    got, _ = P.match_known(*frames(spark, segs, voices, people), ["tenant_id"])
    assert {r.seq: (r.speaker, r.alternatives) for r in got.collect()} == {0: ("Ann", ["Ben"]), 1: ("Ben", ["Ann"])}
    assert {r.speaker for r in I.eliminate_ghosts(got).collect()} == {"Ben"}


def test_evidence_survives_a_second_naming(spark):
    """Who isn't renamed keeps confidence, margin and distance; a name without a confidence keeps the old one."""
    from chronovox.functions.labels import apply_identity

    s = spark.createDataFrame([(1, 0, "Ann", 0.9, 0.4, 0.1, False), (1, 1, "Speaker 2", 0.2, None, None, True)], "recording_id int, seq long, speaker string, speaker_confidence double, speaker_margin double, speaker_match_dist double, uncertain boolean")
    m = spark.createDataFrame([(1, "Speaker 2", "Bob", None, None, None)], "recording_id int, old_name string, new_name string, confidence double, margin double, distance double")
    assert [tuple(r)[2:] for r in apply_identity(s, m).select(s.columns).orderBy("seq").collect()] == [("Ann", 0.9, 0.4, 0.1, False), ("Bob", 0.2, None, None, False)]


def hot(spark, n=3000, people=700):
    """A tenant with nearly all voices and profiles."""
    rng = np.random.default_rng(5)
    tenant = lambda i: 0 if i % 20 else 1 + i % 3
    prof = [(tenant(i), f"N{i}", [float(x) for x in rng.normal(size=6).round(1)], float(i % 3 * 50), float(i % 7), i % 11 == 0) for i in range(people)]
    q = [(tenant(i), i, [float(x) for x in rng.normal(size=6).round(1)], float(i % 2 * 120)) for i in range(n)]
    return q, prof, spark.createDataFrame(q, f"t int, query_id int, {VEC}, pitch_hz double"), spark.createDataFrame(prof, f"t int, name string, {VEC}, pitch_hz double, total_speech_sec double, pending boolean")


@pytest.mark.parametrize("limit", [X.BROADCAST_BYTES, 0])
def test_top_k_of_a_hot_tenant(spark, monkeypatch, limit):
    """k nearest over several blocks, broadcast or by shuffle, are those of a plain sort; no window, and only k a block leave."""
    monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
    q, prof, qs, ps = hot(spark, 400)
    found = N.identify(qs, ps, ["t"], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("BroadcastHashJoin" in plan) == (limit > 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.name, r.distance))
    for t, i, v, hz in q:
        e = entries(np.array(v), hz, [(n, np.array(w), p, s) for u, n, w, p, s, pend in prof if u == t and not pend])[:4]
        mine = sorted(got.get(i, []))
        assert [x[2] for x in mine] == pytest.approx([x[0] for x in e], abs=1.01e-4), i
        assert [x[1] for x in mine] == [x[1] for x in e] or any(abs(a[0] - b[0]) < 2e-4 for a, b in zip(e, e[1:], strict=False))


def test_skipped_and_missing(spark):
    """Names to skip; voices without a vector; tenants without profiles; nobody left."""
    p = spark.createDataFrame([(0, "A", [1.0, 0.0], 0.0, 1.0), (0, "B", [0.0, 1.0], 0.0, 1.0), (0, "N", None, 0.0, 1.0)], f"t int, name string, {VEC}, pitch_hz double, total_speech_sec double")
    q = spark.createDataFrame([(0, 1, [1.0, 0.1], 0.0, ["A"]), (0, 2, None, 0.0, []), (0, 3, [1.0, 0.0], 0.0, ["A", "B", "N"]), (5, 4, [1.0, 0.0], 0.0, []), (0, 5, [0.0, 0.0], 0.0, [])], f"t int, id int, {VEC}, pitch_hz double, no array<string>")
    got = {r.id: [(x.name, x.distance, x.confidence) for x in r.top] for r in X.nearest(q, p, ["t"], 2, ["id"], skip="no").collect()}
    assert [x[0] for x in got[1]] == ["B", "N"] and got[2] == [("A", 1.0, 0.0), ("B", 1.0, 0.0)] and got[3] == [] and 4 not in got
    assert [x[:2] for x in got[5]] == [("A", 0.9), ("B", 0.9)]
    assert X.nearest(q.where("false"), p, ["t"], 2, ["id"]).count() == 0 and X.nearest(q, p.where("false"), ["t"], 2, ["id"]).count() == 0
