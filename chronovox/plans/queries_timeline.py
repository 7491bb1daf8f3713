"""Queries over timelines: sessionisation, joins in time, attribution, cuts, live turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronovox.operators import attribution as A
from chronovox.operators import boundary as B
from chronovox.operators import intervals as I
from chronovox.operators import speakers as P
from chronovox.plans.register import registry
from chronovox.streaming import live as W

QUERIES, ORACLES, query = registry()


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


_W = "(PARTITION BY recording_id ORDER BY start_s, seq)"
_BEFORE = "(PARTITION BY recording_id ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("segments", sql=f"""
WITH f AS (SELECT *, coalesce((start_s - max(end_s) OVER {_BEFORE} > 5)::INT, 1) AS b FROM segments), i AS (SELECT *, sum(b) OVER {_W} AS island FROM f)
SELECT recording_id, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS parts FROM i GROUP BY recording_id, island""")
def e1_merge_intervals(s):
    return I.merge_intervals(s, 5.0).select("recording_id", *r6("start_s", "end_s"), "parts")


def _collapse(same: str, gap: float) -> str:
    return f"""
WITH f AS (SELECT *, CASE WHEN {same} THEN 0 ELSE 1 END AS b FROM segments), r AS (SELECT *, sum(b) OVER {_W} AS run FROM f),
g AS (SELECT *, coalesce((start_s - max(end_s) OVER (PARTITION BY recording_id, run ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap})::INT, 1) AS c FROM r),
i AS (SELECT *, sum(c) OVER {_W} AS island FROM g)
SELECT recording_id, min(seq) AS seq, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, arg_min(speaker, seq) AS speaker, count(*) AS parts, string_agg(text, ' ' ORDER BY start_s, seq) AS text FROM i GROUP BY recording_id, island"""


@query("segments", sql=_collapse(f"lag(coalesce(speaker, '?')) OVER {_W} = coalesce(speaker, '?')", 10.0))
def e2_collapse_runs(s):
    return I.collapse_runs(s, 10.0).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "parts", "text")


_SURE = "(speaker IS NOT NULL AND speaker <> 'OVERLAP' AND NOT uncertain)"


@query("segments", sql=_collapse(f"{_SURE} AND lag({_SURE}) OVER {_W} AND lag(speaker) OVER {_W} = speaker", 10.0))
def e3_collapse_confident(s):
    return I.collapse_confident(s, 10.0).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "parts", "text")


@query("segments", sql=f"""
WITH f AS (SELECT *, CASE WHEN lag(speaker) OVER {_W} = speaker AND start_s - lag(end_s) OVER {_W} <= 10 THEN 0 ELSE 1 END AS b FROM segments), i AS (SELECT *, sum(b) OVER {_W} AS island FROM f)
SELECT recording_id, min(seq) AS seq, round(arg_min(start_s, seq), 6) AS start_s, round(arg_max(end_s, seq), 6) AS end_s, arg_min(speaker, seq) AS speaker, arg_min(speaker_confidence, seq) AS speaker_confidence, count(*) AS children FROM i GROUP BY recording_id, island""")
def e4_to_turns(s):
    return I.to_turns(s, 10.0).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "speaker_confidence", F.size("children").cast("long").alias("children"))


@query("segments", sql=f"""
WITH RECURSIVE b AS (SELECT *, CASE WHEN lag(speaker) OVER {_W} = speaker AND start_s - lag(end_s) OVER {_W} <= 60 THEN 0 ELSE 1 END AS b FROM segments), i AS (SELECT *, sum(b) OVER {_W} AS island FROM b),
a AS (SELECT recording_id, island, arg_min(speaker, seq) AS speaker, list(start_s ORDER BY start_s, seq) AS s, list(end_s ORDER BY start_s, seq) AS e, list(seq ORDER BY start_s, seq) AS q FROM i GROUP BY ALL),
p AS (SELECT recording_id, island, 1::BIGINT AS lo, len(s)::BIGINT AS hi FROM a UNION ALL
  SELECT recording_id, island, unnest([lo, cut + 1]), unnest([cut, hi]) FROM (SELECT *, CASE WHEN list_max(g) > 0 THEN lo + list_position(g, list_max(g)) - 1 ELSE lo END AS cut FROM (
    SELECT p.*, [a.s[i + 1] - a.e[i] FOR i IN range(lo, hi)] AS g FROM p JOIN a USING (recording_id, island) WHERE lo < hi AND a.e[hi] - a.s[lo] > 40) x) y)
SELECT recording_id, q[lo] AS seq, round(s[lo], 6) AS start_s, round(e[hi], 6) AS end_s, speaker, (hi - lo + 1)::INT AS parts FROM p JOIN a USING (recording_id, island) WHERE lo = hi OR e[hi] - s[lo] <= 40""")
def e5_split_long_turns(s):
    turns = I.to_turns(s, 60.0)
    return I.split_long_turns(turns, 40.0).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "parts")


@query("windows", sql=f"""
WITH w AS (SELECT *, CASE WHEN win_id % 4 = 0 THEN 'A+B' ELSE coalesce(speaker, '') END AS key, win_id % 4 = 0 AS ov, (win_id % 10) / 100.0e0 AS cl FROM windows),
f AS (SELECT *, CASE WHEN lag(key) OVER {_W} = key AND start_s - lag(end_s) OVER {_W} <= 1.5 THEN 0 ELSE 1 END AS b FROM w), i AS (SELECT *, sum(b) OVER {_W} AS island FROM f),
g AS (SELECT recording_id, island, min(seq) AS seq, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(speaker, seq) AS dom, bool_or(ov) AS ov, avg(cl) AS cl FROM i GROUP BY recording_id, island),
n AS (SELECT *, CASE WHEN ov AND NOT (end_s - start_s < 0.5 OR coalesce(cl, 1) > 0.08) THEN 'OVERLAP' ELSE dom END AS speaker, lag(end_s) OVER {_W} AS pb, lead(start_s) OVER {_W} AS pa FROM g)
SELECT recording_id, seq, round(CASE WHEN pb > start_s THEN (pb + start_s) / 2 ELSE start_s END, 6) AS start_s, round(CASE WHEN pa < end_s THEN (pa + end_s) / 2 ELSE end_s END, 6) AS end_s, speaker FROM n""")
def e6_build_segments(w):
    o = F.col("win_id") % 4 == 0
    rows = w.withColumns({"is_overlap": o, "overlap_speakers": F.array(F.lit("B"), F.lit("A")), "clarity": (F.col("win_id") % 10) / 100.0})
    return I.build_segments(rows).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


@query("segments", sql=f"""
WITH RECURSIVE s AS (SELECT recording_id, row_number() OVER {_W} AS r, struct_pack(a := start_s, q := seq, b := end_s, n := speaker) AS x FROM segments),
f AS (SELECT recording_id, 0::BIGINT AS r, [x for x in [any_value(x)] if false] AS done FROM s GROUP BY 1 UNION ALL
  SELECT f.recording_id, s.r, CASE WHEN len(done) > 0 AND s.x.a < done[-1].b
    THEN done[:-2] || [y for y in [struct_pack(a := done[-1].a, q := done[-1].q, b := (s.x.a + done[-1].b) / 2, n := done[-1].n), struct_pack(a := (s.x.a + done[-1].b) / 2, q := s.x.q, b := s.x.b, n := s.x.n)] if y.b > y.a]
    ELSE done || [y for y in [s.x] if y.b > y.a] END FROM f JOIN s ON s.recording_id = f.recording_id AND s.r = f.r + 1),
o AS (SELECT recording_id, unnest(done) AS x FROM f QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY r DESC) = 1)
SELECT recording_id, x.q AS seq, round(x.a, 6) AS start_s, round(x.b, 6) AS end_s, x.n AS speaker FROM (SELECT recording_id, unnest(done) AS x FROM (SELECT recording_id, arg_max(done, r) AS done FROM f GROUP BY 1) l) o2""")
def e7_resolve_overlaps(s):
    return I.resolve_overlaps(s).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


@query("segments")
def e8_absorb_islands(s):
    return I.absorb_islands(s, 8.0).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


@query("turns", sql="""
WITH d AS (SELECT *, end_s - start_s AS d FROM turns), a AS (SELECT *, max(d) OVER (PARTITION BY recording_id, speaker) AS mx, sum(d) OVER (PARTITION BY recording_id, speaker) AS sm FROM d),
m AS (SELECT *, (mx >= 5.0 OR sm >= 8.0) AS main FROM a), n AS (SELECT *, max(main::INT) OVER (PARTITION BY recording_id) = 1 AND NOT main AS minor FROM m)
SELECT recording_id, seq, CASE WHEN NOT minor THEN speaker END AS speaker, CASE WHEN minor THEN 'minority_speaker' END AS attribution_reason, text FROM n""")
def e9_absorb_minority(t):
    return I.absorb_minority(t).select("recording_id", "seq", "speaker", "attribution_reason", "text")


@query("turns", sql="""
WITH d AS (SELECT *, end_s - start_s AS d FROM turns), a AS (SELECT *, sum(d) OVER (PARTITION BY recording_id, speaker) AS sm, sum(d) OVER (PARTITION BY recording_id) AS al FROM d),
g AS (SELECT *, sm < 10.0 AND NOT sm / al > 0.25 AS ghost FROM a), s AS (SELECT *, max((speaker = 'Alice' AND ghost)::INT) OVER (PARTITION BY recording_id) = 1 AS alice_ghost FROM g)
SELECT recording_id, seq, CASE WHEN ghost AND seq % 2 = 0 AND NOT alice_ghost THEN 'Alice' WHEN NOT ghost THEN speaker END AS speaker,
       CASE WHEN ghost AND NOT (seq % 2 = 0 AND NOT alice_ghost) THEN 'ghost_speaker' END AS attribution_reason, text FROM s""")
def e10_eliminate_ghosts(t):
    rows = t.withColumn("alternatives", F.when(F.col("seq") % 2 == 0, F.array(F.lit("Alice"))).otherwise(F.array().cast("array<string>")))
    return I.eliminate_ghosts(rows).select("recording_id", "seq", "speaker", "attribution_reason", "text")


@query("windows", sql="""
WITH f AS (SELECT recording_id, cluster, min(struct_pack(s := start_s, q := seq)) AS f FROM windows GROUP BY ALL)
SELECT recording_id, cluster, concat('Speaker ', row_number() OVER (PARTITION BY recording_id ORDER BY f)) AS speaker FROM f""")
def e11_number_speakers(w):
    return I.number_speakers(w.drop("speaker")).select("recording_id", "cluster", "speaker").distinct()


@query("profiles", sql="""
SELECT tenant_id AS recording_id, name AS old_name, concat('Speaker ', row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN pitch_hz > 100 THEN pitch_hz ELSE 9999.0 END, name)) AS new_name FROM profiles""")
def e12_relabel_by_pitch(p):
    return I.relabel_by_pitch(p.select(F.col("tenant_id").alias("recording_id"), F.col("name").alias("speaker"), F.when(F.col("pitch_hz") > 100, F.col("pitch_hz")).otherwise(0.0).alias("pitch_hz")))


@query("turns", sql=f"""
WITH l AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id) + 5 AS len, lag(end_s) OVER {_W} AS b, lead(start_s) OVER {_W} AS a FROM turns)
SELECT recording_id, seq, round(CASE WHEN b IS NULL THEN 0 ELSE (b + start_s) / 2 END, 6) AS start_s, round(CASE WHEN a IS NULL THEN len ELSE (end_s + a) / 2 END, 6) AS end_s, speaker FROM l""")
def e13_close_timeline(t):
    length = F.max("end_s").over(Window.partitionBy("recording_id")) + 5
    return I.close_timeline(t, length).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


@query("turns", sql=f"""
WITH l AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id) + CASE WHEN recording_id % 2 = 0 THEN 5 ELSE 0 END AS len, lag(end_s) OVER {_W} AS pe, lag(seq) OVER {_W} AS ps, lead(start_s) OVER {_W} AS a FROM turns),
c AS (SELECT *, CASE WHEN a - end_s > 0.001 THEN CASE WHEN seq % 2 = 0 THEN end_s + (a - end_s) / 4 ELSE (end_s + a) / 2 END END AS cut FROM l), d AS (SELECT *, lag(cut) OVER {_W} AS before FROM c)
SELECT recording_id, seq, round(CASE WHEN pe IS NULL AND start_s > 0.001 THEN 0 ELSE coalesce(before, start_s) END, 6) AS start_s, round(CASE WHEN a IS NULL AND len - end_s > 0.001 THEN len ELSE coalesce(cut, end_s) END, 6) AS end_s, speaker FROM d""")
def e13_cover_timeline(t):
    """Gaps alone close, those after even turns at a given cut; overlaps stay."""
    length = F.max("end_s").over(Window.partitionBy("recording_id")) + F.when(F.col("recording_id") % 2 == 0, 5).otherwise(0)
    nxt = F.lead("start_s").over(I.order())
    cuts = t.withColumn("_n", nxt).where("seq % 2 = 0 AND _n - end_s > 0.001").select("recording_id", "seq", (F.col("end_s") + (F.col("_n") - F.col("end_s")) / 4).alias("cut"))
    return I.cover_timeline(t, length, cuts).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


_ASOF = """
own AS (SELECT i.recording_id, i.seq, i.start_s, i.end_s, i.text, i.confidence AS item_confidence, (i.start_s + i.end_s) / 2 AS mid, t.seq AS turn_seq, t.start_s AS t0, t.end_s AS t1, t.speaker AS t_speaker, t.speaker_confidence AS t_conf, t.uncertain AS t_unc
  FROM items i LEFT JOIN turns t ON i.recording_id = t.recording_id AND (t.start_s <= (i.start_s + i.end_s) / 2 OR t.seq = 0) QUALIFY row_number() OVER (PARTITION BY i.recording_id, i.seq ORDER BY t.start_s DESC) = 1)"""


@query("items", "turns", sql=f"WITH {_ASOF} SELECT recording_id, seq, turn_seq FROM own")
def c1_asof_turn(i, t):
    return I.asof_turn(i, t).select("recording_id", "seq", F.col("turn.seq").alias("turn_seq"))


@query("items", "turns", sql=f"""
WITH {_ASOF}, n AS (SELECT o.*, t.start_s AS n0, t.speaker AS n_speaker FROM own o LEFT JOIN turns t ON t.recording_id = o.recording_id AND t.seq = o.turn_seq + 1)
SELECT recording_id, seq, CASE WHEN (t0 <= mid AND mid <= t1) OR n0 IS NULL OR mid - t1 <= n0 - mid THEN t_speaker ELSE n_speaker END AS speaker FROM n""")
def c2_speaker_for_span(i, t):
    return I.speaker_for_span(i, t).select("recording_id", "seq", "speaker")


_ATTR = f"""{_ASOF}, d AS (SELECT *, greatest(end_s - start_s, 0) AS d, greatest(0, least(end_s, t1) - greatest(start_s, t0)) AS ins FROM own),
a AS (SELECT *, CASE WHEN turn_seq IS NULL THEN 'no_turns' WHEN d > 0 AND d <= 3 AND d - ins > 0.3 AND (d - ins) / d > 0.34 THEN 'boundary_crossing' WHEN d > 3 AND ins / d < 0.35 THEN 'low_span_turn_overlap'
  WHEN t_unc THEN 'turn_uncertain' WHEN t_speaker IS NULL THEN 'turn_label_uncertain' END AS reason FROM d),
att AS (SELECT *, CASE WHEN reason IS NULL THEN t_speaker END AS speaker, CASE WHEN reason IS NULL THEN least(coalesce(t_conf, ins / d), 1.0) ELSE 0.0 END AS confidence FROM a)"""


@query("items", "turns", sql=f"WITH {_ATTR} SELECT recording_id, seq, speaker, round(confidence, 6) AS confidence, reason FROM att")
def c3_c4_attribute_spans(i, t):
    return A.attribute_spans(i, t).select("recording_id", "seq", "speaker", *r6("confidence"), "reason")


_RUNS = f"""{_ATTR}, k AS (SELECT *, concat(coalesce(speaker, '~'), '|', coalesce(reason, '~'), '|', CASE WHEN speaker IS NULL THEN turn_seq ELSE -1 END) AS key FROM att),
b AS (SELECT *, CASE WHEN lag(key) OVER {_W} = key THEN 0 ELSE 1 END AS b FROM k), g AS (SELECT *, sum(b) OVER {_W} AS island FROM b),
runs AS (SELECT recording_id, min(seq) AS seq, arg_min(start_s, seq) AS start_s, arg_max(end_s, seq) AS end_s, arg_min(speaker, seq) AS speaker, arg_min(reason, seq) AS reason, count(*) AS items, string_agg(text, ' ' ORDER BY start_s, seq) AS text FROM g GROUP BY recording_id, island)"""


@query("items", "turns", sql=f"WITH {_RUNS} SELECT recording_id, seq, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, speaker, reason, items, text FROM runs")
def e14_attribute_items(i, t):
    return A.attribute_items(i, t).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "reason", "items", "text")


@query("items", "turns", sql=f"""
WITH {_RUNS}, m AS (SELECT *, CASE WHEN speaker IS NOT NULL AND speaker <> 'OVERLAP' AND lag(speaker) OVER {_W} = speaker AND start_s - lag(end_s) OVER {_W} <= 1 THEN 0 ELSE 1 END AS nb FROM runs),
j AS (SELECT *, sum(nb) OVER {_W} AS part FROM m),
p AS (SELECT *, CASE WHEN lag(text) OVER q IS NULL THEN '' WHEN regexp_matches(lag(text) OVER q, '[.!?…]$') AND start_s - max(end_s) OVER (PARTITION BY recording_id, part ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2 THEN chr(10) || chr(10) ELSE ' ' END AS glue FROM j WINDOW q AS (PARTITION BY recording_id, part ORDER BY start_s, seq))
SELECT recording_id, min(seq) AS seq, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, arg_min(speaker, seq) AS speaker, count(*) AS parts, string_agg(glue || text, '' ORDER BY start_s, seq) AS text FROM p GROUP BY recording_id, part""")
def e15_merge_results(i, t):
    return A.merge_results(A.attribute_items(i, t)).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "parts", "text")


@query("items", "turns")
def flagship_speaker_totals(i, t):
    """Who said what, and how much: items to turns, runs, results, then totals per recording and name."""
    got = A.merge_results(A.attribute_items(i, t))
    d = F.col("end_s") - F.col("start_s")
    return got.groupBy("recording_id", "speaker").agg(F.count("*").alias("results"), F.round(F.sum(d), 6).alias("speech_sec"), F.sum(F.length("text")).alias("chars"))


@query("items", sql=f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER {_W} AS r FROM items),
f AS (SELECT recording_id, 0::BIGINT AS r, 0 AS p, 0::BIGINT AS n, 0.0::DOUBLE AS e, '' AS l FROM items GROUP BY 1 UNION ALL
  SELECT recording_id, r, p + b::INT, CASE WHEN b THEN length(text) ELSE n + length(text) + (n > 0)::INT END, end_s, text FROM (
    SELECT f.recording_id, s.r, f.p, f.n, s.text, s.end_s, f.n > 0 AND (s.start_s - f.e >= 0.4 OR (f.n >= 20 AND regexp_matches(f.l, '[.!?…]\\s*$')) OR f.n >= 60) AS b FROM f JOIN s ON s.recording_id = f.recording_id AND s.r = f.r + 1) x)
SELECT f.recording_id, p AS paragraph, round(min(start_s), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS items, string_agg(text, ' ' ORDER BY start_s, seq) AS text FROM f JOIN s ON s.recording_id = f.recording_id AND s.r = f.r GROUP BY ALL""")
def e16_paragraphs(i):
    return A.paragraphs(i, pause=0.4, soft=20, hard=60).select("recording_id", "paragraph", *r6("start_s", "end_s"), "items", "text")


@query("frames", sql="""
WITH lim AS (SELECT recording_id, greatest(0.3 * quantile_cont(rms, 0.25), 0.02 * max(rms), 1e-5) AS t, min(frame_idx) AS lo, max(frame_idx) AS hi FROM frames GROUP BY 1),
q AS (SELECT f.recording_id, f.frame_idx, f.frame_idx - row_number() OVER (PARTITION BY f.recording_id ORDER BY f.frame_idx) AS i, lo, hi FROM frames f JOIN lim USING (recording_id) WHERE rms < t),
g AS (SELECT recording_id, min(frame_idx) AS first, max(frame_idx) AS last, any_value(lo) AS lo, any_value(hi) AS hi FROM q GROUP BY recording_id, i)
SELECT recording_id, first, last FROM g WHERE last - first + 1 >= 2 AND first > lo + 1 AND last < hi - 1""")
def e17_interior_pauses(f):
    return I.interior_pauses(f, 2, 1)


@query("items")
def e18_paragraph_breaks(i):
    pauses = i.where(F.col("seq") % 5 == 0).select("recording_id", (F.col("end_s") + 0.1).alias("at"))
    return A.paragraph_breaks(i, pauses)


@query("frames", sql="""
WITH s AS (SELECT recording_id, frame_idx, coalesce((frame_idx - lag(frame_idx) OVER (PARTITION BY recording_id ORDER BY frame_idx) > 3)::INT, 1) AS n FROM frames WHERE speech_prob >= 0.5),
i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i FROM s)
SELECT recording_id, min(frame_idx) * 1.0e0 AS start_s, (max(frame_idx) + 1) * 1.0e0 AS end_s FROM i GROUP BY recording_id, i""")
def e19_sections_from_probs(f):
    return I.sections_from_probs(f)


_ENERGY = """
WITH m AS (SELECT {k}, median(rms) AS m FROM {t} GROUP BY ALL), l AS (SELECT f.*, frame_idx - row_number() OVER (PARTITION BY {fk} ORDER BY frame_idx) AS i FROM {t} f JOIN m USING ({k}) WHERE rms > m)
SELECT {k}, min(frame_idx) * 1.0e0 AS start_s, (max(frame_idx) + 1) * 1.0e0 AS end_s FROM l GROUP BY {k}, i"""


@query("frames", sql=_ENERGY.format(k="recording_id", fk="f.recording_id", t="frames"))
def e20_sections_from_energy(f):
    return I.sections_from_energy(f)


@query("frames", sql="""
WITH c AS (SELECT f.*, unnest(range(greatest(ceil((frame_idx - 29) / 25.0)::INT, 0), (frame_idx // 25)::INT + 1)) AS chunk FROM frames f),
m AS (SELECT recording_id, chunk, median(rms) AS m FROM c GROUP BY ALL), l AS (SELECT c.*, frame_idx - row_number() OVER (PARTITION BY recording_id, chunk ORDER BY frame_idx) AS i FROM c JOIN m USING (recording_id, chunk) WHERE rms > m)
SELECT recording_id, chunk, min(frame_idx)::DOUBLE AS start_s, (max(frame_idx) + 1)::DOUBLE AS end_s FROM l GROUP BY recording_id, chunk, i""")
def e21_sections_chunked(f):
    return I.sections_chunked(f)


@query("frames")
def e22_split_at_dips(f):
    sections = f.groupBy("recording_id", F.floor(F.col("frame_idx") / 40).alias("section_id")).agg(F.min("frame_idx").cast("double").alias("s_start"), (F.max("frame_idx") + 1).cast("double").alias("s_end"))
    return I.split_at_dips(sections, f)


@query("segments", sql="""
WITH u AS (SELECT recording_id, seq, round(start_s * 1e6)::BIGINT AS lo, round(end_s * 1e6)::BIGINT AS hi FROM segments), k AS (SELECT *, unnest(range(0, 1 + greatest(hi - lo, 0) // 1200000)) AS k FROM u), w AS (SELECT *, lo + k * 1200000 AS a, least(lo + k * 1200000 + 2000000, hi) AS b FROM k)
SELECT recording_id, seq, round(a / 1e6, 6) AS w_start, round(b / 1e6, 6) AS w_end FROM w WHERE k = 0 OR (b - a > 100000 AND a - 1200000 + 2000000 < hi)""")
def e23_sliding_windows(s):
    return I.sliding_windows(s.select("recording_id", "seq", "start_s", "end_s")).select("recording_id", "seq", *r6("w_start", "w_end"))


_PROBS = """
ps AS (SELECT recording_id, frame_idx, coalesce((frame_idx - lag(frame_idx) OVER (PARTITION BY recording_id ORDER BY frame_idx) > 3)::INT, 1) AS n FROM frames WHERE speech_prob >= 0.5),
pi AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS i FROM ps),
sections AS (SELECT recording_id, min(frame_idx) * 1.0e0 AS s_start, (max(frame_idx) + 1) * 1.0e0 AS s_end FROM pi GROUP BY recording_id, i)"""


@query("segments", "frames", sql=f"""
WITH {_PROBS}, c AS (SELECT s.recording_id, s.seq, greatest(s.start_s, min(s_start)) AS lo, least(s.end_s, max(s_end)) AS hi FROM segments s JOIN sections x ON x.recording_id = s.recording_id AND s.start_s <= s_end AND s.end_s >= s_start GROUP BY s.recording_id, s.seq, s.start_s, s.end_s)
SELECT s.recording_id, s.seq AS span_id, round(CASE WHEN hi - lo >= 1.5 THEN lo ELSE s.start_s END, 6) AS start_s, round(CASE WHEN hi - lo >= 1.5 THEN hi ELSE s.end_s END, 6) AS end_s, coalesce(hi - lo >= 1.5, false) AS trimmed FROM segments s LEFT JOIN c USING (recording_id, seq)""")
def e24_trim_to_sections(s, f):
    spans = s.select("recording_id", F.col("seq").alias("span_id"), F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    sections = I.sections_from_probs(f).select("recording_id", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    return I.trim_to_sections(spans, sections).select("recording_id", "span_id", *r6("start_s", "end_s"), "trimmed")


def _turn_frames(f, n: int = 20):
    """Frames dealt to turns of n."""
    return f.select("recording_id", F.floor(F.col("frame_idx") / n).alias("turn_id"), (F.col("frame_idx") % n).alias("frame_idx"), "speech_prob", F.lit(n).alias("n_frames"))


@query("frames", sql="""
WITH f AS (SELECT recording_id, frame_idx // 20 AS turn_id, frame_idx % 20 AS k, speech_prob FROM frames), e AS (SELECT recording_id, turn_id, min(k) FILTER (speech_prob >= 0.35) * 0.032e0 AS l, 20 * 0.032e0 - (max(k) FILTER (speech_prob >= 0.35) + 1) * 0.032e0 AS t FROM f GROUP BY ALL),
x AS (SELECT *, least(coalesce(l, 0), 0.4, 0.192) AS lead FROM e)
SELECT recording_id, turn_id, round(turn_id * 0.64e0 + lead, 6) AS start_s, round(turn_id * 0.64e0 + 0.64e0 - greatest(0, least(coalesce(t, 0), 0.4, 0.192 - lead)), 6) AS end_s FROM x""")
def e25_trim_edges(f):
    fr = _turn_frames(f)
    turns = fr.select("recording_id", "turn_id").distinct().withColumns({"start_s": F.col("turn_id") * 0.64, "end_s": F.col("turn_id") * 0.64 + 0.64})
    return I.trim_edges(turns, fr).select("recording_id", "turn_id", *r6("start_s", "end_s"))


@query("frames", sql="""
WITH RECURSIVE a AS (SELECT recording_id, list(rms ORDER BY frame_idx) AS a, count(*) AS n FROM frames GROUP BY 1),
f AS (SELECT recording_id, 0::BIGINT AS c, 0::BIGINT AS p FROM a UNION ALL
  SELECT f.recording_id, c + 1, p + 25 + list_position(a[p + 26 : p + 30], list_min(a[p + 26 : p + 30])) FROM f JOIN a USING (recording_id) WHERE n - p > 30)
SELECT f.recording_id, c::INT AS chunk, p::INT AS first, coalesce(lead(p) OVER (PARTITION BY f.recording_id ORDER BY c), n)::INT AS "end" FROM f JOIN a USING (recording_id)""")
def e26_plan_chunks(f):
    return I.plan_chunks(f)


@query("items", sql="""
SELECT DISTINCT recording_id, seq // 9 AS chunk, CASE WHEN (recording_id + seq // 9) % 6 = 0 THEN (seq // 9) * 30.0e0 ELSE floor(start_s * 8) / 8 + (seq // 9) * 30.0e0 END AS start_s,
  CASE WHEN (recording_id + seq // 9) % 6 = 0 THEN (seq // 9) * 30.0e0 ELSE floor(end_s * 8) / 8 + (seq // 9) * 30.0e0 END AS end_s, CASE WHEN (recording_id + seq // 9) % 6 > 0 THEN text END AS text,
  CASE WHEN (recording_id + seq // 9) % 6 = 0 THEN 'failed' END AS error FROM items""")
def e27_stitch_items(i):
    c = F.floor(F.col("seq") / 9)
    items = i.select("recording_id", c.alias("chunk"), (F.floor(F.col("start_s") * 8) / 8).alias("start_s"), (F.floor(F.col("end_s") * 8) / 8).alias("end_s"), "text")
    chunks = items.select("recording_id", "chunk").distinct().withColumns({"offset_s": F.col("chunk") * 30.0, "error": F.when((F.col("recording_id") + F.col("chunk")) % 6 == 0, "failed")})
    return I.stitch_items(items, chunks)


@query("segments", sql="""
WITH n AS (SELECT recording_id, count(DISTINCT speaker) AS speakers FROM segments GROUP BY 1)
SELECT recording_id, seq, event_id % 2 AS channel, speakers, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, event_id % 2, seq) AS place FROM segments JOIN n USING (recording_id)""")
def e28_merge_channels(s):
    return I.merge_channels(s.withColumn("channel", F.col("event_id") % 2)).select("recording_id", "seq", "channel", "speakers", "place")


@query("segments", "windows", sql="""
SELECT s.recording_id, s.seq, w.win_id FROM segments s JOIN windows w ON s.recording_id = w.recording_id AND w.start_s >= s.start_s - 0.1 AND w.end_s <= s.end_s + 0.1""")
def c5_windows_in_segments(s, w):
    p = w.select("recording_id", "win_id", F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    q = s.select("recording_id", "seq", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    return I.windows_in_segments(p, q).select("recording_id", "seq", "win_id")


@query("segments", sql="""
WITH b AS (SELECT recording_id, seq, end_s AS at FROM segments WHERE seq % 3 = 0)
SELECT DISTINCT b.recording_id, round(b.at, 6) AS at, round(s.start_s, 6) AS s_start, round(s.end_s, 6) AS s_end FROM b JOIN segments s ON s.recording_id = b.recording_id AND s.end_s - s.start_s >= 0.3 AND b.at - 0.5 <= s.end_s AND b.at + 0.5 >= s.start_s""")
def c6_sections_near(s):
    b = s.where(F.col("seq") % 3 == 0).select("recording_id", F.col("end_s").alias("at"))
    q = s.select("recording_id", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    return I.sections_near(b, q).select("recording_id", *r6("at", "s_start", "s_end")).distinct()


@query("windows", sql="""
WITH m AS (SELECT *, (start_s + end_s) / 2 AS mid FROM windows), p AS (SELECT a.recording_id, a.win_id, b.speaker, abs(a.mid - b.mid) AS d, b.mid AS bm FROM m a JOIN m b ON a.recording_id = b.recording_id AND b.speaker IS NOT NULL WHERE a.speaker IS NULL
  QUALIFY row_number() OVER (PARTITION BY a.recording_id, a.win_id ORDER BY d, bm) = 1)
SELECT w.recording_id, w.win_id, coalesce(w.speaker, p.speaker) AS speaker FROM windows w LEFT JOIN p USING (recording_id, win_id)""")
def c7_c8_fill_nearest(w):
    return I.fill_nearest(w).select("recording_id", "win_id", "speaker")


@query("items", sql="""
SELECT recording_id, seq // 6 AS paragraph, round_even(round(100 * sum(confidence * CASE WHEN end_s - start_s > 0 THEN end_s - start_s ELSE 1 END) / sum(CASE WHEN end_s - start_s > 0 THEN end_s - start_s ELSE 1 END), 6), 0)::INT AS confidence_pct FROM items GROUP BY ALL""")
def d14_weighted_confidence(i):
    return A.weighted_confidence(i.withColumn("paragraph", F.floor(F.col("seq") / 6)), ["recording_id", "paragraph"])


@query("turns", sql="""
WITH g AS (SELECT recording_id, count(*) AS results, sum((seq % 5 = 4)::INT)::BIGINT AS errors, sum((speaker_confidence < 0.3)::INT)::BIGINT AS uncertain, max(end_s) AS audio_sec FROM turns GROUP BY 1)
SELECT recording_id, results, errors, uncertain, CASE WHEN errors = results THEN 'error' WHEN errors > 0 THEN 'partial' ELSE 'ok' END AS status, round(audio_sec / (1 + recording_id % 7), 6) AS speed_up FROM g""")
def d13_run_metrics(t):
    rows = t.withColumns({"error": F.when(F.col("seq") % 5 == 4, "x"), "speaker": F.when(F.col("speaker_confidence") >= 0.3, F.col("speaker"))})
    lengths = t.groupBy("recording_id").agg(F.max("end_s").alias("audio_sec")).withColumn("processing_sec", 1.0 + F.col("recording_id") % 7)
    return A.run_metrics(rows, lengths).select("recording_id", "results", "errors", "uncertain", "status", *r6("speed_up"))


@query("frames", sql="""
WITH t AS (SELECT recording_id, frame_idx // 20 AS turn_id, avg(speech_prob) AS m, avg((speech_prob >= 0.5)::INT) AS r FROM frames WHERE frame_idx % 20 > 2 GROUP BY ALL)
SELECT recording_id, turn_id, round(m, 6) AS mean_prob, round(r, 6) AS speech_ratio, m >= 0.3 AND r >= 0.35 AS passes FROM t""")
def d17_speech_gate(f):
    k = ["recording_id", "turn_id"]
    fr = _turn_frames(f).where(F.col("frame_idx") > 2)
    return W.speech_gate(fr.select(*k).distinct(), fr, k).select(*k, *r6("mean_prob", "speech_ratio"), "passes")


@query("segments", "frames", sql="""
WITH x AS (SELECT s.recording_id, s.speaker, f.pitch_hz, f.rms FROM segments s JOIN frames f ON f.recording_id = s.recording_id AND f.frame_idx BETWEEN s.start_s AND s.end_s WHERE s.speaker IS NOT NULL)
SELECT recording_id, speaker, round(median(pitch_hz), 6) AS pitch_hz, round(stddev_pop(pitch_hz), 6) AS pitch_std, round(sqrt(avg(rms * rms)), 6) AS energy_rms, count(*) AS frames FROM x GROUP BY ALL""")
def d7_profile_speakers(s, f):
    p = f.select("recording_id", "pitch_hz", "rms", F.col("frame_idx").cast("double").alias("p_start"), F.col("frame_idx").cast("double").alias("p_end"))
    q = s.where("speaker IS NOT NULL").select("recording_id", "speaker", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    x = I.range_join(p, q, 60.0)
    return x.groupBy("recording_id", "speaker").agg(F.round(F.median("pitch_hz"), 6).alias("pitch_hz"), F.round(F.stddev_pop("pitch_hz"), 6).alias("pitch_std"), F.round(F.sqrt(F.avg(F.col("rms") * F.col("rms"))), 6).alias("energy_rms"), F.count("*").alias("frames"))


@query("segments", "frames", sql="""
WITH s AS (SELECT * FROM segments WHERE speaker IS NOT NULL AND speaker <> 'OVERLAP'), x AS (SELECT s.recording_id, s.speaker, CASE WHEN f.pitch_hz > 100 THEN f.pitch_hz END AS p, f.rms FROM s JOIN frames f ON f.recording_id = s.recording_id AND f.frame_idx * 0.5e0 BETWEEN s.start_s AND s.end_s),
g AS (SELECT recording_id, speaker, median(p) AS p, stddev_pop(p) AS d, sqrt(avg(rms * rms)) AS e, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT recording_id, speaker, sum(end_s - start_s) AS sec FROM s GROUP BY ALL)
SELECT recording_id, speaker, round(coalesce(p, 0), 6) AS pitch_hz, round(coalesce(d, 0), 6) AS pitch_std, round(coalesce(e, 0), 6) AS energy_rms, round(sec, 6) AS total_speech_sec, coalesce(n, 0) AS frames FROM t LEFT JOIN g USING (recording_id, speaker)""")
def d7_speaker_profiles(s, f):
    """The library function, with frames of half a second, some of them without pitch."""
    voiced = f.withColumn("pitch_hz", F.when(F.col("pitch_hz") > 100, F.col("pitch_hz")).otherwise(0.0))
    return P.profile_speakers(voiced, s, 0.5).select("recording_id", "speaker", *r6("pitch_hz", "pitch_std", "energy_rms", "total_speech_sec"), "frames")


@query("items")
def e18_paragraph_text(i):
    """Texts with an empty line at each pause; tests hold it against a plain restatement."""
    pauses = i.where(F.col("seq") % 7 == 3).select("recording_id", (F.col("end_s") + 0.1).alias("at"))
    return A.paragraph_text(i, pauses)


@query("turns")
def e10_remove_ghosts(t):
    """Ghosts to the nearest speaker, neighbours of one speaker joined."""
    rows = t.withColumn("alternatives", F.array().cast("array<string>"))
    return I.eliminate_ghosts(rows, withhold=False, collapse=True).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker", "parts")


# -- boundaries -------------------------------------------------------------------------------------


def _sections(e):
    """Vectors as sections of gaps: five each, with two references."""
    return e.select((F.floor(F.col("vec_id") / 5)).alias("gap_id"), (F.col("vec_id") % 5).alias("pos"), (F.col("vec_id") % 2).cast("int").alias("owner"), (F.lit(1.0) + F.col("vec_id") % 7).alias("weight"), (F.col("vec_id") * 1.0).alias("start_s"), (F.col("vec_id") + 0.8).alias("end_s"))


_SPLIT = """
s AS (SELECT vec_id // 5 AS gap_id, vec_id % 5 AS pos, vec_id % 2 AS o, 1.0e0 + vec_id % 7 AS w FROM embeddings),
k AS (SELECT gap_id, row_number() OVER p - 1 AS k, coalesce(sum(CASE WHEN o = 1 THEN w ELSE 0 END) OVER (PARTITION BY gap_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(CASE WHEN o = 0 THEN w ELSE 0 END) OVER (PARTITION BY gap_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cost
  FROM s WINDOW p AS (PARTITION BY gap_id ORDER BY pos) UNION ALL SELECT gap_id, count(*), sum(CASE WHEN o = 1 THEN w ELSE 0 END) FROM s GROUP BY 1)"""


@query("embeddings", sql=f"WITH {_SPLIT} SELECT gap_id, arg_min(k, cost * 100 + k)::INT AS k, min(cost) AS cost, max(k)::INT AS n FROM k GROUP BY 1")
def f2_best_split(e):
    return B.best_split(_sections(e), ["gap_id"])


_COS = "list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE FOR i IN range(1, len({a}) + 1)]) / (sqrt(list_sum([v::DOUBLE * v FOR v IN {a}])) * sqrt(list_sum([v::DOUBLE * v FOR v IN {b}])))"
_COS = f"(1.0 - {_COS})"


@query("embeddings", sql=f"""
WITH s AS (SELECT vec_id // 5 AS gap_id, vec_id % 5 AS pos, vec_id * 1.0e0 AS a, vec_id + 0.8e0 AS b, embedding FROM embeddings), r AS (SELECT gap_id, arg_min(embedding, pos) AS l, arg_max(embedding, pos) AS r FROM s GROUP BY 1),
x AS (SELECT s.*, 1.0 - {_COS.format(a="s.embedding", b="r.l")} AS sa, 1.0 - {_COS.format(a="s.embedding", b="r.r")} AS sb FROM s JOIN r USING (gap_id)), o AS (SELECT gap_id, pos, a, b, (sb > sa)::INT AS o, abs(sa - sb) + 1e-3 AS w, row_number() OVER (PARTITION BY gap_id ORDER BY pos) - 1 AS k FROM x),
c AS (SELECT p.gap_id, p.k, sum(CASE WHEN q.k < p.k AND q.o = 1 OR q.k >= p.k AND q.o = 0 THEN q.w ELSE 0 END) AS cost FROM (SELECT gap_id, k FROM o UNION ALL SELECT gap_id, count(*) FROM o GROUP BY 1) p JOIN o q USING (gap_id) GROUP BY ALL),
g AS (SELECT gap_id, arg_min(k, struct_pack(c := round(cost, 12), k := k)) AS k FROM c GROUP BY 1)
SELECT g.gap_id, CASE WHEN l.gap_id IS NULL OR l.b <= r2.a THEN r2.a ELSE ((l.a + l.b) / 2 + (r2.a + r2.b) / 2) / 2 END AS cut FROM g LEFT JOIN o l ON l.gap_id = g.gap_id AND l.k = g.k - 1 LEFT JOIN o r2 ON r2.gap_id = g.gap_id AND r2.k = g.k""")
def f1_f3_ownership_cut(e):
    rows = _sections(e).drop("owner", "weight").join(e.select((F.col("vec_id") % 5).alias("pos"), F.floor(F.col("vec_id") / 5).alias("gap_id"), "embedding"), ["gap_id", "pos"])
    refs = rows.groupBy("gap_id").agg(F.min_by("embedding", "pos").alias("left_ref"), F.max_by("embedding", "pos").alias("right_ref"))
    own = B.section_owners(rows.join(refs, "gap_id"))
    return B.ownership_cut(own, B.best_split(own, ["gap_id"]), ["gap_id"])


def _gap_table(s):
    return B.gaps_between(s.select("recording_id", "seq", "start_s", "end_s", "speaker"), 3.0)


_GAPS = f"""gaps AS (SELECT recording_id, seq AS gap_id, start_s AS l_start, end_s AS l_end, lead(start_s) OVER {_W} AS r_start, lead(end_s) OVER {_W} AS r_end, speaker AS ls, lead(speaker) OVER {_W} AS rs FROM segments QUALIFY r_start IS NOT NULL AND ls IS DISTINCT FROM rs),
g AS (SELECT *, greatest(least(l_end, r_start) - 3, l_start) AS lo FROM gaps), h AS (SELECT *, greatest(least(greatest(l_end, r_start) + 3, r_end), lo) AS hi FROM g)"""


@query("segments", "frames", sql=f"""
WITH {_GAPS}, n AS (SELECT h.recording_id, gap_id, frame_idx, rms FROM h JOIN frames f ON f.recording_id = h.recording_id AND f.frame_idx >= lo AND f.frame_idx <= hi)
SELECT recording_id, gap_id, arg_min(frame_idx, struct_pack(r := rms, i := frame_idx)) + 0.5e0 AS cut FROM n GROUP BY ALL HAVING max(rms) > 0""")
def f5_quietest_cut(s, f):
    return B.quietest_cut(_gap_table(s), f)


@query("segments", "frames", sql=f"""
WITH {_GAPS}, n AS (SELECT h.*, frame_idx, rms, max(rms) OVER (PARTITION BY h.recording_id, gap_id) AS peak FROM h JOIN frames f ON f.recording_id = h.recording_id AND f.frame_idx >= lo AND f.frame_idx <= hi),
q AS (SELECT recording_id, gap_id, arg_min(frame_idx, struct_pack(r := rms, i := frame_idx)) + 0.5e0 AS quiet FROM n GROUP BY ALL HAVING max(rms) > 0),
l AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY recording_id, gap_id ORDER BY frame_idx) AS i FROM n WHERE rms < 0.35 * peak),
r AS (SELECT recording_id, gap_id, count(*) AS n, (min(frame_idx) + max(frame_idx) + 1) / 2.0 AS c, any_value((lo + hi) / 2) AS m FROM l GROUP BY recording_id, gap_id, i HAVING count(*) >= 2),
d AS (SELECT recording_id, gap_id, arg_max(c, struct_pack(n := n, d := -abs(c - m), c := -c)) AS dip FROM r GROUP BY ALL)
SELECT h.recording_id, h.gap_id, round(least(greatest(coalesce(dip, quiet, (l_end + r_start) / 2), l_start + 0.001), r_end - 0.001), 4) AS cut, CASE WHEN dip IS NOT NULL THEN 'energy_dip' WHEN quiet IS NOT NULL THEN 'quietest' ELSE 'midpoint' END AS method
FROM h LEFT JOIN d ON d.recording_id = h.recording_id AND d.gap_id = h.gap_id LEFT JOIN q ON q.recording_id = h.recording_id AND q.gap_id = h.gap_id""")
def f4_f6_cut_boundaries(s, f):
    g = _gap_table(s)
    return B.cut_boundaries(g, None, B.energy_dip_cut(g, f, 0.35, 2.0), B.quietest_cut(g, f)).select("recording_id", "gap_id", "cut", "method")


@query("segments", "frames", sql=f"""
WITH {_GAPS}, q AS (SELECT h.recording_id, gap_id, arg_min(frame_idx, struct_pack(r := rms, i := frame_idx)) + 0.5e0 AS quiet FROM h JOIN frames f ON f.recording_id = h.recording_id AND f.frame_idx >= lo AND f.frame_idx <= hi GROUP BY ALL HAVING max(rms) > 0),
c AS (SELECT h.*, round(least(greatest(coalesce(quiet, (l_end + r_start) / 2), l_start + 0.001), r_end - 0.001), 4) AS cut FROM h LEFT JOIN q ON q.recording_id = h.recording_id AND q.gap_id = h.gap_id),
d AS (SELECT recording_id, gap_id, cut FROM c WHERE cut > l_start AND r_end > cut AND greatest(abs(cut - l_end), abs(cut - r_start)) > 0.001),
s AS (SELECT *, lag(seq) OVER {_W} AS prev FROM segments)
SELECT s.recording_id, s.seq, round(coalesce(b.cut, s.start_s), 6) AS start_s, round(greatest(coalesce(d.cut, s.end_s), coalesce(b.cut, s.start_s)), 6) AS end_s, s.speaker FROM s LEFT JOIN d ON d.recording_id = s.recording_id AND d.gap_id = s.seq LEFT JOIN d b ON b.recording_id = s.recording_id AND b.gap_id = s.prev""")
def f7_refine_gaps(s, f):
    g = _gap_table(s)
    cuts = B.cut_boundaries(g, None, None, B.quietest_cut(g, f))
    return B.refine_gaps(s.select("recording_id", "seq", "start_s", "end_s", "speaker"), cuts).select("recording_id", "seq", *r6("start_s", "end_s"), "speaker")


@query("segments", sql=f"""
WITH {_GAPS}, c AS (SELECT round(least(greatest((l_end + r_start) / 2, l_start + 0.001), r_end - 0.001), 4) AS cut, (l_end + r_start) / 2 AS m FROM h)
SELECT 'midpoint' AS method, count(*) AS cuts, round(quantile_cont(abs(cut - m), 0.5), 5) AS p50, round(quantile_cont(abs(cut - m), 0.9), 5) AS p90, round(max(abs(cut - m)), 5) AS largest FROM c""")
def d15_boundary_stats(s):
    r = B.boundary_stats(B.cut_boundaries(_gap_table(s)))
    return r.select("method", "cuts", *[F.round(c, 5).alias(c) for c in ("p50", "p90", "largest")])


@query("segments", "frames", sql=f"""
WITH {_GAPS}, {_PROBS}, c AS (SELECT recording_id, gap_id, round(least(greatest((l_end + r_start) / 2, l_start + 0.001), r_end - 0.001), 4) AS cut FROM h), e AS (SELECT recording_id, unnest([s_start, s_end]) AS t FROM sections),
d AS (SELECT c.recording_id, c.gap_id, min(abs(cut - t)) AS d FROM c JOIN e ON e.recording_id = c.recording_id GROUP BY ALL)
SELECT recording_id, count(*) AS cuts, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS largest FROM d GROUP BY 1""")
def d16_boundary_error(s, f):
    r = B.boundary_error(B.cut_boundaries(_gap_table(s)), I.sections_from_probs(f))
    return r.select("recording_id", "cuts", *r6("p50", "p90", "largest"))


# -- live -------------------------------------------------------------------------------------------


def _live(f):
    return f.select(F.col("recording_id").alias("session_id"), F.lit(0).alias("channel"), "frame_idx", (F.col("rms") * F.col("rms") / 4).alias("rms"))


@query("frames")
def w1_detect_turns(f):
    return W.detect_turns(_live(f), W.Endpointing(frame_ms=160.0, voiced_ms=160.0)).select("session_id", "channel", "first_frame", "end_frame", "reason", *r6("peak_rms", "mean_rms"))


@query("turns", sql="""
WITH RECURSIVE s AS (SELECT recording_id AS session_id, (seq % 2)::INT AS channel, start_s, end_s, row_number() OVER (PARTITION BY recording_id, seq % 2 ORDER BY start_s, end_s) AS r FROM turns),
f AS (SELECT session_id, channel, r, 1 AS g, start_s, end_s, 1 AS parts FROM s WHERE r = 1 UNION ALL
  SELECT session_id, channel, r, CASE WHEN m THEN g ELSE g + 1 END, CASE WHEN m THEN a ELSE x END, y, CASE WHEN m THEN parts + 1 ELSE 1 END FROM (
    SELECT f.session_id, f.channel, s.r, f.g, f.start_s AS a, s.start_s AS x, s.end_s AS y, f.parts, s.start_s - f.end_s BETWEEN 0 AND 1 AND s.end_s - f.start_s <= 15 AS m FROM f JOIN s ON s.session_id = f.session_id AND s.channel = f.channel AND s.r = f.r + 1) z)
SELECT session_id, channel, round(arg_max(start_s, r), 6) AS start_s, round(arg_max(end_s, r), 6) AS end_s, max(parts) AS parts FROM f GROUP BY session_id, channel, g""")
def w2_coalesce_turns(t):
    return W.coalesce_turns(t.select(F.col("recording_id").alias("session_id"), (F.col("seq") % 2).cast("int").alias("channel"), "start_s", "end_s")).select("session_id", "channel", *r6("start_s", "end_s"), "parts")


@query("turns", sql="""
WITH RECURSIVE s AS (SELECT recording_id AS session_id, seq AS sequence, (seq % 2)::INT AS channel, start_s AS el, start_s + CASE WHEN seq % 4 = 3 THEN -3.0 WHEN seq % 6 = 5 THEN 40.0 ELSE 0 END AS a, end_s + CASE WHEN seq % 4 = 3 THEN -3.0 WHEN seq % 6 = 5 THEN 40.0 ELSE 0 END AS b, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS r FROM turns),
f AS (SELECT session_id, 0::BIGINT AS r, NULL::BIGINT AS sequence, NULL::INT AS channel, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::VARCHAR AS flag, 0.0::DOUBLE AS high, NULL::DOUBLE AS e0, NULL::DOUBLE AS e1 FROM s GROUP BY 1 UNION ALL
  SELECT session_id, r, sequence, channel, a, b, CASE WHEN back THEN 'start_sample_regression' WHEN a > reach + greatest(10.0, 0.05 * el) THEN 'start_sample_ahead_of_stream' END, greatest(high, b), CASE WHEN channel = 0 THEN greatest(a, b) ELSE e0 END, CASE WHEN channel = 1 THEN greatest(a, b) ELSE e1 END FROM (
    SELECT z.* EXCLUDE (a), CASE WHEN back THEN last ELSE a END AS a FROM (SELECT f.session_id, s.r, s.sequence, s.channel, s.a, s.b, s.el, f.high, f.e0, f.e1, greatest(f.high, s.el) AS reach, CASE WHEN s.channel = 0 THEN f.e0 ELSE f.e1 END AS last, coalesce(s.a < CASE WHEN s.channel = 0 THEN f.e0 ELSE f.e1 END - 0.05, false) AS back FROM f JOIN s ON s.session_id = f.session_id AND s.r = f.r + 1) z) y)
SELECT session_id, sequence, channel, round(a, 6) AS start_s, round(b, 6) AS end_s, flag FROM f WHERE r > 0""")
def w3_guard_timeline(t):
    late = F.when(F.col("seq") % 4 == 3, -3.0).when(F.col("seq") % 6 == 5, 40.0).otherwise(0.0)
    rows = t.select(F.col("recording_id").alias("session_id"), F.col("seq").alias("sequence"), (F.col("seq") % 2).cast("int").alias("channel"), (F.col("start_s") + late).alias("start_s"), (F.col("end_s") + late).alias("end_s"), F.col("start_s").alias("elapsed_s"))
    return W.guard_timeline(rows).select("session_id", "sequence", "channel", *r6("start_s", "end_s"), "flag")


@query("segments", sql="""
SELECT recording_id AS session_id, count(*) AS turns, sum((event_id % 5 = 0)::INT)::BIGINT AS non_speech, sum((event_id % 5 = 1)::INT)::BIGINT AS malformed, sum((event_id % 2 = 0)::INT)::BIGINT AS channel_0, sum((event_id % 2 = 1)::INT)::BIGINT AS channel_1,
  round(sum(end_s - start_s), 4) AS covered_sec, round(max(end_s), 4) AS reached_sec FROM segments GROUP BY 1""")
def w5_session_stats(s):
    k = F.col("event_id") % 5
    rows = s.select(F.col("recording_id").alias("session_id"), (F.col("event_id") % 2).alias("channel"), "start_s", "end_s", F.when(k == 0, "non_speech").when(k == 1, "malformed").otherwise("turn").alias("kind"))
    return W.session_stats(rows).withColumns({c: F.round(c, 4) for c in ("covered_sec", "reached_sec")})


@query("events", sql="""
WITH f AS (SELECT user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000000)::INT, 1) AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT user_id, count(*) AS events, date_diff('microsecond', min(ts), max(ts)) + 21600000000 AS open_us FROM i GROUP BY user_id, i""")
def w6_inactivity_sessions(e):
    got = W.inactivity_sessions(e.withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp")), "21600 seconds", "user_id")
    return got.select("user_id", "events", (F.unix_micros("expires") - F.unix_micros("opened")).alias("open_us"))


@query("events", sql="""
WITH r AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'bad_version' WHEN event_id % 11 = 0 THEN 'zero_samples' WHEN event_id % 13 = 0 THEN 'bad_length' END AS reject FROM events)
SELECT coalesce(reject, 'good') AS kind, count(*) AS n FROM r GROUP BY 1""")
def w7_validate_frames(e):
    n = F.when(F.col("event_id") % 11 == 0, 0).otherwise(512)
    p = e.select(F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 7 == 0, 9).otherwise(W.VERSION).alias("version"), n.alias("n_samples"), F.when(F.col("event_id") % 13 == 0, 7).otherwise(2 * n).alias("payload_bytes"))
    good, bad = W.validate_frames(p)
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.col("reject").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("items", "turns", sql=f"""
WITH {_ATTR} SELECT recording_id, seq, coalesce(speaker, 'Alice') AS final_speaker, speaker IS NULL AS from_live FROM att""")
def w8_reattribute(i, t):
    return A.reattribute(i.withColumn("speaker", F.lit("Alice")), t).select("recording_id", "seq", "final_speaker", "from_live")


@query("segments", sql="""
WITH g AS (SELECT recording_id AS session_id, event_id % 2 AS channel, CASE event_id % 6 WHEN 0 THEN 'dropped' WHEN 1 THEN 'drift' END AS kind, round(start_s, 6) AS at_s FROM segments)
SELECT * FROM g WHERE kind = 'dropped' UNION ALL SELECT session_id, channel, kind, min(at_s) FROM g WHERE kind = 'drift' GROUP BY ALL""")
def w9_gap_log(s):
    k = F.col("event_id") % 6
    return W.gap_log(s.select(F.col("recording_id").alias("session_id"), (F.col("event_id") % 2).alias("channel"), F.when(k == 0, "dropped").when(k == 1, "drift").alias("kind"), F.round("start_s", 6).alias("at_s")))


@query("items", "turns", sql=f"""
WITH {_RUNS} SELECT recording_id, length(string_agg('[' || coalesce(speaker, 'UNKNOWN') || '] hh:mm:ss.mmm - hh:mm:ss.mmm: ' || text, chr(10) ORDER BY start_s, seq)) + length('Transcript ' || recording_id) + 1 AS chars, count(*) AS segments FROM runs GROUP BY 1""")
def a9_a10_exports(i, t):
    r = A.attribute_items(i, t)
    side = A.export_sidecar(r).select("recording_id", F.json_array_length(F.get_json_object("json", "$.segments")).cast("long").alias("segments"))
    return A.export_text(r).select("recording_id", F.length("text").cast("long").alias("chars")).join(side, "recording_id")
