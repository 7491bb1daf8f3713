"""Queries over labels, names, text and sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronovox.functions import labels as L
from chronovox.functions import text as X
from chronovox.operators import boundary as B
from chronovox.plans.register import registry
from chronovox.sources import tables as S

QUERIES, ORACLES, query = registry()

_UNKNOWN = "(speaker IS NULL OR upper(trim(speaker)) IN ('', 'UNKNOWN'))"
_GENERIC = "coalesce(regexp_matches(trim(speaker), '(?i)^speaker[\\s_]*[0-9]+$'), false)"
_IDENT = f"(NOT {_UNKNOWN} AND trim(speaker) <> 'OVERLAP')"
_CONFIDENT = f"""({_IDENT} AND NOT uncertain AND NOT speaker_confidence < 0.35 AND NOT speaker_margin < 0.02 AND NOT (end_s - start_s > 0 AND end_s - start_s < 0.5))"""


@query("segments", sql=f"""
SELECT CASE WHEN {_UNKNOWN} THEN 'unknown' WHEN trim(speaker) = 'OVERLAP' THEN 'overlap' WHEN {_GENERIC} THEN 'generic' ELSE 'named' END AS class,
       CASE WHEN NOT {_IDENT} THEN 'unknown' WHEN {_GENERIC} THEN 'diarization_cluster' ELSE 'known_voiceprint' END AS source, count(*) AS n
FROM segments GROUP BY ALL""")
def b1_b2_label_classes(s):
    return s.groupBy(L.label_class(F.col("speaker")).alias("class"), L.evidence_source(F.col("speaker")).alias("source")).agg(F.count("*").alias("n"))


@query("segments", sql=f"SELECT recording_id, count(*) AS n, sum(CASE WHEN {_CONFIDENT} THEN 1 ELSE 0 END)::BIGINT AS confident FROM segments GROUP BY 1")
def b3_confident(s):
    return s.groupBy("recording_id").agg(F.count("*").alias("n"), F.count_if(L.is_confident()).alias("confident"))


@query("segments", sql=f"""
SELECT recording_id, seq, CASE WHEN {_CONFIDENT} THEN speaker END AS speaker, CASE WHEN NOT {_CONFIDENT} THEN speaker END AS original_speaker,
       CASE WHEN {_CONFIDENT} THEN speaker_confidence ELSE 0.0 END AS speaker_confidence, CASE WHEN NOT {_CONFIDENT} THEN 'low_evidence' END AS attribution_reason, text
FROM segments""")
def b4_suppress(s):
    return L.suppress(s, ~L.is_confident(), F.lit("low_evidence")).select("recording_id", "seq", "speaker", "original_speaker", "speaker_confidence", "attribution_reason", "text")


@query("segments", sql=f"""
SELECT CASE WHEN {_IDENT} AND {_GENERIC} THEN 'diarization_cluster' WHEN {_IDENT} THEN 'known_voiceprint' ELSE 'unknown' END AS speaker_source, uncertain, count(*) AS n FROM segments GROUP BY ALL""")
def b5_mark_confident(s):
    return L.mark_confident(s.withColumn("speaker_source", F.lit(None).cast("string"))).groupBy("speaker_source", "uncertain").agg(F.count("*").alias("n"))


@query("segments", sql="""
WITH m AS (SELECT DISTINCT recording_id, 'Speaker 1' AS speaker, concat('Carol ', cast(recording_id % 5 AS string)) AS new_name, round_even((recording_id % 97) / 97.0e0, 3) AS c, round_even((recording_id % 89) / 89.0e0, 4) AS g,
  round_even((recording_id % 83) / 83.0e0, 4) AS d FROM segments)
SELECT s.recording_id, s.seq, coalesce(m.new_name, s.speaker) AS speaker, CASE WHEN m.new_name IS NOT NULL THEN m.c ELSE s.speaker_confidence END AS speaker_confidence,
       CASE WHEN m.new_name IS NOT NULL THEN m.g ELSE s.speaker_margin END AS speaker_margin, m.d AS speaker_match_dist, CASE WHEN m.new_name IS NOT NULL THEN false ELSE s.uncertain END AS uncertain
FROM segments s LEFT JOIN m ON s.recording_id = m.recording_id AND s.speaker = m.speaker""")
def b6_apply_identity(s):
    r = F.col("recording_id")
    m = s.select("recording_id").distinct().select("recording_id", F.lit("Speaker 1").alias("old_name"), F.concat(F.lit("Carol "), (r % 5).cast("string")).alias("new_name"), ((r % 97) / 97.0).alias("confidence"), ((r % 89) / 89.0).alias("margin"), ((r % 83) / 83.0).alias("distance"))
    return L.apply_identity(s, m).select("recording_id", "seq", "speaker", "speaker_confidence", "speaker_margin", "speaker_match_dist", "uncertain")


_REFUSAL = f"""CASE WHEN {_UNKNOWN} THEN 'unknown_label' WHEN trim(speaker) = 'OVERLAP' THEN 'overlap' WHEN {_GENERIC} THEN 'generic_label' WHEN uncertain THEN 'uncertain'
  WHEN speaker_confidence < 0.35 THEN 'low_confidence' WHEN speaker_margin < 0.02 THEN 'low_margin' WHEN end_s - start_s > 0 AND end_s - start_s < 0.5 THEN 'too_short' END"""


@query("segments", sql=f"SELECT recording_id, {_REFUSAL} AS reason, count(*) AS n FROM segments GROUP BY ALL")
def b7_collect_refusal(s):
    return s.groupBy("recording_id", L.collect_refusal().alias("reason")).agg(F.count("*").alias("n"))


@query("segments", sql=f"""
SELECT recording_id, CASE WHEN {_UNKNOWN} THEN 'no_identity' WHEN trim(speaker) = 'OVERLAP' THEN 'overlap' WHEN uncertain THEN 'uncertain' WHEN speaker_confidence < 0.35 THEN 'low_confidence' END AS reason, count(*) AS n
FROM segments GROUP BY ALL""")
def b8_learn_refusal(s):
    return s.groupBy("recording_id", L.learn_refusal().alias("reason")).agg(F.count("*").alias("n"))


@query("customer", sql="SELECT c_custkey, trim(regexp_replace(lower(concat('  ', replace(c_name, '#', '   '), ' ')), '\\s+', ' ', 'g')) AS folded FROM customer")
def b12_normalise_name(c):
    return c.select("c_custkey", X.normalise_name(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("   ")), F.lit(" "))).alias("folded"))


_STEM = r"regexp_replace(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"
_LOW = f"(('0x' || right(md5({_STEM}), 8))::BIGINT)"
_HASH = " || ".join(f"substr('{X.HASH_ALPHABET}', ((({_LOW} >> {5 * i}) & 31) + 1)::INT, 1)" for i in range(6))


@query("pages", sql=f"SELECT page_id, {_HASH} AS fingerprint FROM pages")
def b13_source_hash(p):
    return p.select("page_id", X.source_hash(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))).alias("fingerprint"))


@query("pages", sql="""
SELECT CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'ABCDE0' ELSE '' END AS from_name, count(*) AS n FROM pages GROUP BY 1""")
def b14_filename_hash(p):
    k = F.col("page_id") % 3
    name = F.when(k == 0, F.concat(F.lit("/a/ABCDE0_"), F.col("page_id").cast("string"), F.lit("_manual.flac"))).when(k == 1, F.concat(F.lit("/a/ABCDE0_"), F.col("page_id").cast("string"), F.lit(".flac"))).otherwise(F.concat(F.lit("/a/x"), F.col("page_id").cast("string")))
    return p.groupBy(X.filename_hash(name).alias("from_name")).agg(F.count("*").alias("n"))


@query("pages", sql="SELECT page_id % 4 = 0 AS derived, count(*) AS n, count(CASE WHEN page_id % 4 = 0 THEN 'ABCDE0' END) AS by_name FROM pages GROUP BY 1")
def b15_source_identity(p):
    known = F.when(F.col("page_id") % 4 != 0, F.col("url"))
    got = p.withColumn("s", X.source_identity(known, F.lit("/a/ABCDE0_01-02.flac")))
    return got.groupBy("s.derived").agg(F.count("*").alias("n"), F.count(F.when(F.col("s.identity") == "ABCDE0", 1)).alias("by_name"))


@query("orders", sql="""
SELECT o_orderkey, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp, ms / 1000.0e0 AS parsed,
       CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60) ELSE printf('%02d:%02d', ms // 60000, (ms // 1000) % 60) END AS hms
FROM (SELECT o_orderkey, (o_orderkey * 977) % 9000000 AS ms FROM orders) o""")
def b16_times(o):
    sec = ((F.col("o_orderkey") * 977) % 9000000) / 1000.0
    return o.select("o_orderkey", X.format_time(sec).alias("stamp"), F.round(X.parse_time(X.format_time(sec)), 3).alias("parsed"), X.format_hms(sec).alias("hms"))


@query("part", sql="""
SELECT p_partkey, contains(' ' || p_name || ' ', ' ' || split_part(p_name, ' ', 1) || ' ') AS has_first, contains(' speaker ' || p_size || ' ', ' speaker 1 ') AS is_one FROM part""")
def b17_tokens(p):
    return p.select("p_partkey", X.tokens_contain(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("has_first"), X.tokens_contain(F.concat(F.lit("Speaker "), F.col("p_size").cast("string")), F.lit("speaker 1")).alias("is_one"))


@query("profiles", sql="SELECT pending AS is_pending, concat('pending_', regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_Speaker1') AS placeholder FROM profiles")
def b18_pending(p):
    return p.select(X.is_pending(F.col("name"), F.col("pending")).alias("is_pending"), X.pending_name(F.col("name"), F.lit("Speaker 1")).alias("placeholder"))


@query("segments", sql="""
SELECT recording_id, seq, row_number() OVER (PARTITION BY recording_id ORDER BY coalesce(CASE WHEN event_id % 4 > 0 THEN speaker_confidence END, 1.0) DESC, end_s - start_s DESC, seq) AS place FROM segments""")
def b19_span_fit(s):
    conf = F.coalesce(F.when(F.col("event_id") % 4 > 0, F.col("speaker_confidence")), F.lit(1.0))
    return s.select("recording_id", "seq", F.row_number().over(Window.partitionBy("recording_id").orderBy(conf.desc(), L.duration().desc(), "seq")).alias("place"))


@query("documents")
def b20_clean_text(d):
    """Loops over repeats have no SQL; tests hold it against a plain restatement."""
    once = X.of_whole_texts(d).select("doc_id", X.clean_text(F.col("text")).alias("clean"))
    return once.select("doc_id", F.length("clean").alias("n"), F.contains("clean", F.lit(X.MARK)).alias("marked"))


@query("documents", sql="SELECT lang, CASE lang WHEN 'auto' THEN NULL ELSE lang END AS code, count(*) AS n FROM documents GROUP BY ALL")
def b21_language(d):
    names = F.create_map(F.lit("en"), F.lit(" English "), F.lit("de"), F.lit("GERMAN"))
    return d.groupBy("lang", X.canonical_language(F.coalesce(F.try_element_at(names, F.col("lang")), F.col("lang"))).alias("code")).agg(F.count("*").alias("n"))


@query("events", sql="SELECT event_id, round_even(least(greatest(exp(-value / 100), 0.0), 1.0), 3) AS confidence FROM events")
def b22_logprob(e):
    return e.select("event_id", X.logprob_confidence(-F.col("value") / 100).alias("confidence"))


@query("conversations", sql="""
SELECT conv_id, turn, right(trim(regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s+', ' ', 'g')), 40) AS tail FROM conversations""")
def b23_context_tail(c):
    return c.select("conv_id", "turn", X.context_tail(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), 40).alias("tail"))


@query("segments", sql=f"""
SELECT recording_id, seq, CASE WHEN {_IDENT} AND NOT uncertain THEN speaker END AS shown_speaker, NOT ({_IDENT} AND NOT uncertain) AS shown_uncertain,
       CASE WHEN {_IDENT} THEN speaker WHEN event_id % 2 = 0 THEN 'UNKNOWN (no_turns)' ELSE 'UNKNOWN' END AS label FROM segments""")
def b24_b25_display(s):
    d = L.display_spans(s)
    return d.select("recording_id", "seq", "shown_speaker", "shown_uncertain", L.speaker_label(F.col("speaker"), F.when(F.col("event_id") % 2 == 0, "no_turns")).alias("label"))


@query("segments", sql=f"""
WITH r AS (SELECT *, {_REFUSAL} AS reason FROM segments), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY recording_id, seq) AS n FROM r WHERE reason IS NOT NULL)
SELECT reason, count(*) AS rows, string_agg(CASE WHEN n <= 25 THEN recording_id || ':' || seq END, ',' ORDER BY recording_id, seq) AS examples FROM k GROUP BY 1""")
def d11_refusal_report(s):
    r = B.reason_histogram(s, L.collect_refusal())
    return r.select("reason", "rows", F.array_join(F.transform("examples", lambda x: F.concat(x["recording_id"].cast("string"), F.lit(":"), x["seq"].cast("string"))), ",").alias("examples"))


@query("conversations", sql="""
SELECT conv_id, count(*) AS items, sum(length(text))::BIGINT AS chars FROM conversations WHERE conv_id % 5 > 0 AND trim(text) <> '' GROUP BY 1""")
def a5_parse_items(c):
    """Item lists written as JSON and read back; every fifth recording has a value that is no list."""
    js = c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")))).alias("j"))
    items, _ = S.parse_items(js.withColumn("j", F.when(F.col("conv_id") % 5 == 0, "{}").otherwise(F.col("j"))), "j", ["conv_id"])
    return items.groupBy("conv_id").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))


@query("conversations", sql="SELECT conv_id, count(*) AS segments, min(role) AS a_speaker FROM conversations WHERE conv_id % 7 > 0 GROUP BY 1")
def a4_read_transcripts(c):
    """Transcript JSON, every seventh broken: broken rows are passed over."""
    seg = F.struct(F.col("turn").cast("double").alias("start"), F.col("turn").cast("double").alias("end"), F.col("role").alias("speaker"), "text")
    js = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(seg).alias("segments"))).alias("result")).withColumn("result", F.when(F.col("conv_id") % 7 == 0, "{broken").otherwise(F.col("result")))
    got = S.read_transcripts(js)
    return got.select("conv_id", F.size("result.segments").cast("long").alias("segments"), F.array_min("result.segments.speaker").alias("a_speaker"))


@query("embeddings", sql="SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN embedding]), 6) AS total, len(embedding) AS width FROM embeddings")
def a2_unpack_embedding(e):
    """Vectors packed to float32 bytes, and unpacked."""
    from chronovox.functions.vectors import unpack_embedding

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    got = e.select("vec_id", unpack_embedding(pack("embedding")).alias("v"))
    return got.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("v").cast("long").alias("width"))
