"""The domain's tables, derived from the given ones in SQL that both Spark and DuckDB read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL over the given tables and earlier names.  {us}: microseconds of ts since 2024-01-01.
TABLES: dict[str, str] = {
    # events as speech segments: a user is a recording, an hour of the month a second
    "segments": """
        SELECT user_id % 4 AS tenant_id, user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
               {us} / 3.6e9 AS start_s, {us} / 3.6e9 + value / 4.0 AS end_s,
               CASE event_type WHEN 'click' THEN 'Alice' WHEN 'view' THEN 'Bob' WHEN 'purchase' THEN 'Speaker 1' WHEN 'signup' THEN 'OVERLAP' END AS speaker,
               event_id, (event_id % 101) / 100.0e0 AS speaker_confidence, (event_id % 61) / 1000.0e0 AS speaker_margin, event_id % 11 = 0 AS uncertain,
               concat('w', cast(event_id AS string), CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END) AS text, value
        FROM events""",
    # conversations as turns: sixteen characters are a second, pauses between turns
    "turns": """
        SELECT conv_id % 4 AS tenant_id, conv_id AS recording_id, turn AS seq,
               ((sum(n) OVER w) - n) / 16.0e0 + turn * 0.5e0 AS start_s, (sum(n) OVER w) / 16.0e0 + turn * 0.5e0 - (turn % 3) * 0.25e0 AS end_s,
               CASE role WHEN 'user' THEN 'Alice' WHEN 'assistant' THEN 'Bob' ELSE 'Speaker 3' END AS speaker,
               ((conv_id * 7 + turn * 13) % 100) / 100.0e0 AS speaker_confidence, (conv_id + turn) % 9 = 0 AS uncertain, text
        FROM (SELECT *, 16 + length(coalesce(text, '')) AS n FROM conversations) c
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    # each turn's words as three timed items, a little late
    "items": """
        SELECT tenant_id, recording_id, seq * 3 + k AS seq, start_s + (end_s - start_s) * k / 4.0e0 + 0.4e0 AS start_s, start_s + (end_s - start_s) * (k + 1) / 4.0e0 + 0.4e0 AS end_s,
               concat('t', cast(seq AS string), '.', cast(k AS string), CASE WHEN k = 2 THEN '.' ELSE '' END) AS text, ((recording_id + seq + k) % 10) / 10.0e0 AS confidence
        FROM turns CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks""",
    # events as frames: the n-th event of a user is its n-th frame
    "frames": """
        SELECT user_id AS recording_id, user_id % 2 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
               value / 500.0e0 AS rms, (event_id % 97) / 96.0e0 AS speech_prob, 80 + (event_id % 120) * 1.0e0 AS pitch_hz
        FROM events""",
    # vectors as windows of eight recordings, and as snippets of ten speakers
    "windows": """
        SELECT vec_id % 8 AS recording_id, vec_id AS win_id, vec_id AS seq, (vec_id - vec_id % 8) / 8 * 1.2e0 AS start_s, (vec_id - vec_id % 8) / 8 * 1.2e0 + 2.0e0 AS end_s,
               embedding, label AS cluster, CASE WHEN vec_id % 5 < 3 THEN concat('Speaker ', cast(label AS string)) END AS speaker
        FROM embeddings""",
    "snippets": """
        SELECT vec_id % 3 AS tenant_id, vec_id AS id, concat('Person ', cast(label AS string)) AS speaker_name, concat('f', cast(vec_id % 7 AS string)) AS source,
               1.0e0 + vec_id % 20 AS duration_sec, CASE WHEN vec_id % 13 > 0 THEN vec_id * 1.5e0 END AS start_sec, embedding, vec_id % 17 = 0 AS review_flag,
               CASE WHEN vec_id % 34 = 0 THEN (vec_id % 100) / 100.0e0 END AS review_score, md5(cast(vec_id % 211 AS string)) AS content_sha256,
               concat('/store/', cast(vec_id % 3 AS string), '/p', cast(label AS string), '/', cast(vec_id % 400 AS string), '.flac') AS file_path, vec_id % 1000 AS file_size
        FROM embeddings""",
    # customers and orders as a large profile store: a nation is a tenant
    "profiles": """
        SELECT c_nationkey AS tenant_id, c_name AS name, c_custkey, c_mktsegment, c_acctbal, c_custkey % 7 = 0 AS pending, abs(c_acctbal) AS total_speech_sec, 90 + (c_custkey % 80) * 1.0e0 AS pitch_hz
        FROM customer""",
    "clips": """
        SELECT c_nationkey AS tenant_id, c_name AS speaker_name, o_orderkey AS id, o_totalprice / 10000.0e0 AS duration_sec, o_orderpriority AS source, o_orderkey % 5000 AS start_sec,
               o_orderstatus AS status, o_custkey
        FROM orders JOIN customer ON o_custkey = c_custkey""",
}

_SPARK = {"us": "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))"}
_DUCK = {"us": "epoch_us(ts - INTERVAL 19723 DAY)"}
_NEEDS = {"items": ("turns",)}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name].format(**_SPARK)
    used = {t: frame(spark, sf_dir, t) for t in [*BASE, *TABLES] if t != name and f" {t}" in sql.replace("\n", " ") and (t in _NEEDS.get(name, ()) or t in BASE)}
    for t in used:
        sql = _named(sql, t)
    return spark.sql(sql, **used)


def _named(sql: str, table: str) -> str:
    import re

    return re.sub(rf"(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables that it needs as common table expressions."""
    every: list[str] = []
    for n in names:
        every += [*_NEEDS.get(n, ()), n]
    parts = ", ".join(f"{n} AS ({TABLES[n].format(**_DUCK)})" for n in dict.fromkeys(every))
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
