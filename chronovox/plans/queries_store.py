"""Queries over the profile store: totals, audits, budgets, reviews, renames, purges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from chronovox.functions.labels import collect_refusal
from chronovox.operators import speakers as P
from chronovox.operators import store as S
from chronovox.plans.register import registry
from chronovox.thresholds import DEFAULTS

QUERIES, ORACLES, query = registry()


def _profiles(s):
    """Every speaker of the snippets but the tenth, with a claimed total."""
    t = S.speaker_totals(s).where("speaker_name <> 'Person 9'")
    return t.select("tenant_id", F.col("speaker_name").alias("name"), (F.col("total_sec") * F.when(F.col("speaker_name") == "Person 3", 2.0).otherwise(1.0)).alias("total_speech_sec"), (F.col("speaker_name") == "Person 8").alias("pending"))


_T = "t AS (SELECT tenant_id, speaker_name, count(*) AS n, sum(duration_sec) AS total FROM snippets GROUP BY ALL), p AS (SELECT tenant_id, speaker_name AS name, total * CASE WHEN speaker_name = 'Person 3' THEN 2.0 ELSE 1.0 END AS claimed, speaker_name = 'Person 8' AS pending FROM t WHERE speaker_name <> 'Person 9')"


@query("profiles", sql="SELECT tenant_id, count(*) AS profiles FROM profiles WHERE NOT pending GROUP BY 1")
def a1_read_store(p):
    return p.where(~F.col("pending")).groupBy("tenant_id").agg(F.count("*").alias("profiles"))


@query("profiles", sql="""
SELECT tenant_id, name, CASE WHEN c_custkey % 3 = 0 THEN false ELSE pending END AS pending, CASE WHEN c_custkey % 2 = 0 THEN 1.0e0 ELSE total_speech_sec END AS total_speech_sec FROM profiles
UNION ALL SELECT tenant_id, concat(name, ' new'), false, 1.0e0 FROM profiles WHERE c_custkey % 50 = 0""")
def a6_upsert_profiles(p):
    k = F.col("c_custkey")
    old = p.select("tenant_id", "name", "pending", "total_speech_sec")
    pend = F.when(k % 3 == 0, False)
    # every second one gets a total, every third a flag, every fiftieth is new as well
    up = p.where((k % 2 == 0) | (k % 3 == 0)).select("tenant_id", "name", pend.alias("pending"), F.when(k % 2 == 0, 1.0).otherwise(F.col("total_speech_sec")).alias("total_speech_sec"))
    new = p.where(k % 50 == 0).select("tenant_id", F.concat("name", F.lit(" new")).alias("name"), F.lit(None).cast("boolean").alias("pending"), F.lit(1.0).alias("total_speech_sec"))
    return S.upsert_profiles(old, up.unionByName(new))


@query("clips", sql="""
SELECT tenant_id, count(*) AS clips, round(sum(duration_sec), 6) AS total FROM (SELECT tenant_id, duration_sec FROM clips WHERE id % 9 > 0 UNION ALL SELECT tenant_id, 1.0e0 FROM clips WHERE id % 100 = 1) x GROUP BY 1""")
def a7_append_delete_snippets(c):
    left = S.delete_snippets(c.select("tenant_id", "id", "duration_sec"), c.where(F.col("id") % 9 == 0))
    more = c.where(F.col("id") % 100 == 1).select("tenant_id", (-F.col("id")).alias("id"), F.lit(1.0).alias("duration_sec"))
    return S.append_snippets(left, more).groupBy("tenant_id").agg(F.count("*").alias("clips"), F.round(F.sum("duration_sec"), 6).alias("total"))


@query("conversations", sql="""
SELECT conv_id, left(sha256('{"role":"' || role || '","turn":' || turn || '}'), 16) AS file_hash FROM conversations WHERE turn = 0""")
def a8_save_transcripts(c):
    return S.save_transcripts(c.where("turn = 0").withColumn("result", F.struct("role", "turn"))).select("conv_id", "file_hash")


@query("clips", sql="SELECT tenant_id, speaker_name, count(*) AS snippets, round(sum(duration_sec), 6) AS total_sec FROM clips GROUP BY ALL")
def d1_speaker_totals(c):
    return S.speaker_totals(c).withColumn("total_sec", F.round("total_sec", 6))


@query("customer", "supplier", sql="SELECT DISTINCT c_nationkey AS tenant_id FROM customer UNION SELECT s_nationkey FROM supplier")
def d2_tenants(c, s):
    return S.tenants(c.select(F.col("c_nationkey").alias("tenant_id")), s.select(F.col("s_nationkey").alias("tenant_id")))


@query("customer", "supplier", sql="SELECT count(*) AS names FROM (SELECT c_name FROM customer UNION SELECT s_name FROM supplier) x")
def i1_union_names(c, s):
    return S.union_names(c.select("c_name"), s.select("s_name")).agg(F.count("*").alias("names"))


@query("snippets", sql="SELECT tenant_id, 'Person 9' AS speaker_name, 'snippets_without_profile' AS type FROM snippets WHERE speaker_name = 'Person 9' GROUP BY 1")
def c12_orphans(s):
    return S.orphans(_profiles(s), s)


@query("snippets", sql="""
WITH f AS (SELECT DISTINCT tenant_id, file_path AS file FROM snippets WHERE file_size % 4 < 3), k AS (SELECT s.tenant_id, s.id, f.file FROM snippets s LEFT JOIN f ON f.tenant_id = s.tenant_id AND f.file = s.file_path)
SELECT tenant_id, count(file) AS found, count(*) - count(file) AS missing FROM k GROUP BY 1""")
def c13_resolve_paths(s):
    """Half of the paths are known by their tail only; a quarter of the files is gone."""
    files = s.where(F.col("file_size") % 4 < 3).select("tenant_id", F.col("file_path").alias("path")).distinct()
    moved = s.withColumn("file_path", F.when(F.col("id") % 2 == 0, F.concat(F.lit("/old"), "file_path")).otherwise(F.col("file_path")))
    # a tail of the file name alone could meet another speaker's file: take two levels at least
    found, missing, _ = S.resolve_paths(moved.select("tenant_id", "id", "file_path"), files)
    good = found.join(s.select("tenant_id", "id", "file_path"), ["tenant_id", "id"]).where("file = file_path")
    a = good.groupBy("tenant_id").agg(F.count("*").alias("found"))
    return s.groupBy("tenant_id").agg(F.count("*").alias("n")).join(a, "tenant_id").select("tenant_id", "found", (F.col("n") - F.col("found")).alias("missing"))


@query("snippets", sql=f"""
WITH {_T} SELECT coalesce(t.tenant_id, p.tenant_id) AS tenant_id, coalesce(t.speaker_name, p.name) AS speaker_name, n AS snippets, total AS total_sec, p.name IS NOT NULL AS has_profile, coalesce(p.pending, false) AS pending FROM t FULL JOIN p ON t.tenant_id = p.tenant_id AND t.speaker_name = p.name""")
def c14_list_speakers(s):
    return S.list_speakers(_profiles(s), s)


@query("clips", sql="SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id, speaker_name ORDER BY duration_sec DESC, start_sec, id)::INT AS place FROM clips")
def h2_rank_snippets(c):
    return S.rank_snippets(c, S.SPEAKER).select("tenant_id", "id", "place")


@query("clips", sql="""
SELECT tenant_id, speaker_name, id, 'too_short' AS reason FROM clips WHERE duration_sec < 5
UNION ALL SELECT tenant_id, speaker_name, id, 'over_per_file_cap' FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, speaker_name, source ORDER BY duration_sec DESC, start_sec, id) AS r FROM clips WHERE duration_sec >= 5) x WHERE r > 2""")
def h3_plan_source_trim(c):
    return S.plan_source_trim(c, per_source=2)


@query("snippets", sql="""
SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY coalesce(review_score, 0) DESC, id)::INT AS place FROM snippets WHERE review_flag""")
def h1_review_queue(s):
    return S.review_queue(s).select("tenant_id", "id", "place")


@query("clips", sql="""
SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY start_sec DESC, id DESC)::INT AS place FROM clips QUALIFY place <= 20""")
def h1_history(c):
    return S.history(c.withColumn("created_at", F.col("start_sec")), 20).select("tenant_id", "id", "place")


@query("segments")
def h4_collect_snippets(s):
    p = s.select("tenant_id").distinct().select("tenant_id", F.explode(F.array(F.lit("Alice"), F.lit("Bob"))).alias("name"), F.lit(False).alias("pending"))
    got, _ = S.collect_snippets(s, p, collect_refusal())
    return got.select("tenant_id", "speaker_name", "recording_id", "seq", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "place")


@query("clips", sql="""
WITH d AS (SELECT * FROM clips QUALIFY row_number() OVER (PARTITION BY tenant_id, speaker_name, source, start_sec ORDER BY id) = 1), l AS (SELECT *, least(duration_sec, 30) AS d FROM d), n AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, speaker_name) AS n, sum(d) OVER (PARTITION BY tenant_id, speaker_name) AS t FROM l)
SELECT tenant_id, count(*) AS spans FROM n WHERE n >= 2 AND t >= 10 GROUP BY 1""")
def h5_learn_budget(c):
    rows = c.select("tenant_id", "speaker_name", "source", F.col("id").alias("span_id"), F.col("start_sec").cast("double").alias("start_s"), (F.col("start_sec") + F.col("duration_sec")).alias("end_s"))
    got = S.learn_budget(rows, per_source=1000, most=1e9)
    return got.groupBy("tenant_id").agg(F.count("*").alias("spans"))


@query("clips", sql="""
WITH f AS (SELECT tenant_id, speaker_name, source FROM clips WHERE status = 'P' GROUP BY ALL)
SELECT tenant_id, count(*) AS clips FROM (SELECT c.tenant_id, c.id FROM clips c LEFT JOIN f ON c.tenant_id = f.tenant_id AND c.speaker_name = f.speaker_name AND c.source = f.source WHERE f.source IS NULL UNION ALL SELECT tenant_id, id FROM clips WHERE status = 'P') x GROUP BY 1""")
def h6_replace_source(c):
    return S.replace_source(c, c.where("status = 'P'")).groupBy("tenant_id").agg(F.count("*").alias("clips"))


@query("snippets", "clips", sql="SELECT tenant_id, name AS speaker_name FROM (SELECT DISTINCT tenant_id, speaker_name AS name FROM snippets WHERE id % 5 = 0 UNION SELECT DISTINCT tenant_id, speaker_name FROM snippets WHERE speaker_name = 'Person 9') x")
def i2_rescan_targets(s, c):
    scan = s.select("tenant_id", "speaker_name", F.when(F.col("id") % 5 == 0, "changed").otherwise("same").alias("status"))
    return S.rescan_targets(scan, s, _profiles(s))


@query("customer", "supplier", sql="SELECT DISTINCT c_nationkey AS tenant_id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)")
def i4_owners_without_account(c, s):
    return S.owners_without_account(c.select(F.col("c_nationkey").alias("tenant_id")), s.where(F.col("s_suppkey") % 2 == 0).select(F.col("s_nationkey").alias("tenant_id")))


@query("snippets")
def s1_audit(s):
    p = _profiles(s).join(S.refit_profiles(s).select("tenant_id", "name", "embedding"), ["tenant_id", "name"])
    f = S.audit({"profiles": p, "snippets": s}, s.where(F.col("file_size") % 4 < 3).select("tenant_id", F.col("file_path").alias("path")).distinct())
    return f.groupBy("tenant_id", "type").agg(F.count("*").alias("findings"))


@query("snippets", sql="SELECT tenant_id, 'missing' AS type, speaker_name, id::VARCHAR AS details, row_number() OVER (PARTITION BY tenant_id ORDER BY speaker_name, id::VARCHAR)::INT AS place FROM snippets WHERE id % 3 = 0 QUALIFY place <= 50")
def h7_cap_findings(s):
    f = s.where(F.col("id") % 3 == 0).select("tenant_id", F.lit("missing").alias("type"), "speaker_name", F.col("id").cast("string").alias("details"))
    return S.cap_findings(f)


@query("profiles", sql="""
WITH n AS (SELECT tenant_id, lower(c_mktsegment) AS folded, list(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END) AS names FROM profiles GROUP BY ALL)
SELECT tenant_id, folded, len(names)::INT AS spellings FROM n WHERE len(names) > 1""")
def s2_name_collisions(p):
    rows = p.select("tenant_id", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"))
    return S.name_collisions(rows).select("tenant_id", "folded", F.size("names").alias("spellings"))


@query("snippets", sql="""
SELECT tenant_id, speaker_name, id, k AS kept_id FROM (SELECT *, min(id) OVER (PARTITION BY tenant_id, speaker_name, content_sha256) AS k FROM snippets) x WHERE id > k""")
def s3_duplicate_content(s):
    return S.duplicate_content(s)


@query("snippets", sql=f"WITH {_T} SELECT p.tenant_id, p.name AS speaker_name, claimed AS total_speech_sec, total AS total_sec FROM p JOIN t ON p.tenant_id = t.tenant_id AND p.name = t.speaker_name WHERE total > 0 AND claimed > 1.5 * total")
def s4_stale_totals(s):
    return S.stale_totals(_profiles(s), s).select("tenant_id", "speaker_name", "total_speech_sec", "total_sec")


@query("snippets", sql="""
WITH d AS (SELECT *, min(id) OVER (PARTITION BY tenant_id, speaker_name, content_sha256) AS k FROM snippets), r AS (SELECT *, CASE WHEN id > k THEN 'duplicate' WHEN id % 50 = 7 THEN 'dead' WHEN duration_sec < 5 THEN 'too_short' END AS reason FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, speaker_name, source, reason IS NULL ORDER BY duration_sec DESC, start_sec ASC NULLS LAST, id) AS place FROM r)
SELECT tenant_id, coalesce(reason, 'over_per_file_cap') AS reason, count(*) AS rows FROM t WHERE reason IS NOT NULL OR place > 10 GROUP BY ALL""")
def s5_cleanup(s):
    rows = s.withColumn("source_audio", F.col("source"))
    plan = S.cleanup({"profiles": _profiles(s), "snippets": rows}, s.where(F.col("id") % 50 == 7))
    return plan.groupBy("tenant_id", "reason").agg(F.count("*").alias("rows"))


@query("snippets", sql="""
WITH g AS (SELECT tenant_id, speaker_name AS name, sum(duration_sec) FILTER (duration_sec >= 1.5) AS total_speech_sec, count(*) FILTER (duration_sec >= 1.5) AS sample_count, count(*) FILTER (duration_sec < 1.5) AS dropped FROM snippets GROUP BY ALL) SELECT * FROM g""")
def d6_refit_profiles(s):
    return S.refit_profiles(s).drop("embedding")


@query("snippets")
def s6_score_outliers(s):
    return S.score_outliers(s).select("tenant_id", "id", F.round("distance", 5).alias("distance"), F.round("cut", 5).alias("cut"), "outlier")


@query("snippets")
def s7_consolidate(s):
    _, fit = S.consolidate(s)
    return fit.select("tenant_id", "name", "sample_count", "flagged", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"))


@query("snippets", sql="SELECT tenant_id, count(*) AS left_rows, count(*) FILTER (id % 4 > 0 AND id % 17 = 0) AS marked FROM snippets GROUP BY 1")
def s8_resolve_review(s):
    got = S.resolve_review(s.withColumn("review_reason", F.lit(None).cast("string")), s.where(F.col("id") % 4 == 0))
    return got.groupBy("tenant_id").agg(F.count("*").alias("left_rows"), F.count_if("review_flag").alias("marked"))


@query("snippets", "turns", sql="""
SELECT tenant_id, count(*) FILTER (speaker = 'Alice') AS old_name, count(*) FILTER (speaker = 'Bob') AS other FROM (SELECT tenant_id, CASE WHEN speaker = 'Alice' AND tenant_id % 3 < 2 THEN 'Anna' ELSE speaker END AS speaker FROM turns) x GROUP BY 1""")
def s9_rename_speaker(s, t):
    """Nested transcripts renamed: Alice is Anna with the tenants that ask for it."""
    tr = t.groupBy("tenant_id", "recording_id").agg(F.collect_list(F.struct("seq", "speaker")).alias("segments"))
    p = t.select("tenant_id", F.col("speaker").alias("name")).distinct()
    sn = t.select("tenant_id", F.col("speaker").alias("speaker_name"), F.col("seq").alias("id"))
    m = p.where("name = 'Alice' AND tenant_id % 3 < 2").select("tenant_id", F.col("name").alias("old_name"), F.lit("Anna").alias("new_name"))
    out, _ = S.rename_speaker({"profiles": p, "snippets": sn, "transcripts": tr}, m)
    x = out["transcripts"].select("tenant_id", F.explode("segments.speaker").alias("speaker"))
    return x.groupBy("tenant_id").agg(F.count_if(F.col("speaker") == "Alice").alias("old_name"), F.count_if(F.col("speaker") == "Bob").alias("other"))


@query("snippets", sql="""
SELECT tenant_id, CASE WHEN speaker_name = 'Person 8' THEN 'Person 1' ELSE speaker_name END AS speaker_name, count(*) AS snippets FROM snippets GROUP BY ALL""")
def s10_merge_speakers(s):
    m = s.select("tenant_id").distinct().select("tenant_id", F.lit("Person 8").alias("old_name"), F.lit("Person 1").alias("new_name"))
    p = _profiles(s).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("sample_count", F.lit(0).cast("long"))
    out = S.merge_speakers({"profiles": p, "snippets": s}, m)
    return out["snippets"].groupBy("tenant_id", "speaker_name").agg(F.count("*").alias("snippets"))


@query("snippets", sql="""
SELECT DISTINCT tenant_id, speaker_name AS pending_name, CASE WHEN speaker_name <> 'Person 8' THEN 'not_pending' WHEN tenant_id = 0 THEN 'no_name' WHEN tenant_id = 1 THEN 'name_taken' END AS error FROM snippets""")
def s10_confirm_pending(s):
    new = F.when(F.col("tenant_id") == 0, " ").when(F.col("tenant_id") == 1, "Person 1").otherwise("Somebody")
    req = s.select("tenant_id", F.col("speaker_name").alias("pending_name")).distinct().withColumn("new_name", new)
    return S.confirm_pending(_profiles(s), req).select("tenant_id", "pending_name", "error")


@query("snippets", sql="""
SELECT tenant_id, CASE WHEN id % 10 = 0 THEN CASE WHEN duration_sec >= 1.5 THEN 'new' ELSE 'ignored' END WHEN id % 10 = 1 THEN 'gone' WHEN id % 10 = 2 THEN 'unfingerprinted' WHEN id % 10 = 3 THEN 'changed' ELSE 'same' END AS status, count(*) AS files FROM snippets GROUP BY ALL""")
def s11_rescan(s):
    path = F.concat(F.lit("/s/"), F.col("id").cast("string"))
    k = F.col("id") % 10
    inv = s.where(k != 1).select("tenant_id", path.alias("path"), F.col("file_size").alias("size"), F.lit(1.0).alias("mtime"), "duration_sec", "speaker_name")
    sn = s.where(k != 0).select("tenant_id", "id", path.alias("file_path"), F.when(k != 2, F.col("file_size") + F.when(k == 3, 1).otherwise(0)).alias("file_size"), F.lit(1.0).alias("file_mtime"), "speaker_name")
    return S.rescan(inv, sn).groupBy("tenant_id", "status").agg(F.count("*").alias("files"))


@query("customer", "supplier", "orders", sql="""
WITH a AS (SELECT c_nationkey AS t, 'customer' AS s FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier WHERE s_suppkey % 3 = 0), r AS (SELECT t, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM a GROUP BY 1),
n AS (SELECT c_nationkey AS t, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT coalesce(r.t, n.t) AS tenant_id, sources, coalesce(orders, 0) AS orders, sources IS NOT NULL AS has_account FROM r FULL JOIN n ON r.t = n.t""")
def s12_tenant_roster(c, s, o):
    t = F.col("c_nationkey").alias("tenant_id")
    owned = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(t)
    return S.tenant_roster({"customer": c.select(t), "supplier": s.where(F.col("s_suppkey") % 3 == 0).select(F.col("s_nationkey").alias("tenant_id"))}, {"orders": owned})


@query("clips", "profiles", sql="""
SELECT 'clips' AS "table", tenant_id, count(*) AS rows FROM clips WHERE tenant_id < 5 GROUP BY 2 UNION ALL SELECT 'profiles', tenant_id, count(*) FROM profiles WHERE tenant_id < 5 GROUP BY 2""")
def s13_purge_tenant(c, p):
    ids = p.where("tenant_id < 5").select("tenant_id").distinct()
    return S.purge_tenant({"clips": c, "profiles": p}, ids)[1]


@query("snippets", sql="""
SELECT tenant_id, speaker_name, string_agg(DISTINCT CASE WHEN id % 2 = 0 THEN 'stale_total' ELSE 'missing_file' END, ',' ORDER BY CASE WHEN id % 2 = 0 THEN 'stale_total' ELSE 'missing_file' END) AS reasons FROM snippets WHERE id % 7 = 0 AND tenant_id > 0 GROUP BY ALL""")
def s14_rebuild_targets(s):
    f = s.where(F.col("id") % 7 == 0).select("tenant_id", "speaker_name", F.when(F.col("id") % 2 == 0, "stale_total").otherwise("missing_file").alias("type"))
    first = S.rebuild_targets(f)
    done = first.where("tenant_id = 0").select("fingerprint", F.lit("done").alias("status"), F.lit(1).alias("attempts"))
    return S.rebuild_targets(f, done).select("tenant_id", "speaker_name", "reasons")


@query("snippets", sql="""
SELECT tenant_id, speaker_name, CASE WHEN max((duration_sec >= 1.5 AND NOT (speaker_name = 'Person 2' OR id % 11 = 0))::INT) = 1 THEN 'refitted' ELSE 'dropped' END AS status FROM snippets WHERE speaker_name IN ('Person 1', 'Person 2') GROUP BY ALL""")
def s15_rebuild_profiles(s):
    t = s.where(F.col("speaker_name").isin("Person 1", "Person 2")).select("tenant_id", "speaker_name")
    dead = s.where((F.col("speaker_name") == "Person 2") | (F.col("id") % 11 == 0))
    p = _profiles(s).withColumns({"embedding": F.lit(None).cast("array<double>"), "sample_count": F.lit(0).cast("long")})
    return S.rebuild_profiles({"profiles": p, "snippets": s}, t, dead)[1]


@query("snippets", sql="SELECT tenant_id, count(*) AS snippets FROM snippets WHERE speaker_name <> 'Person 4' GROUP BY 1")
def s16_delete_speakers(s):
    n = s.select("tenant_id").distinct().withColumn("name", F.lit("Person 4"))
    return S.delete_speakers({"profiles": _profiles(s), "snippets": s}, n)["snippets"].groupBy("tenant_id").agg(F.count("*").alias("snippets"))


@query("profiles", sql="SELECT tenant_id, count(*) AS profiles FROM profiles WHERE NOT pending AND c_custkey % 5 > 0 GROUP BY 1")
def s17_matchable_profiles(p):
    from chronovox.operators.identity import matchable_profiles

    rows = p.withColumn("name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Speaker "), F.col("c_custkey").cast("string"))).otherwise(F.col("name")))
    return matchable_profiles(rows).groupBy("tenant_id").agg(F.count("*").alias("profiles"))


@query("profiles", "clips", sql="""
WITH t AS (SELECT tenant_id, speaker_name, sum(duration_sec) AS s FROM clips GROUP BY ALL) SELECT p.tenant_id, name, round(coalesce(s, total_speech_sec), 6) AS total_speech_sec FROM profiles p LEFT JOIN t ON t.tenant_id = p.tenant_id AND t.speaker_name = p.name""")
def s18_fix_totals(p, c):
    t = S.speaker_totals(c).select("tenant_id", F.col("speaker_name").alias("name"), F.col("total_sec").alias("total_speech_sec"))
    return S.fix_totals(p, t).select("tenant_id", "name", F.round("total_speech_sec", 6).alias("total_speech_sec"))


@query("segments", sql="""
WITH r AS (SELECT recording_id, seq, speaker, CASE WHEN speaker IS NULL THEN 'unknown_label' WHEN speaker = 'OVERLAP' THEN 'overlap' WHEN speaker = 'Speaker 1' THEN 'generic_label' WHEN uncertain THEN 'uncertain' WHEN speaker_confidence < 0.35 THEN 'low_confidence' WHEN speaker_margin < 0.02 THEN 'low_margin'
  WHEN end_s - start_s > 0 AND end_s - start_s < 0.5 THEN 'too_short' END AS reason FROM segments)
SELECT recording_id, count(*) FILTER (reason IS NULL) AS collected, count(*) FILTER (reason = 'generic_label') AS learnable, count(*) FILTER (reason IS NOT NULL AND reason <> 'generic_label') AS refused FROM r GROUP BY 1""")
def d12_learning_summary(s):
    r = s.withColumn("reason", collect_refusal())
    return r.groupBy("recording_id").agg(F.count_if(F.col("reason").isNull()).alias("collected"), F.count_if(F.col("reason") == "generic_label").alias("learnable"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "generic_label")).alias("refused"))


@query("snippets", sql="""
WITH g AS (SELECT *, 80.0e0 + id % 90 AS pitch, (id % 7) / 10.0e0 AS rms FROM snippets WHERE duration_sec >= 1.5), m AS (SELECT *, least(duration_sec, 4 * median(duration_sec) OVER (PARTITION BY tenant_id, speaker_name)) AS w FROM g),
x AS (SELECT tenant_id, speaker_name, w, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS v FROM m), c AS (SELECT tenant_id, speaker_name, p, sum(v * w) / sum(w) AS m FROM x GROUP BY ALL), n AS (SELECT tenant_id, speaker_name, sqrt(sum(m * m)) AS n, any_value(m) FILTER (p = 1) AS first FROM c GROUP BY ALL),
s AS (SELECT tenant_id, speaker_name, sum(pitch * duration_sec) / sum(duration_sec) AS pitch, sum(rms * duration_sec) / sum(duration_sec) AS rms FROM g GROUP BY ALL)
SELECT n.tenant_id, n.speaker_name AS name, round(first / n, 6) AS first, round(pitch, 6) AS pitch_hz, round(rms, 6) AS energy_rms, n.speaker_name = 'Person 9' AS pending FROM n JOIN s USING (tenant_id, speaker_name)""")
def d6_refit_store(s):
    """Vectors of length 1, pitch and energy of all profiles anew, put into the store: who was pending stays so."""
    rows = s.withColumns({"pitch_hz": F.lit(80.0) + F.col("id") % 90, "energy_rms": (F.col("id") % 7) / 10.0})
    fit = S.refit_profiles(rows).drop("dropped", "sample_count")
    old = fit.select("tenant_id", "name", F.array(F.lit(0.0)).alias("embedding"), F.lit(0.0).alias("total_speech_sec"), F.lit(0.0).alias("pitch_hz"), F.lit(0.0).alias("energy_rms"), (F.col("name") == "Person 9").alias("pending"))
    new = S.upsert_profiles(old, fit)
    return new.select("tenant_id", "name", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round("pitch_hz", 6).alias("pitch_hz"), F.round("energy_rms", 6).alias("energy_rms"), "pending")


@query("snippets")
def h5_learn_profiles(s):
    """Snippets as spans of new voices: what is learned of each, and what is not."""
    rows = s.select("tenant_id", "speaker_name", "source", F.col("id").alias("span_id"), F.coalesce("start_sec", F.lit(0.0)).alias("start_s"), (F.coalesce("start_sec", F.lit(0.0)) + F.col("duration_sec") * 3).alias("end_s"), "embedding")
    clips, people, skipped = S.learn_profiles(rows, th=replace(DEFAULTS, cohesion=1.01))
    done = clips.groupBy("tenant_id", "speaker_name").agg(F.count("*").alias("clips"), F.round(F.sum("duration_sec"), 4).alias("seconds"))
    done = done.join(people.select("tenant_id", F.col("name").alias("speaker_name"), "pending"), ["tenant_id", "speaker_name"]).withColumn("reason", F.lit(None).cast("string"))
    return done.unionByName(skipped.select("tenant_id", "speaker_name", F.lit(0).cast("long").alias("clips"), F.lit(0.0).alias("seconds"), F.lit(None).cast("boolean").alias("pending"), "reason"))


@query("segments")
def h4_collection_told(s):
    """Why speakers of each recording gave clips or not."""
    p = s.select("tenant_id").distinct().select("tenant_id", F.explode(F.array(F.lit("Alice"), F.lit("Cid"))).alias("name"), F.lit(False).alias("pending"))
    _, told = S.collect_snippets(s, p, collect_refusal())
    return told.select("tenant_id", "recording_id", "speaker_name", "spans", "skipped", "snippets", F.round("added_sec", 4).alias("added_sec"), "over_per_file_cap", "too_short_after_trim")


@query("segments", sql="""
WITH r AS (SELECT *, CASE WHEN speaker IS NULL THEN 'unknown_label' WHEN speaker = 'OVERLAP' THEN 'overlap' WHEN speaker = 'Speaker 1' THEN 'generic_label' WHEN uncertain THEN 'uncertain' WHEN speaker_confidence < 0.35 THEN 'low_confidence' WHEN speaker_margin < 0.02 THEN 'low_margin'
  WHEN end_s - start_s > 0 AND end_s - start_s < 0.5 THEN 'too_short' END AS reason FROM segments)
SELECT recording_id, count(*) FILTER (reason IS NULL) AS snippets_added, count(*) FILTER (reason IS NOT NULL) AS refused_total, count(*) FILTER (reason = 'uncertain') AS uncertain, least(count(*) FILTER (reason IS NOT NULL), 8)::INT AS told FROM r GROUP BY 1""")
def d12_learning_counts(s):
    r = s.withColumn("reason", collect_refusal())
    bad = r.where("reason IS NOT NULL").select("recording_id", F.col("seq").cast("string").alias("cluster"), "reason")
    got = P.learning_summary(r.where("reason IS NULL").select("recording_id"), bad, bad.where("false").withColumnRenamed("cluster", "speaker"), bad.select("recording_id", "reason"), ["recording_id"])
    many = F.coalesce(F.element_at("refused_reasons", "uncertain"), F.lit(0))
    return got.select("recording_id", "snippets_added", "refused_total", many.cast("long").alias("uncertain"), F.when(F.col("not_learned").isNull(), 0).otherwise(F.size("not_learned")).alias("told"))
