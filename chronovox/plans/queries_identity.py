"""Queries over voice vectors: distances, clusters, names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from chronovox.functions import vectors as V
from chronovox.operators import clustering as C
from chronovox.operators import identity as N
from chronovox.operators import speakers as P
from chronovox.operators.pruned import farthest
from chronovox.plans.register import registry
from chronovox.streaming import live as W
from chronovox.thresholds import DEFAULTS

QUERIES, ORACLES, query = registry()

_DOT = "list_sum([{a}[i]::DOUBLE * {b}[i]::DOUBLE FOR i IN range(1, len({a}) + 1)])"


def dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def cos(a: str, b: str) -> str:
    return f"(1.0 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


#: Mean vector per label: averaged by position.
_CENTROID = """
x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, p, avg(v) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY p) AS v FROM m GROUP BY 1)"""


def _profiles(e):
    """A profile for each label: its centroid, with pitch, speech and a pending flag."""
    c = V.centroid(e, ["label"])
    k = F.col("label")
    return c.select(F.lit(0).alias("t"), k.alias("label"), F.concat(F.lit("P"), k.cast("string")).alias("name"), F.col("centroid").alias("embedding"), (100.0 + k * 10).alias("pitch_hz"), (F.lit(10.0) * (k + 1)).alias("total_speech_sec"), (k == 9).alias("pending"))


_PROFILES = f"{_CENTROID}, prof AS (SELECT label, concat('P', label) AS name, v, 100.0e0 + label * 10 AS pitch, 10.0e0 * (label + 1) AS sec, label = 9 AS pending FROM c)"


@query("embeddings", sql=f"SELECT vec_id, round({cos('embedding', 'list_reverse(embedding)')}, 6) AS d, round({dot('embedding', 'embedding')}, 6) AS n2 FROM embeddings")
def b9_b10_distance_and_norm(e):
    u = V.l2_normalize(F.col("embedding"))
    return e.select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.reverse("embedding")), 6).alias("d"), F.round(V.dot(u, u) * V.dot(F.col("embedding"), F.col("embedding")), 6).alias("n2"))


@query("profiles", sql="""
WITH d AS (SELECT c_custkey, round_even(greatest(0.9 * ((c_custkey % 100) / 128.0e0) + 0.1 * CASE WHEN pitch_hz > 100 THEN least(abs(pitch_hz - 130) / 50, 1.0) ELSE 0 END - CASE WHEN c_custkey % 2 = 0 THEN 0.05 ELSE 0 END, 0), 4) AS d FROM profiles)
SELECT c_custkey, round(d, 3) AS distance FROM d WHERE c_custkey % 100 % 8 = 0""")
def b11_match_distance(p):
    pitch = F.when(F.col("pitch_hz") > 100, F.col("pitch_hz")).otherwise(0.0)
    d = V.match_distance((F.col("c_custkey") % 100) / 128.0, pitch, F.lit(130.0), F.col("c_custkey") % 2 == 0)
    return p.select("c_custkey", F.round(d, 3).alias("distance")).where(F.col("c_custkey") % 100 % 8 == 0)


@query("profiles")
def b11_match_distance_all(p):
    """Every profile's distance; without SQL, as engines may round a tie either way."""
    pitch = F.when(F.col("pitch_hz") > 100, F.col("pitch_hz")).otherwise(0.0)
    d = V.match_distance((F.col("c_custkey") % 100) / 128.0, pitch, F.lit(130.0), F.col("c_custkey") % 2 == 0)
    return p.select("c_custkey", d.alias("distance"))


@query("embeddings", sql=f"WITH {_CENTROID} SELECT label, p::INT - 1 AS pos, round(m, 6) AS mean FROM m")
def d3_centroid(e):
    return V.centroid(e, ["label"]).select("label", F.posexplode("centroid").alias("pos", "mean")).select("label", "pos", F.round("mean", 6).alias("mean"))


@query("snippets", sql="""
WITH w AS (SELECT *, least(duration_sec, 4 * median(duration_sec) OVER (PARTITION BY tenant_id, speaker_name)) AS w FROM snippets), x AS (SELECT tenant_id, speaker_name, w, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM w)
SELECT tenant_id, speaker_name, pos::INT AS pos, round(sum(v * w) / sum(w), 6) AS mean FROM x GROUP BY ALL""")
def d4_weighted_centroid(s):
    c = V.weighted_centroid(s, ["tenant_id", "speaker_name"])
    return c.select("tenant_id", "speaker_name", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("windows", sql=f"""
SELECT a.recording_id, round(avg({cos('a.embedding', 'b.embedding')}), 6) AS mean_distance, round(max({cos('a.embedding', 'b.embedding')}), 6) AS max_distance FROM windows a JOIN windows b ON a.recording_id = b.recording_id AND a.win_id < b.win_id GROUP BY 1""")
def d5_pairwise_stats(w):
    return V.pairwise_mean(w, ["recording_id"]).join(farthest(w, ["recording_id"], "win_id"), "recording_id").select("recording_id", F.round("mean_distance", 6).alias("mean_distance"), F.round("max_distance", 6).alias("max_distance"))


@query("windows", sql="""
WITH c AS (SELECT recording_id, cluster, count(*) AS size FROM windows WHERE recording_id % 2 = 0 OR cluster < 2 OR win_id % 97 = 0 GROUP BY ALL), s AS (SELECT *, size / sum(size) OVER (PARTITION BY recording_id) AS share, count(*) OVER (PARTITION BY recording_id) AS clusters FROM c), t AS (SELECT *, max(share) OVER (PARTITION BY recording_id) AS top FROM s)
SELECT recording_id, cluster, size, clusters, round(share, 6) AS share, CASE WHEN clusters >= 2 AND top > 0.75 THEN concat('cluster_collapse_', round(top * 100)::INT, '%') END AS naming_block FROM t""")
def d9_cluster_balance(w):
    rows = w.where((F.col("recording_id") % 2 == 0) | (F.col("cluster") < 2) | (F.col("win_id") % 97 == 0))
    return C.cluster_balance(rows).select("recording_id", "cluster", "size", "clusters", F.round("share", 6).alias("share"), "naming_block")


@query("windows", sql="""
WITH r AS (SELECT recording_id, CASE WHEN recording_id % 2 = 0 OR cluster < 2 OR win_id % 97 = 0 THEN cluster ELSE 0 END AS cluster FROM windows), c AS (SELECT recording_id, cluster, count(*) AS size FROM r GROUP BY ALL), s AS (SELECT *, size / sum(size) OVER (PARTITION BY recording_id) AS share, count(*) OVER (PARTITION BY recording_id) AS clusters FROM c), t AS (SELECT *, max(share) OVER (PARTITION BY recording_id) AS top FROM s)
SELECT recording_id, cluster, size, clusters, round(share, 6) AS share, CASE WHEN clusters >= 2 AND top > 0.75 THEN concat('cluster_collapse_', round(top * 100)::INT, '%') END AS naming_block FROM t""")
def d9_cluster_balance_all(w):
    """All windows; in every other recording most of them are of one cluster."""
    own = (F.col("recording_id") % 2 == 0) | (F.col("cluster") < 2) | (F.col("win_id") % 97 == 0)
    rows = w.withColumn("cluster", F.when(own, F.col("cluster")).otherwise(0))
    return C.cluster_balance(rows).select("recording_id", "cluster", "size", "clusters", F.round("share", 6).alias("share"), "naming_block")


@query("embeddings", sql=f"""
WITH {_PROFILES} SELECT vec_id, name, round({cos('e.embedding', 'prof.v')}, 6) AS distance FROM embeddings e, prof""")
def c9_distance_matrix(e):
    p = _profiles(e).select("t", "name", F.col("embedding").alias("ref_embedding"))
    return C.distance_matrix(e.withColumn("t", F.lit(0)), p, ["t"]).select("vec_id", "name", F.round("distance", 6).alias("distance"))


def _queries(e):
    return e.select(F.lit(0).alias("t"), F.col("vec_id").alias("query_id"), "embedding", (F.lit(120.0) + F.col("vec_id") % 9).alias("pitch_hz"))


_SCORED = f"""{_PROFILES}, sc AS (SELECT vec_id, name, sec, {cos('e.embedding', 'prof.v')} AS emb, abs(120.0e0 + vec_id % 9 - pitch) AS dp, pending FROM embeddings e, prof),
d AS (SELECT *, round_even(greatest(0.9 * emb + 0.1 * least(dp / 50.0, 1.0), 0), 4) AS dist FROM sc)"""


@query("embeddings", sql=f"""
WITH {_SCORED} SELECT vec_id AS query_id, name, row_number() OVER (PARTITION BY vec_id ORDER BY dist, name)::INT AS rank FROM d WHERE NOT pending QUALIFY rank <= 3""")
def c10_identify(e):
    return N.identify(_queries(e), _profiles(e), ["t"], 3).select("query_id", "name", "rank")


def _many(e):
    """Each vector as a profile of one of 3 tenants."""
    return e.select((F.col("vec_id") % 3).alias("tenant_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")


@query("embeddings", sql=f"""
WITH p AS (SELECT vec_id % 3 AS tenant_id, concat('v', vec_id) AS name, embedding FROM embeddings), d AS (SELECT a.tenant_id, a.name AS a, b.name AS b, {cos('a.embedding', 'b.embedding')} AS x FROM p a JOIN p b ON a.tenant_id = b.tenant_id AND a.name < b.name)
SELECT tenant_id, a, b, round(x, 6) AS distance FROM d WHERE x <= 0.7""")
def c11_near_duplicates(e):
    return N.near_duplicate_profiles(_many(e), ["tenant_id"], 0.7).withColumn("distance", F.round("distance", 6))


@query("windows", "embeddings", sql=f"""
WITH {_CENTROID}, r AS (SELECT *, sum(end_s - start_s) OVER (PARTITION BY recording_id, cluster ORDER BY end_s - start_s DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM windows),
own AS (SELECT recording_id, cluster, avg(embedding[1]::DOUBLE) FILTER (coalesce(before, 0) < 30) AS first, any_value(len(embedding)) AS width FROM r GROUP BY ALL)
SELECT recording_id, concat('P', cluster) AS speaker, cluster < 5 AS stored, round(CASE WHEN cluster < 5 THEN v[1] ELSE first END, 6) AS first, width::INT AS width FROM own LEFT JOIN c ON c.label = cluster""")
def c15_speaker_refs(w, e):
    turns = w.select("recording_id", "seq", "start_s", "end_s", F.concat(F.lit("P"), F.col("cluster").cast("string")).alias("speaker"))
    # the profiles of the upper labels carry other names, which no speaker has
    name = F.when(F.col("label") < 5, F.col("name")).otherwise(F.concat(F.lit("other "), F.col("name")))
    refs = N.speaker_refs(turns, _profiles(e).withColumn("name", name), w)
    return refs.select("recording_id", "speaker", "stored", F.round(F.element_at("ref", 1), 6).alias("first"), F.size("ref").alias("width"))


# -- clustering -------------------------------------------------------------------------------------


@query("windows")
def g1_agglomerate(w):
    return C.agglomerate(w, 0.75, small=C.WHOLE)


@query("windows")
def g2_agglomerate_k(w):
    return C.agglomerate_k(w, 4, "complete", small=C.WHOLE)


@query("windows")
def g3_cap_clusters(w):
    rows = w
    return C.cap_clusters(rows, C.agglomerate(rows, 0.3, small=C.WHOLE), 15, small=C.WHOLE)


@query("windows")
def g4_greedy_merge(w):
    rows = w.drop("cluster")
    labels = w.select("recording_id", "win_id", F.col("cluster").cast("long").alias("cluster"))
    return C.greedy_merge(rows, labels, 0.5)


_WC = """x AS (SELECT recording_id, cluster, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS v FROM windows), m AS (SELECT recording_id, cluster, p, avg(v) AS m FROM x GROUP BY ALL), c AS (SELECT recording_id, cluster, list(m ORDER BY p) AS v FROM m GROUP BY ALL)"""


@query("windows", sql=f"""
WITH {_WC}, d AS (SELECT w.recording_id, w.win_id, c.cluster, {cos('w.embedding', 'c.v')} AS d FROM windows w JOIN c USING (recording_id)), r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, win_id ORDER BY d, cluster) AS r FROM d),
t AS (SELECT recording_id, win_id, max(cluster) FILTER (r = 1) AS first, max(cluster) FILTER (r = 2) AS second, max(d) FILTER (r = 1) AS d1, max(d) FILTER (r = 2) AS d2 FROM r GROUP BY ALL)
SELECT recording_id, win_id, first, second, d2 - d1 < 0.08 * d1 + 0.015 OR d1 > 0.4 AS is_overlap, round((d2 - d1) / d1, 6) AS clarity FROM t WHERE second IS NOT NULL""")
def g5_detect_overlaps(w):
    c = V.centroid(w, ["recording_id", "cluster"])
    return C.detect_overlaps(w, c).withColumn("clarity", F.round("clarity", 6))


@query("windows", "embeddings", sql=f"""
WITH {_WC}, g AS (SELECT label, p2, avg(v2) AS m2 FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS p2, unnest(embedding)::DOUBLE AS v2 FROM embeddings) y GROUP BY ALL), prof AS (SELECT concat('P', label) AS name, list(m2 ORDER BY p2) AS pv FROM g GROUP BY label),
d AS (SELECT recording_id, cluster, name, {cos('c.v', 'prof.pv')} AS d FROM c, prof), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY recording_id, cluster ORDER BY d, name) = 1)
SELECT recording_id, cluster, name, round(d, 6) AS distance, CASE WHEN d < 0.03 THEN 'match' WHEN d < 0.1 THEN 'close' ELSE 'none' END AS grade FROM b""")
def g6_match_simple(w, e):
    c = V.centroid(w, ["recording_id", "cluster"]).withColumn("t", F.lit(0))
    got = N.match_simple(c.withColumn("k", F.struct("recording_id", "cluster")), _profiles(e), ["t"], "k")
    return got.select("k.recording_id", "k.cluster", "name", F.round("distance", 6).alias("distance"), "grade")


@query("embeddings", sql=f"""
WITH {_SCORED}, w AS (SELECT *, row_number() OVER o AS r, lead(dist) OVER o AS d2, lead(sec) OVER o AS t2 FROM d WINDOW o AS (PARTITION BY vec_id ORDER BY dist, name))
SELECT vec_id AS query_id, name, d2 IS NULL OR d2 - dist >= 0.02 OR (sec > 2 * t2 AND dist < 0.16) AS clear FROM w WHERE r = 1""")
def g7_clear_winner(e):
    return N.clear_winner(N.score_pairs(_queries(e), _profiles(e), ["t"]), ["query_id"]).select("query_id", "name", "clear")


@query("windows", "embeddings", sql=f"""
WITH {_PROFILES}, wx AS (SELECT recording_id, cluster, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS v FROM windows), wm AS (SELECT recording_id, cluster, p, avg(v) AS m FROM wx GROUP BY ALL), wc AS (SELECT recording_id * 100 + cluster AS cluster, list(m ORDER BY p) AS w FROM wm GROUP BY recording_id, cluster),
sc AS (SELECT cluster, name, sec, {cos('w', 'prof.v')} AS emb, pitch FROM wc, prof), d AS (SELECT *, round_even(greatest(0.9 * emb + 0.1 * least(abs(120.0e0 - pitch) / 50.0, 1.0), 0), 4) AS dist FROM sc), k AS (SELECT *, round_even(greatest(0, 1 - dist / 0.5), 4) AS conf FROM d),
b AS (SELECT *, row_number() OVER o AS r, lead(dist) OVER o AS d2, lead(sec) OVER o AS t2 FROM k WINDOW o AS (PARTITION BY cluster ORDER BY dist, name))
SELECT cluster, CASE WHEN (d2 IS NULL OR d2 - dist >= 0.02 OR (sec > 2 * t2 AND dist < 0.16)) AND (emb < 0.16 OR dist <= 0.35) THEN name ELSE concat('Speaker ', cluster) END AS speaker, round(dist, 3) AS distance, (SELECT least(count(*), 3)::INT FROM k WHERE k.cluster = b.cluster AND conf >= 0.3) AS alternatives FROM b WHERE r = 1""")
def g8_g9_match_clusters(w, e):
    c = V.centroid(w, ["recording_id", "cluster"]).select(F.lit(0).alias("t"), (F.col("recording_id") * 100 + F.col("cluster")).alias("cluster"), F.col("centroid").alias("embedding"), F.lit(120.0).alias("pitch_hz"))
    got = N.match_clusters(c, _profiles(e), ["t"])
    return got.select("cluster", "speaker", F.round("distance", 3).alias("distance"), F.size(F.coalesce("alternatives", F.array())).alias("alternatives"))


@query("embeddings")
def g10_merge_by_profile(e):
    c = e.groupBy((F.col("vec_id") % 20).alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumn("t", F.lit(0))
    m = C.distance_matrix(c, _profiles(e).select("t", "name", F.col("embedding").alias("ref_embedding")), ["t"])
    return N.merge_by_profile(m.select("t", "cluster", "name", "distance"), ["t"], 3, 0.35)


@query("embeddings")
def g11_merge_similar(e):
    p = _profiles(e)
    more = p.unionByName(p.withColumns({"name": F.concat("name", F.lit("b")), "total_speech_sec": F.col("total_speech_sec") / 2}))
    return N.merge_similar(more.select("t", F.col("name").alias("speaker"), F.col("total_speech_sec").alias("duration_sec"), "embedding"), ["t"], 0.5)


@query("windows", "embeddings")
def g12_claim_names(w, e):
    """The claim fold alone: no vectors of 3 s or more by speaker, nor their blend with the stored ones."""
    spk = V.centroid(w, ["recording_id", "cluster"]).select("recording_id", F.concat(F.lit("S"), F.col("cluster").cast("string")).alias("speaker"), F.col("centroid").alias("embedding"), F.lit(0.0).alias("pitch_hz"))
    q = spk.withColumn("t", F.lit(0))
    scored = N.score_pairs(q, _profiles(e), ["t"])
    win = N.clear_winner(scored, ["recording_id", "speaker"]).select("recording_id", "speaker", "name", "distance", "emb_dist", "confidence", F.lit(True).alias("clear"))
    a, b = spk.select("recording_id", F.col("speaker").alias("a"), F.col("embedding").alias("va")), spk.select("recording_id", F.col("speaker").alias("b"), F.col("embedding").alias("vb"))
    close = a.join(b, "recording_id").where("a < b").where(V.cosine_distance(F.col("va"), F.col("vb")) < 0.25)
    return N.claim_names(win, ["recording_id"], close).select("recording_id", "speaker", "name")


@query("windows")
def g13_merge_unknowns(w):
    spk = V.centroid(w, ["recording_id", "cluster"]).select("recording_id", F.concat(F.lit("S"), F.col("cluster").cast("string")).alias("speaker"), (F.col("n") * 1.0).alias("duration_sec"), F.col("centroid").alias("embedding"))
    return N.merge_unknowns(spk, ["recording_id"], 0.6)


@query("windows")
def g14_split_by_cohesion(w):
    spans = w.select("recording_id", "cluster", F.col("win_id").alias("span_id"), "embedding")
    return C.split_by_cohesion(spans).select("recording_id", "cluster", "voice", "spans", F.round("mean_distance", 6).alias("mean_distance"), "status")


@query("embeddings", sql=f"""
WITH {_PROFILES}, pn AS (SELECT *, label % 2 AS src, concat('L', label) AS lab FROM prof), k AS (SELECT vec_id, name, {cos('e.embedding', 'pn.v')} AS d, src = vec_id % 2 AND lab <> concat('L', e.label) AS clash FROM embeddings e, pn)
SELECT vec_id AS voice_id, arg_min(name, struct_pack(d := d, n := name)) FILTER (d <= 0.6 AND NOT clash) AS extends FROM k GROUP BY 1""")
def g15_find_pending(e):
    p = _profiles(e).select("t", "name", "embedding", F.lit(True).alias("pending"), (F.col("label") % 2).alias("source"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"))
    c = e.select(F.lit(0).alias("t"), F.col("vec_id").alias("voice_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), (F.col("vec_id") % 2).alias("source"), "embedding")
    return N.find_pending(c, p, ["t"], 0.6).select("voice_id", "extends")


@query("embeddings")
def g16_pending_candidates(e):
    p = _profiles(e)
    pend = p.where("pending").unionByName(p.where("label = 3").withColumns({"pending": F.lit(True), "name": F.lit("pending_x")}))
    return N.pending_candidates(pend, p.where("NOT pending"), ["t"]).select("pending_name", "rank", "name", F.round("distance", 3).alias("distance"), F.round("margin", 3).alias("margin"), "likely")


@query("windows", sql="""
WITH s AS (SELECT *, end_s - start_s + win_id % 3 AS d FROM windows), x AS (SELECT concat('P', cluster) AS name, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM s WHERE d >= 3.5)
SELECT name, pos::INT AS pos, round(avg(v), 6) AS mean FROM x GROUP BY ALL""")
def g17_register(w):
    rows = w.withColumn("name", F.concat(F.lit("P"), F.col("cluster").cast("string"))).where(F.col("end_s") - F.col("start_s") + F.col("win_id") % 3 >= 3.5)
    c = V.centroid(rows, ["name"])
    return c.select("name", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


def _path(f, w, e):
    from chronovox.plans.diarize import diarize

    people = _profiles(e).withColumnRenamed("t", "tenant_id")
    return diarize(f, w.drop("cluster", "speaker"), people, threshold=0.75, frame_s=1.2)


@query("frames", "windows", "embeddings")
def g18_diarize(f, w, e):
    """The whole path from frames and windows to named turns."""
    turns, _ = _path(f, w, e)
    return turns.select("recording_id", "seq", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "speaker", "speaker_confidence", "uncertain", "attribution_reason")


@query("frames", "windows", "embeddings")
def g18_diarize_speakers(f, w, e):
    """The speakers that the path ends with."""
    _, people = _path(f, w, e)
    return people.select("recording_id", "speaker", F.round("speech_sec", 6).alias("speech_sec"), "segments", F.round("pitch_hz", 6).alias("pitch_hz"))


@query("embeddings", sql=f"""
WITH {_PROFILES}, t AS (SELECT vec_id AS turn_id, (vec_id % 4)::INT AS channel, (vec_id % 40) * 1.0e0 AS d, embedding FROM embeddings), sc AS (SELECT turn_id, name, {cos('embedding', 'prof.v')} AS emb FROM t, prof WHERE NOT pending), k AS (SELECT *, round_even(greatest(0.9 * emb, 0), 4) AS dist FROM sc),
b AS (SELECT turn_id, name, dist, round_even(greatest(0, 1 - dist / 0.5), 4) AS conf, coalesce(lead(dist) OVER w - dist, 'infinity'::DOUBLE) AS margin FROM k WINDOW w AS (PARTITION BY turn_id ORDER BY dist, name) QUALIFY row_number() OVER w = 1),
r AS (SELECT *, CASE WHEN d < 0.5 THEN 'live_turn_too_short' WHEN d > 30 THEN 'live_turn_too_long' WHEN channel = 0 THEN NULL WHEN conf < 0.6 THEN 'live_match_weak' WHEN margin < 0.1 THEN 'live_match_ambiguous' END AS reason FROM t JOIN b USING (turn_id))
SELECT turn_id, channel, CASE WHEN reason IS NULL THEN CASE WHEN channel = 0 THEN 'You' ELSE name END END AS speaker, CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN channel = 0 THEN 'input_device' ELSE 'known_voiceprint' END AS source,
  CASE WHEN reason LIKE '%too%' THEN 0 WHEN channel = 0 THEN 1 ELSE round(conf, 3) END::DOUBLE AS confidence, CASE WHEN reason LIKE '%too%' THEN 0 WHEN channel = 0 THEN 1 ELSE round(margin, 4) END::DOUBLE AS margin, reason IS NOT NULL AS uncertain, reason FROM r""")
def w4_attribute_live(e):
    k = F.col("vec_id")
    t = e.select(F.lit(0).alias("t"), k.alias("turn_id"), (k % 4).cast("int").alias("channel"), ((k % 40) * 1.0).alias("duration_sec"), "embedding", F.lit(0.0).alias("pitch_hz"))
    got = W.attribute_live(t, _profiles(e), ["t"])
    return got.select("turn_id", "channel", "speaker", F.col("speaker_source").alias("source"), F.col("speaker_confidence").alias("confidence"), F.col("speaker_margin").alias("margin"), "uncertain", F.col("attribution_reason").alias("reason"))


@query("windows", sql="""
WITH t AS (SELECT recording_id, cluster, sum(end_s - start_s) AS d, count(*) AS n FROM windows GROUP BY ALL)
SELECT recording_id, concat('Speaker ', cluster) AS speaker, round(d, 6) AS speech_sec, n AS segments FROM t WHERE cluster < 8""")
def d10_speaker_summary(w):
    """A speaker is in the summary if it has a profile and owns a segment."""
    own = w.withColumn("speaker", F.concat(F.lit("Speaker "), F.col("cluster").cast("string")))
    prof = own.where("cluster < 8").select("recording_id", "speaker").distinct().withColumn("profiled", F.lit(True))
    got = P.speaker_summary(own, prof).where("profiled")
    return got.select("recording_id", "speaker", F.round("speech_sec", 6).alias("speech_sec"), "segments")


@query("profiles", sql="""
SELECT tenant_id, c_mktsegment AS name, round(sum(pitch_hz * total_speech_sec) / sum(total_speech_sec), 6) AS pitch_hz, round(sum(total_speech_sec), 4) AS total_speech_sec FROM profiles GROUP BY ALL""")
def d8_merge_profile_stats(p):
    """Every profile into that of its segment, which exists for none before."""
    into = p.select("tenant_id", "name", F.col("c_mktsegment").alias("into"))
    got = P.merge_profile_stats(p.select("tenant_id", "name", "pitch_hz", "total_speech_sec"), into, ["tenant_id"], "name")
    return got.select("tenant_id", "name", F.round("pitch_hz", 6).alias("pitch_hz"), F.round("total_speech_sec", 4).alias("total_speech_sec"))


@query("embeddings", sql="SELECT count(*) AS names FROM (SELECT DISTINCT label FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT label FROM embeddings WHERE vec_id % 3 = 0) x")
def i3_common_profiles(e):
    return P.common_profiles(e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0"), ["label"]).agg(F.count("*").alias("names"))


@query("windows", sql=f"""
WITH s AS (SELECT *, end_s - start_s + win_id % 3 AS d FROM windows), x AS (SELECT recording_id, cluster, d, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM s WHERE d >= 1.5), t AS (SELECT recording_id, cluster, sum(d) AS sec, count(*) AS n FROM s WHERE d >= 1.5 GROUP BY ALL)
SELECT x.recording_id, x.cluster, pos::INT AS pos, round(sum(v * d) / sum(d), 6) AS mean, round(any_value(sec), 6) AS total_speech_sec, any_value(n) AS sample_count FROM x JOIN t ON t.recording_id = x.recording_id AND t.cluster = x.cluster GROUP BY ALL""")
def g17_register_weighted(w):
    rows = w.withColumn("end_s", F.col("end_s") + F.col("win_id") % 3)
    r = P.register(rows, ["recording_id", "cluster"])
    return r.select("recording_id", "cluster", F.posexplode("embedding").alias("pos", "mean"), F.round("total_speech_sec", 6).alias("total_speech_sec"), "sample_count").withColumn("mean", F.round("mean", 6))


@query("windows", sql="""
WITH m AS (SELECT *, (start_s + end_s) / 2 AS mid FROM windows), w AS (SELECT DISTINCT recording_id, speaker FROM m WHERE speaker IS NOT NULL)
SELECT a.recording_id, a.win_id AS seq, w.speaker AS candidate, round(min(abs(a.mid - b.mid)), 6) AS distance FROM m a JOIN w ON w.recording_id = a.recording_id JOIN m b ON b.recording_id = a.recording_id AND b.speaker = w.speaker GROUP BY ALL""")
def c8_speaker_distances(w):
    who = w.where("speaker IS NOT NULL").select("recording_id", F.col("speaker").alias("candidate")).distinct()
    return P.speaker_distances(w, who).withColumn("distance", F.round("distance", 6))


@query("windows", "embeddings")
def g9_match_known(w, e):
    """Speakers of windows with names, evidence and alternatives; every profile is of tenant 0."""
    seg = w.select("recording_id", "seq", "start_s", "end_s", F.concat(F.lit("Speaker "), F.col("cluster").cast("string")).alias("speaker")).withColumns({"speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(False)})
    means = V.centroid(w, ["recording_id", "cluster"])
    spk = P.segment_centroids(seg, w, means).withColumns({"t": F.lit(0), "pitch_hz": F.lit(120.0)})
    got, _ = P.match_known(seg, spk, _profiles(e), ["t"])
    return got.select("recording_id", "seq", "speaker", F.round("speaker_confidence", 2).alias("confidence"), F.size("alternatives").alias("alternatives"))


@query("windows", "embeddings")
def g12_second_pass(w, e):
    """Speakers by label once more, against the profiles blended with their own voices."""
    seg = w.select("recording_id", "seq", "start_s", "end_s", F.concat(F.lit("Speaker "), F.col("cluster").cast("string")).alias("speaker")).withColumns({"t": F.lit(0), "speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(False)})
    none = seg.select("recording_id", "speaker", F.lit(0.0).alias("pitch_hz")).distinct()
    got, _ = P.second_pass(seg, w, _profiles(e), none, ["t"], th=replace(DEFAULTS, second_accept=0.5, second_confidence=0.0, clear_gap=0.0, unknown_merge=0.6))
    return got.select("recording_id", "seq", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "speaker")
