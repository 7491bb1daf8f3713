"""From clusters to names: matching with a clear winner, one-to-one claims, pending voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.labels import is_collectible
from chronovox.functions.text import tokens_contain
from chronovox.functions.vectors import cosine_distance, match_confidence, match_distance
from chronovox.operators.intervals import KEYS
from chronovox.operators.nearest import clear_of, margin_of, nearest
from chronovox.operators.pruned import near_pairs
from chronovox.thresholds import DEFAULTS, Thresholds


def matchable_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that may name somebody: not pending, and named by a person."""
    return profiles.where(~F.coalesce("pending", F.lit(False)) & is_collectible(F.col("name")))


def score_pairs(queries: DataFrame, profiles: DataFrame, keys: list[str], th: Thresholds = DEFAULTS) -> DataFrame:
    """Each query (id, embedding, pitch_hz) against its keys' profiles: emb_dist, distance, confidence."""
    p = profiles.select(*keys, "name", F.col("embedding").alias("_pe"), F.col("pitch_hz").alias("_pp"), F.col("total_speech_sec").alias("trained_sec"))
    rows = queries.join(p, keys)
    emb = F.when(F.col("embedding").isNotNull() & F.col("_pe").isNotNull(), cosine_distance(F.col("embedding"), F.col("_pe")))
    rows = rows.withColumn("emb_dist", emb)
    rows = rows.withColumn("distance", match_distance(F.col("emb_dist"), F.col("pitch_hz"), F.col("_pp"), F.lit(False), th))
    return rows.withColumn("confidence", F.when(F.col("emb_dist").isNull(), 0.0).otherwise(match_confidence(F.col("distance"), th))).drop("_pe", "_pp")


def identify(queries: DataFrame, profiles: DataFrame, keys: list[str], k: int = 5, ident: str = "query_id", th: Thresholds = DEFAULTS) -> DataFrame:
    """The k nearest profiles of each query, pending ones left out, by distance, then name."""
    found = nearest(queries, profiles.where(~F.coalesce("pending", F.lit(False))), keys, k, [ident], th)
    rows = found.select(*queries.columns, F.posexplode("top").alias("_at", "_x"))
    return rows.select(*queries.columns, *[F.col(f"_x.{c}").alias(c) for c in ("name", "trained_sec", "emb_dist", "distance", "confidence")], (F.col("_at") + 1).alias("rank"))


def clear_winner(ranked: DataFrame, keys: list[str], th: Thresholds = DEFAULTS) -> DataFrame:
    """(keys, name, distance, ..., clear): the best of each group, and whether it stands apart: alone,
    ahead by the gap, or tied but very near and trained on twice as much speech."""
    w = Window.partitionBy(*keys).orderBy("distance", "name")
    rows = ranked.withColumns({"_r": F.row_number().over(w), "_d2": F.lead("distance").over(w), "_t2": F.lead("trained_sec").over(w)}).where("_r = 1")
    ahead = F.col("_d2") - F.col("distance") >= th.clear_gap
    schooled = (F.col("trained_sec") > 2 * F.col("_t2")) & (F.col("distance") < th.embed_only)
    return rows.withColumns({"clear": F.col("_d2").isNull() | ahead | F.coalesce(schooled, F.lit(False)), "margin": F.coalesce(F.col("_d2"), F.lit(1.0)) - F.col("distance")}).drop("_r", "_d2", "_t2")


def match_simple(centroids: DataFrame, profiles: DataFrame, keys: list[str], ident: str = "cluster") -> DataFrame:
    """Nearest profile of each centroid: a match below .03, close below .1."""
    rows = centroids.join(profiles.select(*keys, "name", F.col("embedding").alias("_p")), keys).withColumn("distance", cosine_distance(F.col("centroid"), F.col("_p")))
    best = rows.groupBy(*keys, ident).agg(F.min(F.struct("distance", "name")).alias("b")).select(*keys, ident, "b.*")
    return best.withColumn("grade", F.when(F.col("distance") < 0.03, "match").when(F.col("distance") < 0.1, "close").otherwise("none"))


def match_clusters(clusters: DataFrame, profiles: DataFrame, keys: list[str], ident: str = "cluster", th: Thresholds = DEFAULTS) -> DataFrame:
    """Each cluster with a speaker: the clear winner that is near enough, else its own label; up to
    three alternatives of some confidence."""
    per = [*keys, ident]
    found = nearest(clusters, profiles, keys, 3, [ident], th)
    first = F.get("top", F.lit(0))
    near = (first["emb_dist"] < th.embed_only) | (first["distance"] <= th.accept)
    other = F.filter("top", lambda x: x["confidence"] >= th.min_alternative)
    other = F.transform(other, lambda x: F.struct(x["distance"].alias("distance"), x["name"].alias("name"), x["confidence"].alias("confidence")))
    win = found.select(*per, first["name"].alias("name"), first["distance"].alias("distance"), first["confidence"].alias("confidence"), F.bround(margin_of(F.col("top")), 4).alias("margin"), (near & clear_of(F.col("top"), th)).alias("named"), F.when(F.size(other) > 0, other).alias("alternatives"))
    out = clusters.select(*per).join(win, per, "left")
    return out.withColumn("speaker", F.when(F.coalesce("named", F.lit(False)), F.col("name")).otherwise(F.concat(F.lit("Speaker "), F.col(ident).cast("string"))))


def claim_names(candidates: DataFrame, keys: list[str], close: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """One name for one speaker: candidates (keys, speaker, name, distance, emb_dist, confidence, clear)
    in order of distance; a name that is taken goes only to a speaker whose voice is close (keys, a, b)
    to every one that has it, and nobody falls back to a second choice.  A fold over each recording's
    candidates with the claims so far."""
    ok = (F.col("confidence") >= th.second_confidence) & ((F.col("distance") <= th.second_accept) | (F.col("emb_dist") < th.embed_only)) & F.col("clear")
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "speaker").orderBy("distance", "name"))).where("_r = 1").where(ok)
    friends = close.select(*keys, F.col("a").alias("speaker"), F.col("b").alias("_f")).unionByName(close.select(*keys, F.col("b").alias("speaker"), F.col("a").alias("_f"))).groupBy(*keys, "speaker").agg(F.collect_set("_f").alias("friends"))
    best = best.join(friends, [*keys, "speaker"], "left")
    item = F.struct("distance", "speaker", "name", F.coalesce("friends", F.array().cast("array<string>")).alias("friends"))
    rows = best.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))

    def step(done, x):
        holders = F.transform(F.filter(done, lambda y: y["name"] == x["name"]), lambda y: y["speaker"])
        free = F.size(F.array_except(holders, x["friends"])) == 0
        return F.when(free, F.concat(done, F.array(F.struct(x["speaker"].alias("speaker"), x["name"].alias("name"), x["distance"].alias("distance"))))).otherwise(done)

    kind = "array<struct<speaker:string,name:string,distance:double>>"
    return rows.select(*keys, F.inline(F.aggregate("c", F.array().cast(kind), step)))


def merge_unknowns(speakers: DataFrame, keys: list[str], limit: float = DEFAULTS.unknown_merge) -> DataFrame:
    """(keys, speaker, into): unknown voices closer than the limit become one, the shorter into the
    longer, in order of length; one that has gone takes no others."""
    a = speakers.select(*keys, F.col("speaker").alias("a"), F.col("duration_sec").alias("da"), F.col("embedding").alias("va"))
    b = speakers.select(*keys, F.col("speaker").alias("b"), F.col("duration_sec").alias("db"), F.col("embedding").alias("vb"))
    longer = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, keys).where(longer & (cosine_distance(F.col("va"), F.col("vb")) < limit))
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("da")).alias("k"), "a", (-F.col("db")).alias("l"), "b"))).alias("p"))

    def step(done, x):
        gone = F.transform(done, lambda y: y["speaker"])
        return F.when(F.array_contains(gone, x["a"]) | F.array_contains(gone, x["b"]), done).otherwise(F.concat(done, F.array(F.struct(x["b"].alias("speaker"), x["a"].alias("into")))))

    return rows.select(*keys, F.inline(F.aggregate("p", F.array().cast("array<struct<speaker:string,into:string>>"), step)))


def merge_similar(clusters: DataFrame, keys: list[str], limit: float = DEFAULTS.embed_only, hops: int = 10) -> DataFrame:
    """(keys, speaker, into): each cluster points to the nearest longer one within the limit; chains are
    followed to their end."""
    a = clusters.select(*keys, F.col("speaker"), F.col("duration_sec").alias("d"), F.col("embedding").alias("v"))
    b = a.toDF(*keys, "into", "e", "w")
    longer = (F.col("e") > F.col("d")) | ((F.col("e") == F.col("d")) & (F.col("into") < F.col("speaker")))
    near = a.join(b, keys).withColumn("x", cosine_distance(F.col("v"), F.col("w"))).where(longer & (F.col("x") < limit))
    step = near.groupBy(*keys, "speaker").agg(F.min_by("into", F.struct("x", "into")).alias("into"))
    for _ in range(max(1, (hops - 1).bit_length())):
        step = step.join(step.toDF(*keys, "into", "_next"), [*keys, "into"], "left").select(*keys, "speaker", F.coalesce("_next", "into").alias("into"))
    return step


def merge_by_profile(matrix: DataFrame, keys: list[str], least: int = 3, limit: float = 0.05) -> DataFrame:
    """(keys, cluster, into): clusters whose distances (keys, cluster, name, distance) to three or more
    common profiles differ little are one, the smaller number takes the larger, first come."""
    a = matrix.select(*keys, F.col("cluster").alias("a"), "name", F.col("distance").alias("da"))
    b = matrix.select(*keys, F.col("cluster").alias("b"), "name", F.col("distance").alias("db"))
    pairs = a.join(b, [*keys, "name"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"), F.max(F.abs(F.col("da") - F.col("db"))).alias("x"))
    return first_come(pairs.where((F.col("n") >= least) & (F.col("x") < limit)), keys)


def first_come(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, into): of pairs (keys, a, b) in order, b goes into a unless one of both is gone."""
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p"))

    def step(done, x):
        gone = F.transform(done, lambda y: y["cluster"])
        return F.when(F.array_contains(gone, x["a"]) | F.array_contains(gone, x["b"]), done).otherwise(F.concat(done, F.array(F.struct(x["b"].cast("bigint").alias("cluster"), x["a"].cast("bigint").alias("into")))))

    return rows.select(*keys, F.inline(F.aggregate("p", F.array().cast("array<struct<cluster:bigint,into:bigint>>"), step)))


def find_pending(candidates: DataFrame, profiles: DataFrame, keys: list[str], limit: float = DEFAULTS.cohesion) -> DataFrame:
    """Each new voice (keys, voice_id, label, source, embedding) with the pending profile that it
    extends: the nearest within the limit, but none of the same source with another label; else one whose
    name holds the label's tokens; null for a new one."""
    p = profiles.where("pending").select(*keys, "name", F.col("embedding").alias("_p"), F.col("source").alias("_s"), F.col("label").alias("_l"))
    rows = candidates.join(p, keys, "left").withColumn("d", cosine_distance(F.col("embedding"), F.col("_p")))
    clash = (F.col("source") == F.col("_s")) & (F.col("label") != F.col("_l"))
    near = (F.col("d") <= limit) & ~F.coalesce(clash, F.lit(False))
    named = tokens_contain(F.col("name"), F.col("label"))
    key = F.when(near, F.struct(F.lit(0).alias("g"), "d", "name")).when(named, F.struct(F.lit(1).alias("g"), F.lit(0.0).alias("d"), "name"))
    return rows.groupBy(*keys, "voice_id").agg(F.min(key).alias("b")).select(*keys, "voice_id", F.col("b.name").alias("extends"), F.when(F.col("b.g") == 0, "voice").when(F.col("b.g") == 1, "name").alias("by"))


def pending_candidates(pending: DataFrame, profiles: DataFrame, keys: list[str], k: int = 5, th: Thresholds = DEFAULTS) -> DataFrame:
    """Named profiles for each pending one: rank, margin to the next (distance 1 after the last), and
    whether it is likely the same person."""
    q = pending.select(*keys, F.col("name").alias("pending_name"), "embedding", "pitch_hz")
    found = nearest(q, matchable_profiles(profiles), keys, k + 1, ["pending_name"], th)
    rows = found.select(*keys, "pending_name", "top", F.posexplode(F.slice("top", 1, k)).alias("_at", "_x"))
    after = F.coalesce(F.get("top", F.col("_at") + 1)["distance"], F.lit(1.0))
    rows = rows.select(*keys, "pending_name", (F.col("_at") + 1).alias("rank"), *[F.col(f"_x.{c}").alias(c) for c in ("name", "distance", "confidence")], F.bround(after - F.col("_x.distance"), 4).alias("margin"))
    return rows.withColumn("likely", (F.col("confidence") >= 0.6) & (F.col("margin") >= 0.1))


def near_duplicate_profiles(profiles: DataFrame, keys: list[str], limit: float = DEFAULTS.near_duplicate) -> DataFrame:
    """(keys, a, b, distance) of a tenant's profiles within the limit, pending ones included; of vectors
    without length none.  Pivots rule most pairs out (pruned.near_pairs)."""
    return near_pairs(profiles, keys, "name", limit)


def speaker_refs(turns: DataFrame, profiles: DataFrame, windows: DataFrame, budget: float = 30.0) -> DataFrame:
    """(recording_id, speaker, ref): the stored profile's vector, else the mean of the speaker's own
    window vectors over its longest spans, up to the budget."""
    from chronovox.functions.vectors import centroid

    w = Window.partitionBy(*KEYS, "speaker").orderBy((F.col("end_s") - F.col("start_s")).desc(), "seq")
    own = turns.withColumn("_sum", F.sum(F.col("end_s") - F.col("start_s")).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("_sum", F.lit(0.0)) < budget)
    own = own.select(*KEYS, "speaker", "seq").join(windows.select(*KEYS, "seq", "embedding"), [*KEYS, "seq"])
    mean = centroid(own, [*KEYS, "speaker"]).drop("n")
    out = turns.select(*KEYS, "speaker").distinct().join(profiles.select(F.col("name").alias("speaker"), F.col("embedding").alias("_p")), "speaker", "left").join(mean, [*KEYS, "speaker"], "left")
    return out.select(*KEYS, "speaker", F.coalesce(F.transform("_p", lambda x: x.cast("double")), "centroid").alias("ref"), F.col("_p").isNotNull().alias("stored"))

