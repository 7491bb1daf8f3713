"""Speakers of recordings: acoustic profiles, full matching, the second pass over unknown ones, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.labels import apply_identity, has_identity, is_generic
from chronovox.functions.vectors import centroid, cosine_distance, l2_normalize
from chronovox.operators.clustering import settled
from chronovox.operators.identity import claim_names, first_come, merge_unknowns
from chronovox.operators.intervals import KEYS, collapse_confident, range_join, windows_in_segments
from chronovox.operators.nearest import best_of, clear_of, margin_of, meet, nearest, packed_profiles, scored
from chronovox.thresholds import DEFAULTS, Thresholds

K = list(KEYS)
#: Entries of each list in a summary for readers.
SUMMARY_ITEMS = 8
#: Spans shorter than this teach nothing, seconds.
REGISTER_SEC = 1.5


# -- profiles of a recording's speakers ---------------------------------------------------------------


def profile_speakers(frames: DataFrame, segments: DataFrame, frame_s: float = 1.0, bucket: float = 60.0) -> DataFrame:
    """(recording_id, speaker, pitch_hz, pitch_std, energy_rms, total_speech_sec, frames): median and spread
    of the pitch of the frames that begin in a speaker's segments, root mean square of their energy."""
    at = F.col("frame_idx") * frame_s
    p = frames.select(*K, "pitch_hz", "rms", at.alias("p_start"), at.alias("p_end"))
    own = segments.where(has_identity(F.col("speaker")))
    got = range_join(p, own.select(*K, "speaker", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end")), bucket)
    voiced = F.when(F.col("pitch_hz") > 0, F.col("pitch_hz"))
    per = got.groupBy(*K, "speaker").agg(F.median(voiced).alias("pitch_hz"), F.stddev_pop(voiced).alias("pitch_std"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("energy_rms"), F.count("*").alias("frames"))
    speech = own.groupBy(*K, "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("total_speech_sec"))
    return speech.join(per, [*K, "speaker"], "left").select(*K, "speaker", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pitch_hz", "pitch_std", "energy_rms")], "total_speech_sec", F.coalesce("frames", F.lit(0)).alias("frames"))


def merge_profile_stats(profiles: DataFrame, mapping: DataFrame, keys: list[str], name: str = "speaker", stats: tuple = ("pitch_hz", "pitch_std", "energy_rms")) -> DataFrame:
    """Profiles with the rows of mapping (keys, name, into) folded into their targets: statistics weighted
    by speech, speech summed; a target without a row of its own adopts the source's; the source goes.
    Columns that are no statistics are the target's."""
    to = mapping.select(*keys, name, F.col("into").alias("_into"))
    rows = profiles.join(to, [*keys, name], "left").withColumn("_own", F.col("_into").isNull()).withColumn("_to", F.coalesce("_into", name))
    w = F.col("total_speech_sec")
    stats = tuple(c for c in stats if c in profiles.columns)
    rest = [c for c in profiles.columns if c not in (*keys, name, "total_speech_sec", *stats)]
    first = F.struct((~F.col("_own")).alias("o"), F.col(name).alias("n"))
    mean = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0.0)) * w) / F.nullif(F.sum(w), F.lit(0.0)), F.min_by(c, first)).alias(c)
    out = rows.groupBy(*keys, "_to").agg(*[mean(c) for c in stats], F.sum(w).alias("total_speech_sec"), *[F.min_by(c, first).alias(c) for c in rest])
    return out.withColumnRenamed("_to", name).select(*profiles.columns)


def speaker_summary(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profiles (recording_id, speaker, ...) of the speakers that own a segment, and of no others, with
    their speech and number of segments; a speaker without a profile has a row without statistics."""
    per = segments.where(has_identity(F.col("speaker"))).groupBy(*K, "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("speech_sec"), F.count("*").alias("segments"))
    return per.join(profiles, [*K, "speaker"], "left")


def speaker_distances(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(recording_id, seq, candidate, distance): how far each row's midpoint is from the nearest one of each
    candidate (recording_id, candidate): a fill from either side along each candidate's timeline."""
    mid = ((F.col("start_s") + F.col("end_s")) / 2).alias("_t")
    rows = segments.select(*K, "seq", mid, F.lit(None).cast("double").alias("_v")).join(speakers.select(*K, "candidate"), K)
    marks = segments.select(*K, F.lit(None).cast("long").alias("seq"), mid, mid.alias("_v").cast("double"), F.col("speaker").alias("candidate")).withColumn("_v", F.col("_t"))
    both = rows.select(*K, F.col("seq").cast("long").alias("seq"), "_t", "_v", "candidate").unionByName(marks.join(speakers, [*K, "candidate"], "left_semi").select(*K, "seq", "_t", "_v", "candidate"))
    per = Window.partitionBy(*K, "candidate")
    seen = lambda o: F.last("_v", True).over(per.orderBy(o).rangeBetween(Window.unboundedPreceding, 0))
    d = F.least(F.abs(F.col("_t") - seen(F.col("_t"))), F.abs(F.col("_t") - seen(F.col("_t").desc())))
    return both.withColumn("distance", d).where("seq IS NOT NULL").select(*K, "seq", "candidate", "distance")


# -- names --------------------------------------------------------------------------------------------


def segment_centroids(segments: DataFrame, windows: DataFrame, means: DataFrame, slack: float = 0.1, bucket: float = 60.0) -> DataFrame:
    """(recording_id, speaker, embedding): the mean, at length 1, of the clusters' means (recording_id,
    cluster, centroid) over the windows that lie in a speaker's segments."""
    p = windows.where("cluster IS NOT NULL").select(*K, "cluster", F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    s = segments.where(has_identity(F.col("speaker"))).select(*K, "speaker", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    # windows of one cluster add one vector so many times: count before the vectors come in
    n = windows_in_segments(p, s, slack, bucket).groupBy(*K, "speaker", "cluster").agg(F.count("*").alias("_n"))
    got = n.join(means.select(*K, "cluster", F.col("centroid").alias("embedding")), [*K, "cluster"])
    return centroid(got, [*K, "speaker"], weight=F.col("_n").cast("double"), unit=True).select(*K, "speaker", F.col("centroid").alias("embedding"))


def match_known(segments: DataFrame, speakers: DataFrame, profiles: DataFrame, tenant: list[str], blocked: DataFrame | None = None, th: Thresholds = DEFAULTS, most: int = 3, common: int = 3, alike: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(segments with names, mapping (recording_id, old_name, new_name, evidence)): speakers (recording_id,
    speaker, embedding, pitch_hz; and the tenant columns) take the name of the profile that is near enough
    and a clear winner.  Speakers are in the order in which they first appear.

    1. A named speaker's segments carry confidence, margin and distance, and as alternatives up to `most`
       further profiles of some confidence; of several speakers of one name, the later one's.
    2. Several speakers whose best profile is one and near: all but the first take its name, if they
       haven't, with the confidence of the last clear one, or none.
    3. Of speakers whose distances to `common` or more profiles hardly differ the later one takes the
       label of the earlier one, unless it has a name by now; one that is gone takes part no more.
    Nobody else has alternatives.  Recordings in `blocked` keep all labels.
    """
    if blocked is not None:
        speakers = speakers.join(blocked.select(*K).distinct(), K, "left_anti")
    first = segments.groupBy(*K, "speaker").agg(F.min(F.struct("start_s", "seq")).alias("_first"))
    order = first.select(*K, "speaker", F.row_number().over(Window.partitionBy(*K).orderBy("_first", "speaker")).cast("long").alias("_o"))
    packed = packed_profiles(profiles, tenant)
    entries = meet(speakers, packed, tenant).select("_q", "_block", scored(F.col("_people"), F.col("_v"), F.col("_l"), F.col("pitch_hz"), th).alias("_s"))
    # of each block: its best, and the distances in order of name, which are the same people for all speakers of a recording
    entries = settled(entries.select(*[F.col(f"_q.{c}").alias(c) for c in (*K, "speaker")], "_block", best_of(F.col("_s"), most + 1).alias("_top"), F.transform("_s", lambda x: x["distance"]).alias("_d")).join(order, [*K, "speaker"]))
    best = entries.groupBy(*K, "speaker", "_o").agg(best_of(F.flatten(F.collect_list("_top")), most + 1).alias("top"))
    win = F.get("top", F.lit(0))
    rows = best.select(*K, "speaker", "_o", win["name"].alias("name"), win["distance"].alias("distance"), win["confidence"].alias("confidence"), F.when(F.size("top") > 1, margin_of(F.col("top"))).alias("margin"), clear_of(F.col("top"), th).alias("clear"), F.slice("top", 2, most).alias("_rest"))
    other = F.transform(F.filter("_rest", lambda x: x["confidence"] >= th.min_alternative), lambda x: x["name"])
    rows = rows.where(F.col("distance") <= th.accept).withColumn("_other", F.when(F.col("clear") & (F.size(other) > 0), other)).drop("_rest")
    per = Window.partitionBy(*K, "name")
    rows = rows.withColumns({
        "_place": F.row_number().over(per.orderBy("_o")), "_sure": F.max_by(F.when(F.col("clear"), F.col("confidence")), F.when(F.col("clear"), F.col("_o"))).over(per),
        "_others": F.first("_other", True).over(per.orderBy(F.desc("_o"))),
    })
    none = F.lit(None).cast("double")
    told = lambda c, extra: F.when(F.col("clear"), F.col(c)).otherwise(extra).alias(c)
    named = rows.where(F.col("clear") | (F.col("_place") > 1)).select(*K, F.col("speaker").alias("old_name"), F.col("name").alias("new_name"), told("confidence", F.col("_sure")), told("margin", none), told("distance", none), F.when(F.col("clear"), F.col("_others")).alias("alternatives"))
    named = settled(named)
    # distance profiles that nearly agree, block by block
    a = entries.select(*K, "_block", F.col("_o").alias("a"), F.col("_d").alias("_da"))
    b = entries.select(*K, "_block", F.col("_o").alias("b"), F.col("_d").alias("_db"))
    off = F.array_max(F.zip_with("_da", "_db", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, [*K, "_block"]).where("a < b").groupBy(*K, "a", "b").agg(F.sum(F.size("_da")).alias("n"), F.max(off).alias("x"))
    into = first_come(pairs.where((F.col("n") >= common) & (F.col("x") < alike)), K)
    label = lambda c, name: order.select(*K, F.col("_o").alias(c), F.col("speaker").alias(name))
    folded = into.join(label("cluster", "old_name"), [*K, "cluster"]).join(label("into", "new_name"), [*K, "into"]).join(named.select(*K, "old_name"), [*K, "old_name"], "left_anti")
    out = segments.drop("alternatives").join(named.select(*K, F.col("old_name").alias("speaker"), "alternatives"), [*K, "speaker"], "left").withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>")))
    out = apply_identity(out, named.drop("alternatives")).join(folded.select(*K, F.col("old_name").alias("speaker"), F.col("new_name").alias("_into")), [*K, "speaker"], "left")
    mapping = named.drop("alternatives").unionByName(folded.select(*K, "old_name", "new_name", *[none.alias(c) for c in ("confidence", "margin", "distance")]))
    return out.withColumn("speaker", F.coalesce("_into", "speaker")).drop("_into"), mapping


def speaker_vectors(segments: DataFrame, windows: DataFrame, least: float = DEFAULTS.second_min_sec, piece: float = 0.2, slack: float = 0.1, bucket: float = 60.0) -> DataFrame:
    """(recording_id, speaker, embedding, duration_sec): the mean of a speaker's own window vectors at length
    1, for speakers with enough speech in segments that are no slivers."""
    own = segments.where(has_identity(F.col("speaker")) & (F.col("end_s") - F.col("start_s") >= piece))
    long = own.groupBy(*K, "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("duration_sec")).where(F.col("duration_sec") >= least)
    p = windows.where("embedding IS NOT NULL").select(*K, "win_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end"))
    s = own.select(*K, "speaker", F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    inside = windows_in_segments(p, s, slack, bucket).dropDuplicates([*K, "speaker", "win_id"])
    return centroid(inside, [*K, "speaker"], unit=True).drop("n").withColumnRenamed("centroid", "embedding").join(long, [*K, "speaker"])


def blended_profiles(profiles: DataFrame, vectors: DataFrame, tenant: list[str], share: float = 0.5) -> DataFrame:
    """The profiles that have a speaker of their name in a recording, once for each of these (of vectors'
    recording_id and tenant columns), with their vector blended at length 1 with that speaker's."""
    own = vectors.select(*K, *[c for c in tenant if c not in K], F.col("speaker").alias("name"), F.col("embedding").alias("_own"))
    mixed = l2_normalize(F.zip_with("embedding", "_own", lambda x, y: (1 - share) * x.cast("double") + share * y))
    return own.join(profiles, [*tenant, "name"]).withColumn("embedding", mixed).drop("_own")


def second_pass(segments: DataFrame, windows: DataFrame, profiles: DataFrame, stats: DataFrame, tenant: list[str], blocked: DataFrame | None = None, th: Thresholds = DEFAULTS, gap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(segments, mapping (recording_id, speaker, into)): unknown speakers once more, by vectors over all of
    their speech against the tenant's profiles, those of the recording's own speakers blended with their voices.

    A name goes to the nearest clear winner of enough confidence first, and to further speakers only if their
    voice is close to its holder's; then unknown voices that are close become one, the longer one's; then
    neighbours of one sure speaker join.  segments hold the tenant columns; stats: recording_id, speaker, pitch_hz.
    """
    more = [c for c in tenant if c not in K]
    vec = speaker_vectors(segments, windows, th.second_min_sec)
    if more:
        vec = vec.join(segments.select(*K, *more).distinct(), K)
    vec = settled(vec)
    unknown = vec.where(is_generic(F.col("speaker"))).join(stats.select(*K, "speaker", "pitch_hz"), [*K, "speaker"], "left").withColumn("pitch_hz", F.coalesce("pitch_hz", F.lit(0.0)))
    if blocked is not None:
        asked = unknown.join(blocked.select(*K).distinct(), K, "left_anti")
    else:
        asked = unknown
    # stored vectors for all names but the recording's own, of which there are few: these are blended
    blended = settled(blended_profiles(profiles, vec, tenant))
    taken = blended.groupBy(*K, *more).agg(F.collect_set("name").alias("_taken"))
    asked = asked.join(taken, [*K, *more], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<string>")))
    stored = nearest(asked, profiles, tenant, 2, [*[c for c in K if c not in tenant], "speaker"], th, skip="_taken").select(*K, *more, "speaker", "top")
    own = nearest(asked, blended, [*K, *more], 2, ["speaker"], th).select(*K, *more, "speaker", "top")
    both = stored.unionByName(own).groupBy(*K, *more, "speaker").agg(best_of(F.flatten(F.collect_list("top")), 2).alias("top")).where(F.size("top") > 0)
    win = F.get("top", F.lit(0))
    best = settled(both.select(*K, "speaker", *[win[c].alias(c) for c in ("name", "distance", "emb_dist", "confidence")], clear_of(F.col("top"), th).alias("clear"), margin_of(F.col("top")).alias("margin")))
    a, b = vec.select(*K, F.col("speaker").alias("a"), F.col("embedding").alias("_a")), vec.select(*K, F.col("speaker").alias("b"), F.col("embedding").alias("_b"))
    close = a.join(b, K).where("a < b").where(cosine_distance(F.col("_a"), F.col("_b")) < th.unknown_merge).select(*K, "a", "b")
    claims = settled(claim_names(best, K, close, th).select(*K, "speaker", "name"))
    named = claims.join(best.select(*K, "speaker", "confidence", "margin", "distance"), [*K, "speaker"])
    rows = apply_identity(segments, named.select(*K, F.col("speaker").alias("old_name"), F.col("name").alias("new_name"), "confidence", "margin", "distance"))
    left = unknown.join(claims.select(*K, "speaker"), [*K, "speaker"], "left_anti")
    into = settled(merge_unknowns(left.select(*K, "speaker", "duration_sec", "embedding"), K, th.unknown_merge))
    rows = rows.join(into, [*K, "speaker"], "left").withColumn("speaker", F.coalesce("into", "speaker")).drop("into")
    mapping = named.select(*K, "speaker", F.col("name").alias("into")).unionByName(into.select(*K, "speaker", "into"))
    return collapse_confident(rows, gap, text=False), mapping


# -- learning -----------------------------------------------------------------------------------------


def register(spans: DataFrame, keys: list[str], least: float = REGISTER_SEC, single: bool = False) -> DataFrame:
    """(keys, embedding, pitch_hz, pitch_std, energy_rms, total_speech_sec, sample_count) from labelled spans
    (keys, start_s, end_s, embedding, and pitch_hz, pitch_std, energy_rms if known), weighted by length.
    Spans that are too short or have no vector don't count; with `single` one span of any length is a profile,
    the last one given for its keys."""
    d = F.col("end_s") - F.col("start_s")
    rows = spans.where(F.col("embedding").isNotNull()).withColumn("_d", d)
    if single:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start_s"), F.desc("end_s")))).where("_r = 1")
    else:
        rows = rows.where(F.col("_d") >= least)
    more = [c for c in ("pitch_hz", "pitch_std", "energy_rms") if c in spans.columns]
    w = F.col("_d")
    stats = rows.groupBy(*keys).agg(*[(F.sum(F.col(c) * w) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))).alias(c) for c in more], F.sum(w).alias("total_speech_sec"), F.count("*").alias("sample_count"))
    return centroid(rows, keys, weight=w).drop("n").withColumnRenamed("centroid", "embedding").join(stats, keys)


def common_profiles(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The names that two sets of compared profiles share."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)


def learning_summary(collected: DataFrame, not_learned: DataFrame, not_collected: DataFrame, refused: DataFrame, keys: list[str], items: int = SUMMARY_ITEMS) -> DataFrame:
    """What a reader is told per key: snippets added, the first few clusters not learned and speakers not
    collected with their reasons (one that isn't registered is no news), and refusals by reason, all counted.

    collected: keys; not_learned: keys, cluster, reason; not_collected: keys, speaker, reason; refused: keys, reason.
    """

    def few(df: DataFrame, who: str, name: str) -> DataFrame:
        rows = df.where("reason IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(who, "reason"))).where(F.col("_n") <= items)
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", who, "reason"))), lambda x: F.struct(x[who].alias(who), x["reason"].alias("reason"))).alias(name))

    why = refused.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    why = why.groupBy(*keys).agg(F.sum("n").alias("refused_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("refused_reasons"))
    parts = [collected.groupBy(*keys).agg(F.count("*").alias("snippets_added")), few(not_learned, "cluster", "not_learned"), few(not_collected.where("reason <> 'not_registered'"), "speaker", "not_collected"), why]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out.fillna(0, ["snippets_added", "refused_total"])


def with_pitch(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Speakers with the pitch of their recording's profile, 0 where there is none."""
    return df.join(stats.select(*K, "speaker", "pitch_hz"), [*K, "speaker"], "left").withColumn("pitch_hz", F.coalesce("pitch_hz", F.lit(0.0)))
