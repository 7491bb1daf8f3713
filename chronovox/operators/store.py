"""The profile store as tables: upserts, audits, budgets, reviews, renames, purges.

A store is a dict of DataFrames (profiles, snippets, transcripts); every operator returns new ones, and
nothing is written until a caller writes them.  Every join carries tenant_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.text import normalise_name, source_identity
from chronovox.functions.vectors import cosine_distance, l2_normalize, pairwise_mean, weighted_centroid
from chronovox.operators.clustering import settled
from chronovox.operators.identity import near_duplicate_profiles
from chronovox.operators.intervals import trim_to_sections
from chronovox.thresholds import DEFAULTS, Thresholds

T = "tenant_id"
SPEAKER = [T, "speaker_name"]


# -- updates ----------------------------------------------------------------------------------------


def upsert_profiles(store: DataFrame, updates: DataFrame) -> DataFrame:
    """New rows by (tenant_id, name); a null pending or purity keeps the stored one; a new profile is
    not pending unless it says so."""
    keep = ["pending", "purity"]
    old, new = store.alias("o"), updates.alias("n")
    on = (F.col(f"o.{T}") == F.col(f"n.{T}")) & (F.col("o.name") == F.col("n.name"))
    both = old.join(new, on, "full_outer")
    cols = []
    for c in store.columns:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in updates.columns else F.lit(None)
        if c == "pending":
            cols.append(F.coalesce(theirs, mine, F.lit(False)).alias(c))
        elif c in keep or c in (T, "name") or c not in updates.columns:
            cols.append(F.coalesce(theirs, mine).alias(c))
        else:
            cols.append(F.when(F.col("n.name").isNotNull(), theirs).otherwise(mine).alias(c))
    return both.select(*cols)


def append_snippets(snippets: DataFrame, more: DataFrame) -> DataFrame:
    return snippets.unionByName(more, allowMissingColumns=True)


def delete_snippets(snippets: DataFrame, ids: DataFrame) -> DataFrame:
    return snippets.join(ids.select(T, "id").distinct(), [T, "id"], "left_anti")


def save_transcripts(results: DataFrame) -> DataFrame:
    """Transcript rows with a fingerprint: the first 16 hex digits of the content's sha256."""
    return results.withColumn("file_hash", F.substring(F.sha2(F.to_json("result"), 256), 1, 16))


def fix_totals(profiles: DataFrame, totals: DataFrame) -> DataFrame:
    """Speech totals corrected by (tenant_id, name); vectors stay."""
    t = totals.select(T, "name", F.col("total_speech_sec").alias("_t"))
    return profiles.join(t, [T, "name"], "left").withColumn("total_speech_sec", F.coalesce("_t", "total_speech_sec")).drop("_t")


# -- counts, rosters --------------------------------------------------------------------------------


def speaker_totals(snippets: DataFrame) -> DataFrame:
    return snippets.groupBy(*SPEAKER).agg(F.count("*").alias("snippets"), F.sum("duration_sec").alias("total_sec"))


def tenants(*tables: DataFrame) -> DataFrame:
    """Distinct tenants of several tables, without null and blank ones."""
    out = tables[0].select(T)
    for t in tables[1:]:
        out = out.union(t.select(T))
    return out.where(F.trim(F.col(T).cast("string")) != "").distinct()


def union_names(*names: DataFrame) -> DataFrame:
    out = names[0]
    for n in names[1:]:
        out = out.union(n)
    return out.distinct()


def orphans(profiles: DataFrame, snippets: DataFrame) -> DataFrame:
    """Profiles without snippets, and snippets' speakers without a profile."""
    p, s = profiles.select(T, F.col("name").alias("speaker_name")), snippets.select(*SPEAKER).distinct()
    return p.join(s, SPEAKER, "left_anti").withColumn("type", F.lit("profile_without_snippets")).unionByName(s.join(p, SPEAKER, "left_anti").withColumn("type", F.lit("snippets_without_profile")))


def list_speakers(profiles: DataFrame, snippets: DataFrame) -> DataFrame:
    """Everyone with snippets or a profile, with what each side knows."""
    p = profiles.select(T, F.col("name").alias("speaker_name"), "pending", "total_speech_sec")
    return p.join(speaker_totals(snippets), SPEAKER, "full_outer").select(*SPEAKER, F.coalesce("snippets", F.lit(0)).alias("snippets"), F.coalesce("total_sec", "total_speech_sec", F.lit(0.0)).alias("total_sec"), F.col("total_speech_sec").isNotNull().alias("has_profile"), F.coalesce("pending", F.lit(False)).alias("pending"))


def tenant_roster(sources: dict[str, DataFrame], counts: dict[str, DataFrame]) -> DataFrame:
    """Every tenant of any identity source or data table, the sources that know it, and its rows."""
    ids = None
    for name, df in sources.items():
        part = df.select(T, F.lit(name).alias("source"))
        ids = part if ids is None else ids.unionByName(part)
    out = ids.where(F.col(T).isNotNull()).groupBy(T).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    for name, df in counts.items():
        out = out.join(df.where(F.col(T).isNotNull()).groupBy(T).agg(F.count("*").alias(name)), T, "full_outer").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("has_account", F.col("sources").isNotNull())


def owners_without_account(owners: DataFrame, roster: DataFrame) -> DataFrame:
    return owners.select(T).distinct().join(roster.select(T), T, "left_anti")


def history(transcripts: DataFrame, n: int = 50) -> DataFrame:
    """The newest transcripts of each tenant: a report of n rows."""
    w = Window.partitionBy(T).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return transcripts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def review_queue(snippets: DataFrame) -> DataFrame:
    """Flagged snippets of each tenant, the worst first."""
    w = Window.partitionBy(T).orderBy(F.coalesce("review_score", F.lit(0.0)).desc(), "id")
    return snippets.where("review_flag").withColumn("place", F.row_number().over(w))


# -- budgets ----------------------------------------------------------------------------------------


def with_source(snippets: DataFrame) -> DataFrame:
    return snippets.withColumn("source", source_identity(F.col("source_audio"), F.col("file_path"))["identity"])


def rank_snippets(snippets: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("duration_sec").desc(), F.col("start_sec").asc_nulls_last(), "id")
    return snippets.withColumn("place", F.row_number().over(w))


def plan_source_trim(snippets: DataFrame, per_source: int = 10, least: float = 5.0) -> DataFrame:
    """Snippets to drop, with a reason: too short ones first, then all but the best of each source;
    snippets of no known source are exempt from the count.  Needs a column `source`."""
    short = snippets.where(F.col("duration_sec") < least).withColumn("reason", F.lit("too_short"))
    rest = rank_snippets(snippets.where((F.col("duration_sec") >= least) & F.col("source").isNotNull()), [*SPEAKER, "source"])
    over = rest.where(F.col("place") > per_source).withColumn("reason", F.lit("over_per_file_cap"))
    return short.select(*SPEAKER, "id", "reason").unionByName(over.select(*SPEAKER, "id", "reason"))


#: What collecting goes by: least seconds of a clip, most of one, most of a speaker, clips of a recording.
CLIP_SEC, CHUNK_SEC, TOTAL_SEC, PER_SOURCE = 5.0, 300.0, 1200.0, 10


def collect_snippets(
    segments: DataFrame, profiles: DataFrame, refusal: Column, existing: DataFrame | None = None, sections: DataFrame | None = None,
    per_source: int = PER_SOURCE, most: float = TOTAL_SEC, chunk: float = CHUNK_SEC, least: float = CLIP_SEC,
) -> tuple[DataFrame, DataFrame]:
    """(clips, diagnostics per tenant, recording and speaker) of the spans worth keeping.

    Spans without a refusal, long enough, of a registered speaker with two of them in the recording, are
    trimmed to the speech in them (sections: recording_id, s_start, s_end), cut in chunks, and taken surest
    and longest first: so many of a recording, until the speaker has enough, counting what the store holds
    of other recordings (existing: tenant_id, speaker_name, source, start_sec, duration_sec, id).  A clip
    that the store has at the same start is taken only if it is longer, and replaces that one (`replaces`).
    """
    own = [*SPEAKER, "recording_id"]
    rows = segments.withColumns({"speaker_name": F.col("speaker"), "_why": refusal, "_d": F.col("end_s") - F.col("start_s")})
    speech = rows.where("speaker_name IS NOT NULL").groupBy(*own).agg(F.sum(F.greatest("_d", F.lit(0.0))).alias("speech_sec"))
    fine = rows.where(F.col("_why").isNull() & (F.col("_d") >= least))
    held = existing if existing is not None else fine.select(*SPEAKER, F.col("recording_id").alias("source"), F.col("start_s").alias("start_sec"), F.col("_d").alias("duration_sec"), F.col("seq").alias("id")).where("false")
    total = held.groupBy(*SPEAKER).agg(F.sum("duration_sec").alias("_all"))
    mine = held.groupBy(*SPEAKER, F.col("source").alias("recording_id")).agg(F.sum("duration_sec").alias("_own"))
    named = profiles.where(~F.coalesce("pending", F.lit(False))).select(T, F.col("name").alias("speaker_name"), F.lit(True).alias("_known")).distinct()
    spoken = fine.groupBy(*own).agg(F.count("*").alias("spans")).join(named, SPEAKER, "left").join(total, SPEAKER, "left").join(mine, own, "left")
    spoken = spoken.withColumn("_base", F.greatest(F.coalesce("_all", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0)), F.lit(0.0)))
    skipped = F.when(F.col("_known").isNull(), "not_registered").when(F.col("spans") < 2, "too_few_spans").when(F.col("_base") >= most, "at_snippet_cap")
    spoken = spoken.withColumn("skipped", skipped)
    fine = fine.join(spoken.where("skipped IS NULL").select(*own, "_base"), own)
    if sections is not None:
        span = F.struct(T, "seq")
        cut = trim_to_sections(fine.select("recording_id", span.alias("span_id"), F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end")), sections)
        cut = cut.select("recording_id", F.col(f"span_id.{T}").alias(T), F.col("span_id.seq").alias("seq"), F.col("start_s").alias("_lo"), F.col("end_s").alias("_hi"))
        fine = fine.join(cut, ["recording_id", T, "seq"]).withColumns({"start_s": F.col("_lo"), "end_s": F.col("_hi")})
    n = F.greatest(F.ceil((F.col("end_s") - F.col("start_s")) / chunk), F.lit(1)).cast("int")
    clips = fine.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    lo = F.col("start_s") + F.col("_k") * chunk
    clips = clips.withColumns({"lo": lo, "hi": F.least(lo + chunk, "end_s")}).withColumn("_len", F.col("hi") - F.col("lo"))
    short = clips.where(F.col("_len") < least)
    old = held.select(*SPEAKER, F.col("source").alias("recording_id"), F.round("start_sec", 2).alias("_at"), F.col("duration_sec").alias("_had"), F.col("id").alias("replaces"))
    clips = clips.where(F.col("_len") >= least).withColumn("_at", F.round("lo", 2)).join(old, [*own, "_at"], "left").where("_had IS NULL OR _had < _len")
    best = [F.coalesce("speaker_confidence", F.lit(1.0)).desc(), F.col("_d").desc(), F.col("recording_id"), F.col("seq"), F.col("_k")]
    ranked = clips.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(*best)))
    kept = ranked.where(F.col("place") <= per_source)
    w = Window.partitionBy(*SPEAKER).orderBy(*best).rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("before", F.col("_base") + F.coalesce(F.sum("_len").over(w), F.lit(0.0))).where(F.col("before") < most)
    kept = kept.select(*own, "seq", "lo", "hi", "place", "before", "replaces")
    count = lambda df, name: df.groupBy(*own).agg(F.countDistinct("seq").alias(name))
    got = kept.groupBy(*own).agg(F.count("*").alias("snippets"), F.sum(F.col("hi") - F.col("lo")).alias("added_sec"))
    over = count(ranked.where(F.col("place") > per_source).join(kept.select(*own, "seq"), [*own, "seq"], "left_anti"), "over_per_file_cap")
    told = spoken.select(*own, "spans", "skipped").join(speech, own)
    for part in (got, over, count(short, "too_short_after_trim")):
        told = told.join(part, own, "left")
    return kept, told.fillna(0, ["snippets", "added_sec", "over_per_file_cap", "too_short_after_trim"])


def learn_profiles(spans: DataFrame, others: DataFrame | None = None, th: Thresholds = DEFAULTS, per_source: int = PER_SOURCE, most: float = 900.0, chunk: float = 30.0, least: float = CLIP_SEC, speech: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips, pending profiles, skipped voices with reasons) from spans of new voices.

    spans: tenant_id, speaker_name (the voice), source, span_id, start_s, end_s, embedding, and
    speaker_confidence if known; others: what the voice has from other sources (tenant_id, speaker_name,
    duration_sec).  A voice needs two spans, ten seconds, and vectors that are close to each other on
    average.  Of spans of a source that begin in the same second one counts, so that a repeat changes
    nothing; they are cut in chunks, surest and longest first, so many of a source and so much in all, the
    last one cut short.  The profiles are fitted on the clips, and pending.
    """
    if "speaker_confidence" not in spans.columns:
        spans = spans.withColumn("speaker_confidence", F.lit(None).cast("double"))
    rows = spans.dropDuplicates([*SPEAKER, "source", "start_s", "end_s"]).withColumn("_d", F.col("end_s") - F.col("start_s"))
    per = rows.groupBy(*SPEAKER).agg(F.count("*").alias("spans"), F.sum("_d").alias("speech_sec"))
    per = per.join(pairwise_mean(rows, SPEAKER).drop("n"), SPEAKER, "left")
    why = F.when(F.col("spans") < 2, "too_few_spans").when(F.col("speech_sec") < speech, "insufficient_speech").when(F.col("mean_distance") > th.cohesion, "impure_group")
    per = per.withColumn("reason", why)
    fine = rows.join(per.where("reason IS NULL").select(*SPEAKER, "mean_distance"), SPEAKER)
    fit = [F.coalesce("speaker_confidence", F.lit(1.0)).desc(), F.col("_d").desc(), F.col("source"), F.col("span_id")]
    second = Window.partitionBy(*SPEAKER, "source", F.floor("start_s")).orderBy(*fit)
    fine = fine.where(F.col("_d") >= least).withColumn("_r", F.row_number().over(second)).where("_r = 1").drop("_r")
    fine = fine.withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_d") / chunk).cast("int") - 1)))
    lo = F.col("start_s") + F.col("_k") * chunk
    fine = fine.withColumns({"lo": lo, "hi": F.least(lo + chunk, "end_s")}).where(F.col("hi") - F.col("lo") >= least)
    base = others.groupBy(*SPEAKER).agg(F.sum("duration_sec").alias("_base")) if others is not None else per.select(*SPEAKER, F.lit(0.0).alias("_base")).where("false")
    fine = fine.join(base, SPEAKER, "left").withColumn("_base", F.coalesce("_base", F.lit(0.0)))
    fine = fine.withColumn("place", F.row_number().over(Window.partitionBy(*SPEAKER, "source").orderBy(*fit, "_k"))).where(F.col("place") <= per_source)
    run = Window.partitionBy(*SPEAKER).orderBy(*fit, "_k").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.col("_base") + F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(run), F.lit(0.0)))
    fine = fine.withColumn("hi", F.least("hi", F.col("lo") + most - F.col("before"))).where(F.col("hi") - F.col("lo") >= least)
    clips = fine.select(*SPEAKER, "source", "span_id", "lo", "hi", "place", "before", "embedding", (F.col("hi") - F.col("lo")).alias("duration_sec"))
    purity = per.where("reason IS NULL").select(T, F.col("speaker_name").alias("name"), F.col("mean_distance").alias("intra_mean"))
    profiles = refit_profiles(clips, th=th).drop("dropped").join(purity, [T, "name"]).withColumn("pending", F.lit(True))
    none = per.where("reason IS NULL").join(clips.select(*SPEAKER).distinct(), SPEAKER, "left_anti").withColumn("reason", F.lit("snippets_rejected"))
    return clips.drop("embedding"), profiles, per.where("reason IS NOT NULL").unionByName(none).select(*SPEAKER, "reason", "spans", "speech_sec")


def learn_budget(spans: DataFrame, per_source: int = 10, most: float = 900.0, chunk: float = 30.0, least: float = 10.0) -> DataFrame:
    """Spans (tenant_id, speaker_name, source, span_id, start_s, end_s) that may teach a voice: two at
    least and ten seconds in all, cut to a length, so many of a source and so much in all; a span that
    is there twice counts once."""
    rows = spans.dropDuplicates([*SPEAKER, "source", "start_s"]).withColumn("end_s", F.least("end_s", F.col("start_s") + chunk)).withColumn("d", F.col("end_s") - F.col("start_s"))
    w = Window.partitionBy(*SPEAKER)
    rows = rows.withColumns({"_n": F.count("*").over(w), "_t": F.sum("d").over(w)}).where((F.col("_n") >= 2) & (F.col("_t") >= least))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*SPEAKER, "source").orderBy(F.col("d").desc(), "span_id"))).where(F.col("place") <= per_source)
    run = Window.partitionBy(*SPEAKER).orderBy(F.col("d").desc(), "source", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("d").over(run), F.lit(0.0))).where(F.col("before") + F.col("d") <= most).drop("_n", "_t")


def replace_source(snippets: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows in place of what their speaker had from their source; no fresh rows, no change."""
    return snippets.join(fresh.select(*SPEAKER, "source").distinct(), [*SPEAKER, "source"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def cap_findings(findings: DataFrame, n: int = 50) -> DataFrame:
    """A report: so many findings of each type, by their keys."""
    w = Window.partitionBy(T, "type").orderBy("speaker_name", "details")
    return findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


# -- audit ------------------------------------------------------------------------------------------


def name_collisions(profiles: DataFrame) -> DataFrame:
    """Names that are one once case, width and spaces are put aside."""
    g = profiles.groupBy(T, normalise_name(F.col("name")).alias("folded")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return g.where(F.size("names") > 1)


def duplicate_content(snippets: DataFrame) -> DataFrame:
    """Snippets whose content a speaker has under a lower id already."""
    rows = snippets.where(F.col("content_sha256").isNotNull())
    keep = F.min("id").over(Window.partitionBy(*SPEAKER, "content_sha256"))
    return rows.withColumn("kept_id", keep).where(F.col("id") > F.col("kept_id")).select(*SPEAKER, "id", "kept_id")


def stale_totals(profiles: DataFrame, snippets: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Profiles that claim far more speech than their snippets hold."""
    p = profiles.select(T, F.col("name").alias("speaker_name"), "total_speech_sec")
    return p.join(speaker_totals(snippets), SPEAKER).where((F.col("total_sec") > 0) & (F.col("total_speech_sec") > th.stale_ratio * F.col("total_sec")))


def resolve_paths(snippets: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, missing, unclaimed): a snippet's file by its path, else by the longest tail of it that
    a file of the tenant ends with; files that no snippet has."""
    files = inventory.select(T, F.col("path").alias("file"))
    direct = snippets.join(files.withColumn("file_path", F.col("file")), [T, "file_path"], "left_outer")
    open_ = direct.where("file IS NULL").drop("file")
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.struct(F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/").alias("tail"), i.alias("at")))
    s = open_.select(T, "id", F.inline(tails(F.col("file_path"))))
    f = files.select(T, "file", F.inline(tails(F.col("file")))).select(T, "file", "tail")
    best = s.join(f, [T, "tail"]).groupBy(T, "id").agg(F.min_by("file", F.struct("at", "file")).alias("file"))
    found = direct.where("file IS NOT NULL").select(T, "id", "file").unionByName(best)
    missing = snippets.select(T, "id").join(found.select(T, "id"), [T, "id"], "left_anti")
    return found, missing, files.join(found.select(T, "file"), [T, "file"], "left_anti")


def audit(store: dict[str, DataFrame], inventory: DataFrame | None = None, th: Thresholds = DEFAULTS) -> DataFrame:
    """All findings: tenant_id, type, speaker_name, details."""
    p, s = store["profiles"], store["snippets"]
    name = lambda t, df, who, what: df.select(T, F.lit(t).alias("type"), who.alias("speaker_name"), what.cast("string").alias("details"))
    out = name("near_duplicate", near_duplicate_profiles(p, [T], th.near_duplicate), F.col("a"), F.col("b"))
    out = out.unionByName(name("name_collision", name_collisions(p), F.col("folded"), F.array_join("names", "|")))
    both = orphans(p, s)
    out = out.unionByName(both.select(T, "type", "speaker_name", F.lit("").alias("details")))
    out = out.unionByName(name("duplicate_content", duplicate_content(s), F.col("speaker_name"), F.col("id")))
    out = out.unionByName(name("stale_total", stale_totals(p, s, th), F.col("speaker_name"), F.lit("")))
    if inventory is not None:
        _, missing, unclaimed = resolve_paths(s, inventory)
        out = out.unionByName(name("missing_file", missing.join(s.select(T, "id", "speaker_name"), [T, "id"]), F.col("speaker_name"), F.col("id")))
        out = out.unionByName(name("unclaimed_file", unclaimed, F.lit(""), F.col("file")))
    return out


def cleanup(store: dict[str, DataFrame], dead: DataFrame | None = None, dry_run: bool = True):
    """The plan (tenant_id, speaker_name, id, reason: the first that holds), or with dry_run=False the
    store without those snippets and with totals of the survivors."""
    s = with_source(store["snippets"])
    plan = duplicate_content(s).select(*SPEAKER, "id", F.lit("duplicate").alias("reason"), F.lit(0).alias("o"))
    if dead is not None:
        plan = plan.unionByName(s.join(dead.select(T, "id"), [T, "id"], "left_semi").select(*SPEAKER, "id", F.lit("dead").alias("reason"), F.lit(1).alias("o")))
    rest = s.join(plan.select(T, "id"), [T, "id"], "left_anti")
    plan = plan.unionByName(plan_source_trim(rest).withColumn("o", F.lit(2)))
    plan = plan.groupBy(*SPEAKER, "id").agg(F.min_by("reason", "o").alias("reason"))
    if dry_run:
        return plan
    left = delete_snippets(store["snippets"], plan)
    totals = speaker_totals(left).join(plan.select(*SPEAKER).distinct(), SPEAKER, "left_semi").select(T, F.col("speaker_name").alias("name"), F.col("total_sec").alias("total_speech_sec"))
    return store | {"snippets": left, "profiles": fix_totals(store["profiles"], totals)}


# -- re-fit and review ------------------------------------------------------------------------------


def refit_profiles(snippets: DataFrame, least: float = 1.5, th: Thresholds = DEFAULTS) -> DataFrame:
    """(tenant_id, name, embedding, total_speech_sec, sample_count, dropped, and pitch_hz, pitch_std,
    energy_rms where snippets have them): a speaker's vector, weighted by length and of length 1, and its
    statistics weighted likewise, of its usable snippets; short ones and those without a vector are dropped
    and counted.  upsert_profiles with these keeps the stored pending and purity."""
    from chronovox.functions.vectors import norm

    good = (F.col("duration_sec") >= least) & F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 1e-8)
    tagged = snippets.withColumn("_ok", F.coalesce(good, F.lit(False)))
    c = weighted_centroid(tagged.where("_ok"), SPEAKER, th=th).drop("n")
    stats = [x for x in ("pitch_hz", "pitch_std", "energy_rms") if x in snippets.columns]
    w = F.when(F.col("_ok"), F.col("duration_sec"))
    mean = lambda x: (F.sum(F.col(x) * w) / F.nullif(F.sum(F.when(F.col(x).isNotNull(), w)), F.lit(0.0))).alias(x)
    n = tagged.groupBy(*SPEAKER).agg(F.sum(w).alias("total_speech_sec"), F.count_if("_ok").alias("sample_count"), F.count_if(~F.col("_ok")).alias("dropped"), *[mean(x) for x in stats])
    return c.join(n, SPEAKER).select(T, F.col("speaker_name").alias("name"), l2_normalize(F.col("centroid")).alias("embedding"), "total_speech_sec", "sample_count", "dropped", *stats)


def score_outliers(snippets: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Snippets with distance from their speaker's centre, the speaker's cut, and outlier: beyond both
    median + k * 1.4826 * MAD and the floor, a fifth of them at most (one at least), three always left;
    the centre is taken anew without the outliers, so many rounds; no rounds only measures."""
    rows = snippets.where(F.col("embedding").isNotNull()).withColumn("outlier", F.lit(False))
    w, worst = Window.partitionBy(*SPEAKER), Window.partitionBy(*SPEAKER).orderBy(F.col("distance").desc(), "id")
    for i in range(max(1, th.outlier_rounds)):
        c = weighted_centroid(rows.where("NOT outlier"), SPEAKER, th=th).drop("n")
        d = rows.drop("distance", "cut", "outlier").join(c, SPEAKER).withColumn("distance", cosine_distance(F.col("embedding"), F.col("centroid"))).drop("centroid")
        med = d.groupBy(*SPEAKER).agg(F.median("distance").alias("_med"), F.count("*").alias("_n"))
        d = d.join(med, SPEAKER)
        mad = d.groupBy(*SPEAKER).agg(F.median(F.abs(F.col("distance") - F.col("_med"))).alias("_mad"))
        d = d.join(mad, SPEAKER).withColumn("cut", F.greatest(F.col("_med") + th.outlier_k * 1.4826 * F.col("_mad"), F.lit(th.outlier_floor)))
        most = F.least(F.greatest(F.floor(F.col("_n") * th.outlier_share), F.lit(1)), F.greatest(F.col("_n") - th.outlier_keep, F.lit(0)))
        flag = (F.col("distance") > F.col("cut")) & (F.row_number().over(worst) <= most) & (F.col("_n") >= 3) & F.lit(th.outlier_rounds > 0)
        rows = settled(d.withColumn("outlier", flag).drop("_med", "_mad", "_n"))
    return rows


def consolidate(snippets: DataFrame, th: Thresholds = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(marked snippets, re-fitted profiles with the mean distance before and after)."""
    s = score_outliers(snippets, th)
    marked = s.withColumns({"review_flag": F.col("outlier"), "review_score": F.when(F.col("outlier"), F.col("distance")), "review_reason": F.when(F.col("outlier"), "voice_outlier")})
    spread = s.groupBy(*SPEAKER).agg(F.avg("distance").alias("before"), F.avg(F.when(~F.col("outlier"), F.col("distance"))).alias("after"), F.count_if("outlier").alias("flagged"))
    fit = refit_profiles(s.where("NOT outlier"), th=th)
    return marked, fit.join(spread.withColumnRenamed("speaker_name", "name"), [T, "name"])


def resolve_review(snippets: DataFrame, keep: DataFrame | None = None, remove: bool = False) -> DataFrame:
    """Clear the marks of the snippets in keep (of all, if there is none), or remove what is marked."""
    if remove:
        return snippets.where(~F.coalesce("review_flag", F.lit(False)))
    if keep is None:
        return snippets.withColumns({"review_flag": F.lit(False), "review_score": F.lit(None).cast("double"), "review_reason": F.lit(None).cast("string")})
    k = keep.select(T, "id", F.lit(True).alias("_k"))
    rows = snippets.join(k, [T, "id"], "left")
    return rows.withColumns({c: F.when(F.col("_k").isNull(), F.col(c)).otherwise(F.lit(v)) for c, v in (("review_flag", False), ("review_score", None), ("review_reason", None))}).drop("_k")


def drop_empty_profiles(profiles: DataFrame, snippets: DataFrame) -> DataFrame:
    return profiles.join(snippets.select(T, F.col("speaker_name").alias("name")).distinct(), [T, "name"], "left_semi")


# -- renames, merges, purges ------------------------------------------------------------------------


def rename_speaker(store: dict[str, DataFrame], mapping: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(store, refused): speakers renamed in profiles, snippets and the segments within transcripts, by
    (tenant_id, old_name, new_name); a new name that a tenant has already is refused."""
    taken = store["profiles"].select(T, F.col("name").alias("new_name"))
    refused = mapping.join(taken, [T, "new_name"], "left_semi")
    m = mapping.join(taken, [T, "new_name"], "left_anti").select(T, "old_name", "new_name")

    def swap(df: DataFrame, col: str) -> DataFrame:
        j = df.join(m.withColumnRenamed("old_name", col), [T, col], "left")
        return j.withColumn(col, F.coalesce("new_name", col)).drop("new_name").select(*df.columns)

    out = store | {"profiles": swap(store["profiles"], "name"), "snippets": swap(store["snippets"], "speaker_name")}
    if "transcripts" in store:
        names = m.groupBy(T).agg(F.map_from_entries(F.collect_list(F.struct("old_name", "new_name"))).alias("_m"))
        t = store["transcripts"].join(names, T, "left")
        new = F.transform("segments", lambda x: x.withField("speaker", F.coalesce(F.try_element_at(F.col("_m"), x["speaker"]), x["speaker"])))
        out["transcripts"] = t.withColumn("segments", F.when(F.col("_m").isNull(), F.col("segments")).otherwise(new)).select(*store["transcripts"].columns)
    return out, refused


def merge_speakers(store: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Snippets of old_name go to new_name, whose profile is fitted anew; old profiles go."""
    m = mapping.select(T, F.col("old_name").alias("speaker_name"), "new_name")
    s = store["snippets"]
    moved = s.join(m, SPEAKER, "left").withColumn("speaker_name", F.coalesce("new_name", "speaker_name")).select(*s.columns)
    touched = mapping.select(T, F.col("new_name").alias("speaker_name")).distinct()
    fit = refit_profiles(moved.join(touched, SPEAKER, "left_semi")).drop("dropped")
    left = store["profiles"].join(mapping.select(T, F.col("old_name").alias("name")), [T, "name"], "left_anti")
    return store | {"snippets": moved, "profiles": upsert_profiles(left, fit)}


def confirm_pending(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (tenant_id, pending_name, new_name) with its error, or null: no such pending voice,
    no name, or a name that is taken."""
    pend = profiles.where("pending").select(T, F.col("name").alias("pending_name"), F.lit(True).alias("_p"))
    taken = profiles.select(T, F.col("name").alias("new_name"), F.lit(True).alias("_t"))
    r = requests.join(pend, [T, "pending_name"], "left").join(taken, [T, "new_name"], "left")
    err = F.when(F.col("_p").isNull(), "not_pending").when(F.coalesce(F.trim("new_name"), F.lit("")) == "", "no_name").when(F.col("_t"), "name_taken")
    return r.withColumn("error", err).drop("_p", "_t")


def delete_speakers(store: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    n = names.select(T, "name").distinct()
    return store | {"profiles": store["profiles"].join(n, [T, "name"], "left_anti"), "snippets": store["snippets"].join(n.withColumnRenamed("name", "speaker_name"), SPEAKER, "left_anti")}


def purge_tenant(store: dict[str, DataFrame], ids: DataFrame, purge: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(store, counts): how many rows each table holds of the tenants; they go only with purge."""
    ids = ids.select(T).distinct()
    counts, out = None, {}
    for name, df in store.items():
        c = ids.join(df.groupBy(T).agg(F.count("*").alias("rows")), T, "left").select(T, F.lit(name).alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"))
        counts = c if counts is None else counts.unionByName(c)
        out[name] = df.join(ids, T, "left_anti") if purge else df
    return out, counts


# -- rescan, rebuild --------------------------------------------------------------------------------


def rescan(inventory: DataFrame, snippets: DataFrame, least: float = 1.5) -> DataFrame:
    """Every file and snippet row with a status: new (long enough), ignored, changed, unfingerprinted,
    gone or same."""
    f = inventory.select(T, F.col("path").alias("file_path"), "size", "mtime", F.col("duration_sec").alias("f_dur"), F.col("speaker_name").alias("f_speaker"))
    s = snippets.select(T, "file_path", "id", "file_size", "file_mtime", "speaker_name")
    j = f.join(s, [T, "file_path"], "full_outer")
    status = (
        F.when(F.col("id").isNull(), F.when(F.col("f_dur") >= least, "new").otherwise("ignored"))
        .when(F.col("size").isNull(), "gone")
        .when(F.col("file_size").isNull() | F.col("file_mtime").isNull(), "unfingerprinted")
        .when((F.col("size") != F.col("file_size")) | (F.col("mtime") != F.col("file_mtime")), "changed")
        .otherwise("same")
    )
    return j.select(T, "file_path", "id", F.coalesce("speaker_name", "f_speaker").alias("speaker_name"), status.alias("status"))


def rescan_targets(scan: DataFrame, snippets: DataFrame, profiles: DataFrame, force: bool = False) -> DataFrame:
    """Speakers to fit anew: of new and changed files, and those with snippets but no profile; all with
    force."""
    if force:
        return snippets.select(*SPEAKER).distinct()
    bare = snippets.select(*SPEAKER).distinct().join(profiles.select(T, F.col("name").alias("speaker_name")), SPEAKER, "left_anti")
    return scan.where(F.col("status").isin("new", "changed")).select(*SPEAKER).union(bare).distinct()


def rebuild_targets(findings: DataFrame, done: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """(tenant_id, speaker_name, reasons, fingerprint): findings of one speaker together; what was done
    for the same reasons, or tried too often (done: fingerprint, status, attempts), is left out."""
    g = findings.where(F.col("speaker_name") != "").groupBy(*SPEAKER).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("reasons"))
    g = g.withColumn("fingerprint", F.md5(F.concat_ws("|", F.col(T).cast("string"), "speaker_name", "reasons").cast("binary")))
    if done is None:
        return g
    out = done.where((F.col("status") == "done") | (F.col("attempts") >= attempts))
    return g.join(out.select("fingerprint"), "fingerprint", "left_anti")


def rebuild_profiles(store: dict[str, DataFrame], targets: DataFrame, missing: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(store, status per target): dead snippet rows of the targets go; speakers left with none lose
    their profile, the others are fitted anew with pending and purity kept."""
    t = targets.select(*SPEAKER).distinct()
    dead = store["snippets"].join(missing.select(T, "id"), [T, "id"], "left_semi").join(t, SPEAKER, "left_semi")
    s = delete_snippets(store["snippets"], dead)
    fit = refit_profiles(s.join(t, SPEAKER, "left_semi")).drop("dropped")
    status = t.join(fit.select(T, F.col("name").alias("speaker_name"), F.lit(True).alias("_f")), SPEAKER, "left").select(*SPEAKER, F.when(F.col("_f"), "refitted").otherwise("dropped").alias("status"))
    gone = status.where("status = 'dropped'").select(T, F.col("speaker_name").alias("name"))
    p = upsert_profiles(store["profiles"].join(gone, [T, "name"], "left_anti"), fit)
    return store | {"profiles": p, "snippets": s}, status
