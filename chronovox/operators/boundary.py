"""Where to cut between two adjacent spans: by who owns the speech about the gap, by an energy dip,
by the quietest frame, or in the middle; and the statistics of such cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.vectors import cosine_distance
from chronovox.operators.intervals import KEYS, order, range_join


def section_owners(sections: DataFrame, left: str = "left_ref", right: str = "right_ref") -> DataFrame:
    """owner (0 left, 1 right: the nearer reference) and weight (how much nearer, at least 1e-3)."""
    sa, sb = 1.0 - cosine_distance(F.col("embedding"), F.col(left)), 1.0 - cosine_distance(F.col("embedding"), F.col(right))
    return sections.withColumns({"owner": F.when(sb > sa, 1).otherwise(0), "weight": F.abs(sa - sb) + 1e-3})


def best_split(sections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, cost, n): the cut before section k (0 .. n) with the least weight on the wrong side,
    the earliest on ties: running sums from either side, and one row per group for k = n."""
    w, back = Window.partitionBy(*keys).orderBy("pos"), Window.partitionBy(*keys).orderBy(F.desc("pos"))
    wrong_left, wrong_right = F.when(F.col("owner") == 1, F.col("weight")).otherwise(0.0), F.when(F.col("owner") == 0, F.col("weight")).otherwise(0.0)
    rows = sections.withColumns(
        {
            "k": F.row_number().over(w) - 1,
            "_l": F.coalesce(F.sum(wrong_left).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_r": F.sum(wrong_right).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).select(*keys, "k", (F.col("_l") + F.col("_r")).alias("cost"))
    last = sections.groupBy(*keys).agg(F.count("*").cast("int").alias("k"), F.sum(wrong_left).alias("cost"))
    both = rows.unionByName(last)
    return both.groupBy(*keys).agg(F.min_by("k", F.struct(F.round("cost", 12), "k")).alias("k"), F.min("cost").alias("cost"), F.max("k").alias("n"))


def ownership_cut(sections: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cut): the start of the first right-owned section after the split, in the middle between
    the last left one's centre and the first right one's where they overlap; null for k = n (the gap's
    end is meant)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = sections.withColumn("_k", F.row_number().over(w) - 1).join(splits, keys)
    mid = (F.col("start_s") + F.col("end_s")) / 2
    g = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_k") < F.col("k"), F.struct("_k", mid.alias("mid"), "end_s"))).alias("l"), F.min(F.when(F.col("_k") >= F.col("k"), F.struct("_k", mid.alias("mid"), "start_s"))).alias("r"), F.max("k").alias("k"), F.max("n").alias("n")
    )
    cut = F.when(F.col("k") == F.col("n"), None).when(F.col("l").isNull() | (F.col("l.end_s") <= F.col("r.start_s")), F.col("r.start_s")).otherwise((F.col("l.mid") + F.col("r.mid")) / 2)
    return g.select(*keys, cut.alias("cut"))


def _near(gaps: DataFrame, frames: DataFrame, frame_s: float, bucket: float) -> DataFrame:
    f = frames.select(*KEYS, "frame_idx", "rms", (F.col("frame_idx") * frame_s).alias("p_start"), (F.col("frame_idx") * frame_s).alias("p_end"))
    return range_join(f, gaps.select(*KEYS, "gap_id", F.col("lo").alias("s_start"), F.col("hi").alias("s_end")), bucket)


def energy_dip_cut(gaps: DataFrame, frames: DataFrame, ratio: float = 0.35, least: float = 0.12, frame_s: float = 1.0, bucket: float = 60.0) -> DataFrame:
    """(recording_id, gap_id, cut): the middle of the longest run of frames quieter than a ratio of the
    peak between lo and hi; of equals the one nearest to the middle."""
    per = [*KEYS, "gap_id"]
    near = _near(gaps, frames, frame_s, bucket)
    near = near.withColumn("_peak", F.max("rms").over(Window.partitionBy(*per))).where(F.col("rms") < ratio * F.col("_peak"))
    near = near.withColumn("_i", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*per).orderBy("frame_idx")))
    runs = near.groupBy(*per, "_i").agg(F.count("*").alias("n"), ((F.min("frame_idx") + F.max("frame_idx") + 1) / 2.0 * frame_s).alias("c"), F.first((F.col("s_start") + F.col("s_end")) / 2).alias("m"))
    runs = runs.where(F.col("n") * frame_s >= least)
    return runs.groupBy(*per).agg(F.max_by("c", F.struct("n", -F.abs(F.col("c") - F.col("m")), -F.col("c"))).alias("cut"))


def quietest_cut(gaps: DataFrame, frames: DataFrame, frame_s: float = 1.0, bucket: float = 60.0) -> DataFrame:
    """(recording_id, gap_id, cut): the middle of the quietest frame, the first of equals; none where
    nothing sounds."""
    near = _near(gaps, frames, frame_s, bucket)
    g = near.groupBy(*KEYS, "gap_id").agg(F.min_by("frame_idx", F.struct("rms", "frame_idx")).alias("i"), F.max("rms").alias("peak"))
    return g.where("peak > 0").select(*KEYS, "gap_id", ((F.col("i") + 0.5) * frame_s).alias("cut"))


def gaps_between(spans: DataFrame, around: float = 0.5) -> DataFrame:
    """Every boundary of neighbouring spans of different speakers: gap_id (the left one's seq), its two
    sides, and the stretch in which a cut may lie."""
    w = order()
    n = lambda c: F.lead(c).over(w)
    g = spans.select(*KEYS, F.col("seq").alias("gap_id"), F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"), n("start_s").alias("r_start"), n("end_s").alias("r_end"), F.col("speaker").alias("l_speaker"), n("speaker").alias("r_speaker"))
    g = g.where(F.col("r_start").isNotNull() & ~F.col("l_speaker").eqNullSafe(F.col("r_speaker")))
    lo = F.greatest(F.least("l_end", "r_start") - around, F.col("l_start"))
    return g.withColumns({"lo": lo, "hi": F.greatest(F.least(F.greatest("l_end", "r_start") + around, F.col("r_end")), lo)})


def cut_boundaries(gaps: DataFrame, owned: DataFrame | None = None, dips: DataFrame | None = None, quiet: DataFrame | None = None) -> DataFrame:
    """Each gap with cut and method: the first of ownership, dip, quietest and midpoint that has one,
    kept a millisecond within both spans, 4 places."""
    per = [*KEYS, "gap_id"]
    out, found = gaps, []
    for name, cuts in (("ownership", owned), ("energy_dip", dips), ("quietest", quiet)):
        if cuts is not None:
            out = out.join(cuts.select(*per, F.col("cut").alias(name)), per, "left")
            found.append(name)
    mid = (F.col("l_end") + F.col("r_start")) / 2
    method = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in found], F.lit("midpoint"))
    cut = F.coalesce(*[F.col(n) for n in found], mid)
    cut = F.round(F.least(F.greatest(cut, F.col("l_start") + 0.001), F.col("r_end") - 0.001), 4)
    return out.withColumns({"cut": cut, "method": method}).drop(*found)


def refine_gaps(spans: DataFrame, cuts: DataFrame, least: float = 0.0, shift: float = 0.001) -> DataFrame:
    """Both sides of every cut moved to it, all cuts in one pass; a cut that would leave a side too
    short, or moves nothing, is refused."""
    per = list(KEYS)
    good = cuts.where((F.col("cut") - F.col("l_start") > least) & (F.col("r_end") - F.col("cut") > least) & (F.greatest(F.abs(F.col("cut") - F.col("l_end")), F.abs(F.col("cut") - F.col("r_start"))) > shift))
    c = good.select(*per, F.col("gap_id").alias("seq"), "cut")
    rows = spans.withColumn("_prev", F.lag("seq").over(order())).join(c, [*per, "seq"], "left").join(c.select(*per, F.col("seq").alias("_prev"), F.col("cut").alias("_before")), [*per, "_prev"], "left")
    lo, hi = F.coalesce("_before", "start_s"), F.coalesce("cut", "end_s")
    return rows.select(*per, "seq", lo.alias("start_s"), F.greatest(hi, lo).alias("end_s"), "speaker")


def boundary_stats(cuts: DataFrame) -> DataFrame:
    """Per method: how many cuts, and how far they moved."""
    moved = F.abs(F.col("cut") - (F.col("l_end") + F.col("r_start")) / 2)
    return cuts.groupBy("method").agg(F.count("*").alias("cuts"), F.percentile(moved, 0.5).alias("p50"), F.percentile(moved, 0.9).alias("p90"), F.max(moved).alias("largest"))


def boundary_error(cuts: DataFrame, sections: DataFrame) -> DataFrame:
    """Distance of each cut from the nearest edge of a section, as p50, p90 and largest per recording: a
    fill from either side over cuts and edges in one order."""
    edge = sections.select(*KEYS, F.explode(F.array("start_s", "end_s")).alias("t"), F.lit(0).alias("tag"))
    both = edge.unionByName(cuts.select(*KEYS, F.col("cut").alias("t"), F.lit(1).alias("tag")))
    w, back = Window.partitionBy(*KEYS).orderBy("t", "tag"), Window.partitionBy(*KEYS).orderBy(F.desc("t"), F.desc("tag"))
    e = F.when(F.col("tag") == 0, F.col("t"))
    seen = lambda v: F.last(e, True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    d = F.least(F.col("t") - seen(w), seen(back) - F.col("t"))
    rows = both.withColumn("d", d).where("tag = 1 AND d IS NOT NULL")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("cuts"), F.percentile("d", 0.5).alias("p50"), F.percentile("d", 0.9).alias("p90"), F.max("d").alias("largest"))


def reason_histogram(df: DataFrame, reason: Column, examples: int = 25, keys: tuple = KEYS) -> DataFrame:
    """How often each reason occurs, with some examples; the counts are of all rows."""
    rows = df.withColumn("reason", reason).where(F.col("reason").isNotNull())
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("reason").orderBy(*keys, "seq"))).where(F.col("_n") <= examples)
    shown = top.groupBy("reason").agg(F.sort_array(F.collect_list(F.struct(*keys, "seq"))).alias("examples"))
    return rows.groupBy("reason").agg(F.count("*").alias("rows")).join(shown, "reason")
