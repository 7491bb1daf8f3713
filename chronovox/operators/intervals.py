"""Interval and timeline operators.  Tables have recording_id, seq, start_s, end_s (seconds); a
recording is a window partition, recordings are spread over the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.labels import has_identity, is_overlap, suppress
from chronovox.thresholds import DEFAULTS, Thresholds

KEYS = ("recording_id",)


def order(*more: str):
    return Window.partitionBy(*KEYS, *more).orderBy("start_s", "seq")


def islands(df: DataFrame, begins: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows of each recording; a true `begins` opens a new one."""
    return df.withColumn(name, F.sum(F.coalesce(begins.cast("int"), F.lit(1))).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def running_end(more: tuple = ()) -> Column:
    """Largest end of all earlier rows of the recording."""
    return F.max("end_s").over(order(*more).rowsBetween(Window.unboundedPreceding, -1))


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


# -- sessionisation ---------------------------------------------------------------------------------


def merge_intervals(df: DataFrame, gap: float) -> DataFrame:
    """Intervals of any label whose gap to all before them is small enough become one."""
    marked = islands(df, F.col("start_s") - running_end() > gap)
    return marked.groupBy(*KEYS, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("parts")).drop("island")


#: Columns of a run's first row that the run keeps, where there are any.
EVIDENCE = ("speaker_confidence", "speaker_margin", "speaker_match_dist", "speaker_source", "uncertain", "attribution_reason", "original_speaker", "alternatives")


def _runs(df: DataFrame, begins: Column, text: bool) -> DataFrame:
    marked = islands(df, begins)
    aggs = [F.min("seq").alias("seq"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("speaker", "seq").alias("speaker"), F.count("*").alias("parts")]
    aggs += [F.min_by(c, "seq").alias(c) for c in EVIDENCE if c in df.columns]
    if text and "text" in df.columns:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))
    return marked.groupBy(*KEYS, "island").agg(*aggs).drop("island")


def collapse_runs(df: DataFrame, gap: float = 1.5, text: bool = True) -> DataFrame:
    """Neighbours with the same label (null equals null here) and a small gap become one; a run's end
    is the largest of its rows'."""
    tagged = df.withColumn("_label", F.coalesce("speaker", F.lit("\x00")))
    tagged = tagged.withColumn("_same", F.lag("_label").over(order()) == F.col("_label"))
    # a first pass numbers label runs, so that the running end is of the run only
    first = islands(tagged, ~F.col("_same"), "_run")
    begins = F.col("start_s") - F.max("end_s").over(Window.partitionBy(*KEYS, "_run").orderBy("start_s", "seq").rowsBetween(Window.unboundedPreceding, -1)) > gap
    first = first.withColumn("_gap", F.coalesce(begins, F.lit(True)))
    return _runs(first, F.col("_gap"), text)


def collapse_confident(df: DataFrame, gap: float = 1.5, text: bool = True) -> DataFrame:
    """As collapse_runs, but rows without a sure identity stay single and end the runs about them."""
    sure = has_identity(F.col("speaker")) & ~F.coalesce(F.col("uncertain"), F.lit(False))
    tagged = df.withColumn("_sure", sure)
    same = F.col("_sure") & F.lag("_sure").over(order()) & (F.lag("speaker").over(order()) == F.col("speaker"))
    first = islands(tagged, ~F.coalesce(same, F.lit(False)), "_run")
    begins = F.col("start_s") - F.max("end_s").over(Window.partitionBy(*KEYS, "_run").orderBy("start_s", "seq").rowsBetween(Window.unboundedPreceding, -1)) > gap
    first = first.withColumn("_gap", F.coalesce(begins, F.lit(True)))
    return _runs(first, F.col("_gap"), text)


def to_turns(df: DataFrame, gap: float = DEFAULTS.turn_gap) -> DataFrame:
    """Segments of one known speaker with small gaps become a turn: evidence of the first, end of the
    last, all segments as children.  A null speaker equals none, so such rows stay alone."""
    same = (F.lag("speaker").over(order()) == F.col("speaker")) & (F.col("start_s") - F.lag("end_s").over(order()) <= gap)
    marked = islands(df, ~F.coalesce(same, F.lit(False)))
    child = F.struct("start_s", "seq", "end_s")
    return (
        marked.groupBy(*KEYS, "island")
        .agg(
            F.min("seq").alias("seq"),
            F.min_by("start_s", "seq").alias("start_s"),
            F.max_by("end_s", "seq").alias("end_s"),
            F.min_by("speaker", "seq").alias("speaker"),
            F.min_by("speaker_confidence", "seq").alias("speaker_confidence"),
            F.array_sort(F.collect_list(child)).alias("children"),
        )
        .drop("island")
    )


def cut_pieces(start: np.ndarray, end: np.ndarray, most: float) -> list[tuple[int, int]]:
    """(first, last) child of each piece of a turn, 1-based and in order, in one pass over its children.

    The gaps' tree, in which each stands above the smaller ones on either side and the first of equal ones
    on top, is built with a stack; a piece that is too long is cut where its tree's root is.
    """
    n = len(start)
    gap = np.maximum(start[1:] - end[:-1], 0.0).tolist()
    left, right, stack = [-1] * (n - 1), [-1] * (n - 1), []
    for i, g in enumerate(gap):
        below = -1
        while stack and gap[stack[-1]] < g:
            below = stack.pop()
        left[i] = below
        if stack:
            right[stack[-1]] = i
        stack.append(i)
    out, todo = [], [(0, n - 1, stack[0] if stack else -1)]
    while todo:
        lo, hi, root = todo.pop()
        if lo == hi or end[hi] - start[lo] <= most:
            out.append((lo + 1, hi + 1))
        else:
            todo += [(root + 1, hi, right[root]), (lo, root, left[root])]
    return out


def split_long_turns(turns: DataFrame, most: float = 120.0) -> DataFrame:
    """Turns longer than `most` are cut at their largest inner gap, the first of equal ones, again and
    again, until each piece fits or has one child; without a gap the cut is after the first child.  Long
    turns' children go through cut_pieces in Arrow batches, all else stays as it is; no shuffle."""

    @F.pandas_udf("array<struct<lo: int, hi: int>>")
    def pieces(start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else [{"lo": lo, "hi": hi} for lo, hi in cut_pieces(np.asarray(a, float), np.asarray(b, float), most)] for a, b in zip(start, end, strict=True)], dtype=object)

    kids = F.col("children")
    long = F.col("end_s") - F.col("start_s") > most
    sides = [F.when(long, _side(kids, c)) for c in ("start_s", "end_s")]
    short = F.array(F.struct(F.lit(1).alias("lo"), F.size(kids).alias("hi")))
    out = turns.withColumn("_cut", pieces(*sides)).withColumn("_p", F.explode(F.coalesce("_cut", short)))
    child = lambda i: F.element_at(kids, F.col(f"_p.{i}"))
    return out.select(*KEYS, child("lo")["seq"].alias("seq"), child("lo")["start_s"].alias("start_s"), child("hi")["end_s"].alias("end_s"), "speaker", (F.col("_p.hi") - F.col("_p.lo") + 1).alias("parts"))


def _side(children: Column, name: str) -> Column:
    return F.transform(children, lambda x: x[name].cast("double"))


def resolve_overlaps(df: DataFrame) -> DataFrame:
    """Where a segment begins before the kept one before it ends, both meet in the middle of the
    overlap; empty ones go.  A fold over each run of segments in which one begins before another's end:
    a segment after all ends before it meets none of them."""
    item = F.struct("start_s", "seq", "end_s", "speaker")
    rows = islands(df, F.col("start_s") >= running_end()).groupBy(*KEYS, "island").agg(F.array_sort(F.collect_list(item)).alias("a"))

    def step(done, x):
        last = F.element_at(done, -1)
        mid = (x["start_s"] + last["end_s"]) / 2
        hit = (F.size(done) > 0) & (x["start_s"] < last["end_s"])
        cut = F.struct(last["start_s"].alias("start_s"), last["seq"].alias("seq"), mid.alias("end_s"), last["speaker"].alias("speaker"))
        new = F.struct(mid.alias("start_s"), x["seq"].alias("seq"), x["end_s"].alias("end_s"), x["speaker"].alias("speaker"))
        keep = lambda s: F.when(s["end_s"] > s["start_s"], F.array(s)).otherwise(F.slice(F.array(s), 1, 0))
        return F.when(hit, F.concat(F.slice(done, 1, F.size(done) - 1), keep(cut), keep(new))).otherwise(F.concat(done, keep(x)))

    kind = "array<struct<start_s:double,seq:bigint,end_s:double,speaker:string>>"
    a = F.col("a").cast(kind)
    rows = rows.withColumn("a", F.aggregate(a, F.array().cast(kind), lambda d, x: F.when(F.size(d) == 0, F.when(x["end_s"] > x["start_s"], F.array(x)).otherwise(d)).otherwise(step(d, x))))
    return rows.select(*KEYS, F.inline("a"))


def settle_islands(rows: list[list], least: float, near: float = 1.0) -> list[list]:
    """[seq, start, end, speaker] of a stretch, whose neighbours join in any case: the rule of absorb_islands."""
    joined = False
    while True:
        taken = False
        for i in range(1, len(rows) - 1):
            name, side = rows[i][3], rows[i - 1][3]
            if name != "OVERLAP" and rows[i][2] - rows[i][1] < least and side == rows[i + 1][3] and name != side:
                rows[i][3], taken = side, True
        if joined and not taken:
            return rows
        kept = rows[:1]
        for r in rows[1:]:
            if r[3] == kept[-1][3] and r[1] - kept[-1][2] <= near:
                kept[-1][2] = max(kept[-1][2], r[2])
            else:
                kept.append(r)
        rows, joined = kept, True


def absorb_islands(df: DataFrame, least: float = 1.0) -> DataFrame:
    """A short segment between two of one speaker takes that speaker, left to right, OVERLAP excepted;
    then neighbours within a second join; both again until nothing changes.

    A segment of `least` or more, or OVERLAP, keeps its label for good, so between two such neighbours with
    different labels nothing can ever join or be taken: a recording is cut there, and each stretch settles by
    itself, in Arrow batches.  Whether anything changes in a recording at all, which joins neighbours in all of
    its stretches, is seen from each segment's neighbours.
    """
    rows = df.select(*KEYS, F.col("seq").cast("long").alias("seq"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "speaker")
    w = order()
    lag, lead, inner = F.lag("speaker").over(w), F.lead("speaker").over(w), F.lag("seq").over(w).isNotNull() & F.lead("seq").over(w).isNotNull()
    short = F.coalesce(F.col("speaker") != "OVERLAP", F.lit(True)) & (F.col("end_s") - F.col("start_s") < least)
    rows = rows.withColumns({"_fixed": ~short, "_taken": short & inner & lag.eqNullSafe(lead) & ~F.col("speaker").eqNullSafe(lag)})
    rows = rows.withColumn("_any", F.max("_taken").over(Window.partitionBy(*KEYS)))
    apart = F.col("_fixed") & F.lag("_fixed").over(w) & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    rows = islands(rows, F.coalesce(apart, F.lit(False)))
    same = rows.where("NOT _any").select(*KEYS, "seq", "start_s", "end_s", "speaker")
    kind = "array<struct<seq: bigint, start_s: double, end_s: double, speaker: string>>"

    @F.pandas_udf(kind)
    def settle(stretches: pd.Series) -> pd.Series:
        done = ([settle_islands([[x["seq"], x["start_s"], x["end_s"], x["speaker"]] for x in s], least)] for s in stretches)
        return pd.Series([[{"seq": r[0], "start_s": r[1], "end_s": r[2], "speaker": r[3]} for r in one] for (one,) in done], dtype=object)

    item = F.struct("start_s", "seq", "end_s", "speaker")
    stretch = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["seq"].alias("seq"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["speaker"].alias("speaker")))
    moved = rows.where("_any").groupBy(*KEYS, "island").agg(stretch.alias("s")).select(*KEYS, F.inline(settle("s")))
    return same.unionByName(moved)


# -- dominance of speakers --------------------------------------------------------------------------


def absorb_minority(df: DataFrame, protected: tuple[str, ...] = (), th: Thresholds = DEFAULTS, withhold: bool = True, keep: Column | None = None) -> DataFrame:
    """Speakers without one long utterance and with little speech in all lose their name (withhold),
    or their segments go to the nearest main speaker; where nobody is main nothing changes.  Protected
    names, and speakers of rows where `keep` holds, are main."""
    per = Window.partitionBy(*KEYS, "speaker")
    dur = F.col("end_s") - F.col("start_s")
    name = F.col("speaker")
    real = name.isNotNull() & (name != "")
    main = (F.max(dur).over(per) >= th.minority_utterance) | (F.sum(dur).over(per) >= th.minority_sec)
    if protected:
        main = main | name.isin(*protected)
    if keep is not None:
        main = main | keep
    main = real & main
    tagged = df.withColumn("_main", main)
    some = F.max(F.col("_main").cast("int")).over(Window.partitionBy(*KEYS)) == 1
    tagged = tagged.withColumn("_minor", real & ~F.col("_main") & some)
    if withhold:
        return suppress(tagged, F.col("_minor"), F.lit("minority_speaker")).drop("_main", "_minor")
    return nearest_label(tagged, F.col("_main")).withColumn("speaker", F.when(F.col("_minor"), F.col("_nearest")).otherwise(name)).drop("_main", "_minor", "_nearest")


def eliminate_ghosts(df: DataFrame, th: Thresholds = DEFAULTS, withhold: bool = True, collapse: bool = False, gap: float = 1.5) -> DataFrame:
    """Speakers with little speech and no large share of it: the first alternative that is no ghost
    takes their segments; without one the name is withheld, or (withhold=False) that of the nearest
    speaker who is none, by midpoint, the earlier on a tie, and 'Speaker 1' where nobody is left.  With
    collapse, neighbours of one speaker join at the end: sure ones only, if names are withheld."""
    dur = F.col("end_s") - F.col("start_s")
    per, whole = Window.partitionBy(*KEYS, "speaker"), Window.partitionBy(*KEYS)
    real = F.col("speaker").isNotNull() & (F.col("speaker") != "")
    total = F.sum(dur).over(per)
    share = F.when(real, total) / F.nullif(F.sum(F.when(real, dur)).over(whole), F.lit(0.0))
    tagged = df.withColumn("_ghost", real & (total < th.ghost_sec) & ~F.coalesce(share > th.ghost_share, F.lit(False)))
    tagged = tagged.withColumn("_ghosts", F.collect_set(F.when(F.col("_ghost"), F.col("speaker"))).over(whole))
    other = F.try_element_at(F.filter("alternatives", lambda x: x.isNotNull() & (x != "") & ~F.array_contains(F.col("_ghosts"), x)), F.lit(1))
    tagged = tagged.withColumn("_other", F.when(F.col("_ghost"), other))
    if withhold:
        out = suppress(tagged, F.col("_ghost") & F.col("_other").isNull(), F.lit("ghost_speaker"))
    else:
        out = nearest_label(tagged, ~F.col("_ghost") & real)
        out = out.withColumn("_other", F.when(F.col("_ghost"), F.coalesce("_other", "_nearest", F.lit("Speaker 1")))).drop("_nearest")
    out = out.withColumn("speaker", F.coalesce("_other", "speaker")).drop("_ghost", "_ghosts", "_other")
    if not collapse:
        return out
    return collapse_confident(out, gap) if withhold else collapse_runs(out, gap)


def nearest_label(df: DataFrame, known: Column) -> DataFrame:
    """_nearest: the label of the nearest known row by midpoint, of the earlier one on a tie: a fill
    from either side, no pair made."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    at, back_to = Window.partitionBy(*KEYS).orderBy("_mid", "seq"), Window.partitionBy(*KEYS).orderBy(F.desc("_mid"), F.desc("seq"))
    rows = df.withColumn("_mid", mid).withColumn("_k", known).withColumn("_v", F.when(F.col("_k"), F.struct("_mid", "speaker")))
    # the row after is the last one seen in the opposite order: a frame that runs to the end would be read anew for each row
    rows = rows.withColumns({"_b": F.last("_v", True).over(at.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.last("_v", True).over(back_to.rowsBetween(Window.unboundedPreceding, 0))})
    back, ahead = F.col("_mid") - F.col("_b._mid"), F.col("_a._mid") - F.col("_mid")
    near = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b.speaker")).otherwise(F.col("_a.speaker"))
    return rows.withColumn("_nearest", near).drop("_mid", "_k", "_v", "_b", "_a")


def fill_nearest(windows: DataFrame) -> DataFrame:
    """Rows without a label take that of the nearest labelled one."""
    return nearest_label(windows, F.col("speaker").isNotNull()).withColumn("speaker", F.coalesce("speaker", "_nearest")).drop("_nearest")


def number_speakers(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """'Speaker N' by the order in which clusters first appear."""
    first = df.where(F.col(cluster).isNotNull()).groupBy(*KEYS, cluster).agg(F.min(F.struct("start_s", "seq")).alias("_f"))
    first = first.withColumn("speaker", F.concat(F.lit("Speaker "), F.row_number().over(Window.partitionBy(*KEYS).orderBy("_f"))))
    return df.join(first.drop("_f"), [*KEYS, cluster], "left")


def relabel_by_pitch(profiles: DataFrame) -> DataFrame:
    """old name -> 'Speaker N' by rising pitch, unknown pitch last."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.when(F.col("pitch_hz") > 0, F.col("pitch_hz")).otherwise(9999.0), "speaker"))
    return profiles.select(*KEYS, F.col("speaker").alias("old_name"), F.concat(F.lit("Speaker "), rank).alias("new_name"))


def close_timeline(turns: DataFrame, length: Column) -> DataFrame:
    """Turns that cover 0 .. length once: a gap closes in its middle, so does an overlap; the first
    starts at 0, the last ends with the recording."""
    w = order()
    mid = lambda a, b: (a + b) / 2
    before, after = F.lag("end_s").over(w), F.lead("start_s").over(w)
    rows = turns.withColumns({"_b": before, "_a": after, "_len": length})
    return rows.withColumns(
        {
            "start_s": F.when(F.col("_b").isNull(), 0.0).otherwise(mid(F.col("_b"), F.col("start_s"))),
            "end_s": F.when(F.col("_a").isNull(), F.col("_len")).otherwise(mid(F.col("end_s"), F.col("_a"))),
        }
    ).drop("_b", "_a", "_len")


def cover_timeline(turns: DataFrame, length: Column, cuts: DataFrame | None = None, least: float = 1e-3) -> DataFrame:
    """Turns without gaps: one of more than a millisecond closes at its cut (recording_id, seq of the turn
    before it, cut), in its middle where there is none; overlaps stay.  The first turn begins at 0 and the
    last ends with the recording."""
    w = order()
    rows = turns if cuts is None else turns.join(cuts.select(*KEYS, "seq", F.col("cut").alias("_cut")), [*KEYS, "seq"], "left")
    rows = rows.withColumns({"_len": length, "_a": F.lead("start_s").over(w), "_b": F.lag("end_s").over(w)})
    middle = (F.col("end_s") + F.col("_a")) / 2
    rows = rows.withColumn("_cut", F.when(F.col("_a") - F.col("end_s") > least, middle if cuts is None else F.coalesce("_cut", middle)))
    rows = rows.withColumn("_before", F.lag("_cut").over(w))
    start = F.when(F.col("_b").isNull() & (F.col("start_s") > least), 0.0).otherwise(F.coalesce("_before", "start_s"))
    end = F.when(F.col("_a").isNull() & (F.col("_len") - F.col("end_s") > least), F.col("_len")).otherwise(F.coalesce("_cut", "end_s"))
    return rows.withColumns({"start_s": start, "end_s": end}).drop("_len", "_a", "_b", "_cut", "_before")


# -- joins ------------------------------------------------------------------------------------------


def asof_turn(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Each item with the turn that owns its midpoint: the last that starts no later, the first turn
    for items before all.  One sort per recording: turns and items in one table, the last turn seen."""
    t = turns.select(*KEYS, F.col("start_s").alias("_t"), F.lit(0).alias("_tag"), F.col("seq").alias("_s"), F.struct("start_s", "seq", "end_s", "speaker", "speaker_confidence", "uncertain").alias("turn"), F.lit(None).cast(items.select(F.struct("*").alias("i")).schema["i"].dataType).alias("item"))
    i = items.select(*KEYS, ((F.col("start_s") + F.col("end_s")) / 2).alias("_t"), F.lit(1).alias("_tag"), F.col("seq").alias("_s"), F.lit(None).cast(t.schema["turn"].dataType).alias("turn"), F.struct(*items.columns).alias("item"))
    w = Window.partitionBy(*KEYS).orderBy("_t", "_tag", "_s")
    both = t.unionByName(i)
    # before all turns the first one of the recording owns an item
    both = both.withColumn("turn", F.coalesce(F.last("turn", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("turn", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return both.where("_tag = 1").select("item.*", "turn")


def speaker_for_span(items: DataFrame, turns: DataFrame) -> DataFrame:
    """The owning turn's speaker, or in a gap the nearer neighbour's (the earlier on a tie)."""
    nxt = turns.withColumn("_next", F.lead(F.struct("start_s", "speaker")).over(order()))
    t = nxt.select(*KEYS, F.col("seq").alias("_seq"), "_next")
    own = asof_turn(items, turns).withColumn("_seq", F.col("turn.seq"))
    own = own.join(t, [*KEYS, "_seq"], "left")
    mid = (F.col("start_s") + F.col("end_s")) / 2
    inside = (F.col("turn.start_s") <= mid) & (mid <= F.col("turn.end_s"))
    near = (mid - F.col("turn.end_s")) <= (F.col("_next.start_s") - mid)
    name = F.when(inside | F.col("_next").isNull() | F.coalesce(near, F.lit(True)), F.col("turn.speaker")).otherwise(F.col("_next.speaker"))
    return own.withColumn("speaker", name).drop("turn", "_seq", "_next")


def range_join(points: DataFrame, spans: DataFrame, bucket: float, slack: float = 0.0) -> DataFrame:
    """Rows of points (p_start, p_end, recording_id, ...) with the spans (s_start, s_end) that they
    overlap, grown by slack.  Both sides are dealt to time buckets, so that it is a hash join; the pair
    is kept in the bucket in which its overlap begins, once."""
    cut = lambda c: F.floor(c / bucket)
    p = points.withColumn("_bucket", F.explode(F.sequence(cut(F.col("p_start")), cut(F.col("p_end")))))
    s = spans.withColumn("_bucket", F.explode(F.sequence(cut(F.col("s_start") - slack), cut(F.col("s_end") + slack))))
    hit = (F.col("p_start") <= F.col("s_end") + slack) & (F.col("p_end") >= F.col("s_start") - slack)
    once = F.col("_bucket") == cut(F.greatest(F.col("p_start"), F.col("s_start") - slack))
    return p.join(s, [*KEYS, "_bucket"]).where(hit & once).drop("_bucket")


def windows_in_segments(windows: DataFrame, segments: DataFrame, slack: float = 0.1, bucket: float = 60.0) -> DataFrame:
    """Windows that lie within a segment, give or take the slack."""
    both = range_join(windows, segments, bucket, slack)
    return both.where((F.col("p_start") >= F.col("s_start") - slack) & (F.col("p_end") <= F.col("s_end") + slack))


def sections_near(boundaries: DataFrame, sections: DataFrame, around: float = 0.5, least: float = 0.3, bucket: float = 60.0) -> DataFrame:
    """Sections of some length about each boundary (recording_id, at)."""
    b = boundaries.withColumns({"p_start": F.col("at") - around, "p_end": F.col("at") + around})
    return range_join(b, sections.where(F.col("s_end") - F.col("s_start") >= least), bucket).dropDuplicates([*KEYS, "at", "s_start", "s_end"])


# -- sections from frames ---------------------------------------------------------------------------


def sections_from_energy(frames: DataFrame, factor: float = 1.0, frame_s: float = 1.0, least: float = 0.0) -> DataFrame:
    """Runs of frames (frame_idx, rms) louder than a factor of the recording's median."""
    w = Window.partitionBy(*KEYS).orderBy("frame_idx")
    med = frames.groupBy(*KEYS).agg(F.median("rms").alias("_med"))
    loud = frames.join(med, list(KEYS)).where(F.col("rms") > F.col("_med") * factor)
    loud = loud.withColumn("_i", F.col("frame_idx") - F.row_number().over(w))
    out = loud.groupBy(*KEYS, "_i").agg((F.min("frame_idx") * frame_s).alias("start_s"), ((F.max("frame_idx") + 1) * frame_s).alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= least).drop("_i")


def sections_from_probs(frames: DataFrame, on: float = 0.5, silent: int = 3, frame_s: float = 1.0, least: float = 0.0) -> DataFrame:
    """Sections open at a frame of some probability and close at the first of `silent` lower ones in a
    row; islands of speaking frames with at most silent - 1 others between them."""
    w = Window.partitionBy(*KEYS).orderBy("frame_idx")
    speech = frames.where(F.col("speech_prob") >= on)
    speech = speech.withColumn("_n", F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) > silent).cast("int"), F.lit(1)))
    speech = speech.withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = speech.groupBy(*KEYS, "_i").agg((F.min("frame_idx") * frame_s).alias("start_s"), ((F.max("frame_idx") + 1) * frame_s).alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= least).drop("_i")


def sections_chunked(frames: DataFrame, chunk: int = 30, shared: int = 5, factor: float = 1.0) -> DataFrame:
    """Energy sections within overlapping chunks of frames, on the recording's timeline; what two
    chunks both find stays twice."""
    step = chunk - shared
    last = F.floor(F.col("frame_idx") / step).cast("int")
    first = F.greatest(F.ceil((F.col("frame_idx") - chunk + 1) / step), F.lit(0)).cast("int")
    rows = frames.withColumn("chunk", F.explode(F.sequence(first, last)))
    med = rows.groupBy(*KEYS, "chunk").agg(F.median("rms").alias("_med"))
    loud = rows.join(med, [*KEYS, "chunk"]).where(F.col("rms") > F.col("_med") * factor)
    loud = loud.withColumn("_i", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*KEYS, "chunk").orderBy("frame_idx")))
    return loud.groupBy(*KEYS, "chunk", "_i").agg(F.min("frame_idx").cast("double").alias("start_s"), (F.max("frame_idx") + 1).cast("double").alias("end_s")).drop("_i")


def interior_pauses(frames: DataFrame, least: int = 3, edge: int = 1) -> DataFrame:
    """Runs of quiet frames within a recording: quieter than the largest of three tenths of the lower
    quartile, a fiftieth of the peak, and 1e-5; away from both ends."""
    lim = frames.groupBy(*KEYS).agg(F.greatest(0.3 * F.percentile("rms", 0.25), 0.02 * F.max("rms"), F.lit(1e-5)).alias("_t"), F.min("frame_idx").alias("_lo"), F.max("frame_idx").alias("_hi"))
    w = Window.partitionBy(*KEYS).orderBy("frame_idx")
    quiet = frames.join(lim, list(KEYS)).where(F.col("rms") < F.col("_t")).withColumn("_i", F.col("frame_idx") - F.row_number().over(w))
    out = quiet.groupBy(*KEYS, "_i", "_lo", "_hi").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    return out.where((F.col("last") - F.col("first") + 1 >= least) & (F.col("first") > F.col("_lo") + edge) & (F.col("last") < F.col("_hi") - edge)).select(*KEYS, "first", "last")


def sliding_windows(sections: DataFrame, size: float = 2.0, step: float = 1.2, least: float = 0.1) -> DataFrame:
    """Windows of a size every step; a remainder counts if it is long enough; a short section is one.

    Times are taken in whole microseconds, so that no window hangs on the last bit of a sum.
    """
    size, step, least = (round(x * 1e6) for x in (size, step, least))
    rows = sections.withColumns({c: F.round(F.col(t) * 1e6).try_cast("long") for c, t in (("_lo", "start_s"), ("_hi", "end_s"))})
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)) / step).cast("int"))))
    at = F.col("_lo") + F.col("_k") * step
    rows = rows.withColumns({"_a": at, "_b": F.least(at + size, F.col("_hi"))})
    # a window that begins after one that reached the end adds nothing
    rows = rows.where((F.col("_k") == 0) | ((F.col("_b") - F.col("_a") > least) & (F.col("_a") - step + size < F.col("_hi"))))
    return rows.withColumns({"w_start": F.col("_a") / 1e6, "w_end": F.col("_b") / 1e6}).drop("_k", "_lo", "_hi", "_a", "_b")


def trim_to_sections(spans: DataFrame, sections: DataFrame, least: float = 1.5, bucket: float = 60.0) -> DataFrame:
    """Spans (span_id, p_start, p_end) shrunk to the speech in them; a result too short leaves the span."""
    got = range_join(spans, sections, bucket).groupBy(*KEYS, "span_id").agg(F.max(F.struct("p_start", "p_end")).alias("s"), F.min("s_start").alias("_lo"), F.max("s_end").alias("_hi"))
    lo, hi = F.greatest("s.p_start", "_lo"), F.least("s.p_end", "_hi")
    cut = got.select(*KEYS, "span_id", lo.alias("_lo"), hi.alias("_hi"))
    out = spans.join(cut, [*KEYS, "span_id"], "left")
    good = F.coalesce(F.col("_hi") - F.col("_lo") >= least, F.lit(False))
    return out.select(*KEYS, "span_id", F.when(good, F.col("_lo")).otherwise(F.col("p_start")).alias("start_s"), F.when(good, F.col("_hi")).otherwise(F.col("p_end")).alias("end_s"), good.alias("trimmed"))


def trim_edges(turns: DataFrame, frames: DataFrame, on: float = 0.35, most: float = 0.4, share: float = 0.3, frame_s: float = 0.032) -> DataFrame:
    """Silence at a turn's ends goes: up to `most` seconds and `share` of its length, the lead first."""
    f = frames.where(F.col("speech_prob") >= on).select(*KEYS, F.col("turn_id"), "frame_idx", "n_frames")
    edge = f.groupBy(*KEYS, "turn_id").agg((F.min("frame_idx") * frame_s).alias("_lead"), (F.max(F.col("n_frames")) * frame_s - (F.max("frame_idx") + 1) * frame_s).alias("_trail"))
    out = turns.join(edge, [*KEYS, "turn_id"], "left")
    room = (F.col("end_s") - F.col("start_s")) * share
    lead = F.least(F.coalesce("_lead", F.lit(0.0)), F.lit(most), room)
    trail = F.greatest(F.lit(0.0), F.least(F.coalesce("_trail", F.lit(0.0)), F.lit(most), room - lead))
    return out.withColumns({"start_s": F.col("start_s") + lead, "end_s": F.col("end_s") - trail}).drop("_lead", "_trail")


def split_at_dips(sections: DataFrame, frames: DataFrame, least: float = 3.0, ratio: float = 0.35, dip: int = 2) -> DataFrame:
    """Long sections (section_id, s_start, s_end in frames) are cut in the middle of each run of frames
    quieter than a ratio of the section's median; pieces keep the section's extent in all."""
    f = frames.select(*KEYS, F.col("frame_idx").cast("double").alias("p_start"), F.col("frame_idx").cast("double").alias("p_end"), "frame_idx", "rms")
    inside = range_join(f, sections.where(F.col("s_end") - F.col("s_start") >= least), 60.0)
    per = [*KEYS, "section_id"]
    med = inside.groupBy(*per).agg(F.median("rms").alias("_m"))
    low = inside.join(med, per).where(F.col("rms") < F.col("_m") * ratio)
    low = low.withColumn("_i", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*per).orderBy("frame_idx")))
    dips = low.groupBy(*per, "_i").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).where(F.col("b") - F.col("a") + 1 >= dip)
    cuts = dips.groupBy(*per).agg(F.array_sort(F.collect_list((F.col("a") + F.col("b") + 1) / 2.0)).alias("cuts"))
    out = sections.join(cuts, per, "left").withColumn("e", F.concat(F.array("s_start"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("s_end")))
    # cuts that would leave a piece under two frames are passed over, so that nothing is lost
    e = F.aggregate(F.slice("e", 2, F.size("e") - 2), F.slice("e", 1, 1), lambda d, x: F.when((x - F.element_at(d, -1) >= 2.0) & (F.element_at(F.col("e"), -1) - x >= 2.0), F.concat(d, F.array(x))).otherwise(d))
    out = out.withColumn("e", F.concat(e, F.array("s_end")))
    return out.select(*per, F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.element_at("e", i).alias("start_s"), F.element_at("e", i + 1).alias("end_s")))).alias("p")).select(*per, "p.*")


def build_segments(windows: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Overlap-aware segments: windows with one key (label, or the sorted overlapping pair) and small
    gaps join; neighbours that differ and overlap meet in the middle; OVERLAP runs that are short or
    unclear fall back to the dominant label."""
    key = F.when(F.col("is_overlap"), F.array_join(F.array_sort("overlap_speakers"), "+")).otherwise(F.col("speaker"))
    rows = windows.withColumn("_key", F.coalesce(key, F.lit("")))
    same = (F.lag("_key").over(order()) == F.col("_key")) & (F.col("start_s") - F.lag("end_s").over(order()) <= th.overlap_gap)
    runs = islands(rows, ~F.coalesce(same, F.lit(False))).groupBy(*KEYS, "island").agg(
        F.min("seq").alias("seq"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("speaker", "seq").alias("dominant"), F.max("is_overlap").alias("is_overlap"), F.avg("clarity").alias("clarity")
    )
    fallback = F.col("is_overlap") & ((F.col("end_s") - F.col("start_s") < th.overlap_min_sec) | (F.coalesce("clarity", F.lit(1.0)) > th.overlap_clarity))
    runs = runs.withColumn("speaker", F.when(F.col("is_overlap") & ~fallback, "OVERLAP").otherwise(F.col("dominant")))
    before, after = F.lag("end_s").over(order()), F.lead("start_s").over(order())
    rows = runs.withColumns({"_b": before, "_a": after})
    return rows.select(
        *KEYS, "seq", F.when(F.col("_b") > F.col("start_s"), (F.col("_b") + F.col("start_s")) / 2).otherwise(F.col("start_s")).alias("start_s"),
        F.when(F.col("_a") < F.col("end_s"), (F.col("_a") + F.col("end_s")) / 2).otherwise(F.col("end_s")).alias("end_s"), "speaker",
    )


class _Chunks:
    """Cuts of one recording as its frames come: only the last frames that may be cut at are kept."""

    def __init__(self, most: int, band: int):
        self.most, self.band = most, band

    def begin(self) -> list:
        return [0, 0, 0, []]  # chunk, its first frame, frames so far, levels of its last frames that fit

    def __call__(self, s: list, rms: float) -> list[tuple]:
        out = []
        if s[2] - s[1] == self.most:
            cut = s[1] + self.most - self.band + s[3].index(min(s[3])) + 1
            out = [(s[0], s[1], cut)]
            s[0], s[1], s[3] = s[0] + 1, cut, []
        if s[2] - s[1] >= self.most - self.band:
            s[3].append(rms)
        s[2] += 1
        return out

    def end(self, s: list) -> list[tuple]:
        return [(s[0], s[1], s[2])]


def plan_chunks(frames: DataFrame, most: int = 30, band: int = 5) -> DataFrame:
    """Chunks of at most `most` frames, each cut at the quietest of the last `band` frames that still
    fit (the earliest on a tie): a recording's frames pass in order, and a few of them are held."""
    from chronovox.streaming.live import each_in_order

    rows = frames.select(F.col("recording_id").cast("long").alias("recording_id"), "frame_idx", F.col("rms").cast("double").alias("rms"))
    return each_in_order(rows, list(KEYS), ["frame_idx"], "recording_id long, chunk int, first int, end int", _Chunks(most, band), ["rms"])


def stitch_items(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items relative to a chunk, on the recording's timeline (3 places); a failed chunk gives one row
    with its error instead."""
    rows = chunks.join(items, [*KEYS, "chunk"], "left")
    at = lambda c: F.bround(F.col(c) + F.col("offset_s"), 3)
    failed = F.col("error").isNotNull()
    return rows.where(failed | F.col("text").isNotNull()).select(*KEYS, "chunk", F.when(~failed, at("start_s")).otherwise(F.col("offset_s")).alias("start_s"), F.when(~failed, at("end_s")).otherwise(F.col("offset_s")).alias("end_s"), F.when(~failed, F.col("text")).alias("text"), "error").distinct()


def merge_channels(items: DataFrame) -> DataFrame:
    """Items of all channels in time order, numbered, with the number of speakers of the recording."""
    w = Window.partitionBy(*KEYS).orderBy("start_s", "channel", "seq")
    n = items.groupBy(*KEYS).agg(F.countDistinct("speaker").alias("speakers"))
    return items.join(n, list(KEYS)).withColumn("place", F.row_number().over(w))
