"""Text items to speakers, with an explicit reason wherever an identity is withheld."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.labels import evidence_source, has_identity
from chronovox.operators.intervals import KEYS, asof_turn, islands, order, overlap_seconds
from chronovox.thresholds import DEFAULTS, Thresholds

SENTENCE_END = r"[.!?…]\s*$"


def attribute_spans(items: DataFrame, turns: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Each item with speaker, confidence, speaker_source, reason and turn_seq.  In order: no turns; a
    short item mostly outside its turn; a long item of which the turn holds too little; an uncertain
    turn; a turn without an identity; else the turn's name."""
    own = asof_turn(items, turns)
    t = F.col("turn")
    dur = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    inside = F.when(t.isNull(), 0.0).otherwise(overlap_seconds(F.col("start_s"), F.col("end_s"), t["start_s"], t["end_s"]))
    own = own.withColumns({"_d": dur, "_in": inside})
    out, d = F.col("_d") - F.col("_in"), F.col("_d")
    crossing = (d > 0) & (d <= th.cross_span) & (out > th.cross_sec) & (out / F.nullif(d, F.lit(0.0)) > th.cross_ratio)
    shared = (d > th.cross_span) & (F.col("_in") / F.nullif(d, F.lit(0.0)) < th.min_confidence)
    reason = (
        F.when(t.isNull(), "no_turns")
        .when(crossing, "boundary_crossing")
        .when(shared, "low_span_turn_overlap")
        .when(F.coalesce(t["uncertain"], F.lit(False)), "turn_uncertain")
        .when(~has_identity(t["speaker"]), "turn_label_uncertain")
    )
    own = own.withColumn("reason", reason)
    known = F.col("reason").isNull()
    conf = F.coalesce(t["speaker_confidence"], F.when(d > 0, F.col("_in") / F.nullif(d, F.lit(0.0))).otherwise(1.0))
    return own.withColumns(
        {"speaker": F.when(known, t["speaker"]), "confidence": F.when(known, F.least(conf, F.lit(1.0))).otherwise(0.0), "speaker_source": F.when(known, evidence_source(t["speaker"])).otherwise("unknown"), "turn_seq": t["seq"]}
    ).drop("turn", "_d", "_in")


def attribute_items(items: DataFrame, turns: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Runs of items with one key: speaker and reason, for unknown ones reason and turn.  Texts stay
    whole: a run's text is its items' in order."""
    rows = attribute_spans(items, turns, th)
    key = F.struct("speaker", "reason", F.when(F.col("speaker").isNull(), F.col("turn_seq")).alias("t"))
    rows = rows.withColumn("_key", key).withColumn("_same", F.lag("_key").over(order()).eqNullSafe(F.col("_key")))
    runs = islands(rows, ~F.col("_same"))
    return (
        runs.groupBy(*KEYS, "island")
        .agg(
            F.min("seq").alias("seq"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), F.min_by("speaker", "seq").alias("speaker"),
            F.min_by("confidence", "seq").alias("confidence"), F.min_by("speaker_source", "seq").alias("speaker_source"), F.min_by("reason", "seq").alias("reason"), F.count("*").alias("items"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "text"))), lambda s: s["text"]), " ").alias("text"),
        )
        .drop("island")
    )


def merge_results(results: DataFrame, gap: float = DEFAULTS.result_gap, pause: float = 2.0) -> DataFrame:
    """Neighbouring results of one named speaker become one; the texts meet at an empty line where a
    sentence ends before a long pause, else at a space, and at nothing after a line's end or beside an
    empty text.  tokens and inference_sec, where results have them, are summed."""
    same = has_identity(F.col("speaker")) & (F.lag("speaker").over(order()) == F.col("speaker")) & (F.col("start_s") - F.lag("end_s").over(order()) <= gap)
    rows = islands(results, ~F.coalesce(same, F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    # what a text is joined with follows from the last text before it in its run: no text is copied along
    before = Window.partitionBy(*KEYS, "island").orderBy("start_s", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_t": F.last(F.nullif("text", F.lit("")), True).over(before), "_e": F.max("end_s").over(before)})
    ended = F.col("_t").rlike(r"[.!?…]$") & (F.col("start_s") - F.col("_e") >= pause)
    glue = F.when(F.col("_t").isNull() | (F.col("text") == "") | F.col("_t").endswith("\n"), "").when(ended, "\n\n").otherwise(" ")
    rows = rows.withColumn("_piece", F.concat(glue, "text"))
    sums = [F.sum(c).alias(c) for c in ("tokens", "inference_sec") if c in results.columns]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "_piece"))), lambda s: s["_piece"]), "")
    return rows.groupBy(*KEYS, "island").agg(F.min("seq").alias("seq"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("speaker", "seq").alias("speaker"), F.count("*").alias("parts"), *sums, text.alias("text")).drop("island")


def paragraphs(items: DataFrame, pause: float = 1.5, soft: int = 800, hard: int = 1600) -> DataFrame:
    """Items to paragraphs: a new one after a pause, past `soft` characters at a sentence's end, or
    past `hard`.  A fold, as the length starts anew with each paragraph, over the items between two
    pauses: behind a text, a pause always begins a paragraph."""
    kind = "array<struct<start_s:double,seq:bigint,end_s:double,text:string>>"
    behind = (F.col("start_s") - F.lag("end_s").over(order()) >= pause) & (F.length(F.lag("text").over(order())) > 0)
    rows = islands(items, F.coalesce(behind, F.lag("seq").over(order()).isNull()))
    rows = rows.groupBy(*KEYS, "island").agg(F.array_sort(F.collect_list(F.struct("start_s", F.col("seq").cast("bigint").alias("seq"), "end_s", F.coalesce("text", F.lit("")).alias("text")))).cast(kind).alias("a"))

    def step(s, x):
        new = (s["n"] > 0) & ((x["start_s"] - s["end_s"] >= pause) | ((s["n"] >= soft) & s["last"].rlike(SENTENCE_END)) | (s["n"] >= hard))
        p = (s["p"] + new.cast("int")).cast("int")
        n = F.when(new, F.length(x["text"])).otherwise(s["n"] + F.length(x["text"]) + F.when(s["n"] > 0, 1).otherwise(0)).cast("int")
        return F.struct(p.alias("p"), n.alias("n"), x["end_s"].alias("end_s"), x["text"].alias("last"), F.concat(s["out"], F.array(p)).alias("out"))

    init = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(0.0).alias("end_s"), F.lit("").alias("last"), F.array().cast("array<int>").alias("out"))
    rows = rows.withColumn("p", F.aggregate("a", init, step, lambda s: s["out"]))
    # numbers go on from island to island
    so_far = F.sum(F.element_at("p", -1) + 1).over(Window.partitionBy(*KEYS).orderBy("island").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_from", F.coalesce(so_far, F.lit(0)).cast("int"))
    rows = rows.select(*KEYS, F.explode(F.zip_with("a", "p", lambda x, p: F.struct((p + F.col("_from")).alias("paragraph"), x["start_s"].alias("start_s"), x["seq"].alias("seq"), x["end_s"].alias("end_s"), x["text"].alias("text")))).alias("r")).select(*KEYS, "r.*")
    return rows.groupBy(*KEYS, "paragraph").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))


def paragraph_breaks(items: DataFrame, pauses: DataFrame, least: int = 25) -> DataFrame:
    """Character offsets in the joined text of a recording at which its pauses (recording_id, at) fall:
    the item boundary nearest to each pause; breaks closer than `least` characters are passed over."""
    w = order()
    ends = items.withColumn("chars", F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    marks = ends.select(*KEYS, F.col("end_s").alias("t"), "chars")
    p = pauses.select(*KEYS, F.col("at").alias("t"), F.lit(None).cast("bigint").alias("chars"))
    both = marks.withColumn("pause", F.lit(0)).unionByName(p.withColumn("pause", F.lit(1)))
    v = F.when(F.col("pause") == 0, F.struct("t", "chars"))
    seen = lambda *o: F.last(v, True).over(Window.partitionBy(*KEYS).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"b": seen("t", "pause"), "a": seen(F.desc("t"), F.desc("pause"))}).where("pause = 1")
    near = F.when(F.col("a").isNull() | (F.col("t") - F.col("b.t") <= F.col("a.t") - F.col("t")), F.col("b.chars")).otherwise(F.col("a.chars"))
    got = both.select(*KEYS, near.alias("at")).where("at IS NOT NULL").groupBy(*KEYS).agg(F.array_sort(F.collect_set("at")).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<bigint>"), lambda d, x: F.when(x - F.coalesce(F.try_element_at(d, F.lit(-1)), F.lit(0)) >= least, F.concat(d, F.array(x))).otherwise(d))
    return got.select(*KEYS, F.explode(kept).alias("at"))


#: A sentence's end, how far from a pause it may be, what goes before a full stop that is
#: put in, and the least characters of a part.
SENTENCE_STOP = r"[.!?…][\"”’)\]]?(?=\s|$)"
SNAP, LOOSE_END, LEAST_PART = 40, r"[,;:—– -]+$", 25


def paragraph_text(items: DataFrame, pauses: DataFrame, window: int = SNAP, least: int = LEAST_PART) -> DataFrame:
    """(recording_id, text): the items' texts joined, with an empty line at each pause (recording_id, at).

    A pause falls to the nearest end of an item but the last, the earlier on a tie; from there to the
    nearest end of a sentence within `window` characters, or else the part before it gets a full stop.
    Breaks that leave a part under `least` characters, or so little behind them, are passed over.
    """
    w = order()
    rows = items.withColumn("text", F.coalesce("text", F.lit("")))
    ends = rows.withColumns({"chars": F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1, "_last": F.lead("seq").over(w).isNull()})
    marks = ends.where("NOT _last").select(*KEYS, F.col("end_s").alias("t"), F.lit(0).alias("pause"), "chars")
    both = marks.unionByName(pauses.select(*KEYS, F.col("at").alias("t"), F.lit(1).alias("pause"), F.lit(None).cast("bigint").alias("chars")))
    v = F.when(F.col("pause") == 0, F.struct("t", "chars"))
    per = Window.partitionBy(*KEYS)
    seen = lambda *o: F.last(v, True).over(per.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"b": seen("t", "pause"), "a": seen(F.desc("t"), F.desc("pause"))}).where("pause = 1")
    near = F.when(F.col("a").isNull() | (F.col("t") - F.col("b.t") <= F.col("a.t") - F.col("t")), F.col("b.chars")).otherwise(F.col("a.chars"))
    at = both.select(*KEYS, near.cast("int").alias("at")).where("at IS NOT NULL").groupBy(*KEYS).agg(F.array_sort(F.collect_set("at")).alias("at"))
    whole = rows.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))
    whole = whole.join(at, list(KEYS), "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    text, size = F.col("text"), F.length("text")

    def snapped(pos):
        """(place, unsnapped) of a pause that fell to the character pos."""
        lo, hi = F.greatest(pos - window, F.lit(0)), F.least(pos + window, size)
        region = F.substring(text, lo + 1, hi - lo)
        stops = F.filter(F.sequence(F.lit(1), F.length(region)), lambda i: F.substring(region, i, F.length(region)).rlike(r"\A" + SENTENCE_STOP))
        ends_at = F.transform(stops, lambda i: lo + i + F.length(F.regexp_extract(F.substring(region, i, F.length(region)), SENTENCE_STOP, 0)) - 1)
        best = F.array_min(F.transform(ends_at, lambda e: F.struct(F.abs(e - pos).alias("d"), e.cast("int").alias("e"))))
        return F.struct(F.coalesce(best["e"], pos).alias("i"), best.isNull().alias("u"))

    # the first pause, in order, that falls to a place says whether it is a sentence's end
    found = F.transform("at", snapped)
    first = F.aggregate(found, F.array().cast("array<struct<i:int,u:boolean>>"), lambda d, x: F.when(F.exists(d, lambda y: y["i"] == x["i"]), d).otherwise(F.concat(d, F.array(x))))
    whole = whole.withColumn("m", F.array_sort(first))
    kept = F.aggregate("m", F.array().cast("array<struct<i:int,u:boolean>>"), lambda d, x: F.when((x["i"] - F.coalesce(F.try_element_at(d, F.lit(-1))["i"], F.lit(0)) < least) | (size - x["i"] < least), d).otherwise(F.concat(d, F.array(x))))
    whole = whole.withColumn("m", kept)
    edge = lambda i: F.when(i > 0, F.try_element_at("m", i)["i"]).otherwise(0)

    def part(x, i):
        chunk = F.trim(F.substring(text, edge(i) + 1, x["i"] - edge(i)))
        bare = F.regexp_replace(chunk, LOOSE_END, "")
        return F.when(~x["u"], chunk).otherwise(F.when((bare == "") | bare.rlike("[.!?…]$"), bare).otherwise(F.concat(bare, F.lit("."))))

    parts = F.concat(F.transform("m", part), F.array(F.trim(F.substring(text, edge(F.size("m")) + 1, size))))
    return whole.select(*KEYS, F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("text"))


def weighted_confidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence per group weighted by length (1 where there is none), 0 to 100, half to even; taken at
    6 places before, so that a half is one in whatever order the sums were made."""
    w = F.when(F.col("end_s") - F.col("start_s") > 0, F.col("end_s") - F.col("start_s")).otherwise(1.0)
    c = F.col("confidence")
    return df.where(c.isNotNull()).groupBy(*keys).agg(F.bround(F.round(100 * F.sum(c * w) / F.sum(w), 6), 0).cast("int").alias("confidence_pct"))


def run_metrics(results: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per recording: ok, partial or error, uncertain results, and audio seconds per second of work."""
    bad = F.count_if(F.col("error").isNotNull())
    per = results.groupBy(*KEYS).agg(F.count("*").alias("results"), bad.alias("errors"), F.count_if(~has_identity(F.col("speaker"))).alias("uncertain"))
    per = per.join(lengths, list(KEYS), "left")
    status = F.when(F.col("errors") == F.col("results"), "error").when(F.col("errors") > 0, "partial").otherwise("ok")
    return per.withColumns({"status": status, "speed_up": F.when(F.col("processing_sec") > 0, F.col("audio_sec") / F.col("processing_sec"))})


def reattribute(items: DataFrame, turns: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """A finished live session anew: turns of the whole recording name the items; where they withhold
    a name the live label stays."""
    live = items.withColumnRenamed("speaker", "live_speaker")
    out = attribute_spans(live, turns, th)
    return out.withColumns({"final_speaker": F.coalesce("speaker", F.when(has_identity(F.col("live_speaker")), F.col("live_speaker"))), "from_live": F.col("speaker").isNull() & has_identity(F.col("live_speaker"))})


def export_text(results: DataFrame) -> DataFrame:
    """One text per recording: a header, then '[speaker] start - end: text' lines in order."""
    from chronovox.functions.text import format_time

    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("UNKNOWN")), F.lit("] "), format_time(F.col("start_s")), F.lit(" - "), format_time(F.col("end_s")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = results.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start_s", "seq", line.alias("l")))).alias("a"))
    return rows.select(*KEYS, F.concat(F.lit("Transcript "), F.col("recording_id").cast("string"), F.lit("\n"), F.array_join(F.transform("a", lambda s: s["l"]), "\n")).alias("text"))


def export_sidecar(results: DataFrame) -> DataFrame:
    """The same for machines: one JSON object per recording."""
    item = F.struct("start_s", "seq", "end_s", "speaker", "text")
    rows = results.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("segments"))
    return rows.select(*KEYS, F.to_json(F.struct("segments")).alias("json"))


def attach_items(df: DataFrame, fn, schema: str) -> DataFrame:
    """Items from a caller's own recogniser: fn maps a pandas frame to a pandas frame."""
    return df.mapInPandas(lambda frames: (fn(f) for f in frames), schema)


attach_vectors = attach_items

