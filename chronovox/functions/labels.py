"""Speaker labels as Columns: classes, evidence, refusal reasons, suppression of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.thresholds import DEFAULTS, Thresholds

#: Fixed value: the form of a label that a clustering step gave.
GENERIC = r"(?i)^speaker[\s_]*\d+$"
OVERLAP, UNKNOWN = "OVERLAP", "UNKNOWN"


def is_unknown(name: Column) -> Column:
    return name.isNull() | F.upper(F.trim(name)).isin("", UNKNOWN)


def is_overlap(name: Column) -> Column:
    return F.coalesce(F.trim(name) == OVERLAP, F.lit(False))


def is_generic(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(GENERIC), F.lit(False))


def has_identity(name: Column) -> Column:
    """A cluster label or a name: somebody, not nobody and not several."""
    return ~is_unknown(name) & ~is_overlap(name)


def is_collectible(name: Column) -> Column:
    """A name that a person was given."""
    return has_identity(name) & ~is_generic(name)


def label_class(name: Column) -> Column:
    return F.when(is_unknown(name), "unknown").when(is_overlap(name), "overlap").when(is_generic(name), "generic").otherwise("named")


def evidence_source(name: Column) -> Column:
    return F.when(~has_identity(name), "unknown").when(is_generic(name), "diarization_cluster").otherwise("known_voiceprint")


def duration() -> Column:
    return F.col("end_s") - F.col("start_s")


def is_confident(th: Thresholds = DEFAULTS) -> Column:
    """Identity, not uncertain, and no evidence (if there is any) below its limit."""
    low_conf = F.coalesce(F.col("speaker_confidence") < th.min_confidence, F.lit(False))
    low_margin = F.coalesce(F.col("speaker_margin") < th.min_margin, F.lit(False))
    short = (duration() > 0) & (duration() < th.min_duration)
    return has_identity(F.col("speaker")) & ~F.coalesce(F.col("uncertain"), F.lit(False)) & ~low_conf & ~low_margin & ~short


def collect_refusal(th: Thresholds = DEFAULTS) -> Column:
    """Why a segment may not be collected: the first objection, null where there is none."""
    name, conf, margin = F.col("speaker"), F.col("speaker_confidence"), F.col("speaker_margin")
    return (
        F.when(is_unknown(name), "unknown_label")
        .when(is_overlap(name), "overlap")
        .when(is_generic(name), "generic_label")
        .when(F.coalesce(F.col("uncertain"), F.lit(False)), "uncertain")
        .when(conf < th.min_confidence, "low_confidence")
        .when(margin < th.min_margin, "low_margin")
        .when((duration() > 0) & (duration() < th.min_duration), "too_short")
    )


def learn_refusal(th: Thresholds = DEFAULTS) -> Column:
    """Why a segment may not teach a new voice; a generic label is no objection."""
    return (
        F.when(is_unknown(F.col("speaker")), "no_identity")
        .when(is_overlap(F.col("speaker")), "overlap")
        .when(F.coalesce(F.col("uncertain"), F.lit(False)), "uncertain")
        .when(F.col("speaker_confidence") < th.min_confidence, "low_confidence")
    )


def suppress(df: DataFrame, when: Column, reason: Column) -> DataFrame:
    """Withhold the identity of some rows: the words and the old label stay, the name goes."""
    return df.withColumns(
        {
            "original_speaker": F.when(when, F.coalesce(F.col("original_speaker") if "original_speaker" in df.columns else F.lit(None), F.col("speaker"))).otherwise(F.col("original_speaker") if "original_speaker" in df.columns else F.lit(None)),
            "speaker": F.when(~when, F.col("speaker")),
            "speaker_confidence": F.when(when, 0.0).otherwise(F.col("speaker_confidence")),
            "speaker_source": F.when(when, "unknown").otherwise(F.col("speaker_source") if "speaker_source" in df.columns else evidence_source(F.col("speaker"))),
            "uncertain": F.when(when, True).otherwise(F.coalesce(F.col("uncertain"), F.lit(False))),
            "attribution_reason": F.when(when, reason).otherwise(F.col("attribution_reason") if "attribution_reason" in df.columns else F.lit(None).cast("string")),
        }
    )


def mark_confident(df: DataFrame) -> DataFrame:
    """Evidence defaults, only where there is none yet."""
    return df.withColumns({"speaker_source": F.coalesce("speaker_source", evidence_source(F.col("speaker"))), "uncertain": F.coalesce("uncertain", F.lit(False))})


def apply_identity(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename speakers by (recording_id, old_name): name, confidence (3 places), margin and distance
    (4), uncertainty cleared.  Speakers without a mapping keep all they have, and so do named ones what the
    mapping has no value for."""
    m = mapping.select("recording_id", F.col("old_name").alias("speaker"), "new_name", "confidence", "margin", "distance")
    out = segments.join(m, ["recording_id", "speaker"], "left")
    hit = F.col("new_name").isNotNull()
    had = F.col("speaker_match_dist") if "speaker_match_dist" in segments.columns else F.lit(None).cast("double")
    return out.withColumns(
        {
            "speaker": F.coalesce("new_name", "speaker"),
            "speaker_confidence": F.coalesce(F.bround("confidence", 3), "speaker_confidence"),
            "speaker_margin": F.coalesce(F.bround("margin", 4), "speaker_margin"),
            "speaker_match_dist": F.coalesce(F.bround("distance", 4), had),
            "uncertain": F.when(hit, False).otherwise(F.col("uncertain")),
        }
    ).drop("new_name", "confidence", "margin", "distance")


def display_spans(df: DataFrame) -> DataFrame:
    """What a reader sees: no name means uncertain."""
    unsure = ~has_identity(F.col("speaker")) | F.coalesce(F.col("uncertain"), F.lit(False))
    return df.withColumns({"shown_speaker": F.when(~unsure, F.col("speaker")), "shown_uncertain": unsure})


def speaker_label(name: Column, reason: Column) -> Column:
    return F.when(has_identity(name), name).when(reason.isNotNull(), F.concat(F.lit("UNKNOWN ("), reason, F.lit(")"))).otherwise("UNKNOWN")
