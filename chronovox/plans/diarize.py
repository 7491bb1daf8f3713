"""From frames and window vectors to named turns: the whole path, for all recordings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.vectors import centroid
from chronovox.operators import boundary as B
from chronovox.operators import clustering as C
from chronovox.operators import identity as N
from chronovox.operators import intervals as I
from chronovox.operators import speakers as P
from chronovox.thresholds import DEFAULTS, Thresholds

K = list(I.KEYS)


def speech_windows(frames: DataFrame, windows: DataFrame, frame_s: float) -> DataFrame:
    """The windows in which somebody speaks: sections of speaking frames, joined over short pauses and cut
    again at long dips of energy; a window counts if its middle lies in a piece."""
    raw = I.sections_from_probs(frames, frame_s=frame_s)
    joined = I.merge_intervals(raw.withColumn("seq", F.lit(0)), 0.5)
    numbered = joined.select(*K, F.row_number().over(Window.partitionBy(*K).orderBy("start_s")).alias("section_id"), (F.col("start_s") / frame_s).alias("s_start"), (F.col("end_s") / frame_s).alias("s_end"))
    pieces = I.split_at_dips(numbered, frames, least=3.0 / frame_s, dip=max(1, round(0.5 / frame_s)))
    mid = (F.col("start_s") + F.col("end_s")) / 2
    at = windows.select(*K, "win_id", mid.alias("p_start"), mid.alias("p_end"))
    spans = pieces.select(*K, (F.col("start_s") * frame_s).alias("s_start"), (F.col("end_s") * frame_s).alias("s_end"))
    return windows.join(I.range_join(at, spans, 60.0).select(*K, "win_id").distinct(), [*K, "win_id"], "left_semi")


def refine(segments: DataFrame, windows: DataFrame, refs: DataFrame, frames: DataFrame, frame_s: float) -> DataFrame:
    """Segments with each boundary of two speakers moved to its cut: by whom the windows about it are nearer
    to (refs: recording_id, speaker, embedding), an energy dip, or the quietest frame."""
    gaps = B.gaps_between(segments)
    ref = refs.select(*K, "speaker", "embedding")
    side = lambda c, name: ref.select(*K, F.col("speaker").alias(c), F.col("embedding").alias(name))
    known = gaps.join(side("l_speaker", "left_ref"), [*K, "l_speaker"]).join(side("r_speaker", "right_ref"), [*K, "r_speaker"])
    spans = known.select(*K, "gap_id", "left_ref", "right_ref", F.col("lo").alias("s_start"), F.col("hi").alias("s_end"))
    near = I.range_join(windows.select(*K, "win_id", "start_s", "end_s", "embedding", F.col("start_s").alias("p_start"), F.col("end_s").alias("p_end")), spans, 60.0)
    per = [*K, "gap_id"]
    owned = B.section_owners(near.where("embedding IS NOT NULL")).select(*per, "owner", "weight", "start_s", "end_s", F.struct("start_s", "win_id").alias("pos"))
    cuts = B.ownership_cut(owned, B.best_split(owned, per), per).where("cut IS NOT NULL")
    done = B.cut_boundaries(gaps, cuts, B.energy_dip_cut(gaps, frames, frame_s=frame_s), B.quietest_cut(gaps, frames, frame_s=frame_s))
    moved = B.refine_gaps(segments, done).select(*K, "seq", "start_s", "end_s")
    return segments.drop("start_s", "end_s").join(moved, [*K, "seq"]).where("end_s > start_s")


def diarize(frames: DataFrame, windows: DataFrame, profiles: DataFrame, tenants: DataFrame | None = None, threshold: float | None = None, frame_s: float = 1.0, th: Thresholds = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(segments with speakers and their evidence, speakers with statistics) of all recordings.

    frames: recording_id, frame_idx, rms, speech_prob, pitch_hz; windows: recording_id, win_id, seq, start_s,
    end_s, embedding; profiles: tenant_id, name, embedding, pitch_hz, total_speech_sec, pending; tenants:
    recording_id, tenant_id (one row a recording; all are of tenant 0 without it).

    In order: windows with speech; clusters, capped and merged; windows without a label filled from the
    nearest; overlapping windows; numbers; segments, those of overlapping speech put aside; short islands
    absorbed; boundaries cut; acoustic profiles and numbers by pitch; names of clear matches, but where one
    cluster holds nearly all; ghosts and minority speakers withheld; unknown speakers once more; boundaries
    cut again; all segments together without overlaps; the speakers that own one.
    """
    t = ["tenant_id"]
    of = tenants if tenants is not None else windows.select(*K).distinct().withColumn("tenant_id", F.lit(0))
    people = N.matchable_profiles(profiles)
    windows = C.settled(speech_windows(frames, windows, frame_s))
    labels = C.agglomerate(windows, threshold if threshold is not None else th.cluster, small=C.WHOLE)
    labels = C.settled(C.greedy_merge(windows, C.cap_clusters(windows, C.settled(labels), th.max_clusters, small=C.WHOLE), th.merge))
    rows = windows.join(labels, [*K, "win_id"], "left")
    means = C.settled(centroid(rows.where("cluster IS NOT NULL"), [*K, "cluster"]))
    numbered = I.number_speakers(rows)
    names = numbered.select(*K, "cluster", "speaker").where("cluster IS NOT NULL").distinct()
    over = C.detect_overlaps(windows, means, th)
    two = over.join(names.select(*K, F.col("cluster").alias("first"), F.col("speaker").alias("s1")), [*K, "first"]).join(names.select(*K, F.col("cluster").alias("second"), F.col("speaker").alias("s2")), [*K, "second"])
    marked = I.fill_nearest(numbered).join(two.select(*K, "win_id", "is_overlap", "clarity", F.array("s1", "s2").alias("overlap_speakers")), [*K, "win_id"], "left")
    segments = C.settled(I.build_segments(marked.withColumn("is_overlap", F.coalesce("is_overlap", F.lit(False))), th))
    both, own = segments.where("speaker = 'OVERLAP'"), I.absorb_islands(segments.where("speaker <> 'OVERLAP'"))
    refs = means.join(names, [*K, "cluster"]).select(*K, "cluster", "speaker", F.col("centroid").alias("embedding"))
    own = C.settled(refine(own, windows, refs, frames, frame_s))
    # profiles, and numbers by pitch
    stats = C.settled(P.profile_speakers(frames, own, frame_s))
    number = I.relabel_by_pitch(stats).withColumnRenamed("old_name", "speaker")
    rename = lambda df: df.join(number, [*K, "speaker"], "left").withColumn("speaker", F.coalesce("new_name", "speaker")).drop("new_name")
    own, stats = rename(own), rename(stats)
    own = own.withColumns({"speaker_confidence": F.lit(None).cast("double"), "speaker_margin": F.lit(None).cast("double"), "uncertain": F.lit(False)})
    # names, unless one cluster swallowed the recording
    blocked = C.cluster_balance(labels, th).where("naming_block IS NOT NULL").select(*K).distinct()
    speakers = P.with_pitch(P.segment_centroids(own, rows, means), stats).join(of, K)
    own, mapping = P.match_known(own, speakers, people, t, blocked, th)
    mapping = C.settled(mapping)
    stats = P.merge_profile_stats(stats, mapping.select(*K, F.col("old_name").alias("speaker"), F.col("new_name").alias("into")), K)
    own = C.settled(I.eliminate_ghosts(own, th, collapse=True))
    # a registered name stays, however little its owner says
    known = people.select("tenant_id", F.col("name").alias("speaker"), F.lit(True).alias("_known")).distinct()
    own = own.join(of, K).join(known, [*t, "speaker"], "left")
    own = I.absorb_minority(own, th=th, keep=F.coalesce("_known", F.lit(False))).drop("_known")
    own, more = P.second_pass(own, rows, people, stats, t, blocked, th)
    own, more = C.settled(own), C.settled(more)
    stats = P.merge_profile_stats(stats, more, K)
    final = P.segment_centroids(own, rows, means)
    own = refine(own, windows, final, frames, frame_s)
    evidence = ["speaker_confidence", "speaker_margin", "uncertain", "attribution_reason"]
    whole = own.select(*K, "seq", "start_s", "end_s", "speaker", *evidence).unionByName(both.select(*K, "seq", "start_s", "end_s", "speaker"), allowMissingColumns=True)
    whole = C.settled(whole.withColumn("seq", F.row_number().over(I.order()).cast("bigint")))
    cut = I.resolve_overlaps(whole.select(*K, "seq", "start_s", "end_s", "speaker"))
    turns = cut.join(whole.select(*K, "seq", *evidence), [*K, "seq"])
    return turns, P.speaker_summary(turns, stats)
