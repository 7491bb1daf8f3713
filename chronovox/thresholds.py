"""Tunable limits.  Frozen, so that they reach plans as literals; override with dataclasses.replace."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """The shipped defaults of the domain (seconds, cosine distances, shares)."""

    accept: float = 0.35
    clear_gap: float = 0.02
    embed_only: float = 0.16
    min_alternative: float = 0.3
    w_embedding: float = 0.9
    w_pitch: float = 0.1
    pitch_unit: float = 50.0
    max_distance: float = 0.5
    known_bias: float = 0.05
    merge: float = 0.35
    cluster: float = 0.55
    max_clusters: int = 15
    overlap_ratio: float = 0.08
    overlap_far: float = 0.4
    overlap_min_sec: float = 0.5
    overlap_gap: float = 1.5
    overlap_clarity: float = 0.08
    min_confidence: float = 0.35
    min_margin: float = 0.02
    min_duration: float = 0.5
    cross_sec: float = 0.3
    cross_ratio: float = 0.34
    cross_span: float = 3.0
    turn_gap: float = 1.0
    result_gap: float = 1.0
    ghost_share: float = 0.25
    ghost_sec: float = 10.0
    minority_sec: float = 8.0
    minority_utterance: float = 5.0
    naming_share: float = 0.75
    second_accept: float = 0.38
    second_confidence: float = 0.5
    second_min_sec: float = 3.0
    unknown_merge: float = 0.25
    cohesion: float = 0.32
    weight_ratio: float = 4.0
    outlier_floor: float = 0.35
    outlier_k: float = 6.0
    outlier_share: float = 0.2
    outlier_keep: int = 3
    outlier_rounds: int = 2
    near_duplicate: float = 0.25
    stale_ratio: float = 1.5
    live_confidence: float = 0.6
    live_margin: float = 0.1
    live_min_sec: float = 0.5
    live_max_sec: float = 30.0


DEFAULTS = Thresholds()
