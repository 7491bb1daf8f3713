"""Live recordings: turn detection, coalescing, timeline checks and attribution.

The recurrences exist once, as plain functions over one event and a small state.  On a stream all three
run in transformWithStateInPandas, keyed by session (and channel), with event-time timers; on a finished
table each key's events pass through the same functions in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronovox.functions.vectors import norm
from chronovox.operators.nearest import BROADCAST_BYTES, best_of, nearest, packed_bytes, packed_profiles, scored
from chronovox.thresholds import DEFAULTS, Thresholds

SAMPLE_RATE = 16_000
VERSION = 1


@dataclass(frozen=True)
class Endpointing:
    """The shipped endpointing limits."""

    frame_ms: float = 32.0
    floor_min: float = 0.0005
    floor_max: float = 0.05
    start_ratio: float = 2.5
    end_ratio: float = 1.6
    start_min: float = 0.0012
    end_min: float = 0.0006
    confirm: int = 2
    hangover_ms: float = 320.0
    pre_ms: float = 160.0
    post_ms: float = 200.0
    voiced_ms: float = 120.0
    max_sec: float = 30.0

    def frames_of(self, ms: float, least: int = 0) -> int:
        return max(least, round(ms / self.frame_ms))


@dataclass
class TurnState:
    floor: float = 0.0005
    active: bool = False
    #: Frames since the last turn (or the beginning), how many of them were loud in a row up to now, and the last ones' levels.
    idle: int = 0
    loud: int = 0
    recent: list = field(default_factory=list)
    #: The open turn: its first frame, frames held with those before its onset, measured ones and voiced ones.
    first: int = 0
    held: int = 0
    frames: int = 0
    voiced: int = 0
    quiet: int = 0
    peak: float = 0.0
    total: float = 0.0
    #: The last frame that was seen.
    frame: int = -1


TURN_COLUMNS = ["first_frame", "end_frame", "reason", "peak_rms", "mean_rms"]


def detect_step(s: TurnState, frame: int, rms: float, p: Endpointing = Endpointing()) -> list[tuple]:
    """One frame; the turns that end with it.

    The noise floor follows every frame, in speech too, fast downward and slowly upward, and the frame is
    held against the limits that the new floor gives.  A turn starts after some loud frames in a row, at
    the first of the pre-roll frames, which count those; it ends after a hangover of quiet ones, or at its
    longest.
    """
    s.frame = frame
    keep = 0.7 if rms < s.floor else 0.995
    s.floor = min(max(keep * s.floor + (1 - keep) * rms, p.floor_min), p.floor_max)
    start_at = max(s.floor * p.start_ratio, p.start_min)
    end_at = max(s.floor * p.end_ratio, p.end_min, 0.6 * start_at)
    if not s.active:
        s.idle += 1
        s.recent = [*s.recent, rms][-p.confirm :]
        s.loud = s.loud + 1 if rms >= start_at else 0
        if s.loud >= p.confirm:
            s.held = min(s.idle, max(1, int(p.pre_ms / p.frame_ms)))
            s.active, s.first, s.quiet = True, frame - max(s.held, p.confirm) + 1, 0
            onset = s.recent[-s.held :]
            s.frames, s.peak, s.total, s.voiced = len(onset), max(onset), sum(onset), sum(r >= end_at for r in onset)
        return []
    s.held, s.frames, s.peak, s.total = s.held + 1, s.frames + 1, max(s.peak, rms), s.total + rms
    if rms >= end_at:
        s.voiced, s.quiet = s.voiced + 1, 0
    else:
        s.quiet += 1
    if s.held >= int(p.max_sec * 1000 / p.frame_ms):
        return close_turn(s, "max_turn", p)
    return close_turn(s, "hangover", p) if s.quiet >= p.frames_of(p.hangover_ms, 1) else []


def close_turn(s: TurnState, reason: str, p: Endpointing = Endpointing()) -> list[tuple]:
    """End the open turn, if it was voiced enough: hangover less post-roll is taken off its end."""
    if not s.active:
        return []
    length = max(1, s.held - p.frames_of(p.hangover_ms, 1) + p.frames_of(p.post_ms))
    s.active, s.loud, s.idle, s.recent = False, 0, 0, []
    if s.voiced * p.frame_ms < p.voiced_ms:
        return []
    return [(int(s.first), int(s.first + min(length, s.held)), reason, float(s.peak), float(s.total / max(1, s.frames)))]


#: Limits of joining turns: the pause between two, and the length of both together, seconds.
MERGE_GAP, MERGE_MOST = 1.0, 15.0


@dataclass
class HeldTurn:
    start: float = -1.0
    end: float = -1.0
    parts: int = 0
    #: When the held turn is released, whatever comes; no deadline below 0.
    due: float = -1.0


def coalesce_step(s: HeldTurn, start: float, end: float, now: float | None = None, gap: float = MERGE_GAP, most: float = MERGE_MOST) -> list[tuple]:
    """One closed turn, received at `now`; what is released: the held one, if its time is over or the new
    one doesn't follow closely or makes both too long.  A turn that is taken in extends the time."""
    out = release(s) if s.parts and now is not None and now >= s.due >= 0 else []
    due = -1.0 if now is None else now + gap
    if s.parts and 0 <= start - s.end <= gap and end - s.start <= most:
        s.end, s.parts, s.due = end, s.parts + 1, due
        return out
    out += release(s)
    s.start, s.end, s.parts, s.due = start, end, 1, due
    return out


def release(s: HeldTurn) -> list[tuple]:
    out = [(s.start, s.end, s.parts)] if s.parts else []
    s.parts, s.due = 0, -1.0
    return out


#: What a turn's declared start may be blamed for.
REGRESSION, AHEAD = "start_sample_regression", "start_sample_ahead_of_stream"
#: Faults of a session that are told in detail.
FAULT_DETAILS = 10


@dataclass
class Timeline:
    high: float = 0.0
    ends: dict = field(default_factory=dict)


def guard_step(s: Timeline, channel: int, start: float, end: float, elapsed: float | None, slack: float = 0.05, lead: float = 10.0, lead_ratio: float = 0.05) -> tuple:
    """(start, end, flag, faults) of one turn: a start before the channel's last end, beyond the slack, is
    moved there; one far beyond what the session has reached is flagged.  A turn may be both: then the
    first is its flag, and faults holds both."""
    last, faults = s.ends.get(channel), []
    if last is not None and start < last - slack:
        faults.append(REGRESSION)
        start = last
    reach = s.high if elapsed is None else max(s.high, elapsed)
    if start > reach + max(lead, lead_ratio * (elapsed or 0.0)):
        faults.append(AHEAD)
    s.ends[channel], s.high = max(end, start), max(s.high, end)
    return start, end, faults[0] if faults else None, faults


# -- finished tables --------------------------------------------------------------------------------


def each_in_order(df: DataFrame, keys: list[str], order: list[str], schema: str, run, columns: list[str] | None = None) -> DataFrame:
    """run's steps over every key's rows in order (their `columns`, all but the keys without), as one task's
    sorted stream of Arrow batches, so that a long session never has to be in memory at once."""
    n = len(keys)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key, out = None, None, []
        for f in frames:
            for row in zip(*(f[c].astype(object).tolist() for c in picked), strict=True):
                if row[:n] != key:
                    if key is not None:
                        out += [key + r for r in run.end(state)]
                    state, key = run.begin(), row[:n]
                out += [key + r for r in run(state, *row[n:])]
            yield pd.DataFrame(out, columns=names)
            out = []
        if key is not None:
            yield pd.DataFrame([key + r for r in run.end(state)], columns=names)

    names = _names(schema)
    picked = [*keys, *(columns or [c for c in df.columns if c not in keys])]
    return df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)


class _Detect:
    """The steps over one key's rows: begin, one row, end; and the state as a row, for streams."""

    state = "floor double, active boolean, idle long, loud long, recent array<double>, first long, held long, frames long, voiced long, quiet long, peak double, total double, frame long"

    def __init__(self, p: Endpointing = Endpointing()):
        self.p = p

    def begin(self) -> TurnState:
        return TurnState(floor=self.p.floor_min)

    def __call__(self, s, frame, rms):
        return detect_step(s, int(frame), float(rms), self.p) if frame > s.frame else []  # a frame that came before counts once

    def end(self, s):
        return close_turn(s, "flush", self.p)

    def due(self, s, seen: float, idle: float) -> float | None:
        return seen + idle if s.active else None

    def pack(self, s) -> tuple:
        return astuple(s)

    def unpack(self, v) -> TurnState:
        return TurnState(*v[:4], list(v[4]), *v[5:])


class _Coalesce:
    state = "start double, end double, parts long, due double"

    def begin(self) -> HeldTurn:
        return HeldTurn()

    def __call__(self, s, start, end, now=None):
        return coalesce_step(s, float(start), float(end), None if now is None or now != now else float(now))

    def end(self, s):
        return release(s)

    def due(self, s, seen: float, idle: float) -> float | None:
        return s.due if s.parts else None

    def pack(self, s) -> tuple:
        return astuple(s)

    def unpack(self, v) -> HeldTurn:
        return HeldTurn(*v)


class _Guard:
    state = "high double, channels array<int>, ends array<double>"

    def begin(self) -> Timeline:
        return Timeline()

    def __call__(self, s, seq, channel, start, end, elapsed=None):
        elapsed = None if elapsed is None or elapsed != elapsed else float(elapsed)
        return [(int(seq), int(channel), *guard_step(s, int(channel), float(start), float(end), elapsed))]

    def end(self, s):
        return []

    def due(self, s, seen: float, idle: float) -> float | None:
        return None

    def pack(self, s) -> tuple:
        return s.high, list(s.ends), list(s.ends.values())

    def unpack(self, v) -> Timeline:
        return Timeline(v[0], dict(zip(v[1], v[2], strict=True)))


_TURNS = "session_id long, channel int, first_frame long, end_frame long, reason string, peak_rms double, mean_rms double"
_JOINED = "session_id long, channel int, start_s double, end_s double, parts int"
_GUARDED = "session_id long, sequence long, channel int, start_s double, end_s double, flag string, faults array<string>"


def detect_turns(frames: DataFrame, p: Endpointing = Endpointing()) -> DataFrame:
    """Turns of every (session_id, channel) from frames (frame_idx, rms)."""
    return each_in_order(frames.select("session_id", "channel", "frame_idx", "rms"), ["session_id", "channel"], ["frame_idx"], _TURNS, _Detect(p))


def coalesce_turns(turns: DataFrame) -> DataFrame:
    """Turns (start_s, end_s) of every (session_id, channel), short pauses closed; with a column recv_s,
    the second in which a turn came, a held turn is released after its time, as on a stream."""
    more = ["recv_s"] if "recv_s" in turns.columns else []
    return each_in_order(turns.select("session_id", "channel", "start_s", "end_s", *more), ["session_id", "channel"], [*more, "start_s", "end_s"], _JOINED, _Coalesce())


def guard_timeline(turns: DataFrame) -> DataFrame:
    """Turns of every session in arrival order (sequence), clamped and flagged."""
    return each_in_order(turns.select("session_id", "sequence", "channel", "start_s", "end_s", "elapsed_s"), ["session_id"], ["sequence"], _GUARDED, _Guard())


def timeline_faults(guarded: DataFrame, details: int = FAULT_DETAILS) -> DataFrame:
    """Per session: how many faults of each kind, the channels they are of, and the first few turns with
    one; the counts are of all."""
    rows = guarded.where(F.size("faults") > 0)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("sequence"))).where(F.col("_n") <= details)
    shown = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "channel", "start_s", "flag"))).alias("details"))
    kind = lambda k: F.count_if(F.array_contains("faults", k))
    per = rows.groupBy("session_id").agg(kind(REGRESSION).alias("regressions"), kind(AHEAD).alias("ahead"), F.array_sort(F.collect_set("channel")).alias("channels"))
    return per.join(shown, "session_id")


# -- streams ----------------------------------------------------------------------------------------


#: Seconds without a row after which a session is over and its state is removed.
SESSION_SEC = 3600.0
#: Column of a stream's output that holds a row which came too late, as JSON; null in all other rows.
REJECTED = "rejected"


class Steps(StatefulProcessor):
    """One of the recurrences on a stream: a key's state between micro-batches, its new rows in order of
    `order`, and an event-time timer for what ends without a further row.

    Rows that are older than the watermark change nothing; with `rejects` they leave as they are, as JSON.
    A key's state is removed once nothing has come for SESSION_SEC.
    """

    def __init__(self, run, columns: list[str], order: list[str], names: list[str], idle_s: float = 5.0, rejects: bool = False, session_s: float = SESSION_SEC):
        self.run, self.columns, self.order, self.names, self.idle_s, self.rejects, self.session_s = run, columns, order, names, idle_s, rejects, session_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.run.state)
        self.seen = handle.getValueState("seen", "at double")

    def _load(self):
        return self.run.unpack(self.state.get()) if self.state.exists() else self.run.begin()

    def _rows(self, key, found: list[tuple], late: list[str] = ()) -> pd.DataFrame:
        key = tuple(int(k) for k in key)
        rows = [(*key, *x) for x in found]
        if not self.rejects:
            return pd.DataFrame(rows, columns=self.names)
        blank = (None,) * (len(self.names) - len(key))
        return pd.DataFrame([(*r, None) for r in rows] + [(*key, *blank, x) for x in late], columns=[*self.names, REJECTED], dtype=object)

    def _wake(self, s, seen: float, now_ms: int) -> None:
        """One timer: when the held result is due, else when the session is over."""
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        due = self.run.due(s, seen, self.idle_s)
        over = seen + self.session_s
        self.handle.registerTimer(max(int(1000 * (over if due is None else min(due, over))), now_ms + 1))

    def handleInputRows(self, key, rows, timerValues):
        # a key's rows of one micro-batch may come in several frames, in no order
        batch = pd.concat(list(rows))
        now = timerValues.getCurrentWatermarkInMs()
        old = batch["seen_s"] * 1000.0 < now
        late = [x.to_json(double_precision=15) for _, x in batch[old].drop(columns="seen_s").iterrows()] if self.rejects and old.any() else []
        batch, found = batch[~old].sort_values(self.order, kind="stable"), []
        if len(batch):
            s = self._load()
            for row in zip(*(batch[c].astype(object).tolist() for c in self.columns), strict=True):
                found += self.run(s, *row)
            seen = max(float(batch["seen_s"].max()), self.seen.get()[0] if self.seen.exists() else 0.0)
            self.state.update(self.run.pack(s))
            self.seen.update((seen,))
            self._wake(s, seen, now)
        yield self._rows(key, found, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s, found = self._load(), []
        if self.state.exists():
            seen = self.seen.get()[0]
            found = self.run.end(s)
            if expiredTimerInfo.getExpiryTimeInMs() >= 1000 * (seen + self.session_s):
                self.state.clear()
                self.seen.clear()
            else:
                self.state.update(self.run.pack(s))
                self._wake(s, seen, timerValues.getCurrentWatermarkInMs())
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def _stream(df: DataFrame, keys: list[str], steps: Steps, schema: str, lateness: str) -> DataFrame:
    # the processor itself tells late rows, so the time goes in as a plain number, which Spark doesn't filter by
    rows = df.withWatermark("recv_ts", lateness).withColumn("seen_s", F.unix_micros("recv_ts") / 1e6).drop("recv_ts")
    out = f"{schema}, {REJECTED} string" if steps.rejects else schema
    return rows.groupBy(*keys).transformWithStateInPandas(steps, outputStructType=out, outputMode="Append", timeMode="EventTime")


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def detect_turns_stream(frames: DataFrame, lateness: str = "10 seconds", p: Endpointing = Endpointing(), rejects: bool = False) -> DataFrame:
    """frames: a stream of (session_id, channel, frame_idx, rms, recv_ts).  A frame that steps back counts no
    more; frames older than the watermark change nothing and, with `rejects`, come out in the column
    `rejected` (see write_split)."""
    return _stream(frames, ["session_id", "channel"], Steps(_Detect(p), ["frame_idx", "rms"], ["frame_idx"], _names(_TURNS), rejects=rejects), _TURNS, lateness)


def coalesce_turns_stream(turns: DataFrame, lateness: str = "10 seconds", rejects: bool = False) -> DataFrame:
    """turns: a stream of (session_id, channel, start_s, end_s, recv_ts).  A held turn is released by the
    next one, or when the watermark passes its deadline."""
    rows = turns.withColumn("recv_s", F.unix_micros("recv_ts") / 1e6)
    return _stream(rows, ["session_id", "channel"], Steps(_Coalesce(), ["start_s", "end_s", "recv_s"], ["recv_s", "start_s", "end_s"], _names(_JOINED), rejects=rejects), _JOINED, lateness)


def guard_timeline_stream(turns: DataFrame, lateness: str = "10 seconds", rejects: bool = False) -> DataFrame:
    """turns: a stream of (session_id, sequence, channel, start_s, end_s, elapsed_s, recv_ts), keyed by
    session, as what a session has reached is that of all its channels."""
    return _stream(turns, ["session_id"], Steps(_Guard(), ["sequence", "channel", "start_s", "end_s", "elapsed_s"], ["sequence"], _names(_GUARDED), rejects=rejects), _GUARDED, lateness)


def write_split(stream: DataFrame, results: Callable[[DataFrame, int], None], rejects: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream of one of the functions above (with rejects=True): of each micro-batch its results go to
    `results` and what came too late to `rejects`, both called with (rows, batch number).  The two writes read
    one kept copy, so that the stateful step runs once."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        results(batch.where(F.col(REJECTED).isNull()).drop(REJECTED), number)
        rejects(batch.where(F.col(REJECTED).isNotNull()), number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def validate_frames(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with a reason): wrong version, no samples, a length that doesn't match, or no key;
    works on tables and streams."""
    why = (
        F.when(F.col("version").isNull() | (F.col("version") != VERSION), "bad_version")
        .when(F.coalesce("n_samples", F.lit(0)) <= 0, "zero_samples")
        .when(F.col("payload_bytes") != 2 * F.col("n_samples"), "bad_length")
        .when(F.col("session_id").isNull(), "no_session")
    )
    tagged = packets.withColumn("reject", why)
    return tagged.where("reject IS NULL").drop("reject"), tagged.where("reject IS NOT NULL")


def session_stats(turns: DataFrame, keys: tuple = ("session_id",)) -> DataFrame:
    """Counters per session (and a window, if keys hold one): turns, refused ones by kind, covered and
    furthest seconds."""
    d = F.col("end_s") - F.col("start_s")
    return turns.groupBy(*keys).agg(
        F.count("*").alias("turns"), F.count_if(F.col("kind") == "non_speech").alias("non_speech"), F.count_if(F.col("kind") == "malformed").alias("malformed"),
        F.count_if(F.col("channel") == 0).alias("channel_0"), F.count_if(F.col("channel") == 1).alias("channel_1"), F.sum(d).alias("covered_sec"), F.max("end_s").alias("reached_sec"),
    )


_COUNTED = "session_id long, turns long, non_speech long, malformed long, channel_0 long, channel_1 long, covered_sec double, reached_sec double"


class _Count:
    """Counters of a session, which come out once, when it is over."""

    state = "counts array<long>, covered double, reached double, known boolean"

    def begin(self) -> list:
        return [[0, 0, 0, 0, 0], 0.0, 0.0, False]

    def __call__(self, s, channel, start, end, kind):
        for i, hit in enumerate((True, kind == "non_speech", kind == "malformed", channel == 0, channel == 1)):
            s[0][i] += bool(hit)
        known = [x is not None and x == x for x in (start, end)]
        if all(known):
            s[1] += end - start
        if known[1]:
            s[2], s[3] = max(s[2], end) if s[3] else end, True
        return []

    def end(self, s):
        return [(*s[0], s[1], s[2] if s[3] else None)]

    def due(self, s, seen: float, idle: float) -> float | None:
        return None

    def pack(self, s) -> tuple:
        return tuple(s)

    def unpack(self, v) -> list:
        return [list(v[0]), *v[1:]]


def session_stats_stream(turns: DataFrame, lateness: str = "10 seconds", session_s: float = SESSION_SEC, rejects: bool = False) -> DataFrame:
    """session_stats of a stream (session_id, channel, start_s, end_s, kind, recv_ts): a row for each session
    once nothing has come for session_s, when its state goes; a session that comes back counts anew."""
    return _stream(turns, ["session_id"], Steps(_Count(), ["channel", "start_s", "end_s", "kind"], ["seen_s"], _names(_COUNTED), rejects=rejects, session_s=session_s), _COUNTED, lateness)


def inactivity_sessions(events: DataFrame, gap: str = "3600 seconds", key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Sessions that end when nothing comes for a while; tables and (with a watermark) streams."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("expires"), "events")


def gap_log(events: DataFrame, lateness: str = "1 hour", stream: bool = False) -> DataFrame:
    """Dropped stretches, all of them, and drift notices, one for a channel of a session."""
    drops = events.where("kind = 'dropped'").select("session_id", "channel", "kind", "at_s")
    drift = events.where("kind = 'drift'")
    if stream:
        drift = drift.withWatermark("recv_ts", lateness).dropDuplicatesWithinWatermark(["session_id", "channel", "kind"])
    else:
        drift = drift.groupBy("session_id", "channel", "kind").agg(F.min("at_s").alias("at_s"))
    return drops.unionByName(drift.select("session_id", "channel", "kind", "at_s"))


def speech_gate(turns: DataFrame, frames: DataFrame, keys: list[str], mean: float = 0.30, ratio: float = 0.35, on: float = 0.5) -> DataFrame:
    """Each turn with its frames' mean speech probability and share of speaking ones; it passes if both
    suffice, and where there are no frames."""
    f = frames.groupBy(*keys).agg(F.avg("speech_prob").alias("mean_prob"), F.avg((F.col("speech_prob") >= on).cast("double")).alias("speech_ratio"))
    return turns.join(f, keys, "left").withColumn("passes", F.coalesce((F.col("mean_prob") >= mean) & (F.col("speech_ratio") >= ratio), F.lit(True)))


#: Whom the microphone's channel belongs to, and where a name comes from.
LOCAL_SPEAKER = "You"
FROM_DEVICE, FROM_PROFILE, FROM_NOTHING = "input_device", "known_voiceprint", "unknown"
#: A tenant's profiles meet a stream's turns as one array, of this many bytes at most.
STREAM_BYTES = 64 << 20


def live_reason(duration: Column, mic: Column, embedding: Column, best: Column, margin: Column, th: Thresholds = DEFAULTS) -> Column:
    """Why a turn has no name, null if it has one: the length first, then (the microphone is its owner's)
    profiles, the vector, and how sure and how far ahead the best match is."""
    return (
        F.when(duration < th.live_min_sec, "live_turn_too_short")
        .when(duration > th.live_max_sec, "live_turn_too_long")
        .when(mic, F.lit(None).cast("string"))
        .when(best.isNull(), "no_voiceprints")
        .when(embedding.isNull() | (F.size(embedding) == 0), "live_match_failed")
        .when(best["confidence"] < th.live_confidence, "live_match_weak")
        .when(margin < th.live_margin, "live_match_ambiguous")
    )


def attribute_live(turns: DataFrame, profiles: DataFrame, keys: list[str], th: Thresholds = DEFAULTS) -> DataFrame:
    """Live turns (keys, turn_id, channel, duration_sec, embedding, pitch_hz) with speaker, speaker_source,
    speaker_confidence, speaker_margin, speaker_match_dist, uncertain and the attribution_reason of those
    without a name: channel 0, the microphone, is the user, others need a sure match that stands apart.
    A lone profile is ahead of all others by infinity.  Null durations count as 0; pending profiles don't match.

    Tables and streams.  On a table the two best come from blocks of profiles (nearest), however many a
    tenant has.  On a stream each turn meets its tenant's profiles as one array, a join with a table that
    needs no state and is broadcast if it is small; where a tenant's array would be larger than STREAM_BYTES that
    is an error: give the table form to foreachBatch instead.
    """
    known = profiles.where(~F.coalesce("pending", F.lit(False)))
    d, mic = F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0)), F.coalesce(F.col("channel") == 0, F.lit(False))
    kept = [*keys, "turn_id", "channel"]
    more = [c for c in turns.columns if c in ("recv_ts",)]
    rows = turns.select(*kept, *more, d.alias("_d"), mic.alias("_mic"), "embedding", F.coalesce(F.col("pitch_hz").cast("double"), F.lit(0.0)).alias("pitch_hz"))
    if turns.isStreaming:
        packed = packed_profiles(known, keys, None)
        largest = packed.agg(F.max(F.aggregate("_people", F.lit(0).cast("long"), lambda s, p: s + 64 + 8 * F.coalesce(F.size(p["_e"]), F.lit(0)))).alias("b")).first().b or 0
        if largest > STREAM_BYTES:
            raise ValueError(f"a tenant's profiles take {largest} bytes: call attribute_live in foreachBatch")
        small = packed_bytes(packed) <= BROADCAST_BYTES
        packed = packed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_people")
        met = rows.join(F.broadcast(packed) if small else packed, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
        voice = F.transform("embedding", lambda x: x.cast("double"))
        met = met.withColumn("_v", voice).withColumn("_l", norm(F.col("_v")))
        out = met.withColumn("top", best_of(scored(F.col("_people"), F.col("_v"), F.col("_l"), F.col("pitch_hz"), th), 2))
    else:
        asked = rows.where("NOT _mic").select(*keys, "turn_id", "embedding", "pitch_hz")
        out = rows.join(nearest(asked, known, keys, 2, ["turn_id"], th).select(*keys, "turn_id", "top"), [*keys, "turn_id"], "left")
    best, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    margin = F.when(second.isNotNull(), second["distance"] - best["distance"]).otherwise(float("inf"))
    out = out.withColumns({"_b": F.when(~F.col("_mic"), best), "_m": margin})
    out = out.withColumn("attribution_reason", live_reason(F.col("_d"), F.col("_mic"), F.col("embedding"), F.col("_b"), F.col("_m"), th))
    why, fine = F.col("attribution_reason"), F.col("attribution_reason").isNull()
    tried = ~F.col("_mic") & (fine | why.isin("live_match_weak", "live_match_ambiguous"))
    value = lambda mine, c, other: F.when(fine & F.col("_mic"), mine).when(tried, c).otherwise(F.lit(other).cast("double"))
    return out.select(
        *kept, *more, F.when(fine, F.when(F.col("_mic"), LOCAL_SPEAKER).otherwise(F.col("_b.name"))).alias("speaker"),
        F.when(~fine, FROM_NOTHING).when(F.col("_mic"), FROM_DEVICE).otherwise(FROM_PROFILE).alias("speaker_source"),
        value(1.0, F.bround("_b.confidence", 3), 0.0).alias("speaker_confidence"), value(1.0, F.bround("_m", 4), 0.0).alias("speaker_margin"),
        value(0.0, F.bround("_b.distance", 4), None).alias("speaker_match_dist"), (~fine).alias("uncertain"), "attribution_reason",
    )
