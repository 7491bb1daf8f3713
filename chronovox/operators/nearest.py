"""The k nearest profiles of a voice, without a window or an aggregate over pairs.

A tenant's profiles are packed into blocks: rows that hold about BLOCK of them in one array.  A voice meets
the blocks of its tenant, and of each block only the k best leave the row; what is merged afterwards is k
entries a block.  A large tenant is spread over its blocks and, where the blocks are small enough
to be broadcast, its voices need no exchange at all before the merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.functions.vectors import dot, match_confidence, match_distance, norm
from chronovox.thresholds import DEFAULTS, Thresholds

#: Profiles of a block, on average (names are dealt by hash).
BLOCK = 128
#: Blocks are broadcast if their vectors take fewer bytes than this, which is counted.
BROADCAST_BYTES = 32 << 20
_PERSON = ("name", "_e", "_n", "_p", "_t")


def packed_profiles(profiles: DataFrame, keys: list[str], block: int | None = BLOCK) -> DataFrame:
    """(keys, _blocks, _block, _people) of profiles (keys, name, embedding, pitch_hz, total_speech_sec): a
    row for each block of each tenant; with block None one row for each tenant."""
    rows = profiles.select(*keys, "name", F.transform("embedding", lambda x: x.cast("double")).alias("_e"), F.col("pitch_hz").cast("double").alias("_p"), F.col("total_speech_sec").cast("double").alias("_t")).withColumn("_n", norm(F.col("_e")))
    if block is None:
        rows = rows.withColumns({"_blocks": F.lit(1).cast("long"), "_block": F.lit(0).cast("long")})
    else:
        per = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
        rows = rows.join(per, keys).withColumn("_block", F.pmod(F.xxhash64("name"), F.col("_blocks")))
    return rows.groupBy(*keys, "_blocks", "_block").agg(F.array_sort(F.collect_list(F.struct(*_PERSON))).alias("_people"))


def packed_bytes(packed: DataFrame) -> int:
    """Bytes of the vectors of packed profiles, in one pass."""
    one = F.aggregate("_people", F.lit(0).cast("long"), lambda s, p: s + 64 + 8 * F.coalesce(F.size(p["_e"]), F.lit(0)))
    return packed.agg(F.sum(one).alias("b")).first().b or 0


def scored(people: Column, embedding: Column, length: Column, pitch: Column, th: Thresholds = DEFAULTS) -> Column:
    """(distance, name, emb_dist, confidence, trained_sec) of a voice to each of an array of people; the
    voice's length is computed once, outside."""

    def one(p):
        both = length * p["_n"]
        fine = (length > 1e-8) & (p["_n"] > 1e-8) & (both < float("inf"))
        emb = F.when(embedding.isNotNull() & p["_e"].isNotNull(), F.when(fine, 1.0 - dot(embedding, p["_e"]) / both).otherwise(1.0))
        return F.struct(p["name"].alias("name"), emb.alias("emb_dist"), match_distance(emb, pitch, p["_p"], F.lit(False), th).alias("distance"), p["_t"].alias("trained_sec"))

    def told(s):
        sure = F.when(s["emb_dist"].isNull(), 0.0).otherwise(match_confidence(s["distance"], th))
        return F.struct(s["distance"].alias("distance"), s["name"].alias("name"), s["emb_dist"].alias("emb_dist"), sure.alias("confidence"), s["trained_sec"].alias("trained_sec"))

    return F.transform(F.transform(people, one), told)


def best_of(entries: Column, k: int) -> Column:
    """The k first entries, by distance, then name."""
    return F.slice(F.array_sort(entries), 1, k)


def _voice(queries: DataFrame) -> DataFrame:
    return queries.withColumns({"_v": F.transform("embedding", lambda x: x.cast("double")), "_q": F.struct(*queries.columns)}).withColumn("_l", norm(F.col("_v")))


def meet(queries: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """Each query (embedding, pitch_hz) with each block of its tenant: _q (all of it), _v, _l, _people,
    _block.  Larger tables than BROADCAST_BYTES meet by shuffle, in which AQE splits a hot tenant's voices."""
    small = packed_bytes(packed) <= BROADCAST_BYTES
    packed = packed.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return _voice(queries).join(F.broadcast(packed) if small else packed, on)


def nearest(queries: DataFrame, profiles: DataFrame, keys: list[str], k: int, per: list[str], th: Thresholds = DEFAULTS, skip: str | None = None) -> DataFrame:
    """queries' columns and top: the k nearest profiles of the tenant (keys) as an array of (distance,
    name, emb_dist, confidence, trained_sec), fewer where there are fewer; `per` are the columns that
    tell queries of a tenant apart.  Profiles named in the array column `skip` don't count; queries of a
    tenant without profiles are left out, and have an empty array where all are skipped."""
    packed = packed_profiles(profiles, keys)
    people = F.filter("_people", lambda p: ~F.array_contains(F.col(skip), p["name"])) if skip else F.col("_people")
    part = meet(queries, packed, keys).select("_q", *[F.col(c).alias(f"_g{i}") for i, c in enumerate([*keys, *per])], best_of(scored(people, F.col("_v"), F.col("_l"), F.col("pitch_hz"), th), k).alias("_top"))
    out = part.groupBy(*[f"_g{i}" for i in range(len(keys) + len(per))]).agg(F.first("_q").alias("_q"), best_of(F.flatten(F.collect_list("_top")), k).alias("top"))
    return out.select("_q.*", "top")


def clear_of(top: Column, th: Thresholds = DEFAULTS) -> Column:
    """Whether the first of two (or more) stands apart: alone, ahead by the gap, or tied but very near and
    trained on twice as much speech."""
    a, b = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    schooled = F.coalesce((a["trained_sec"] > 2 * b["trained_sec"]) & (a["distance"] < th.embed_only), F.lit(False))
    return b.isNull() | (b["distance"] - a["distance"] >= th.clear_gap) | schooled


def margin_of(top: Column) -> Column:
    return F.coalesce(F.get(top, F.lit(1))["distance"], F.lit(1.0)) - F.get(top, F.lit(0))["distance"]
