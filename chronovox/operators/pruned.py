"""Pairs of near vectors, and the two farthest ones, without a table of all pairs.

Angles on the sphere obey the triangle inequality, so an angle to a pivot that two vectors share bounds the
angle between them from both sides.  Every vector belongs to the cell of its nearest pivot.  Vectors within
an angle of each other can only meet in a cell that the one belongs to and the other reaches, at angles
to its pivot that differ by no more; these are the pairs that are compared, exactly.

At wide angles pivots rule out next to nothing.  There blocks of vectors meet, a task for each two blocks, as
products of matrices of TILE rows; only what is found leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.functions.vectors import dot, l2_normalize, norm
from chronovox.scratch import forget, saved

#: Pivots are picked, farthest first, from this many vectors: those with the smallest hashes of all.
SAMPLE = 1024
PIVOTS = 64
#: Rows of one side of a cell that one join key holds; larger cells are dealt to several keys.
CELL_ROWS = 1000
#: Vectors of a block, of which two are in a task: 8 MB at 64 dimensions.
BLOCK = 8192
#: Vectors of a side that are compared at a time.
TILE = 1024
#: Added to every bound, so that rounding loses no pair.
EPS = 1e-6


def _has_length(vec: Column) -> Column:
    return (norm(vec) > 1e-8) & (norm(vec) < float("inf"))


def unit_vectors(df: DataFrame, keys: list[str], ident: str, vec: str = "embedding") -> DataFrame:
    """(keys, _id, _u): vectors at length 1; those that are null, of no length or of no finite one stay out."""
    fine = df.where(F.col(vec).isNotNull() & _has_length(F.col(vec)))
    return fine.select(*keys, F.col(ident).alias("_id"), l2_normalize(F.col(vec)).alias("_u"))


def pivots(unit: DataFrame, most: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Directions that are far from each other, of a bounded sample of all groups; which ones are picked
    changes how much is compared, never what is found."""
    rows = unit.select(F.xxhash64("_u").alias("_h"), "_u").orderBy("_h").limit(sample).select("_u").collect()
    if not rows:
        return np.zeros((0, 0))
    width = max(len(r["_u"]) for r in rows)
    v = np.array([r["_u"] for r in rows if len(r["_u"]) == width], dtype=float)
    picked = [0]
    near = v @ v[0]
    while len(picked) < min(most, len(v)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    return v[picked]


def with_angles(unit: DataFrame, pivot: np.ndarray) -> DataFrame:
    """unit with _a: the angle to every pivot, in Arrow batches.  Vectors of another width than the pivots' have
    pi / 2 to all of them, which rules out no pair among themselves."""
    names = unit.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for u in f["_u"]:
                u = np.asarray(u, dtype=float)
                out.append(np.arccos(np.clip(pivot @ u, -1.0, 1.0)) if len(u) == pivot.shape[1] else np.full(len(pivot), math.pi / 2))
            yield f.assign(_a=pd.Series(out, index=f.index, dtype=object))[[*names, "_a"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema) + ", _a array<double>"
    return unit.mapInPandas(run, schema)


def candidate_pairs(unit: DataFrame, keys: list[str], limit: float, most: int = PIVOTS) -> DataFrame:
    """(keys, a, b, ua, ub), a < b: pairs that the pivots don't rule out from lying within the cosine
    distance `limit`; each pair once."""
    alpha = math.acos(max(-1.0, min(1.0, 1.0 - limit))) + EPS
    # a wide angle reaches most cells, whatever their number: then a few do
    pivot = pivots(unit, most if alpha < math.pi / 4 else max(1, most // 8))
    if not len(pivot):
        return unit.select(*keys, F.col("_id").alias("a"), F.col("_id").alias("b"), F.col("_u").alias("ua"), F.col("_u").alias("ub")).where("false")
    rows = with_angles(unit, pivot)
    own = F.array_position("_a", F.array_min("_a")).cast("int") - 1
    rows = saved(rows.withColumn("_cell", own).withColumn("_r", F.array_min("_a")), "angles")
    # how far out a cell goes, and in how many keys its own rows are dealt; a row a cell
    cells = rows.groupBy(*keys, "_cell").agg(F.max("_r").alias("_reach"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts"))
    cells = saved(cells, "cells")
    home = rows.join(cells.select(*keys, "_cell", "_parts"), [*keys, "_cell"]).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    band = F.floor(F.col("_r") / alpha).cast("int")
    home = home.select(*keys, "_cell", "_part", band.alias("_band"), F.col("_id").alias("x"), F.col("_u").alias("ux"), F.col("_a").alias("ax"), F.col("_r").alias("rx"))
    # the cells that a vector reaches: its own and those before it, so that a pair meets once
    per = cells.groupBy(*keys).agg(F.collect_list(F.struct("_cell", "_reach", "_parts")).alias("_cells"))  # a group's cells: PIVOTS at most
    angle = F.get(F.col("_a"), F.col("c._cell"))
    guest = rows.join(per, keys).select(*keys, "_id", "_u", "_a", F.col("_cell").alias("_home"), "_r", F.explode("_cells").alias("c"))
    guest = guest.where((F.col("c._cell") <= F.col("_home")) & (angle <= F.least(F.col("_r") + 2 * alpha, F.col("c._reach") + alpha) + EPS))
    at = F.floor(angle / alpha).cast("int")
    guest = guest.select(*keys, F.col("c._cell").alias("_cell"), F.explode(F.sequence(F.lit(0), F.col("c._parts") - 1)).alias("_part"), F.array(at - 1, at, at + 1).alias("_bands"), F.col("_id").alias("y"), F.col("_u").alias("uy"), F.col("_a").alias("ay"), angle.alias("ry"), (F.col("c._cell") == F.col("_home")).alias("_same"))
    guest = guest.withColumn("_band", F.explode("_bands")).drop("_bands")
    met = home.join(guest, [*keys, "_cell", "_part", "_band"]).where((F.col("x") < F.col("y")) | (~F.col("_same") & (F.col("x") != F.col("y"))))
    apart = F.array_max(F.zip_with("ax", "ay", lambda p, q: F.abs(p - q)))
    met = met.where((F.abs(F.col("rx") - F.col("ry")) <= alpha) & (apart <= alpha))
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(*keys, pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("ux", "uy").alias("ua"), pick("uy", "ux").alias("ub"))


def _by_blocks(unit: DataFrame, keys: list[str]):
    """unit grouped by every two blocks of a group's vectors of one width, each two once; _left tells the
    side, and a block that meets itself is on the left alone."""
    of = [*keys, "_w"]
    rows = unit.withColumn("_w", F.size("_u"))
    per = rows.groupBy(*of).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    rows = rows.join(per, of).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select(*of, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") <= F.col("_o")).alias("_left"), "_id", "_u")
    return rows.groupBy(*of, "_i", "_j")


def _tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """(left rows, right rows, their distances) of two blocks, TILE rows a side; each pair once, others are nan."""
    t = pa.Table.from_batches(list(batches))
    at = t.column("_left").to_numpy()
    ids = t.select([*keys, "_id"])
    u = np.asarray(t.column("_u").combine_chunks().flatten(), dtype=float).reshape(len(t), -1)
    left, right = np.flatnonzero(at), np.flatnonzero(~at)
    own = not len(right)
    right = left if own else right
    for i in range(0, len(left), TILE):
        p = left[i : i + TILE]
        rows = ids.take(pa.array(p))
        for j in range(i if own else 0, len(right), TILE):
            q = right[j : j + TILE]
            d = 1.0 - u[p] @ u[q].T
            if own and i == j:
                d[np.tril_indices(len(p))] = np.nan
            yield rows, ids.take(pa.array(q)), d


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)


def block_pairs(unit: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """(keys, a, b, distance), a < b: near_pairs by comparing all with all, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, d in _tiles(batches, keys):
            i, j = np.nonzero(d <= limit)
            x = left.take(pa.array(i))
            found = x.append_column("_to", right.column("_id").take(pa.array(j))).append_column("distance", pa.array(d[i, j]))
            yield from found.combine_chunks().to_batches()

    kind = unit.schema["_id"].dataType.simpleString()
    met = _by_blocks(unit, keys).applyInArrow(run, f"{_kinds(unit, [*keys, '_id'])}_to {kind}, distance double")
    return met.where(F.col("_id") != F.col("_to")).select(*keys, F.least("_id", "_to").alias("a"), F.greatest("_id", "_to").alias("b"), "distance")


def near_pairs(df: DataFrame, keys: list[str], ident: str, limit: float, vec: str = "embedding", most: int = PIVOTS) -> DataFrame:
    """(keys, a, b, distance), a < b: all pairs of a group within the cosine distance `limit`; by pivots
    if that is narrow, else by blocks."""
    unit = saved(unit_vectors(df, keys, ident, vec), "unit")
    if 1.0 - limit < math.cos(math.pi / 4):
        return block_pairs(unit, keys, limit)
    d = candidate_pairs(unit, keys, limit, most).select(*keys, "a", "b", (1.0 - dot(F.col("ua"), F.col("ub"))).alias("distance"))
    return d.where(F.col("distance") <= limit)


# -- the farthest pair ------------------------------------------------------------------------------


def _cos(angle: Column) -> Column:
    return F.cos(F.least(angle, F.lit(math.pi)))


def far_pairs(unit: DataFrame, keys: list[str], most: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(pairs (keys, a, b, ua, ub), least (keys, _low)): a distance that two vectors of each group have, and
    the pairs that the pivots let be as far apart.

    The distance is that of a sweep: from a group's member farthest from its mean to the one farthest from that.  A pair's angle is at most the sum of both angles to
    any pivot, and at most 2 pi less that sum.  Vectors go in cells, and pairs of cells that can't be as far
    apart never meet.
    """
    pivot = pivots(unit, most)
    rows = saved(with_angles(unit, pivot), "angles")
    rows = rows.withColumn("_cell", F.array_position("_a", F.array_min("_a")).cast("int") - 1)
    mean = rows.select(*keys, F.posexplode("_u").alias("_p", "_x")).groupBy(*keys, "_p").agg(F.sum("_x").alias("_x"))
    mean = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("_v"))
    sweep = lambda ref: rows.join(ref, keys).groupBy(*keys).agg(F.min_by("_u", F.struct(dot(F.col("_u"), F.col("_v")).alias("c"), "_id")).alias("_v"))
    start = saved(sweep(mean), "sweep")
    low = saved(rows.join(start, keys).groupBy(*keys).agg(F.max(1.0 - dot(F.col("_u"), F.col("_v"))).alias("_low")), "low")
    # a cell: the range of its members' angles to every pivot
    spread = rows.select(*keys, "_cell", F.posexplode("_a").alias("_p", "_x")).groupBy(*keys, "_cell", "_p").agg(F.max("_x").alias("hi"), F.min("_x").alias("lo"))
    spread = spread.groupBy(*keys, "_cell").agg(F.array_sort(F.collect_list(F.struct("_p", "hi", "lo"))).alias("_s"))
    spread = saved(spread, "spread")
    bound = lambda x, y: F.array_min(F.zip_with(x, y, lambda p, q: F.least(p["hi"] + q["hi"], 2 * math.pi - p["lo"] - q["lo"])))
    a, b = spread.select(*keys, F.col("_cell").alias("ca"), F.col("_s").alias("sa")), spread.select(*keys, F.col("_cell").alias("cb"), F.col("_s").alias("sb"))
    cells = a.join(b, keys).where("ca <= cb").join(low, keys)  # PIVOTS squared rows a group at most
    cells = cells.where(1.0 - _cos(bound("sa", "sb") + EPS) >= F.col("_low") - EPS).select(*keys, "ca", "cb", "_low")
    left = rows.select(*keys, F.col("_cell").alias("ca"), F.col("_id").alias("x"), F.col("_u").alias("ux"), F.col("_a").alias("ax"))
    right = rows.select(*keys, F.col("_cell").alias("cb"), F.col("_id").alias("y"), F.col("_u").alias("uy"), F.col("_a").alias("ay"))
    # a vector takes part in a pair of cells only if it can be far enough from some member of the other
    other = cells.join(spread.select(*keys, F.col("_cell").alias("cb"), F.col("_s").alias("sb")), [*keys, "cb"])
    reach = F.array_min(F.zip_with("ax", "sb", lambda p, q: F.least(p + q["hi"], 2 * math.pi - p - q["lo"])))
    left = left.join(other, [*keys, "ca"]).where(1.0 - _cos(reach + EPS) >= F.col("_low") - EPS).drop("sb")
    salt = F.pmod(F.xxhash64("x"), F.lit(8)).cast("int")
    met = left.withColumn("_part", salt).join(right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(7)))), [*keys, "cb", "_part"]).where(((F.col("ca") < F.col("cb")) & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    angle = F.array_min(F.zip_with("ax", "ay", lambda p, q: F.least(p + q, 2 * math.pi - p - q)))
    met = met.where(1.0 - _cos(angle + EPS) >= F.col("_low") - EPS)
    return met.select(*keys, F.col("x").alias("a"), F.col("y").alias("b"), F.col("ux").alias("ua"), F.col("uy").alias("ub")), low


def farthest(df: DataFrame, keys: list[str], ident: str, vec: str = "embedding") -> DataFrame:
    """(keys, max_distance): the largest cosine distance of two rows of each group of two or more.

    A null vector has a distance from none; one of no length has 1 from all others.  All meet all in blocks: a
    block's product takes less than its vectors' way through the joins of far_pairs.
    """
    known = df.where(F.col(vec).isNotNull()).select(*keys, ident, vec)
    count = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(~_has_length(F.col(vec))).alias("_none"))
    unit = saved(unit_vectors(known, keys, ident, vec), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for left, _, d in _tiles(batches, keys):
            high = np.fmax.reduce(d, axis=None, initial=-1.0)
            if high > (best[1] if best else -1.0):
                best = left.select(keys).slice(0, 1), high
        if best:
            yield from best[0].append_column("_d", pa.array([best[1]])).combine_chunks().to_batches()

    found = _by_blocks(unit, keys).applyInArrow(run, f"{_kinds(unit, keys)}_d double").groupBy(*keys).agg(F.max("_d").alias("_d"))
    out = count.where("_n > 1").join(found, keys, "left")
    real = F.when(F.col("_n") - F.col("_none") > 1, F.col("_d"))
    out = out.select(*keys, F.greatest(real, F.when(F.col("_none") > 0, F.lit(1.0))).alias("max_distance"))
    done = saved(out, "farthest")
    forget(unit)
    return done
