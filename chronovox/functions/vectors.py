"""Voice vectors: distances, centroids, packed storage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from chronovox.thresholds import DEFAULTS, Thresholds


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _once(value: Column, then) -> Column:
    """then(value) with value computed once: a function's argument is, a repeated expression isn't."""
    return F.element_at(F.transform(F.array(value), then), 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a side has (nearly) no length or no finite one."""
    both = F.struct(norm(a).alias("x"), norm(b).alias("y"))
    fine = lambda n: (n["x"] > 1e-8) & (n["y"] > 1e-8) & (n["x"] * n["y"] < float("inf"))
    return _once(both, lambda n: F.when(fine(n), 1.0 - dot(a, b) / (n["x"] * n["y"])).otherwise(1.0))


def l2_normalize(a: Column) -> Column:
    """The vector at length 1, as doubles; one of no length as it is, null for null."""
    unit = _once(F.nullif(norm(a), F.lit(0.0)), lambda n: F.transform(a, lambda x: x.cast("double") / F.coalesce(n, F.lit(1.0))))
    return F.when(a.isNotNull(), unit)


def match_distance(emb: Column, pitch_a: Column, pitch_b: Column, named: Column, th: Thresholds = DEFAULTS) -> Column:
    """Weighted embedding and pitch distance, less the bias that named profiles enjoy; 4 places.
    emb: the cosine distance, null for a missing vector."""
    pitch = F.when((pitch_a > 0) & (pitch_b > 0), F.least(F.abs(pitch_a - pitch_b) / th.pitch_unit, F.lit(1.0))).otherwise(0.0)
    raw = th.w_embedding * emb + th.w_pitch * pitch - F.when(named, th.known_bias).otherwise(0.0)
    return F.when(emb.isNull(), 1.0).otherwise(F.bround(F.greatest(raw, F.lit(0.0)), 4))  # greatest() would take 0 for a missing one


def match_confidence(distance: Column, th: Thresholds = DEFAULTS) -> Column:
    return F.bround(F.greatest(F.lit(0.0), 1.0 - distance / th.max_distance), 4)


@F.pandas_udf(ArrayType(FloatType()))
def unpack_embedding(blob: pd.Series) -> pd.Series:
    """Packed little-endian float32 values; null for null or a torn value."""
    return blob.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


def centroid(df: DataFrame, keys: list[str], vec: str = "embedding", weight: Column | None = None, unit: bool = False) -> DataFrame:
    """(Weighted) mean vector per group, as (keys, centroid, n).  Values are averaged per position, so
    that partial sums combine before the exchange; null vectors don't count."""
    rows = df.where(F.col(vec).isNotNull()).select(*keys, (weight if weight is not None else F.lit(1.0)).alias("_w"), F.posexplode(vec).alias("_p", "_x"))
    per = rows.groupBy(*keys, "_p").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"), F.count("*").alias("n"))
    out = per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("centroid"), F.max("n").alias("n"))
    return out.withColumn("centroid", l2_normalize(F.col("centroid"))) if unit else out


def weighted_centroid(df: DataFrame, keys: list[str], vec: str = "embedding", duration: str = "duration_sec", th: Thresholds = DEFAULTS) -> DataFrame:
    """Mean vector per group, weighted by duration, no weight above a multiple of the group's median;
    equal weights where they sum to nothing."""
    med = df.groupBy(*keys).agg(F.median(duration).alias("_med"), F.sum(duration).alias("_sum"))
    rows = df.join(med, keys).withColumn("_c", F.when(F.col("_sum") > 0, F.least(F.col(duration).cast("double"), F.col("_med") * th.weight_ratio)).otherwise(1.0))
    return centroid(rows, keys, vec, F.col("_c"))


def pairwise_mean(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance per group from the sum of unit vectors, no pair made; null below
    two vectors: 1 - (|sum|^2 - n) / (n (n - 1))."""
    rows = df.where(F.col(vec).isNotNull()).withColumn("_u", l2_normalize(F.col(vec))).select(*keys, F.posexplode("_u").alias("_p", "_x"))
    per = rows.groupBy(*keys, "_p").agg(F.sum("_x").alias("_s"), F.count("*").alias("n"))
    out = per.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.max("n").alias("n"))
    n = F.col("n").cast("double")
    return out.withColumn("mean_distance", F.when(F.col("n") > 1, 1.0 - (F.col("_q") - n) / (n * (n - 1)))).drop("_q")
