"""What the operators share: table reading, shared scratch space and Arrow text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronovox.scratch import forget, saved, scratch

__all__ = ["batched", "forget", "held_out", "numbered", "partitions", "ragged", "saved", "scratch", "table", "text_views", "train_row"]

#: Text bytes that one numpy step handles at a time inside a task.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: documents are long, and a batch is in memory whole.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batched(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut down to BATCH_ROWS rows where they are longer."""
    conf = df.sparkSession.conf
    if int(conf.get(_ROWS)) > BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_views(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) for slices of about SLICE_BYTES; a null text is empty.

    The bytes are a view of the Arrow buffer: no Python string is made.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, "right")) - 1)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def train_row(doc_id: str = "doc_id"):
    """Rows that labels may be learned from: crc32 of doc_id as text, mod 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def numbered(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """df with _number, its place from 0 in the given order, and the number of rows.

    A range-partitioned sort is written with each row's place in its part; one row a part gives the rows
    before it.  df is read twice, so it should be a written step; _at, _part are taken.
    """
    parts = partitions(df.sparkSession)
    step = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    per = step.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    per = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), "_n")
    before = saved(per, "parts")
    size = before.agg(F.sum("_n").alias("n")).first().n or 0
    out = step.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before.drop("_n")), "_part")
    return out.withColumn("_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before"), size


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 of every i, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
