"""Reading and writing the store's tables, recordings' inventory, transcripts and item lists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: audio file endings.
AUDIO = ("flac", "wav", "mp3", "m4a", "ogg", "opus", "webm")

SEGMENT = "struct<start:double,end:double,text:string,confidence:double>"
RESULT = f"struct<segments:array<struct<start:double,end:double,speaker:string,text:string>>,results:array<struct<start:double,end:double,speaker:string,text:string,segments:array<{SEGMENT}>>>>"
ITEM = "array<struct<start:double,end:double,text:string>>"
PURITY = "struct<intra_max:double,intra_mean:double,inter_min:double,purity_ratio:double,groups:int>"


def read_store(spark: SparkSession, path: str, tenant: str | None = None, include_pending: bool = True) -> DataFrame:
    """A store table, partitioned by tenant: a tenant's rows come from its own folder only."""
    df = spark.read.parquet(path)
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    return df if include_pending or "pending" not in df.columns else df.where(~F.coalesce("pending", F.lit(False)))


def write_store(df: DataFrame, path: str) -> None:
    """A snapshot, dealt by tenant so that each folder gets few files."""
    df.repartition("tenant_id").write.mode("overwrite").partitionBy("tenant_id").parquet(path)


_MANIFEST = "version long, writer string, table string, folder string"


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def store_versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first: a row each."""
    known = _manifest(spark, root)
    return [] if known is None else [r.version for r in known.select("version").distinct().orderBy("version").collect()]


def open_store(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of the store as of one version, the last one if none is named; {} before the first."""
    versions = store_versions(spark, root)
    if not versions:
        return {}
    at = versions[-1] if version is None else version
    if at not in versions:
        raise ValueError(f"no version {at}: {versions}")
    rows = _manifest(spark, root).where(F.col("version") == at).select("table", "folder").collect()  # a row a table
    return {r.table: read_store(spark, f"{root}/{r.folder}") for r in rows}


def commit_store(spark: SparkSession, root: str, changed: dict[str, DataFrame]) -> int:
    """Write the changed tables as new folders, then all of them at once become the next version, whose number
    it returns; tables that aren't named stay as they are.

    Nothing that a reader of an older version reads is touched, so tables may be computed from the store
    itself, and if a table fails the store is as before.  The version is one file that Spark's commit puts in its
    place.  One writer at a time: a second one that took the same number is told so, and its rows don't count.
    """
    known, versions = _manifest(spark, root), store_versions(spark, root)
    version, writer = (versions[-1] if versions else 0) + 1, uuid.uuid4().hex
    before = {} if not versions else {r.table: r.folder for r in known.where(F.col("version") == versions[-1]).select("table", "folder").collect()}
    after = dict(before)
    for name, df in changed.items():
        after[name] = f"data/{name}/{version}-{writer}"
        write_store(df, f"{root}/{after[name]}")
    if store_versions(spark, root) != versions:
        raise RuntimeError(f"another writer took version {version}")
    rows = [(version, writer, name, folder) for name, folder in sorted(after.items())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def scan_inventory(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """Audio files under root/<tenant>/<speaker>/: path, size, mtime and (digest) the content's sha256;
    without it the files' bytes are not read.  Empty files are not listed, as the reader skips them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = r"/([^/]+)/([^/]+)/([^/]+)$"
    ok = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*AUDIO)
    cols = [F.regexp_extract("path", parts, 1).alias("tenant_id"), F.regexp_extract("path", parts, 2).alias("speaker_name"), "path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime")]
    return files.where(ok).select(*cols, *([F.sha2("content", 256).alias("content_sha256")] if digest else []))


def read_transcripts(df: DataFrame, column: str = "result") -> DataFrame:
    """Rows with the parsed result; what can't be parsed is left out, not fatal."""
    out = df.withColumn("_r", F.from_json(column, RESULT, {"mode": "PERMISSIVE"}))
    return out.where(F.col("_r.segments").isNotNull() | F.col("_r.results").isNotNull()).withColumn(column, F.col("_r")).drop("_r")


def parse_items(df: DataFrame, column: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of a JSON array of {start, end, text}: blank texts go, other JSON is a reject."""
    parsed = df.withColumn("_a", F.when(F.trim(column).startswith("["), F.from_json(column, ITEM)))
    items = parsed.where("_a IS NOT NULL").select(*keys, F.posexplode("_a").alias("seq", "_i")).select(*keys, "seq", F.col("_i.start").alias("start_s"), F.col("_i.end").alias("end_s"), F.col("_i.text").alias("text"))
    return items.where(F.trim("text") != ""), parsed.where("_a IS NULL").select(*keys, column)


def parse_purity(column: str) -> Column:
    """Purity figures from JSON text; anything else is null."""
    return F.from_json(column, PURITY)


def export(df: DataFrame, path: str, kind: str = "text") -> None:
    """Write transcripts: text files, or JSON lines."""
    df.write.mode("overwrite").format(kind).save(path)
