"""Mixing sources to target weights: tokens per source, a repetition rate each, then floor(rate)
copies of a document plus one hash-seeded Bernoulli copy for the fraction.

The further copies of a source are one dependent draw: its documents are numbered by size, and number n has
its copy if a multiple of 1 lies between n * fraction + u and (n + 1) * fraction + u, with one number u
in [0, 1) hashed from source and seed.  Over all seeds each document has its copy with exactly the
fraction as probability, and as neighbours in size stand for each other, a source's words come within
about its longest document of the target under every seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.llm.common import forget, numbered, saved, table

#: A source takes at most this many times its own size.
MAX_REPEATS = 3
#: Weights of the sources in order of their names, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hashed(value: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def coin(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) fixed by the source's name and the seed: 52 bits of an md5."""
    return F.conv(F.substring(_hashed(source, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, rate; from rows (source, size).

    Filling to a level: a source takes weight * level, but max_repeats times its size at most.
    With the sources in order of (cap / weight), the level is the first at which the rest, shared by
    the remaining weights, stays below the next cap.  The window has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_repeats))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    open_ = F.col("level") <= F.col("cap") / F.col("weight")
    # the first source that is not filled up sets the level for itself and all after it
    per = per.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(every))
    per = per.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest (of the text) of every row, written once: texts are read in one pass."""
    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _text_digest(F.col("text")).alias("digest")), "sized")


def _with(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of per (one row a source), null sources with each other; per is broadcast
    if it is small, which is counted."""
    per = per.withColumnRenamed("source", "_source")
    small = per.select("_source").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def decisions(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, digest, source_size, target, copies of every different row of sized(); written.

    Documents are numbered by a range-partitioned sort with the parts' lengths, sources beside each other;
    what a source's first number is comes from one row a source.
    """
    rates = saved(source_rates(sizes), "rates")
    units = saved(sizes.select("doc_id", "source", "size", "digest").distinct(), "units")
    order = [F.col("source").asc_nulls_last(), F.col("size"), _hashed(F.col("doc_id"), seed), F.col("doc_id"), F.col("digest")]
    ordered, _ = numbered(units, order)
    starts = ordered.groupBy("source").agg(F.min("_number").alias("start")).withColumnRenamed("source", "_s")
    rates = rates.join(starts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = _with(ordered, rates)
    fraction, n, u = F.col("rate") - F.floor("rate"), (F.col("_number") - F.col("start")).cast("double"), coin(F.col("source"), seed)
    extra = F.floor((n + 1.0) * fraction + u) - F.floor(n * fraction + u)
    out = saved(rows.select("doc_id", "source", "digest", "source_size", "target", (F.floor("rate") + extra).cast("long").alias("copies")), "mix-plan")
    forget(units)
    return out


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (doc_id, source, digest, ...) with the columns of their decision."""
    plan = plan.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "source", "digest")})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source")]
    return rows.join(plan, [*same, F.col("digest") == F.col("_digest")]).drop("_doc_id", "_source", "_digest")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: each row of docs as often as decided, in docs' columns.

    Null texts have size 0; a null source is a source of its own; rows of one doc_id, source and text share
    their decision; other columns ride along, whatever their names; no rows give no rows.  Texts go
    through one exchange, dealt by document.
    """
    sizes = sized(docs)
    plan = decisions(sizes, seed)
    forget(sizes)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    rows = rows.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "source": F.col(at["source"]).cast("string"), "digest": _text_digest(F.col(at["text"]))})
    taken = _decided(rows, plan.select("doc_id", "source", "digest", "copies")).where("copies > 0")
    return taken.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select(*names).toDF(*docs.columns)


def mix_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs; see mix."""
    sizes = sized(docs)
    rows = _decided(sizes, decisions(sizes, seed)).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), lv AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER ()
          - coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST)
), chosen AS (
  SELECT arg_min(level, struct_pack(a := cap / weight, b := source IS NULL, c := source)) AS level FROM lv WHERE level <= cap / weight
), rated AS (
  SELECT source, source_size, least(cap, weight * chosen.level) AS target,
         CASE WHEN source_size > 0 THEN least(least(cap, weight * chosen.level) / source_size, 3.0) ELSE 0.0 END AS rate
  FROM lv, chosen
), placed AS (
  SELECT doc_id, source, digest, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), doc_id NULLS FIRST, digest) - 1 AS n
  FROM (SELECT DISTINCT doc_id, source, size, digest FROM sized)
), drawn AS (
  SELECT source, ('0x' || substr(md5(coalesce(source, '') || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u, rate - floor(rate) AS f, source_size, target, floor(rate)::BIGINT AS whole FROM rated
), decided AS (
  SELECT p.doc_id, p.source, p.digest, d.source_size, d.target,
         d.whole + (floor((p.n::DOUBLE + 1.0::DOUBLE) * d.f + d.u) - floor(p.n::DOUBLE * d.f + d.u))::BIGINT AS copies
  FROM placed p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source
)
SELECT s.doc_id, s.size, d.source_size, d.target, (s.size * d.copies)::BIGINT AS taken
FROM sized s JOIN decided d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.source IS NOT DISTINCT FROM d.source AND s.digest = d.digest
"""
