"""Importance resampling towards a target: hashed word features of the corpus and of the target set give
each document a log weight, and documents are drawn without replacement by weight plus Gumbel noise.

The corpus is counted by segments.  Separator newlines cut texts into lines; equal lines meet in one
group, whose features are counted once and multiplied by the group's occurrences.  Runs of words that
cross a line's end are no line's own and are counted apart, document by document (with MOST_WORDS = 1
there are none).  The map side combines lines before the exchange, so a line that stands in a third of
all documents costs one row a task.

A document's own weight is read off the gains of the buckets (an array of fixed length) while its text is
scanned: fetching it line by line from the groups would send a row for each line of the corpus
through two exchanges, to save some hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import numbered, saved, table

#: Features are runs of up to this many words.
MOST_WORDS = 1
BUCKETS = 10_000
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Share of the other documents that is drawn, in percent.
PERCENT = 10
SEED = "2024"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z (and no other letters) in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _runs(of: Column, k: int, wanted=None) -> Column:
    """Runs of k words of an array, joined by a space; wanted(i) may leave some out by their start."""
    starts = F.when(F.size(of) >= k, F.sequence(F.lit(0), F.size(of) - k)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(starts, wanted) if wanted else starts
    return F.transform(starts, lambda i: F.array_join(F.slice(of, i + 1, F.lit(k)), " "))


def runs(of: Column, most: int) -> Column:
    """All runs of 1 to most consecutive words."""
    return F.flatten(F.array(of, *[_runs(of, k) for k in range(2, most + 1)])) if most > 1 else of


def crossing_runs(docs: DataFrame, most: int) -> DataFrame:
    """feature of every run of 2 to most words of a text (column text) whose words lie in several lines."""
    lines = F.transform(F.split("text", "\n"), words)
    flat = docs.select(F.flatten(lines).alias("w"), F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w: i))).alias("l"))

    def cross(k: int):
        return lambda i: F.get(F.col("l"), i) != F.get(F.col("l"), i + (k - 1))

    across = [_runs(F.col("w"), k, cross(k)) for k in range(2, most + 1)]
    return flat.select(F.explode(F.flatten(F.array(*across))).alias("feature"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all texts of docs: features of distinct lines times occurrences, crossing ones added."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    counted = lines.select("times", F.explode(runs(words(F.col("line")), most)).alias("feature"))
    if most > 1:
        counted = counted.unionByName(crossing_runs(texts, most).withColumn("times", F.lit(1).cast("long")))
    return counted.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.sum("times").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, gains: for every bucket 1000 times the log ratio of its smoothed shares in both, floored."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    zero = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    per = both.unionByName(zero).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # one row of a fixed number of buckets, in which the sums are taken as well
    row = per.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("b"), F.sum("s").alias("S"), F.sum("t").alias("T"))
    up, down = F.col("S") + buckets, F.col("T") + buckets
    return row.select(F.transform("b", lambda x: F.floor(F.log((x["t"] + 1).cast("double") * up / ((x["s"] + 1).cast("double") * down)) * 1000)).alias("gains"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of a document in thousandths, floored, fixed by the seed and its id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def scores(docs: DataFrame, gained: list[int], most: int = MOST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs; gained is one array literal of the plan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), runs(F.col("w"), most).alias("f"))
    gained_ = F.split(F.lit(",".join(map(str, gained))), ",").cast("array<long>")  # folded once, when the query is planned
    weight = F.aggregate("f", F.lit(0).cast("long"), lambda sum_, f: sum_ + F.get(gained_, bucket(f, buckets)))
    rows = rows.select("doc_id", "n_words", F.size("f").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for those not drawn.

    Null and empty texts have no features, weight 0 and are not drawn; a null doc_id counts as an empty
    one in the noise and comes last in ties; repeated rows are drawn one by one; further columns, of
    whatever names, and null texts of the target count for nothing; without documents there are no rows.
    The ranking is a range-partitioned sort of the scores, numbered by the parts' lengths.
    """
    gained = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets), buckets).first().gains
    rows = saved(scores(docs, gained, most, buckets, seed), "scores")
    long_ = rows.where(F.col("n_words") >= least)
    ordered, size = numbered(long_, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    drawn = size * percent // 100
    out = ordered.withColumn("rank", F.when(F.col("_number") < drawn, F.col("_number") + 1))
    short = rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    kept = ("doc_id", "n_features", "weight", "score", "rank")
    return out.select(*kept).unionByName(short.select(*kept))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH features AS (
  SELECT doc_id, FALSE AS target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL
  SELECT NULL, TRUE, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), distinct_words AS (
  SELECT f, hex(encode(f)) AS code FROM (SELECT DISTINCT f FROM features)
), bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(code) // 2), lambda i: ('0x' || code[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 10000 AS bucket
  FROM distinct_words
), placed AS (
  SELECT doc_id, target, bucket FROM features JOIN bucketed USING (f)
), per AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM placed GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM per
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM per, totals
), weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM placed JOIN gained USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id IS NOT DISTINCT FROM w.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM ranked
"""
