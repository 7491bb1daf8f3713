"""Merkle manifest of a dataset: every row a leaf, a tree of its own for each language, one over them.

Built levels are stored as parent-linked rows: a run of up to eight sibling nodes with their digests, and
the run and place in which their own digest stands.  A recursive query ascends from every leaf at once:
each step meets the run above, appends the siblings that it finds there, puts a leaf's digest so far at
its place and hashes, and takes the run's parent link along.  The leaves of one run have the same siblings
from there upward, so they ascend in one row, with a digest for each of them: a leaf costs 60 bytes a level
instead of 256.

A run high up has all leaves of a language below it.  Leaves are dealt to blocks of BLOCK, and a run is
stored once for each block below it (beyond four levels up that is one copy in BLOCK leaves), so that no
row of the join has more than BLOCK partners and a block's rows stay together all the way up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.llm.common import numbered, saved, table

#: Nodes of a run.
ARITY = 8
#: Leaves of a block: a power of ARITY.
BLOCK = ARITY**4
#: Levels of the tree over the languages are numbered from here.
TOP = 1000
#: Language tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Leaves with this remainder are tampered with.
TAMPERED = 3


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 bytes, colon, value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(of: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(of, 256))


def _hexed(digests: Column) -> Column:
    """The text that bytes of digests stand for in hashes."""
    return F.lower(F.hex(digests)).cast("binary")


def _leaf(text: Column) -> Column:
    return digest(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)).cast("binary"))


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed: a digest of each row, and the one after tampering (doc_ids whose
    crc32 TAMPERED divides; a null id is none)."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "lang", _leaf(F.col("text")).alias("leaf"), F.when(hit, _leaf(tampered(F.col("text")))).alias("changed"))
    return rows.withColumn("changed", F.coalesce("changed", "leaf"))


def build(nodes: DataFrame, top: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """(runs, tops) over nodes (tree, n, size, digest), n counting a tree's nodes from 0, size of them.

    runs: tree, size, level, n, members (digests one after another), digest; tops: tree and digest of the
    one node left.  A level is written before the next is built from it; trees of one node have no runs.
    """
    most, height, levels, tops = nodes.agg(F.max("size").alias("m")).first().m or 0, 0, [], []
    while True:
        tops.append(nodes.where(F.col("size") <= ARITY**height).select("tree", "digest"))
        if most <= ARITY**height:
            break
        run = nodes.where(F.col("size") > ARITY**height).groupBy("tree", "size", F.expr(f"n div {ARITY}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("m"))
        run = run.select("tree", "size", F.col("run").alias("n"), F.aggregate("m", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("members"))
        height += 1
        level = F.lit(height + (TOP if top else 0)).alias("level")
        levels.append(saved(run.select("tree", "size", level, "n", "members", digest(_hexed(F.col("members"))).alias("digest")), "level"))
        nodes = levels[-1]
    return reduce(DataFrame.unionByName, levels) if levels else None, reduce(DataFrame.unionByName, tops)


def _linked(runs: DataFrame | None, top: DataFrame | None, trees: DataFrame, number: int) -> DataFrame | None:
    """Parent-linked rows (tree, block, level, n, members, up_level, up_n, up_place) of all runs, once for
    each block of leaves below; up_level is null at the root.  trees: tree, size; number of them."""
    out = None
    if runs is not None:
        span = F.expr(f"power({ARITY}, level)").cast("long")  # leaves of a full run
        first, last = F.expr("n * span").alias("first"), F.least(F.expr("(n + 1) * span"), F.col("size")) - 1
        rows = runs.withColumn("span", span).select("*", first, last.alias("last"), (F.col("size") > F.col("span")).alias("inner"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))))
        out = rows.select("tree", "block", "level", "n", "members", *_up(F.col("inner"), F.col("level"), F.col("n"), F.col("tree"), number))
    if top is not None:
        blocks = trees.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {BLOCK}"))).alias("block"))
        rows = top.select(F.col("level"), F.col("n"), "members", F.expr(f"power({ARITY}, level - {TOP})").cast("long").alias("span"))
        rows = rows.select("*", F.explode(F.sequence(F.expr("n * span"), F.least(F.expr("(n + 1) * span"), F.lit(number)) - 1)).alias("tree")).join(blocks, "tree")
        inner = F.col("span") < number
        up = (F.when(inner, F.col("level") + 1).alias("up_level"), F.when(inner, F.expr(f"n div {ARITY}")).alias("up_n"), F.when(inner, F.expr(f"n % {ARITY}").cast("int")).alias("up_place"))
        rows = rows.select("tree", "block", "level", "n", "members", *up)
        out = rows if out is None else out.unionByName(rows)
    return out


def _up(inner: Column, level: Column, n: Column, tree: Column, number: int) -> tuple[Column, ...]:
    """Level, number and place of the run above: in the same tree, else in the tree over the languages."""
    over = F.lit(number > 1)
    at = F.when(inner, n).when(over, tree)
    return (
        F.when(inner, level + 1).when(over, F.lit(TOP + 1)).cast("int").alias("up_level"),
        F.floor(at / ARITY).cast("long").alias("up_n"), F.pmod(at, F.lit(ARITY)).cast("int").alias("up_place"),
    )


#: The climb: each leaf's digest so far takes its place among the members of the run above, the others are appended.
CLIMB = """
WITH RECURSIVE climb (tree, run, block, level, n, place, folded, siblings) AS (
  SELECT tree, run, block, up_level, up_n, up_place, folded, CAST('' AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.tree, c.run, c.block, r.up_level, r.up_n, r.up_place,
         transform(c.folded, x -> unhex(sha2(CAST(lower(hex(overlay(r.members PLACING x FROM c.place * 32 + 1 FOR 32))) AS BINARY), 256))),
         concat(c.siblings, overlay(r.members PLACING CAST('' AS BINARY) FROM c.place * 32 + 1 FOR 32))
  FROM climb c JOIN {runs} r ON c.tree = r.tree AND c.block = r.block AND c.level = r.level AND c.n = r.n
)
SELECT tree, run, folded, siblings FROM climb WHERE level IS NULL LIMIT ALL
"""


def leaf_runs(nodes: DataFrame) -> DataFrame:
    """tree, run, size, members, ids, folded: the leaves of each lowest run in order, their doc_ids, and the
    run's digest for each leaf with its changed digest in place (a lone leaf's own changed one)."""
    run = nodes.groupBy("tree", F.expr(f"n div {ARITY}").alias("run"), "size").agg(F.array_sort(F.collect_list(F.struct("n", "doc_id", "digest", "changed"))).alias("m"))
    run = run.withColumn("members", F.aggregate("m", F.lit(b""), lambda a, x: F.concat(a, x["digest"])))
    put = lambda x, i: F.when(F.col("size") > 1, digest(_hexed(F.overlay("members", x["changed"], (i * 32 + 1).cast("int"), F.lit(32))))).otherwise(x["changed"])
    return run.select("tree", "run", "size", "members", F.transform("m", lambda x: x["doc_id"]).alias("ids"), F.transform("m", put).alias("folded"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    A null in any column is hashed as `-`; a null language is a tree of its own and stands first; leaves
    of null doc_ids come last in their tree; repeated rows are leaves side by side; further columns, of
    whatever names, are not hashed; no rows give no rows; one row is its own root with an empty proof.
    """
    spark = docs.sparkSession
    hashed = saved(leaves(docs), "leaves")
    placed, _ = numbered(hashed, [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), "leaf"])
    trees = placed.groupBy("lang").agg(F.count("*").alias("size"), F.min("_number").alias("start"))
    trees = saved(trees.withColumn("tree", F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())).cast("long") - 1), "trees")  # a row a language
    number = trees.count()
    small = F.broadcast if number <= BROADCAST_ROWS else lambda df: df
    nodes = placed.join(small(trees.withColumnRenamed("lang", "_lang")), F.col("lang").eqNullSafe(F.col("_lang")))
    nodes = saved(nodes.select("doc_id", "tree", "size", (F.col("_number") - F.col("start")).alias("n"), F.col("leaf").alias("digest"), "changed"), "nodes")
    runs, tops = build(nodes.select("tree", "n", "size", "digest"))
    subroots = saved(tops, "subroots")
    over, root = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("n"), F.lit(number).cast("long").alias("size"), "digest"), top=True)
    root = root.select("digest").first()
    linked = _linked(runs.where("level > 1") if runs is not None else None, over, trees, number)  # the lowest runs are kept with their leaves
    empty = "tree long, block long, level int, n long, members binary, up_level int, up_n long, up_place int"
    linked = saved(linked, "runs") if linked is not None else spark.createDataFrame([], empty)
    low = saved(leaf_runs(nodes), "leaf-runs")
    # a tree's lowest runs are nodes like others above them; a lone leaf hangs in the tree over the languages
    start = low.select("tree", "run", F.expr(f"run div {BLOCK // ARITY}").alias("block"), "folded", *_up(F.col("size") > ARITY, F.lit(1), F.col("run"), F.col("tree"), number))
    climbed = spark.sql(CLIMB, leaves=start, runs=linked)
    rows = low.drop("folded").join(climbed, ["tree", "run"]).select("tree", "members", "siblings", F.posexplode(F.arrays_zip("ids", "folded")).alias("i", "x"))
    own = lambda with_: F.overlay("members", with_, (F.col("i") * 32 + 1).cast("int"), F.lit(32))
    rows = rows.select("tree", F.col("x.ids").alias("doc_id"), F.substring("members", F.col("i") * 32 + 1, F.lit(32)).alias("leaf"), F.sha2(_hexed(F.concat(own(F.lit(b"")), "siblings")), 256).alias("proof_sha256"), F.col("x.folded").alias("folded"))
    text = lambda c: F.lower(F.hex(c))
    out = rows.join(small(subroots.withColumnRenamed("digest", "subroot")), "tree").withColumn("root", F.lit(bytes(root.digest) if root else b""))
    return out.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof_sha256", text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 3 = 0, FALSE) AS hit
  FROM documents
), fields AS (
  SELECT doc_id, lang, hit, text,
    coalesce(len(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM ids
), leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, sha256(head || CASE WHEN hit THEN lowered ELSE body END) AS changed,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, sha256(head || body)) - 1 AS n
  FROM fields
), nodes AS (
  SELECT tree, 0 AS level, n, leaf AS h, count(*) OVER (PARTITION BY tree) AS left_ FROM leaves
  UNION ALL
  SELECT tree, level, n, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level + 1 AS level, n // 8 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM nodes WHERE left_ > 1 GROUP BY tree, level, n // 8)
), subroots AS (
  SELECT tree, h FROM nodes WHERE left_ = 1
), over_ AS (
  SELECT 1000 AS level, tree AS n, h, count(*) OVER () AS left_ FROM subroots
  UNION ALL
  SELECT level, n, h, count(*) OVER () FROM (SELECT level + 1 AS level, n // 8 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM over_ WHERE left_ > 1 GROUP BY level, n // 8)
), every AS (
  SELECT tree, level, n, h, left_ FROM nodes UNION ALL SELECT NULL, level, n, h, left_ FROM over_
), runs AS (
  SELECT tree, level, n // 8 AS run, list(h ORDER BY n) AS members FROM every WHERE left_ > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, leaf, l.tree, 0 AS level, l.n, changed AS folded, '' AS siblings, l.tree AS below FROM leaves l
  UNION ALL
  SELECT doc_id, leaf, c.tree, CASE WHEN r.members IS NULL THEN 1000 ELSE c.level + 1 END, CASE WHEN r.members IS NULL THEN c.tree ELSE c.n // 8 END,
    CASE WHEN r.members IS NULL THEN folded ELSE sha256(array_to_string(list_transform(r.members, lambda x, i: CASE WHEN i = c.n % 8 + 1 THEN folded ELSE x END), '')) END,
    CASE WHEN r.members IS NULL THEN siblings ELSE siblings || array_to_string(list_concat(r.members[1 : c.n % 8], r.members[c.n % 8 + 2 :]), '') END,
    CASE WHEN r.members IS NULL THEN NULL ELSE below END
  FROM climb c LEFT JOIN runs r ON r.tree IS NOT DISTINCT FROM c.below AND r.level = c.level AND r.run = c.n // 8
  WHERE r.members IS NOT NULL OR c.level < 1000
), top AS (
  SELECT doc_id, leaf, tree, folded, siblings, level, row_number() OVER (PARTITION BY doc_id, leaf, tree ORDER BY level DESC) AS k FROM climb
)
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = o.h AS verified
FROM top JOIN subroots s USING (tree), (SELECT h FROM over_ WHERE left_ = 1) o WHERE k = 1
"""
