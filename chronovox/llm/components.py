"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import forget, saved


def _small(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the smallest of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), two long columns; root is the smallest node that
    is reachable.  Each round is written to the shared folder; no row leaves the executors.

    Self links and repeated links change nothing; null ends are dropped; no links give no rows.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:  # a round shortens every way to a root, so that the marks meet in the end
        got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if got.n == 0 or (got.n, got.h) == mark:
            break
        mark = (got.n, got.h)
        before, edges = edges, saved(_small(_large(edges)), "links")
        forget(before)
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
