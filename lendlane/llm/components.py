"""Connected components of a distributed edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest one. Only the pairs move; no neighbour list is gathered."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    hung = both.where("b > a").join(least, "a")
    return hung.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (smallest node reachable) of every node in `edges` (`a`, `b`, longs) that is not the smallest.

    Loops (a = b) and rows with a NULL are left out. Each round is written to
    the shared folder; when a round changes nothing, all edges point to the smallest node.
    """
    given = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stored(given, "edges")
    before = mark(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
