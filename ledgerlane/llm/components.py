"""Connected components by alternating stars, as joins and groupings of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import staged


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours (u, v) with the least of the node and its neighbours, m."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being its least node.

    Large star: a node's larger neighbours point to its least one; small star: a node and its smaller
    neighbours do. Rounds, each written to the shared folder, go on until the edges stay the
    same: about the logarithm of the longest path."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct())
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large)
        now = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m"))).filter("u <> v").distinct(), "edges")
