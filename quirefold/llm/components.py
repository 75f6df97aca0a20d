"""Connected components by alternating large-star and small-star steps, each a shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import common


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v); the root is the least node of the component.

    Only edges move, and every round replaces them by at most as many. Minima are aggregated before the shuffle. A node with very many
    edges, the hub of a large component, has its minimum broadcast, so that its edges don't meet in one task.
    """
    edges = common.checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        n = before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = common.join_skewed(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = common.checkpoint(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = common.join_skewed(large, least, "u", "n", 2 * n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.checkpoint(small)
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
