"""Connected components of an edge list, in place on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import cut_lineage


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, or u itself if that is less."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the least node reachable), for every node of the bigint columns a and b of edges.

    Alternates large-star and small-star steps: each edge is replaced by one to the least node of its neighbourhood
    until nothing changes, which takes a number of rounds that grows with the logarithm of the longest chain. Every
    round is checkpointed; no component ever meets in one task.
    """
    a, b = F.col("a"), F.col("b")
    current = cut_lineage(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.filter("u <> v").distinct()
        star = _with_least(large)
        small = star.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            star.select("u", F.col("least").alias("v")))
        current = cut_lineage(small.filter("u <> v").distinct())
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
