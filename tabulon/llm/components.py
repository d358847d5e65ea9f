"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's neighbours (the larger ones, or the smaller ones) to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b), root the least node of its component. Each step is checkpointed; the number of steps grows with the logarithm of the nodes."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most):
        now = cut(_star(_star(now, True), False))
        new = tuple(now.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
