"""Connected components by alternating large-star and small-star, on edges that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, saved


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every greater neighbour of a node goes to the node's least neighbour; also the table of least neighbours.

    That table is saved first, so that the join has plain exchanges on both sides and a hub's edges can be split.
    """
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b"), least


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every smaller neighbour of a node, and the node, goes to the least of them; also the table of those."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct(), least


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


def connected(edges: DataFrame) -> DataFrame:
    """A saved table (node, component) for every node of edges (a, b): the smallest node that it can reach.

    Self-loops give nothing; nodes without other edges are not returned. Ids must not be null.
    """
    e = saved(edges.select("a", "b").where("a != b"))
    before = _state(e)
    while before[0]:
        large, one = _large_star(e)
        large = saved(large)
        small, two = _small_star(large)
        small = saved(small)
        discard(e, one, large, two)
        e, now = small, _state(small)
        if now == before:
            break
        before = now
    out = saved(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
    discard(e)
    return out
