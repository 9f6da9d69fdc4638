"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges from which the least neighbours are written before they are joined: then only exchanges stand before the join, and adaptive
#: execution can split the rows of a hub. Fewer edges fit a task whatever their hubs are.
SPLIT = 1 << 20


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, split: int = SPLIT) -> DataFrame:
    """edges (a long, b long) -> (node, root): the smallest node reachable from each node that an edge names.

    Every step replaces edges by as many or fewer, so nothing grows with the square of a group; rows are pairs of longs, and a hub's
    smallest neighbour is found by a partial aggregation, its rows being split over tasks (see ``SPLIT``). The number of steps grows with
    the logarithm of the longest path."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.write(pairs)
    mark = _mark(now)
    for _ in range(rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        apart = scratch.write if mark[0] > split else lambda df: df
        low = apart(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = apart(large)
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.where("u <> v").distinct())
        mark_after = _mark(after)
        for old in (now, low, large, least):
            scratch.drop(old)
        now = after
        if mark_after == mark:
            break
        mark = mark_after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells whether two sets of edges differ."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
