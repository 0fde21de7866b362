"""Connected components of an edge table by alternating large and small stars.

Only joins and aggregates by node; no group is collected, and every round is written, so a
lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.stage import materialize


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of every node, or the node itself if that is less."""
    return edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component."""
    held = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "star")
    mark = None
    while True:
        # large star: every larger neighbour of a node goes to the least one
        both = materialize(held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))), "star-both")
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = materialize(large.filter("a != b").distinct(), "star-large")
        # small star: the smaller neighbours of a node, and the node, go to the least one
        near = large.join(_least(large), "a")
        small = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(near.select("a", F.col("least").alias("b")))
        held = materialize(small.filter("a != b").distinct(), "star")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
