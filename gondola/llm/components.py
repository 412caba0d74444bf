"""Connected components by alternating large-star and small-star rounds.

Each round is two joins of the edges with the least neighbour of a node; the number
of rounds grows with the logarithm of the longest path, and ends as soon as the edges
are stars. A node of many edges is a hot key of joins that adaptive execution may
split, and its least neighbour is found by partial aggregation. Edges stay in tables;
only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.frames import cut, forget


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one at most, and none if it has one to a larger one; edges: distinct, a > b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return (nodes.agg(F.max(F.col("down") + F.col("up"))).first()[0] or 0) <= 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows node, component for every node that has an edge to another; component is the least node reached.

    Edges with a null end and loops are left out; repeated edges count once; no edges
    give no rows. Any column type with an order will do.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # as many rows as edges, repeated ones among them
        large = cut(both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")), "edges")
        kept = large.join(_least(large), "a")
        small = kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        after = cut(small, "edges")
        forget(now)
        forget(large)
        now = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
