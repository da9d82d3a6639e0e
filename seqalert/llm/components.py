"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqalert.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``, both long).

    Each round lets every node point at its smallest neighbour, follows the pointers to their ends by doubling, and
    contracts the graph to those ends; it ends when no edge is left, after a number of rounds logarithmic in the number of
    nodes. Every step is a join or a grouping that combines before it shuffles; a star's centre is a skewed join key, which
    adaptive execution splits. Edges with a null end are ignored; no edges give an empty table."""
    pairs = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    loops = nodes.select("node", F.col("node").alias("component")).distinct()
    label = None
    both = cut(_both(pairs))
    while not both.isEmpty():
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            twice = up.join(above, "up").select("node", F.col("top").alias("up"))
            jumped = cut(twice.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = up.select("node", F.col("up").alias("component"))
        else:
            ends = up.select(F.col("node").alias("component"), "up")
            label = label.join(ends, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        label = cut(label)
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        moved = both.where("a < b").join(a, "a").join(b, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        both = cut(_both(moved))
    if label is None:
        return loops
    return loops.join(label.withColumnRenamed("component", "c"), "node", "left").select("node", F.coalesce("c", "component").alias("component"))


def _both(pairs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(ends).select("e.a", "e.b")
