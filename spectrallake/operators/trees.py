"""Sums over the subtrees of a forest, in as many rounds as the logarithm of its depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import forget, settled


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes(node, parent, *sums) -> node, *sums added up over the node's subtree, level (steps down to its deepest descendant).

    parent is null at roots. In round r each node gives what lies less than 2^r below it to its ancestor at distance 2^r,
    by an aggregation, and then looks up that ancestor's own one. Only nodes with an ancestor so far up go on.
    """
    nodes = settled(nodes.select("node", "parent", *sums, F.lit(0).cast("long").alias("level")), "nodes")
    parts, spent, step = [nodes.drop("parent")], [], 1
    alive = nodes.where("parent is not null").withColumnRenamed("parent", "up")
    while not alive.isEmpty():
        given = settled(alive.groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(c) for c in sums], (F.max("level") + step).alias("level")), "given")
        parts.append(given)
        farther = alive.select(F.col("node").alias("up"), F.col("up").alias("far"))
        more = given.select("node", *[F.col(c).alias(f"{c}_more") for c in [*sums, "level"]])
        both = alive.join(farther, "up").join(more, "node", "left")
        added = [(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums]
        alive = settled(both.select("node", F.col("far").alias("up"), *added, F.greatest("level", "level_more").alias("level")), "alive")
        spent.append(alive)
        step *= 2
    out = reduce(DataFrame.unionByName, parts).groupBy("node").agg(*[F.sum(c).alias(c) for c in sums], F.max("level").alias("level"))
    out = settled(out, "rolled-up")
    forget(*parts[1:], *spent)
    return out
