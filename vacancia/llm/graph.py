"""Connected components of an edge list, by alternating stars; nothing of the graph leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of `edges`; a component is named by its least node.

    Each round points every node at the least node of its neighbourhood, first from larger neighbours,
    then from smaller; the depth falls by about half, so rounds grow with the log of the diameter. It ends
    when a round changes nothing.
    """
    now = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    while True:
        both = now.unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(low, "x")
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).unionAll(low.select("x", F.col("m").alias("y"))).where("x != y").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.hash("x", "y").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("y").alias("node"), F.col("y").alias("component"))
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionAll(roots).distinct()
