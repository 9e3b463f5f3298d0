"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: every node points at smaller ones, until
    the edges are stars. The rounds grow with the logarithm of the longest path. Each
    round is one table in the shared folder, so its lineage is short."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: neighbours above a node point at the least node of its neighbourhood.
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours of a node point at the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = materialise(small, "edges")
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(new.select(F.col("b"), F.col("b")).distinct())
        edges = new
