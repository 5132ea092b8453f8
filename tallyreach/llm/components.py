"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreach.sources.storage import scratch_table


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node points to one other that points to none."""
    if not edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(roots, "a", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (columns a, b).

    Large-star and small-star steps take turns until every node points to the smallest of its component;
    each is a grouping that combines before it shuffles and a join that Spark can split. Every step's
    edges are stored.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = scratch_table(edges.distinct(), "edges")
    while not _is_settled(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch_table(
            both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest"
        )
        large = scratch_table(
            both.join(lowest, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "large",
        )
        below = scratch_table(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = (
            large.join(below, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(below.select("a", F.col("m").alias("b")))
        )
        edges = scratch_table(small.distinct(), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
