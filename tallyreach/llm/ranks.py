"""Numbering the rows of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreach.sources.storage import scratch_table

PLACE_BITS = 33


def group_of(key: Column) -> Column:
    """A text for each key, never NULL, that sorts as texts do, NULL first."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key.cast("string")))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``rank`` within ``grp`` by ``order`` from 0, and the ``size`` of the group.

    Partitions of the whole order are sorted one by one; what comes before a partition is told by a
    table of a row for each partition and group that meet.
    """
    placed = (
        rows.repartitionByRange("grp", *order)
        .sortWithinPartitions("grp", *order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    placed = scratch_table(placed, name)
    part = F.shiftright("place", PLACE_BITS)
    runs = placed.groupBy("grp", part.alias("part")).agg(
        F.count("*").alias("n"), F.min("place").alias("lowest")
    )
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "grp",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lowest")).alias("shift"),
        F.sum("n").over(Window.partitionBy("grp")).alias("size"),
    )
    starts = scratch_table(starts, f"{name}-starts")
    return (
        placed.withColumn("part", part)
        .join(starts, ["grp", "part"])
        .withColumn("rank", F.col("place") + F.col("shift"))
        .drop("place", "part", "shift")
    )
