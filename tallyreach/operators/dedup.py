"""One row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key by ``order``, missing values last.

    The remaining columns break ties, so the row kept does not depend on how the input is split.
    They must be sortable. Because only rank 1 is wanted, Spark cuts every map-side group to one
    row before the shuffle: a key that holds a third of the table sends one row per map task.
    """
    ties = [name for name in df.columns if name not in keys and name not in order]
    ranked = Window.partitionBy(*keys).orderBy(
        *[F.col(name).asc_nulls_last() for name in [*order, *ties]]
    )
    return (
        df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
    )
