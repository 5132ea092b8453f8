"""Frequent categories, and everything else as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreach.functions.cleaning import blank_to_null

# How many categories are kept by default, and the name of all others.
TOP_CATEGORIES = 20
OTHER = "Other"


def named_category(category: Column, default: str) -> Column:
    """The trimmed category, or ``default`` where it is missing or blank."""
    return F.coalesce(blank_to_null(category), F.lit(default))


def top_categories(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """The ``k`` most frequent values with their row counts, ties in name order. k is at least 1."""
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("row_count"))
        .orderBy(F.col("row_count").desc(), F.col(column).asc_nulls_last())
        .limit(max(1, k))
    )


def with_category_group(
    df: DataFrame,
    column: str,
    group: str,
    k: int = TOP_CATEGORIES,
    other: str = OTHER,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``group``: the category where it is one of the ``k`` most frequent, else ``other``.

    Frequencies are those in ``counted``, by default ``df`` itself; give the table that ``df`` was
    derived from where that is cheaper to read.
    """
    top = top_categories(df if counted is None else counted, column, k)
    names = top.select(F.col(column).alias("_top_name"))
    return (
        df.join(names, F.col(column) == F.col("_top_name"), "left")
        .withColumn(group, F.coalesce(F.col("_top_name"), F.lit(other)))
        .drop("_top_name")
    )
