"""How many rows of a table passed the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_row(
    clean: DataFrame, name: str, timestamp_flag: str | None, rejected: Column
) -> DataFrame:
    """One row: rows, invalid identifiers, invalid times (NULL without a flag), rejects."""
    invalid_times = (
        F.lit(None).cast("bigint")
        if timestamp_flag is None
        else F.count_if(~F.col(timestamp_flag))
    )
    return clean.agg(
        F.count("*").alias("row_count"),
        F.count_if(~F.col("identifier_is_valid")).alias("invalid_identifier_rows"),
        invalid_times.alias("invalid_timestamp_rows"),
    ).select(
        F.lit(name).alias("table"),
        "row_count",
        "invalid_identifier_rows",
        "invalid_timestamp_rows",
        rejected.cast("bigint").alias("rejected_csv_rows"),
    )


def quality_measures(timestamp_flag: str | None) -> dict[str, Column]:
    """The same counts as aggregates of clean and rejected rows in one table, told apart by ``rejected``.

    For taking them while the table is written.
    """
    clean = F.col("rejected") == 0
    measures = {
        "row_count": F.count_if(clean),
        "invalid_identifier_rows": F.count_if(clean & ~F.col("identifier_is_valid")),
        "rejected_csv_rows": F.count_if(~clean),
    }
    if timestamp_flag is not None:
        measures["invalid_timestamp_rows"] = F.count_if(clean & ~F.col(timestamp_flag))
    return measures


def reject_count(rejects: DataFrame) -> DataFrame:
    """Number of rejected lines, whatever is wrong with each: distinct (file, line) where lines have numbers."""
    if "line" in rejects.columns:
        rejects = rejects.select("source_file", "line").distinct()
    return rejects.agg(F.count("*").alias("rejected_csv_rows"))
