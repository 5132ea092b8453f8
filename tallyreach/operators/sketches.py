"""Approximate column profiles from sketches that are kept per part of a table and merged.

A table that grows by days or files is profiled part by part, once; the profile of any choice of parts
is a merge of a few kilobytes a column, and reads no rows. The exact form is ``summaries.column_profile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.operators.summaries import QUARTILES, named

#: 2^14 registers: distinct counts have a standard error of 0.65 %.
DISTINCT_BITS = 14
DISTINCT_ERROR = 0.83 / 2 ** (DISTINCT_BITS / 2)
#: Quantiles are off by 0.55 % of all ranks at most, 99 times of 100.
RANK_SIZE = 800
RANK_ERROR = 2.296 / RANK_SIZE**0.9021

MEASURES = ("column_name", "rows", "present", "total", "distinct_sketch", "number_sketch")


def column_sketches(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each column and value of ``by`` (all rows are one part without it).

    Has ``rows``, ``present`` values, and of numbers their ``total`` and ranks (NaN has none), of all
    columns their distinct values as text. One grouping that combines before it shuffles. A part of
    NULLs has empty sketches; a table without rows has no parts, or a single empty one without ``by``.
    """
    _check(by)
    fields = [field for field in df.schema.fields if field.name not in by]
    numbers = {field.name for field in fields if isinstance(field.dataType, T.NumericType)}
    kept = df.select(*[named(name) for name in by], *[named(field.name) for field in fields])
    measures = [F.count("*").alias("rows of all")]
    for number, field in enumerate(fields):
        column = named(field.name)
        measures += [
            F.count(column).alias(f"present {number}"),
            F.hll_sketch_agg(column.cast("string"), DISTINCT_BITS).alias(f"distinct {number}"),
        ]
        if field.name in numbers:
            value = column.cast("double")
            measures += [
                F.sum(value).alias(f"total {number}"),
                F.kll_sketch_agg_double(value, RANK_SIZE).alias(f"ranks {number}"),
            ]

    def row(number: int, name: str) -> Column:
        def of_numbers(measure: str, kind: str) -> Column:
            return F.col(f"{measure} {number}") if name in numbers else F.lit(None).cast(kind)

        return F.struct(
            F.lit(name).alias("column_name"),
            F.col("rows of all").alias("rows"),
            F.col(f"present {number}").alias("present"),
            of_numbers("total", "double").alias("total"),
            F.col(f"distinct {number}").alias("distinct_sketch"),
            of_numbers("ranks", "binary").alias("number_sketch"),
        )

    rows = F.array(*[row(number, field.name) for number, field in enumerate(fields)])
    grouped = kept.groupBy(*[named(name) for name in by]).agg(*measures)
    return grouped.select(*[named(name) for name in by], F.inline(rows))


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of parts as those of larger parts: of each value of ``by``, or of all."""
    _check(by)
    return sketches.groupBy(*[named(name) for name in by], "column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("number_sketch", RANK_SIZE).alias("number_sketch"),
    )


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """What the sketches say, in the columns of the exact profile.

    ``min``, ``max`` (of numbers), ``avg``, ``count`` and ``null_percentage`` are exact but for the
    rounding of sums; ``distinct_values`` and quartiles are as near as DISTINCT_ERROR and RANK_ERROR say.
    """
    ranked = F.col("number_sketch").isNotNull()
    # A sketch without values has no quantiles to ask for.
    filled = F.when(ranked, F.kll_sketch_get_n_double("number_sketch") > 0).otherwise(False)

    def quantile(fraction: float) -> Column:
        return F.when(filled, F.kll_sketch_get_quantile_double("number_sketch", F.lit(fraction)))

    kept = [name for name in sketches.columns if name not in MEASURES]
    return sketches.select(
        *[named(name) for name in kept],
        "column_name",
        quantile(0.0).alias("min"),
        quantile(1.0).alias("max"),
        F.try_divide("total", "present").alias("avg"),
        *[quantile(fraction).alias(at) for at, fraction in QUARTILES.items()],
        F.col("rows").alias("count"),
        F.round(F.try_divide((F.col("rows") - F.col("present")) * 100.0, "rows"), 2).alias("null_percentage"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
    )


def _check(by: tuple[str, ...]) -> None:
    clash = sorted(set(by) & set(MEASURES))
    if clash:
        raise ValueError(f"parts can't be told apart by columns of these names: {clash}")
