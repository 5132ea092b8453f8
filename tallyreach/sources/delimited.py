"""Header-less, unquoted delimited text: good lines become typed rows, bad lines are kept apart.

Lines are read as text and cut here, because Spark's CSV reader pads or truncates lines with a
wrong number of fields, drops lines that consist of delimiters only, and knows a single null token.
Without quoting a line is a record, so files of any size stay splittable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.functions.cleaning import null_tokens
from tallyreach.sources.specs import TableSpec

REJECT_FIELDS = (
    ("source_file", T.StringType()),
    ("raw_line", T.StringType()),
    ("field_count", T.IntegerType()),
    ("expected_count", T.IntegerType()),
    ("error_type", T.StringType()),
)


# monotonically_increasing_id has the partition above, the row within it below this bit.
_PLACE_BITS = 33


def read_lines(spark: SparkSession, paths: list[str], numbered: bool = False) -> DataFrame:
    """All lines of all files as ``value``, with the ``source_file`` each came from.

    A line ends at a newline; a carriage return before it is dropped, any other one is data. Lines that
    are to be ``numbered`` have two more columns, for :func:`line_shifts`: where the split of the file that
    they are in begins, and their place among all lines that a task reads.
    """
    line = F.col("value")
    bare = F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)
    place = [
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    ]
    return spark.read.option("lineSep", "\n").text(paths).select(
        bare.alias("value"), F.col("_metadata.file_path").alias("source_file"), *(place if numbered else [])
    )


def line_shifts(lines: DataFrame) -> DataFrame:
    """source_file, split and what to add to the ``place`` of a line of the split to get its number.

    A task reads the lines of a split one after the other. So a line's number is its distance from the
    first line of its split, and the lines of the splits of its file before that: a row for each split.
    """
    before = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("source_file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return splits.select(
        "source_file",
        "split",
        F.shiftright("first", _PLACE_BITS).alias("task"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"),
    )


def split_lines(lines: DataFrame, delimiter: str) -> DataFrame:
    """Cut every line at ``delimiter`` into ``fields``. Empty lines are not records."""
    return lines.filter(F.col("value") != "").withColumn(
        "fields", F.split("value", re.escape(delimiter), -1)
    )


def parse(lines: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """Well-formed lines as raw text columns, null tokens as NULL.

    A line is well formed when it is valid UTF-8 and has the expected number of fields.
    """
    return (
        split_lines(lines, delimiter)
        .filter(_well_formed(F.size("fields"), len(names)))
        .select(
            *[null_tokens(F.get("fields", F.lit(i))).alias(name) for i, name in enumerate(names)],
            "source_file",
        )
    )


def rejects(lines: DataFrame, expected: int, delimiter: str) -> DataFrame:
    """All other lines, whole, and what is wrong with them. None is dropped.

    Numbered lines also have their number in their file as ``line``, from 1; empty lines count.
    """
    numbered = "place" in lines.columns
    bad = (
        lines.filter(F.col("value") != "")
        .withColumn("field_count", F.size(F.split("value", re.escape(delimiter), -1)))
        .filter(~_well_formed(F.col("field_count"), expected))
        .select(
            "source_file",
            F.make_valid_utf8("value").alias("raw_line"),
            "field_count",
            F.lit(expected).alias("expected_count"),
            _error_type(F.col("field_count"), expected).alias("error_type"),
            *(["split", "place"] if numbered else []),
        )
    )
    if not numbered:
        return bad
    # Both sides read the files; that they cut them alike is checked, not assumed.
    same_cut = F.col("task") == F.shiftright("place", _PLACE_BITS)
    line = F.when(same_cut, F.col("place") + F.col("shift")).otherwise(
        F.raise_error(F.lit("the files were cut differently when their lines were counted")).cast("bigint")
    )
    return (
        bad.join(line_shifts(lines), ["source_file", "split"], "left")
        .withColumn("line", line)
        .drop("split", "place", "task", "shift")
    )


def _well_formed(count: Column, expected: int) -> Column:
    return (count == expected) & F.is_valid_utf8("value")


def _error_type(count: Column, expected: int) -> Column:
    return (
        F.when(~F.is_valid_utf8("value"), "INVALID ENCODING")
        .when(count < expected, "MISSING COLUMNS")
        .otherwise("TOO MANY COLUMNS")
    )


def typed(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Raw text columns as the typed, flagged columns of the clean table."""
    columns = [part for field in spec.fields for part in field.columns(F.col(field.name))]
    kept = [name for name in raw.columns if name not in {field.name for field in spec.fields}]
    values = raw.select(*columns, *kept)
    return values.select("*", *spec.flags())


def clean_table(lines: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """The clean rows and the rejected lines of one raw table."""
    names = [field.name for field in spec.fields]
    good = typed(parse(lines, names, spec.delimiter), spec)
    return good, rejects(lines, len(names), spec.delimiter)


def sorted_out(lines: DataFrame, spec: TableSpec) -> DataFrame:
    """Clean and rejected rows in one table, told apart by ``rejected`` (0 or 1).

    Meant to be written partitioned by ``rejected``: the raw text, the largest input of all, is
    then read once for both.
    """
    names = [field.name for field in spec.fields]
    fields = F.col("fields")
    matches = _well_formed(F.size(fields), len(names))
    raw = split_lines(lines, spec.delimiter).select(
        *[
            F.when(matches, null_tokens(F.get(fields, F.lit(i)))).alias(name)
            for i, name in enumerate(names)
        ],
        "source_file",
        F.when(~matches, F.make_valid_utf8("value")).alias("raw_line"),
        F.when(~matches, F.size(fields)).alias("field_count"),
        F.when(~matches, F.lit(len(names))).alias("expected_count"),
        F.when(~matches, _error_type(F.size(fields), len(names))).alias("error_type"),
        F.when(matches, 0).otherwise(1).alias("rejected"),
    )
    return typed(raw, spec)
