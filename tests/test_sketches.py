"""Sketches of parts against exact counts and against sketches of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from tallyreach.operators.sketches import (
    DISTINCT_ERROR,
    RANK_ERROR,
    column_sketches,
    merged,
    sketch_profile,
)
from tallyreach.operators.summaries import QUARTILES, column_profile

SCHEMA = "day int, number int, `odd.name` double, word string, gone bigint"


def made_up(spark, size=30_000):
    draw = random.Random(11)
    rows = [
        (
            i % 7,
            draw.choice([None, 0, draw.randint(-9000, 9000)]),
            draw.gauss(0, 5),
            draw.choice(["hot", f"w{draw.randint(0, 20_000)}"]),
            None,
        )
        for i in range(size)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(8, "word")


def test_merged_parts_are_within_the_bounds(spark):
    rows, frame = made_up(spark)
    parts = column_sketches(frame, ("day",))
    assert parts.count() == 7 * 4
    found = {r["column_name"]: r for r in sketch_profile(merged(parts)).collect()}
    exact = {r["column_name"]: r for r in column_profile(frame.drop("day")).collect()}
    assert found.keys() == exact.keys()
    for name, row in found.items():
        true = exact[name]
        assert (row["count"], row["null_percentage"]) == (true["count"], true["null_percentage"])
        off = abs(row["distinct_values"] - true["distinct_values"])
        assert off <= 4 * DISTINCT_ERROR * true["distinct_values"] + 1
    for at, (name, place) in enumerate((("number", 1), ("odd.name", 2))):
        values = sorted(r[place] for r in rows if r[place] is not None)
        row = found[name]
        assert (row["min"], row["max"]) == (values[0], values[-1])
        assert row["avg"] == pytest.approx(sum(values) / len(values))
        for quartile, fraction in QUARTILES.items():
            below = sum(v < row[quartile] for v in values) / len(values)
            up_to = sum(v <= row[quartile] for v in values) / len(values)
            assert below - 2 * RANK_ERROR <= fraction <= up_to + 2 * RANK_ERROR
    assert found["word"]["q50"] is None and found["gone"]["q50"] is None
    assert (found["gone"]["distinct_values"], found["gone"]["null_percentage"]) == (0, 100.0)


def test_merge_equals_the_whole(spark):
    """However parts are put together: exact in what is exact, and within the bound in distinct counts.

    (A sketch that saw all rows itself estimates by another formula than a merged one.)
    """
    _, frame = made_up(spark, 5_000)
    by_day = column_sketches(frame, ("day",))
    halves = merged(by_day.withColumn("half", F.col("day") % 2), ("half",))

    def profiled(sketches):
        return {r["column_name"]: r for r in sketch_profile(sketches).collect()}

    whole = profiled(column_sketches(frame.drop("day")))
    for found in map(profiled, (merged(by_day), merged(halves), merged(merged(halves, ("half",))))):
        assert found.keys() == whole.keys()
        for name, row in found.items():
            for exact in ("count", "null_percentage", "min", "max"):
                assert row[exact] == whole[name][exact]
            off = abs(row["distinct_values"] - whole[name]["distinct_values"])
            assert off <= 4 * DISTINCT_ERROR * whole[name]["distinct_values"]


def test_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert column_sketches(empty, ("day",)).count() == 0
    assert merged(column_sketches(empty, ("day",))).count() == 0
    rows = sketch_profile(column_sketches(empty)).collect()
    assert len(rows) == 5
    assert {(r["count"], r["distinct_values"], r["q50"], r["avg"]) for r in rows} == {(0, 0, None, None)}
    clash = spark.createDataFrame([(1, 2, "a")], "rows int, present int, day string")
    found = {r["column_name"]: r["max"] for r in sketch_profile(column_sketches(clash, ("day",))).collect()}
    assert found == {"rows": 1.0, "present": 2.0}
    with pytest.raises(ValueError, match="rows"):
        column_sketches(clash, ("rows",))
