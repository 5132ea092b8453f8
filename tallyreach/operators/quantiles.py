"""Exact quantiles without sorting, sketching or holding a column anywhere.

Values are counted by bucket, first on a logarithmic scale, with the smallest and the largest value of
each bucket. The bucket that holds a wanted rank is found from the counts, and is cut into finer
buckets by the next pass, until it holds a single value. Buckets are counted before they shuffle, so
every pass moves a bounded number of rows, whatever the size of the table, and no rank can be missed.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Buckets in a factor of two of the first pass, and buckets that later passes cut one into.
STEPS_PER_OCTAVE = 64
BUCKETS = 4096


@dataclass(frozen=True)
class Quantile:
    """One wanted value: ``name`` of the result column, source ``column``, and ``fraction``.

    ``interpolate`` asks for the value between two ranks, as opposed to the nearest rank, an
    element of the data. ``above`` restricts the rows to larger values.
    """

    name: str
    column: str
    fraction: float
    interpolate: bool = False
    above: float | None = None


@dataclass(frozen=True)
class _Bucket:
    """Rows of a source from ``low`` to ``high``; ``before`` rows of it are smaller."""

    low: object
    high: object
    before: int
    rows: int


def exact_quantiles(df: DataFrame, wanted: list[Quantile]) -> DataFrame:
    """A single row with one column per wanted quantile, NULL where no row qualifies.

    An element of an integer column is a bigint, all else a double. Missing values do not count; NaN
    is larger than all numbers. Runs when called: mostly two or three passes over the named columns,
    each for all quantiles at once, that bring back a few thousand rows.
    """
    sources = list(dict.fromkeys((one.column, one.above) for one in wanted))
    values = [_value(df, column, above) for column, above in sources]
    first = _counted(df, [(number, value, None) for number, value in enumerate(values)])
    totals = [sum(bucket.rows for bucket in buckets) for buckets in first]
    # The buckets that hold the rank that is looked for, by source and rank.
    held: dict[tuple[int, int], _Bucket] = {}
    for one in wanted:
        number = sources.index((one.column, one.above))
        for rank in _ranks(one, totals[number])[0]:
            held[number, rank] = _holding(first[number], rank)
    while wide := [bucket for bucket in dict.fromkeys((n, b) for (n, _), b in held.items()) if _open(bucket[1])]:
        parts = [(number, bucket, _inside(values[number], bucket)) for number, bucket in wide]
        cuts = [(number, value, _cut(value, bucket)) for number, bucket, value in parts]
        finer = dict(zip(wide, _counted(df, cuts, [bucket.before for _, bucket in wide])))
        for (number, rank), bucket in held.items():
            if (number, bucket) in finer:
                held[number, rank] = _holding(finer[number, bucket], rank)
    results = []
    for one in wanted:
        number = sources.index((one.column, one.above))
        ranks, share = _ranks(one, totals[number])
        found = [held[number, rank].low for rank in ranks]
        results.append(_between(found, share) if one.interpolate else next(iter(found), None))
    kinds = [
        "bigint" if _is_whole(df, one.column) and not one.interpolate else "double" for one in wanted
    ]
    row = df.sparkSession.range(1)
    return row.select(
        *[F.lit(value).cast(kind).alias(one.name) for value, kind, one in zip(results, kinds, wanted)]
    )


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _value(df: DataFrame, column: str, above: float | None) -> Column:
    value = F.col("`" + column.replace("`", "``") + "`").cast("bigint" if _is_whole(df, column) else "double")
    return value if above is None else F.when(value > above, value)


def _scale(value: Column) -> Column:
    """A number that never falls when the value rises, the same for values that are near each other."""
    size = F.log2(F.abs(value.cast("double")) + 1) * STEPS_PER_OCTAVE
    step = F.when(size < 1 << 20, F.ceil(size)).otherwise(1 << 20)
    return F.when(value < 0, -step).otherwise(step)


def _open(bucket: _Bucket) -> bool:
    return bucket.low != bucket.high and bucket.low == bucket.low


def _inside(value: Column, bucket: _Bucket) -> Column:
    return F.when((value >= F.lit(bucket.low)) & (value <= F.lit(bucket.high)), value)


def _cut(value: Column, bucket: _Bucket) -> Column:
    """Like :func:`_scale`, but finer. The ends of the bucket always come apart."""
    low, high = bucket.low, bucket.high
    if not (isfinite(low) and isfinite(high) and isfinite(float(high) - float(low))):
        return F.when(value == F.lit(low), 0).when(value == F.lit(high), 2).otherwise(1)
    if isinstance(low, int):
        if high - low < BUCKETS:
            return value - low
        share = (value.cast("decimal(38,0)") - low).cast("double") / float(high - low)
    else:
        share = (value - low) / (high - low)
    ends = F.when(value == F.lit(high), BUCKETS).when(value == F.lit(low), -1)
    return ends.otherwise(F.floor(share * BUCKETS))


def _counted(
    df: DataFrame, cuts: list[tuple[int, Column, Column | None]], before: list[int] | None = None
) -> list[list[_Bucket]]:
    """The buckets of each cut in ascending order, by its steps or else by :func:`_scale`. Whole numbers stay whole."""
    kinds = [_kind(df, value) for _, value, _ in cuts]
    tagged = [
        F.struct(
            F.lit(at).alias("cut"),
            (F.lit(None) if step is None else step).cast("bigint").alias("step"),
            (value if kind == "bigint" else F.lit(None).cast("bigint")).alias("whole"),
            (value if kind == "double" else F.lit(None).cast("double")).alias("real"),
        )
        for at, ((_, value, step), kind) in enumerate(zip(cuts, kinds))
    ]
    spread = (
        df.select(F.explode(F.array(*tagged)).alias("at"))
        .select("at.*")
        .filter(F.col("whole").isNotNull() | F.col("real").isNotNull())
    )
    if any(step is None for _, _, step in cuts):
        # Once for all columns: scales of twenty, side by side in a row, are more code than the JVM compiles.
        scale = _scale(F.coalesce("real", F.col("whole").cast("double"))).cast("bigint")
        spread = spread.withColumn("step", F.coalesce("step", scale))
    rows = (
        spread.groupBy("cut", "step")
        .agg(
            F.count("*").alias("rows"),
            *[f(c).alias(f"{n}_{c}") for c in ("whole", "real") for n, f in (("low", F.min), ("high", F.max))],
        )
        .collect()
    )
    result: list[list[_Bucket]] = [[] for _ in cuts]
    passed = list(before or [0] * len(cuts))
    for row in sorted(rows, key=lambda r: (r["cut"], r["step"])):
        at = row["cut"]
        column = "whole" if kinds[at] == "bigint" else "real"
        result[at].append(
            _Bucket(row[f"low_{column}"], row[f"high_{column}"], passed[at], row["rows"])
        )
        passed[at] += row["rows"]
    return result


def _kind(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("value")).schema["value"].dataType.simpleString()


def _holding(buckets: list[_Bucket], rank: int) -> _Bucket:
    return next(bucket for bucket in buckets if rank <= bucket.before + bucket.rows)


def _ranks(one: Quantile, rows: int) -> tuple[list[int], float]:
    """The ranks (from 1) that the quantile lies on or between, and how far it is from the first."""
    if not rows:
        return [], 0.0
    if not one.interpolate:
        return [max(1, ceil(Fraction(str(one.fraction)) * rows))], 0.0
    position = (rows - 1) * one.fraction
    lower, upper = floor(position), ceil(position)
    return ([lower + 1] if lower == upper else [lower + 1, upper + 1]), position - lower


def _between(found: list, share: float) -> float | None:
    """The value itself where both ranks have the same, else one that lies between them."""
    if not found:
        return None
    low, high = float(found[0]), float(found[-1])
    if low == high:
        return low
    return min(max(low + (high - low) * share, low), high)
