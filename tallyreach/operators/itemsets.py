"""Counting every combination of up to k feature values, with distinct entities behind each."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.sources.storage import scratch_table


def column_sets(columns: list[str], max_size: int) -> Column:
    """All sets of 1 to ``max_size`` columns, as arrays of column positions.

    The position of a set in this constant array is the set id used here.
    """
    sets = [
        f"array({', '.join(map(str, chosen))})"
        for size in range(1, max_size + 1)
        for chosen in combinations(range(len(columns)), size)
    ]
    return F.expr(f"array({', '.join(sets)})")


def _set_of_row(columns: list[str], max_size: int) -> Column:
    return F.get(column_sets(columns, max_size), F.col("set_id"))


def category_text(df: DataFrame, column: str) -> Column:
    """A feature value as text, yes or no for a flag; missing stays NULL."""
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return F.when(F.col(column), "yes").when(~F.col(column), "no")
    return F.col(column).cast("string")


def _combinations(
    df: DataFrame, columns: list[str], targets: list[str], entity: str | None
) -> DataFrame:
    """One row per entity and full feature combination."""
    texts = [category_text(df, name).alias(name) for name in columns]
    who = [] if entity is None else [entity]
    return (
        df.select(*texts, *[F.col(name) for name in who], *targets)
        .groupBy(*columns, *who)
        .agg(
            F.count("*").alias("_rows"),
            *[F.count_if(target).alias(f"_joint{i}") for i, target in enumerate(targets)],
        )
    )


def _by_entity(rows: DataFrame, entity: str | None) -> DataFrame:
    """``rows`` with those of an entity in one partition."""
    if entity is None:
        return rows
    # A fixed number of partitions: judged by their size before the sets are spread out, they
    # would be merged into far too few.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, entity)


def itemset_counts(
    df: DataFrame,
    columns: list[str],
    targets: list[str],
    max_size: int,
    entity: str | None = None,
) -> DataFrame:
    """Rows per column set and value combination.

    Result: ``set_id`` (see :func:`column_sets`), ``values`` (array of text, NULL where the
    feature is missing), ``antecedent_count``, and per target ``joint_<target>``; with ``entity``
    also ``entities`` and ``entities_<target>``, the distinct entities behind either.

    The table collapses to one row per entity and full feature combination before anything is
    multiplied by the number of sets, which also takes the weight off an entity that owns a third
    of all rows. From there on the rows stay with their entity: the sets are spread out and
    reduced to one row per entity and item inside the same stage, and only item totals shuffle.
    """
    combos = _by_entity(_combinations(df, columns, targets, entity), entity)
    who = [] if entity is None else [entity]
    sums = ["_rows", *[f"_joint{i}" for i in range(len(targets))]]
    item = ["set_id", *[f"value{place}" for place in range(max_size)]]
    # A position beyond the end of a set is NULL, and so is the value there.
    spread = combos.select(
        *who,
        *sums,
        F.array(*columns).alias("_texts"),
        F.posexplode(column_sets(columns, max_size)).alias("set_id", "_set"),
    ).select(
        *who,
        *sums,
        "set_id",
        *[
            F.get("_texts", F.get("_set", F.lit(place))).alias(f"value{place}")
            for place in range(max_size)
        ],
    )
    counted = _item_totals(spread, item, sums, targets, entity)
    return counted.select(
        "set_id",
        F.slice(F.array(*item[1:]), F.lit(1), set_size(columns, max_size)).alias("values"),
        F.col("_rows").alias("antecedent_count"),
        *[F.col(f"_joint{i}").alias(f"joint_{target}") for i, target in enumerate(targets)],
        *([] if entity is None else ["entities", *[f"entities_{target}" for target in targets]]),
    )


def frequent_itemset_counts(
    df: DataFrame,
    columns: list[str],
    targets: list[str],
    max_size: int,
    min_count: int,
    entity: str | None = None,
) -> DataFrame:
    """The rows of :func:`itemset_counts` with at least ``min_count`` rows behind them, found by levels.

    A set can't have more rows than one with a column less. So only sets that reached ``min_count`` are
    extended, by the columns after their last one, and a row is spread to the sets that are left
    to it in place of all. Frequent values and sets are numbered as they are found: a row carries the number of
    its set and those of the frequent values that may follow, and a longer set is two numbers, whatever its
    values. Frequent sets are at most as many as rows fit ``min_count`` times for each set of
    columns; whether they are broadcast is left to Spark.
    """
    combos = scratch_table(_combinations(df, columns, targets, entity), "combinations")
    sums = ["_rows", *[f"_joint{i}" for i in range(len(targets))]]
    who = [] if entity is None else [entity]
    singles = _by_entity(combos, entity).select(
        *who, *sums, F.posexplode(F.array(*columns)).alias("_place", "_value")
    )
    values = _frequent(singles, ["_place", "_value"], sums, targets, entity, min_count, 1)
    found = values.withColumns({"_places": F.array("_place"), "_values": F.array("_value")})
    levels = [found]
    if max_size > 1:
        spread = scratch_table(_spread_to_values(combos, columns, values, [*who, *sums]), "spread-1")
    for size in range(2, max_size + 1):
        following = F.posexplode("_later").alias("_at", "_code")
        last = spread.filter(F.size("_later") > 0)
        longer = _by_entity(last, entity).select(*who, *sums, "_set", following)
        level = _frequent(longer, ["_set", "_code"], sums, targets, entity, min_count, size)
        if size < max_size:
            after = F.slice("_later", F.col("_at") + 2, len(columns))
            extended = (
                last.select("*", following)
                .join(level.select("_set", "_code", "_number"), ["_set", "_code"])
                .select(*who, *sums, F.col("_number").alias("_set"), after.alias("_later"))
            )
            spread = scratch_table(extended, f"spread-{size}")
        before = found.select(F.col("_number").alias("_set"), "_places", "_values")
        added = values.select(F.col("_number").alias("_code"), "_place", "_value")
        found = (
            level.join(before, "_set")
            .join(added, "_code")
            .withColumns(
                {
                    "_places": F.array_append("_places", F.col("_place")),
                    "_values": F.array_append("_values", F.col("_value")),
                }
            )
        )
        levels.append(found)
    set_id = F.array_position(column_sets(columns, max_size), F.col("_places")) - 1
    return reduce(
        DataFrame.unionAll,
        [
            level.select(
                set_id.cast("int").alias("set_id"),
                F.col("_values").alias("values"),
                F.col("_rows").alias("antecedent_count"),
                *[F.col(f"_joint{i}").alias(f"joint_{target}") for i, target in enumerate(targets)],
                *([] if entity is None else ["entities", *[f"entities_{target}" for target in targets]]),
            )
            for level in levels
        ],
    )


def _spread_to_values(
    combos: DataFrame, columns: list[str], values: DataFrame, kept: list[str]
) -> DataFrame:
    """A row for each frequent value of a row: its number (_set), and those of later columns (_later)."""
    for place, name in enumerate(columns):
        known = values.filter(F.col("_place") == place).select(
            F.col("_value").alias("_known"), F.col("_number").alias(f"_code{place}")
        )
        combos = combos.join(known, F.col(name).eqNullSafe(F.col("_known")), "left").drop("_known")
    codes = F.array(*[f"_code{place}" for place in range(len(columns))])
    later = F.array_compact(F.slice("_codes", F.col("_at") + 2, len(columns)))
    return (
        combos.select(*kept, codes.alias("_codes"), F.posexplode(codes).alias("_at", "_set"))
        .filter(F.col("_set").isNotNull())
        .select(*kept, "_set", later.alias("_later"))
    )


def _frequent(
    spread: DataFrame,
    item: list[str],
    sums: list[str],
    targets: list[str],
    entity: str | None,
    min_count: int,
    size: int,
) -> DataFrame:
    """The items with at least ``min_count`` rows, stored with a number (_number) for each."""
    totals = _item_totals(spread, item, sums, targets, entity).filter(F.col("_rows") >= min_count)
    return scratch_table(totals.withColumn("_number", F.monotonically_increasing_id()), f"itemsets-{size}")


def _item_totals(
    spread: DataFrame, item: list[str], sums: list[str], targets: list[str], entity: str | None
) -> DataFrame:
    """Sums per item, with the distinct entities behind it."""
    totals = [F.sum(name).alias(name) for name in sums]
    if entity is not None:
        spread = spread.groupBy(entity, *item).agg(*totals)
        known = F.col(entity).isNotNull()
        totals.append(F.count_if(known).alias("entities"))
        for i, target in enumerate(targets):
            behind = known & (F.col(f"_joint{i}") > 0)
            totals.append(F.count_if(behind).alias(f"entities_{target}"))
    return spread.groupBy(*item).agg(*totals)


def set_size(columns: list[str], max_size: int) -> Column:
    return F.size(_set_of_row(columns, max_size))


def uses_column(columns: list[str], max_size: int, column: str) -> Column:
    """TRUE where the set of a row holds ``column``."""
    place = columns.index(column) if column in columns else -1
    return F.array_contains(_set_of_row(columns, max_size), place)


def antecedent_text(columns: list[str], max_size: int) -> Column:
    """``column=value AND column=value``, with ``missing`` for a missing value."""
    names = F.lit(list(columns))
    items = F.zip_with(
        _set_of_row(columns, max_size),
        F.col("values"),
        lambda place, value: F.concat(
            F.get(names, place), F.lit("="), F.coalesce(value, F.lit("missing"))
        ),
    )
    return F.array_join(items, " AND ")
