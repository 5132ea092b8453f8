"""Stored layouts that spare later reads a shuffle, or most of a scan."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.functions.time import in_window, moment
from tallyreach.sources import storage

_KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)


@dataclass(frozen=True)
class Colocated:
    """A stored table by a key.

    ``even`` lies in buckets of the key, so joins and groupings by it need no shuffle with tables of as
    many buckets. ``heavy`` holds the rows of the keys in ``heavy_keys``, which hold more than a
    bucket's share each, and those without a key; it lies in any order. Fewer keys than there are buckets
    can be heavy, so their list is small, however large the table.
    """

    key: str
    buckets: int
    even: DataFrame
    heavy: DataFrame
    heavy_keys: tuple
    heavy_rows: int

    def keys_frame(self, spark: SparkSession) -> DataFrame:
        kind = self.even.schema[self.key].dataType
        return spark.createDataFrame([(key,) for key in self.heavy_keys], T.StructType([T.StructField(self.key, kind)]))


def colocate(df: DataFrame, path: str, key: str, buckets: int, made_from: dict | None = None) -> Colocated:
    """Replace the table at ``path`` by ``df``, stored by ``key`` (whole numbers or strings).

    ``df`` is read four times, so it should be stored: its keys twice, for their number and the frequent ones,
    its rows for the buckets and for the heavy keys. No task gets more of one key than a bucket's share.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, _KEY_TYPES):
        raise TypeError(f"{key} is neither a whole number nor a string")
    if buckets < 1:
        raise ValueError("there has to be a bucket")
    measured = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("keyless")).first()
    # At most `buckets` keys hold more than a bucket's share, so they are among as many of the most frequent.
    often = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("times"))
        .orderBy(F.col("times").desc(), "key")
        .limit(buckets)
        .collect()
    )
    share = max(1, measured["rows"] / buckets)
    heavy = {row["key"]: row["times"] for row in often if row["times"] > share}
    is_heavy = F.col(key).isNull() | F.col(key).isin(list(heavy))

    def write(target: str) -> None:
        name = f"colocated_{uuid.uuid4().hex}"
        even = df.filter(~is_heavy).repartition(buckets, key)
        writer = even.write.format("parquet").options(**storage.PARQUET_OPTIONS).option("path", f"{target}/even")
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        # An external table: its files stay.
        spark.sql(f"DROP TABLE {name}")
        df.filter(is_heavy).write.options(**storage.PARQUET_OPTIONS).parquet(f"{target}/heavy")
        measures = {
            "key": key,
            "buckets": buckets,
            "schema": df.schema.jsonValue(),
            "heavy_keys": sorted(heavy),
            "heavy_rows": measured["keyless"] + sum(heavy.values()),
        }
        storage.write_manifest(spark, target, {"made_from": made_from, "measures": measures})

    storage.replace_directory(spark, path, write)
    return open_colocated(spark, path)


def open_colocated(spark: SparkSession, path: str) -> Colocated:
    """The table that :func:`colocate` wrote to ``path``, in this session or another."""
    stored = storage.read_manifest(spark, path).get("measures", {})
    if "heavy_keys" not in stored:
        raise FileNotFoundError(f"no table by key at {path}")
    schema, key, buckets = T.StructType.fromJson(stored["schema"]), stored["key"], stored["buckets"]
    name = f"colocated_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    place = f"{path}/even".replace("\\", "\\\\").replace("'", "\\'")
    quoted = "`" + key.replace("`", "``") + "`"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet "
        f"CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    heavy = spark.read.schema(schema).parquet(f"{path}/heavy")
    return Colocated(key, buckets, spark.table(name), heavy, tuple(stored["heavy_keys"]), stored["heavy_rows"])


def materialise_colocated(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    key: str,
    buckets: int,
    made_from: dict,
    force: bool = False,
) -> Colocated:
    """The table by key at ``path``, built first where it is absent or was made from other things."""
    made_from = {**made_from, "layout": [key, buckets]}
    if force or storage.read_manifest(spark, path).get("made_from") != made_from:
        return colocate(build(), path, key, buckets, made_from)
    return open_colocated(spark, path)


#: Partition column of tables by month: months since the year 0, NULL for rows without a time.
MONTH = "month_number"


def month_number(time: Column) -> Column:
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def with_month(df: DataFrame, time: str, *others: str) -> DataFrame:
    """``df`` with its month, dealt for a write in a partition for each month (and each value of ``others``).

    Spark splits the rows of a large month over several tasks and lets small ones share a task.
    """
    return df.withColumn(MONTH, month_number(F.col(time))).hint("rebalance", *others, MONTH)


def in_months(start: str, end: str) -> Column:
    """TRUE in the months that ``[start, end)`` touches."""
    first, last = (datetime.fromisoformat(value) for value in (start, end))
    return F.col(MONTH).between(first.year * 12 + first.month - 1, last.year * 12 + last.month - 1)


def write_by_month(df: DataFrame, path: str, time: str) -> None:
    """Replace the table at ``path`` by ``df`` in a partition for each month of ``time``."""
    storage.write_parquet(with_month(df, time), path, (MONTH,))


def read_window(spark: SparkSession, path: str, time: str, start: str, end: str) -> DataFrame:
    """Rows of a table by month with ``start <= time < end``; files of other months aren't opened."""
    rows = spark.read.parquet(path).filter(in_months(start, end))
    return rows.filter(in_window(F.col(time), moment(start), moment(end))).drop(MONTH)
