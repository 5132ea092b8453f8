"""Tables on stores that can't rename directories: versions side by side, and a note that names the newest.

A version is a directory of its own below the table. It counts from the moment its note is there, a small
file of the next number that is written last. Nothing is renamed or overwritten, so a reader sees a whole
version at any time, also while a writer works or after it was lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyreach.sources import storage

NOTES = "_versions"
#: Versions that stay when a new one is published: the newest, and the one that readers may be in.
KEPT = 2


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kept: int = KEPT) -> int:
    """Write ``df`` as the next version of the table at ``path``, and return the version's number.

    ``df`` may read the table itself. Of two writers that start from one version the second fails and
    leaves the table as the first one made it. Older versions than the ``kept`` newest are deleted.
    """
    if kept < 1:
        raise ValueError("the newest version has to stay")
    spark = df.sparkSession
    # Notes that a lost writer left half written have numbers too; those are not used again.
    number = max(_numbers(spark, path), default=0) + 1
    directory = f"data-{uuid.uuid4().hex}"
    writer = df.write.options(**storage.PARQUET_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(f"{path}/{directory}")
        _note(spark, path, number, directory)
    except BaseException:
        if _directory(spark, path, number) != directory:
            storage.delete(spark, f"{path}/{directory}")
        raise
    _forget(spark, path, kept)
    return number


def newest(spark: SparkSession, path: str) -> str:
    """The directory that holds the newest version."""
    for number in sorted(_numbers(spark, path), reverse=True):
        directory = _directory(spark, path, number)
        if directory is not None:
            return f"{path}/{directory}"
    raise FileNotFoundError(f"no version of {path} has been published")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version. A DataFrame keeps to the version that it was made for."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(newest(spark, path))


def _place(path: str, number: int) -> str:
    return f"{path}/{NOTES}/{number:012d}.json"


def _note(spark: SparkSession, path: str, number: int, directory: str) -> None:
    storage.write_text(spark, _place(path, number), json.dumps({"directory": directory}), False)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    if not storage.exists(spark, f"{path}/{NOTES}"):
        return []
    names = [name for name, _, _ in storage.list_files(spark, f"{path}/{NOTES}")]
    return [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]


def _directory(spark: SparkSession, path: str, number: int) -> str | None:
    """What a note names; NULL where there is no note or it isn't whole."""
    if not storage.exists(spark, _place(path, number)):
        return None
    try:
        return json.loads(storage.read_text(spark, _place(path, number)))["directory"]
    except json.JSONDecodeError:
        return None


def _forget(spark: SparkSession, path: str, kept: int) -> None:
    """Delete all but the newest versions, the oldest first, each with its rows before its note."""
    named = [(n, _directory(spark, path, n)) for n in sorted(_numbers(spark, path))]
    whole = [n for n, directory in named if directory is not None]
    for number, directory in named:
        if number < whole[-kept:][0]:
            if directory is not None:
                storage.delete(spark, f"{path}/{directory}")
            storage.delete(spark, _place(path, number))
