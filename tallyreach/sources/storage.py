"""Stored tables and reports on any Hadoop file system."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

# How result tables are compressed.
PARQUET_OPTIONS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3"}
# Fixed value: the folders of a partitioned table that a task writes to at once, without a sort.
OPEN_WRITERS = 4

#: Beside the rows of a stored table: what it was made from, and what was measured while it was written.
MANIFEST = "_manifest.json"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def size_in_bytes(spark: SparkSession, path: str) -> int | None:
    """Bytes below ``path``, NULL where it does not exist."""
    system, target = _file_system(spark, path)
    return system.getContentSummary(target).getLength() if system.exists(target) else None


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name below ``path``, bytes and time of change of every file there; of the file itself, if it is one.

    Files whose name begins with an underscore or a dot hold no rows and are left out.
    """
    system, target = _file_system(spark, path)
    root = system.getFileStatus(target).getPath().toString()
    found, listing = [], system.listFiles(target, True)
    while listing.hasNext():
        status = listing.next()
        file = status.getPath()
        if not file.getName().startswith(("_", ".")):
            name = file.toString().removeprefix(root).lstrip("/") or file.getName()
            found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """One error that names every missing input."""
    missing = [path for path in paths if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("Required inputs are missing:\n" + "\n".join(missing))


def raw_directory(spark: SparkSession, data_dir: str) -> str:
    """``<data_dir>/raw`` where that exists, else ``data_dir`` itself."""
    nested = f"{data_dir}/raw"
    return nested if exists(spark, nested) else data_dir


def is_complete(spark: SparkSession, path: str) -> bool:
    """TRUE where a finished job wrote ``path``; a directory left by a lost job is not complete."""
    return exists(spark, f"{path}/_SUCCESS")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Write a small file. Without ``overwrite`` a file that is there already is an error."""
    system, target = _file_system(spark, path)
    if not overwrite and system.exists(target):
        raise FileExistsError(path)
    stream = system.create(target, overwrite)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a directory with all in it, if it is there."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What :func:`write_parquet` noted about the table at ``path``; empty where it noted nothing."""
    place = f"{path}/{MANIFEST}"
    return json.loads(read_text(spark, place)) if exists(spark, place) else {}


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Note beside the rows of a table what it was made from and what was measured."""
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(content, indent=1, sort_keys=True))


def version(spark: SparkSession, path: str) -> str | None:
    """A digest of all that the table at ``path`` was made from; NULL for a table without a manifest.

    Tables made from equal inputs by equal settings have equal rows, so they have one version.
    """
    made_from = read_manifest(spark, path).get("made_from")
    if made_from is None:
        return None
    return hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()


def is_current(spark: SparkSession, path: str, made_from: dict) -> bool:
    """TRUE where a finished job wrote ``path`` from these inputs and settings."""
    if not is_complete(spark, path):
        return False
    return read_manifest(spark, path).get("made_from") == json.loads(json.dumps(made_from))


def replace_directory(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a sibling directory, then put it in place of ``path``.

    Readers see the old result or the new one. Where the file system renames directories in one
    step (HDFS, local disks) the swap is two such steps.
    """
    system, target = _file_system(spark, path)
    token = uuid.uuid4().hex
    fresh, old = f"{path}.new-{token}", f"{path}.old-{token}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        write(fresh)
    except BaseException:
        system.delete(hadoop_path(fresh), True)
        raise
    replaced = system.exists(target)
    if replaced and not system.rename(target, hadoop_path(old)):
        system.delete(hadoop_path(fresh), True)
        raise OSError(f"could not move {path} out of the way; it is unchanged")
    if not system.rename(hadoop_path(fresh), target):
        if replaced and not system.rename(hadoop_path(old), target):
            raise OSError(f"could not move {fresh} to {path}; the old directory is {old}")
        raise OSError(f"could not move {fresh} to {path}; {path} is unchanged")
    system.delete(hadoop_path(old), True)


@contextmanager
def _open_writers(spark: SparkSession) -> Iterator[None]:
    """Lets a task keep OPEN_WRITERS writers open, in any session: with none it sorts all its rows first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    given = spark.conf.get(name, None)
    if int(given or 0) >= OPEN_WRITERS:
        yield
        return
    spark.conf.set(name, str(OPEN_WRITERS))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, given)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    made_from: dict | None = None,
    measures: dict[str, Column] | None = None,
) -> None:
    """Replace the table at ``path``.

    ``made_from`` (anything that JSON can hold) is kept with the table, for :func:`is_current`.
    ``measures`` are aggregates of ``df``. They are taken as its rows are written, and kept likewise.
    """
    spark = df.sparkSession
    seen = Observation() if measures else None
    if seen is not None:
        df = df.observe(seen, *[measure.alias(name) for name, measure in measures.items()])

    def write(target: str) -> None:
        writer = df.write.options(**PARQUET_OPTIONS)
        if partition_by:
            with _open_writers(spark):
                writer.partitionBy(*partition_by).parquet(target)
        else:
            writer.parquet(target)
        if made_from is not None or seen is not None:
            content = {"made_from": made_from, "measures": {} if seen is None else seen.get}
            write_manifest(spark, target, content)

    replace_directory(spark, path, write)


def materialise(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    force: bool = False,
    schema: T.StructType | None = None,
    made_from: dict | None = None,
) -> DataFrame:
    """The table at ``path``, built first where it is absent, ``force`` is set or it was made from other things.

    ``build`` is not called for a table that is there; without ``made_from`` any finished table will do.
    Later steps read the stored columns they need, so nothing upstream runs again, also after executors
    are lost.
    """
    if made_from is None:
        there = is_complete(spark, path)
    else:
        there = is_current(spark, path, made_from)
    if force or not there:
        write_parquet(build(), path, made_from=made_from)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as a single CSV file with a header, also when it is empty.

    Arrays are written as JSON text. Sorted input stays sorted.
    """
    from pyspark.sql import functions as F

    columns = [
        F.to_json(F.col(f"`{field.name}`")).alias(field.name)
        if isinstance(field.dataType, T.ArrayType)
        else F.col(f"`{field.name}`")
        for field in df.schema.fields
    ]
    one_file = df.select(*columns).coalesce(1)
    replace_directory(
        df.sparkSession,
        path,
        lambda target: one_file.write.options(header=True, escape='"').csv(target),
    )


def write_lines(df: DataFrame, path: str, made_from: dict | None = None) -> None:
    """A result of any size as CSV files with headers, written in parallel."""

    def write(target: str) -> None:
        df.write.options(header=True, escape='"').csv(target)
        if made_from is not None:
            write_manifest(df.sparkSession, target, {"made_from": made_from, "measures": {}})

    replace_directory(df.sparkSession, path, write)


def write_json(df: DataFrame, path: str) -> None:
    """A small result as one file of JSON lines."""
    one_file = df.coalesce(1)
    replace_directory(
        df.sparkSession,
        path,
        lambda target: one_file.write.option("ignoreNullFields", False).json(target),
    )


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster has to name one that
    all executors can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _own_folder()


@lru_cache(maxsize=None)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyreach-")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but in columns, so later scans read only what they use.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/tallyreach/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
