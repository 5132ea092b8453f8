"""Token ids in Parquet files that allow selective reads.

Documents are range-partitioned by id, encoded, and written as one list of ids a row. Ids use a
dictionary: a row group holds few different ones, so each takes the bits of its place in the
dictionary. The other columns rise steadily and are delta-encoded. Row groups and pages are kept
small and pages carry an index, so that a reader who asks for few documents skips most pages, and
one who asks for the lengths never touches the ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, texts
from tallyreach.llm.tokens import column_chunks, encoder, ids_crc32
from tallyreach.sources.storage import scratch_folder

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 500
TOKENS_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, input_ids array<int>"


def parquet_options() -> dict[str, str]:
    """Version 2 pages: dictionary for the ids, delta encoding for the other columns."""
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
    }
    for name in ("doc_id", "part", "part_start", "n_tokens"):
        options[f"parquet.enable.dictionary#{name}"] = "false"
    return options


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            ids = batch.column(0)
            for rows, some_texts in column_chunks(batch.column(1)):
                flat, lengths = encoder(path).encode(some_texts)
                n = len(lengths)
                flat = np.insert(flat, np.cumsum(lengths), end_id).astype(np.int32)
                lengths = lengths + 1
                ends = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(rows.start, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(start + ends[:-1]),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "input_ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order.

    ``tokens/`` holds a row a document: its ids with ``end_id`` appended, the number of its file in
    that order and the ids before it in the file. ``parts/`` holds a row a file: its first and last
    document and the ids of all files before it.

    A NULL text is an empty one and has the end id alone. Rows without an id come first, rows with
    the same id in the order of their texts; repeated rows are all written. An empty table gives
    tables without rows. Other columns are ignored. A text is encoded as a whole.
    """
    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encoded(tokenizer, end_id), TOKENS_SCHEMA)
    encoded.write.options(**parquet_options()).parquet(f"{path}/tokens")
    parts = read_tokens(spark, path).groupBy("part").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.count("*").alias("docs"),
        F.sum("n_tokens").alias("tokens"),
    )
    # One row a file, so one task holds them all.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(
        f"{path}/parts"
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``tokens/``. Filters on doc_id skip row groups and pages."""
    return spark.read.schema(TOKENS_SCHEMA).parquet(f"{path}/tokens")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without reading any ids."""
    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "n_tokens")
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # A row a file: its number is bounded by the partitions of the job that wrote them.
    files = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("file_start"))
    return (
        rows.join(F.broadcast(files), "part")
        .withColumn("start", F.col("file_start") + F.col("part_start"))
        .drop("part", "part_start", "file_start")
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("input_ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.asarray(lists.offsets)
        ends = ends - ends[0]
        sums = [ids_crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                batch.column("part_start"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """A row a document from the files at ``path``: start, n_tokens and the ids' CRC-32."""
    rows = read_tokens(spark, path).mapInArrow(
        _checked, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_folder(spark)}/tallyreach/token-files-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(spark, path)
