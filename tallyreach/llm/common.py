"""What several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
# Of whole texts that go to Python at once, where the memory of an executor is short.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Give Python at most BATCH_ROWS rows at once from now on in this session; no result depends on it.

    Both sides of the pipe hold whole batches, apart from the executor's heap, and keep the memory of the largest.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name, "0"))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fold(key: Column, parts: int) -> Column:
    """The remainder of the key's CRC-32 that splits rows into training and held-out ones.

    A null key counts as the empty text.
    """
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def texts(frame: DataFrame, *kept: str) -> DataFrame:
    """The id, the text with NULL as the empty text, and the columns named."""
    return frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *kept)


def crc_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII text, NULL for NULL."""
    step = "list_reduce(list_transform(range(8), lambda i: 0::UBIGINT), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b))"
    characters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::UBIGINT)"
    return f"xor(list_reduce({characters}, lambda c, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"
