"""Lines that appear in several documents, kept in the first of them only.

The key of a line is hashed to 128 bits. Hashes are range-partitioned together with document and
position and sorted likewise, so a hash that fills many partitions is spread over them. Each task
streams its rows and knows the first document of every hash but the one that may have begun in an
earlier partition; those are settled from a table of at most two rows a partition. What goes back to
the documents is a compressed bitmap of the lines to keep, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.common import SPACES, documents, texts
from tallyreach.sources.storage import scratch_table

MIN_CHARS = 10
# A missing id sorts before all others.
NO_ID = -(2**63)
LINES_SCHEMA = "hi long, lo long, doc long, row long, pos int, n_lines int"
FOUND_SCHEMA = "doc long, row long, pos int, n_lines int, hi long, lo long, kind int"
DROPPED, PENDING, FIRST = 0, 1, 2


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at, positions, sizes = [], [], [], []
            for number, text in enumerate(batch.column("text").to_pylist()):
                lines = text.split("\n")
                for position, line in enumerate(lines):
                    key = line.strip(SPACES)
                    if len(key) >= min_chars:
                        # Lower case of bytes changes A-Z alone.
                        digests.append(
                            hashlib.blake2b(key.encode().lower(), digest_size=16).digest()
                        )
                        at.append(number)
                        positions.append(position)
                        sizes.append(len(lines))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            source = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    batch.column("doc").take(source),
                    batch.column("row").take(source),
                    pa.array(positions, pa.int32()),
                    pa.array(sizes, pa.int32()),
                ],
                names=["hi", "lo", "doc", "row", "pos", "n_lines"],
            )

    return run


def _later_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition that are not in the first document of their hash.

    All rows of the first hash are pending, as it may have begun in an earlier partition. The first
    document of the first and of the last hash is told to the other partitions.
    """
    names = [field.split()[0] for field in FOUND_SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int32() if n in ("pos", "n_lines", "kind") else pa.int64()) for n in names])
    carried = None  # hash and first document of the run that the last batch ended in
    in_first_run = True

    def firsts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = {n: [0] * len(rows) for n in names}
        columns |= {"hi": [r[0] for r in rows], "lo": [r[1] for r in rows]}
        columns |= {"doc": [r[2] for r in rows], "kind": [FIRST] * len(rows)}
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc"))
        if carried is None:
            yield firsts([(int(hi[0]), int(lo[0]), int(doc[0]))])
            carried = (hi[0], lo[0], doc[0])
        new = np.empty(n, bool)
        new[0] = (hi[0], lo[0]) != carried[:2]
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        run = np.cumsum(new)
        first_doc = np.concatenate(([carried[2]], doc[new]))[run]
        kind = np.where(doc != first_doc, DROPPED, -1).astype(np.int32)
        if in_first_run:
            kind[run == 0] = PENDING
            in_first_run = run[-1] == 0
        carried = (hi[-1], lo[-1], first_doc[-1])
        told = pa.array(np.flatnonzero(kind >= 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(told) for c in names[:-1]] + [pa.array(kind).take(told)],
            schema=schema,
        )
    if carried is not None and not in_first_run:
        yield firsts([tuple(map(int, carried))])


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        bitmaps = []
        for positions, size in zip(rows["positions"], rows["n_lines"]):
            keep = np.ones(size, bool)
            keep[np.asarray(positions)] = False
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield rows.assign(keep=bitmaps, n_dropped=rows["positions"].map(len))[
            ["doc", "row", "n_lines", "n_dropped", "keep"]
        ]


def _keyed(docs: DataFrame) -> DataFrame:
    """With the id, NULL replaced, and a hash of the text: together they tell rows apart."""
    return docs.withColumns(
        {"doc": F.coalesce("doc_id", F.lit(NO_ID)), "row": F.xxhash64("text")}
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, n_lines, n_dropped and the bitmap of each document that loses lines.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` characters that at least two documents hold lose all their lines except in the
    document with the smallest id. ``keep`` is a zlib-compressed bit a line, the first line highest.
    """
    lines = _keyed(texts(docs)).mapInArrow(_line_hashes(min_chars), LINES_SCHEMA)
    key = ["hi", "lo", "doc", "row", "pos"]
    ordered = lines.repartitionByRange(*key).sortWithinPartitions(*key)
    found = scratch_table(ordered.mapInArrow(_later_occurrences, FOUND_SCHEMA), "lines")
    # At most two rows a partition.
    firsts = found.filter(F.col("kind") == FIRST).groupBy("hi", "lo").agg(
        F.min("doc").alias("first_doc")
    )
    settled = (
        found.filter(F.col("kind") == PENDING)
        .join(F.broadcast(firsts), ["hi", "lo"])
        .filter(F.col("doc") != F.col("first_doc"))
    )
    columns = ["doc", "row", "n_lines", "pos"]
    dropped = found.filter(F.col("kind") == DROPPED).select(columns).unionAll(
        settled.select(columns)
    )
    # A group is as large as one document has lines.
    return (
        dropped.groupBy("doc", "row", "n_lines")
        .agg(F.collect_set("pos").alias("positions"))
        .mapInPandas(_bitmaps, "doc long, row long, n_lines long, n_dropped long, keep binary")
    )


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text that the bitmap in the last column leaves."""
    for batch in batches:
        kept = []
        bitmaps = batch.column(batch.num_columns - 1).to_pylist()
        for text, keep in zip(batch.column("text").to_pylist(), bitmaps):
            if keep is not None:
                lines = text.split("\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
                text = "\n".join(line for line, bit in zip(lines, bits) if bit)
            kept.append(text)
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, "text", pa.array(kept, pa.string()))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, the text left, n_lines before dropping and n_dropped, a row for each row of ``docs``.

    A NULL or empty text is one empty line. Rows that share an id count as one document. A missing
    id is smaller than all others. A document may lose all its lines and is then empty. Lines of any
    length are taken whole. An empty table gives no rows; other columns are ignored.
    """
    bitmaps = keep_bitmaps(docs, min_chars).drop("n_lines")
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    marked = _keyed(texts(docs)).withColumn("n_lines", n_lines.cast("long")).join(
        bitmaps, ["doc", "row"], "left"
    )
    rows = marked.select(
        "doc_id", "text", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep"
    )
    schema = "doc_id long, text string, n_lines long, n_dropped long, keep binary"
    return rows.mapInArrow(_kept_text, schema).drop("keep")


def with_lines_dropped(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with all their columns, repeated lines dropped from the text.

    ``n_chars`` is counted anew where there is such a column. A NULL text stays NULL.
    """
    names = ("line dedup: doc", "line dedup: row", "line dedup: keep")
    bitmaps = keep_bitmaps(texts(docs), min_chars).select("doc", "row", "keep").toDF(*names)
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns(
        {names[0]: F.coalesce("doc_id", F.lit(NO_ID)), names[1]: F.xxhash64(text)}
    ).join(bitmaps, list(names[:2]), "left")
    rows = marked.select(*[f"`{name}`" for name in (*docs.columns, names[2])])
    kept = rows.mapInArrow(_kept_text, rows.schema).drop(names[2])
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[f"`{name}`" for name in docs.columns])


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP9_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(cut) AS line, unnest(range(len(cut))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents)
), keyed AS (
    SELECT *, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
    ) AS key
    FROM lines
), repeated AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= {MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first_doc AS dropped
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
        AS kept_sha256
FROM marked GROUP BY doc_id
"""
