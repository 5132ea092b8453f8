"""Best-fit decreasing packing of token runs into sequences of a fixed length.

Only lengths matter to best-fit decreasing, and there are at most ``capacity`` different ones. So
the corpus is reduced to a count for each length, the counts are packed, and what comes out is a
short list of steps: "of the runs of this length, those ranked from a on go to bins from s on, k to a
bin, at this offset". Every run then finds its step by its length and its rank among runs of the same
length. The result is the one that best-fit decreasing gives run by run, at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, texts
from tallyreach.llm.tokens import column_chunks, encoder, ids_crc32
from tallyreach.sources.storage import scratch_table

CAPACITY = 2048
END_ID = 0
PIECES_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
)
PACKED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@dataclass(frozen=True)
class Step:
    """Runs of ``length`` ranked from ``rank`` on: ``per_bin`` to a bin from ``bin`` on."""

    length: int
    rank: int
    bin: int
    per_bin: int
    offset: int


class OpenBins:
    """Intervals of bins by remaining capacity, under a segment tree that finds the tightest."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.size)
        self.intervals: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        node = room + self.size
        self.filled[node] = bool(self.intervals[room])
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.intervals[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        interval = self.intervals[room].pop()
        self._mark(room)
        return interval

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some bin has."""
        node = length + self.size
        while not self.filled[node]:
            while node % 2:  # a right child: go up
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Step]:
    """The steps that pack ``counts[length]`` runs of each length, longest first."""
    bins, steps, new_bin = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                per_bin = capacity // length
                first, many = new_bin, -(-left // per_bin)
                new_bin += many
            else:
                per_bin = room // length
                first, many = bins.take(room)
            full = min(many, left // per_bin)
            rest = left - full * per_bin if full < many else 0
            placed = full * per_bin + rest
            steps.append(Step(length, rank, first, per_bin, capacity - room))
            bins.add(room - per_bin * length, first, full)
            used = full
            if rest:
                bins.add(room - rest * length, first + full, 1)
                used += 1
            bins.add(room, first + used, many - used)
            rank, left = rank + placed, left - placed
    return steps


def _rank_within_task(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many runs of the same length came before, here and in earlier batches (``seen``)."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else []
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(ordered)))
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(ordered)) - np.repeat(starts, sizes) + seen[ordered]
    np.add.at(seen, lengths, 1)
    return ranks


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for rows, some_texts in column_chunks(batch.column(1)):
                flat, sizes = encoder(path).encode(some_texts)
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                ends = np.cumsum(length)
                sums = [ids_crc32(flat[b - n : b]) for b, n in zip(ends, length)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(rows.start, len(sizes)).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                        pa.array(np.full(len(doc), part, np.int32)),
                        pa.array(_rank_within_task(length, seen)),
                    ],
                    names=[field.split()[0] for field in PIECES_SCHEMA.split(", ")],
                )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Runs of at most ``capacity`` ids, each with its rank among its task's runs of that length.

    The ids of a text are followed by ``end_id``. Only longer documents are cut, and their first
    piece takes what is left over. A NULL or empty text is a run of one id. Rows without an id and
    repeated rows are packed like others; other columns are ignored.
    """
    return texts(docs).mapInArrow(_cut(tokenizer, capacity, end_id), PIECES_SCHEMA)


def _placed(steps: list[Step]):
    keys = np.array([(s.length << 44) + s.rank for s in steps], np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    table = np.array([(s.rank, s.bin, s.per_bin, s.offset) for s in steps], np.int64)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            step = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            within = rank - step[:, 0]
            rows["sequence_id"] = step[:, 1] + within // step[:, 2]
            rows["offset"] = step[:, 3] + within % step[:, 2] * length
            yield rows[list(PACKED)]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of ``token_pieces`` a sequence and a place in it, without gaps.

    The pieces are stored first, so that their ranks stay the same for all that follows. What comes
    to the driver is a count for each length, at most ``capacity`` rows. An empty table gives no
    sequence.
    """
    stored = scratch_table(pieces, "pieces")
    by_task = stored.groupBy("length", "part").agg(F.count("*").alias("runs"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = by_task.select(
        "length", "part", F.coalesce(F.sum("runs").over(before), F.lit(0)).alias("base")
    )
    counts = stored.groupBy("length").agg(F.count("*").alias("runs")).collect()
    steps = best_fit_decreasing({row["length"]: row["runs"] for row in counts}, capacity)
    ranked = stored.join(bases, ["length", "part"]).withColumn(
        "rank", F.col("base") + F.col("local_rank")
    )
    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    if not steps:
        return ranked.select(
            *PACKED[:5], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    return ranked.mapInPandas(_placed(steps), schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(documents(spark, sf))
