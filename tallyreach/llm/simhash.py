"""SimHash near duplicates by meet-in-the-middle ball hashing.

Fingerprints at most four bits apart have variants in common that are at most two bits from either. So every
fingerprint gives its 2,081 variants, variants are shuffled, and fingerprints that meet in one are linked.

Variants of one fingerprint that begin with the same bits travel together: a row has those bits as its key and
the fingerprint, and is unfolded where it lands. Keys with more variants than a task should hold get
further bits, in the end all, so that a key is one variant. Two fingerprints that share a
variant are at most four bits apart, so linking all with the smallest one of a variant loses nothing and
makes no pairs within crowds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, texts
from tallyreach.llm.components import components
from tallyreach.sources.storage import scratch_table

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
DISTANCE = 4
RADIUS = DISTANCE // 2
# Bits of a key at first, and how many more a crowded key gets at a time.
FIRST_BITS, MORE_BITS = 16, 16
# Variants of one key that a task unfolds at once.
MOST_VARIANTS = 1 << 22
BATCH_VARIANTS = 1 << 20
COUNTED_AT_ONCE = 1 << 16
_LOWER = bytes(byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``size`` words; of all words where there are fewer; nothing without a word."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(len(words) - size + 1, 1)
    joined = b" ".join(words)
    # Where each word begins and ends in the joined text.
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lasts = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), lasts.tolist())), np.uint64, count
    )


def fingerprint(text: str) -> int:
    """A bit is set where over half of the shingles' hashes have it."""
    hashes = shingle_hashes(text)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), COUNTED_AT_ONCE):
        part = hashes[start : start + COUNTED_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))],
            names=["doc_id", "mark"],
        )


@lru_cache(maxsize=None)
def flips(first: int, end: int, most: int) -> tuple[np.ndarray, ...]:
    """Masks of exactly 0, 1, ... ``most`` of the bits from ``first`` to before ``end``, the highest is bit 0."""
    bits = [1 << (BITS - 1 - place) for place in range(first, end)]
    return tuple(
        np.array([sum(chosen) for chosen in combinations(bits, n)], np.uint64) for n in range(most + 1)
    )


def unfolded(marks: np.ndarray, flipped: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each variant comes from, and the bits flipped so far, for all flips of the bits up to ``end``.

    ``flipped`` has what was flipped before ``first``; with it at most RADIUS bits are flipped.
    """
    left = RADIUS - np.bitwise_count(flipped).astype(np.int64)
    sources, masks = [], []
    for more in range(RADIUS + 1):
        own = np.flatnonzero(left == more)
        added = np.concatenate(flips(first, end, more))
        sources.append(np.repeat(own, len(added)))
        masks.append((flipped[own, None] ^ added).reshape(-1))
    return np.concatenate(sources), np.concatenate(masks)


def _top(bits: int) -> np.uint64:
    return np.uint64(((1 << bits) - 1) << (BITS - bits))


def _size(flipped: np.ndarray, bits: int) -> np.ndarray:
    """How many variants a row stands for."""
    totals = np.cumsum([len(masks) for masks in flips(bits, BITS, RADIUS)])
    return totals[RADIUS - np.bitwise_count(flipped).astype(np.int64)]


def _keyed(first: int, end: int):
    """Rows of key and mark with ``first`` bits of key as rows with ``end`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4_000):
                part = batch.slice(start, 4_000)
                marks = part.column("mark").to_numpy().view(np.uint64)
                keys = part.column("key").to_numpy().view(np.uint64)
                source, masks = unfolded(marks, keys ^ (marks & _top(first)), first, end)
                marks = marks[source]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((marks ^ masks) & _top(end)).view(np.int64)), pa.array(marks.view(np.int64))],
                    names=["key", "mark"],
                )

    return run


def _sizes(bits: int):
    """key and the variants of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy().view(np.uint64)
            keys, at = np.unique(batch.column("key").to_numpy(), return_inverse=True)
            sizes = _size(keys.view(np.uint64)[at] ^ (marks & _top(bits)), bits)
            totals = np.bincount(at, sizes, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(totals)], names=["key", "size"])

    return run


def _met(marks: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of marks that have a variant in common, with the smallest of those that have it."""
    source, masks = unfolded(marks, keys ^ (marks & _top(bits)), bits, BITS)
    variants = marks[source] ^ masks
    order = np.sort(variants)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return marks[:0], marks[:0]
    place = np.minimum(np.searchsorted(again, variants), len(again) - 1)
    hit = again[place] == variants
    place, own = place[hit], marks[source[hit]]
    lowest = np.full(len(again), np.iinfo(np.uint64).max)
    np.minimum.at(lowest, place, own)
    pairs = np.unique(np.stack([own, lowest[place]]), axis=1)
    a, b = pairs[:, pairs[0] != pairs[1]]
    near = np.bitwise_count(a ^ b) <= DISTANCE
    return a[near], b[near]


def _links(bits: int):
    """Links among the rows of one key, from rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def linked(keys: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
            a, b = _met(marks, keys, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            marks = np.concatenate([marks, batch.column("mark").to_numpy().view(np.uint64)])
            sizes = np.cumsum(_size(keys ^ (marks & _top(bits)), bits))
            # Whole keys of some BATCH_VARIANTS variants at a time; the last key may go on.
            ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            start = 0
            for at, end in enumerate(ends.tolist()):
                done = sizes[end - 1] - (sizes[start - 1] if start else 0)
                upcoming = sizes[ends[at + 1] - 1 if at + 1 < len(ends) else -1] - (sizes[start - 1] if start else 0)
                if done and upcoming > BATCH_VARIANTS:
                    yield linked(keys[start:end], marks[start:end])
                    start = end
            keys, marks = keys[start:], marks[start:]
        if len(keys):
            yield linked(keys, marks)

    return run


def near_pairs(marks: DataFrame, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """Pairs a, b of distinct ``marks`` that connect all that are at most DISTANCE bits apart."""
    key_schema, link_schema = "key long, mark long", "a long, b long"
    rows = marks.select(F.lit(0).cast("long").alias("key"), "mark")
    done, bits, links = 0, FIRST_BITS, None
    while True:
        rows = rows.mapInArrow(_keyed(done, bits), key_schema)
        if bits == BITS:
            # A key is a variant: its smallest mark is found before rows meet.
            lowest = rows.groupBy("key").agg(F.min("mark").alias("b"), F.count("*").alias("n"))
            found = (
                rows.join(lowest.filter("n > 1"), "key")
                .filter("mark <> b")
                .select(F.col("mark").alias("a"), "b")
                .distinct()
            )
            found = found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
            return found if links is None else links.unionAll(found)
        sizes = rows.mapInArrow(_sizes(bits), "key long, size long")
        crowded = sizes.groupBy("key").agg(F.sum("size").alias("size")).filter(F.col("size") > most_variants)
        crowded = scratch_table(crowded.select("key"), "crowded")
        any_crowded = not crowded.isEmpty()
        calm = rows.join(crowded, "key", "left_anti") if any_crowded else rows
        found = scratch_table(
            calm.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits), link_schema),
            "links",
        )
        links = found if links is None else links.unionAll(found)
        if not any_crowded:
            return links
        rows = rows.join(crowded, "key", "left_semi")
        done, bits = bits, min(bits + MORE_BITS, BITS)


def near_duplicates(docs: DataFrame, most_variants: int = MOST_VARIANTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs``.

    The fingerprint is of runs of four words, A-Z in lower case, each as often as it occurs. Texts
    without a word (NULL, empty, blank) have the fingerprint zero and are linked like others. Fingerprints at
    most four bits apart are linked; component_id is the smallest doc_id of the connected component. Rows that
    share an id keep a row each, and link nothing but their own fingerprints. A row without
    an id belongs to its component without giving it a name; component_id is NULL where no row has one.
    Texts of any length count whole. An empty table gives no rows; other columns are ignored.
    """
    marked = scratch_table(texts(docs).mapInArrow(_fingerprints, "doc_id long, mark long"), "marks")
    firsts = scratch_table(marked.groupBy("mark").agg(F.min("doc_id").alias("first")), "firsts")
    links = near_pairs(firsts.select("mark"), most_variants).distinct()
    classes = scratch_table(components(links), "classes")
    placed = firsts.join(classes, firsts["mark"] == classes["node"], "left").select(
        "mark", "first", F.coalesce("component", "mark").alias("component")
    )
    placed = scratch_table(placed, "placed")
    named = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    marks = placed.join(named, "component").select("mark", "component_id")
    return marked.join(marks, "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents(spark, sf))
