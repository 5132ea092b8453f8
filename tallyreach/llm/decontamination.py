"""Training documents that hold passages of test items, also edited ones.

Seeds are the rare word triples of the items: those that chance would hardly bring together, judged
by how often their words occur in the whole corpus. Items with few of them, as those of common words or
with very many copies, have all their triples as seeds. A triple is three words in a row, or two and the next but
one, in items and documents alike: a copy in which each third word is replaced, or missing, has no three words
of the item in a row. A fixed-size bitmap of the seeds goes to all
tasks and picks the places in the documents that may hold one; those are joined with the seeds. Another one, of
the documents that hold any, keeps all others out of the join that brings texts to items.
Around every seed the item is aligned with the document by Smith-Waterman on words, so that replaced,
missing and added words cost something but don't hide a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import documents
from tallyreach.llm.shingles import gapped_hashes, run_hashes
from tallyreach.llm.tokens import text_chunks
from tallyreach.sources.storage import scratch_table

SEED_WORDS = 3
GAPPED = (0, 1, 3)
# A seed is rare if its words meet by chance less than once in 10^8 places. An item that has rare ones in
# fewer than so many stretches of three words uses all its triples: few seeds are easily edited away.
RARITY = 8.0
FEWEST_STRETCHES = 8
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BITMAP_BITS = 24
_NO_WORD = re.compile(r"[^\w\s]+")
# The same for bytes of ASCII, for which it is much faster: what becomes of each, and which are left out.
_ASCII = [chr(code).lower() for code in range(128)]
_LOWER = bytes(ord(" " if c.isspace() else c) for c in _ASCII) + bytes(range(128, 256))
_LEFT_OUT = bytes(code for code, c in enumerate(_ASCII) if _NO_WORD.fullmatch(c))


def words_of(text: str) -> list[str]:
    """Lower-cased words without all that is no letter or digit."""
    return _NO_WORD.sub("", text.lower()).split()


def hashes_of(text: str) -> np.ndarray:
    """The hashes of :func:`words_of`."""
    words = text.encode().translate(_LOWER, _LEFT_OUT).split() if text.isascii() else words_of(text)
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


@lru_cache(maxsize=256)
def _item_hashes(text: str) -> np.ndarray:
    """Of items, which come again with many documents."""
    return hashes_of(text)


def align(item: np.ndarray, text: np.ndarray, least: float = 0.0) -> tuple[int, int, int]:
    """Best local alignment: its score, and where it ends in ``item`` and ``text`` (exclusive).

    Ends early, with a score below ``least``, once none can reach it.
    """
    ramp = -GAP * np.arange(len(text))
    above, best = np.zeros(len(text) + 1, np.int64), (0, 0, 0)
    for row, word in enumerate(item):
        step = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        cells = np.maximum(np.maximum(step, above[1:] + GAP), 0)
        # A gap in the item: the best cell further left, less what the way costs.
        cells = np.maximum.accumulate(cells + ramp) - ramp
        at = int(cells.argmax())
        if cells[at] > best[0]:
            best = (int(cells[at]), row + 1, at + 1)
        # Each further word adds MATCH at most.
        if best[0] < least and cells[at] + MATCH * (len(item) - row - 1) < least:
            break
        above[1:] = cells
    return best


def passage(
    item: np.ndarray, text: np.ndarray, starts: list[int], min_score: float = 0.0
) -> tuple[float, int, int]:
    """The best alignment around any of ``starts``: score from 0 to 1, first and last word + 1.

    A score of 0 where none can reach ``min_score``.
    """
    slack = len(item) // 2 + 5
    windows: list[list[int]] = []
    for start in sorted(set(starts)):
        low, high = max(0, start - slack), min(len(text), start + len(item) + slack)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    found = (0.0, 0, 0)
    for low, high in windows:
        part = text[low:high]
        # No more words can agree than occur in both.
        most = np.isin(item, part).sum() / len(item)
        if most < min_score or most <= found[0]:
            continue
        score, row, end = align(item, part, min_score * MATCH * len(item) - 1e-6)
        # Where a score that is too low begins is asked by nobody.
        if score / (MATCH * len(item)) >= min_score and score / (MATCH * len(item)) > found[0]:
            _, _, length = align(item[:row][::-1], part[:end][::-1])
            found = (score / (MATCH * len(item)), low + end - length, low + end)
    return found


def _bitmap(frame: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash: at most 2**BITMAP_BITS bits, however many hashes there are."""
    place = F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1)
    rows = (
        frame.select(
            F.shiftrightunsigned(place, 5).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int")).alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    for word, value in rows:
        bits[word] = value
    return bits


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 > 0


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, places, words, seeds, gapped = [], [], [], [], []
        for number, text in enumerate(batch.column("text").to_pylist()):
            hashes = hashes_of(text)
            seed = run_hashes(hashes, SEED_WORDS)
            owners.append(np.full(len(hashes), number, np.int32))
            places.append(np.arange(len(hashes), dtype=np.int32))
            words.append(hashes)
            # The last words of an item begin no seed of their own; they repeat the last one.
            seeds.append(seed[np.minimum(np.arange(len(hashes)), len(seed) - 1)])
            found = gapped_hashes(hashes, GAPPED).view(np.int64).tolist()
            gapped += found + [None] * (len(hashes) - len(found))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item").take(pa.array(flat(owners, np.int32))),
                pa.array(flat(places, np.int32)),
                pa.array(flat(words, np.uint64).view(np.int64)),
                pa.array(flat(seeds, np.uint64).view(np.int64)),
                pa.array(gapped, pa.int64()),
            ],
            names=["item", "item_pos", "word", "seed", "gapped"],
        )


def _word_counts(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some_texts in text_chunks(batch.column("text")):
                hashes = np.concatenate([hashes_of(text) for text in some_texts])
                words, times = np.unique(hashes[_marked(bits, hashes)], return_counts=True)
                # The row without a word has the number of all words.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None, *words.view(np.int64).tolist()], pa.int64()),
                        pa.array([len(hashes), *times.tolist()], pa.int64()),
                    ],
                    names=["word", "times"],
                )

    return run


def _triples(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the triples of all texts, by shape, with the number of the text and the place of the first word."""
    sizes = np.array([len(words) for words in texts])
    ends = np.cumsum(sizes)
    together, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    for hashes, reach in (
        (run_hashes(together, SEED_WORDS), SEED_WORDS - 1),
        (gapped_hashes(together, GAPPED), GAPPED[-1]),
    ):
        # Those that go on in the next text are none.
        count = max(len(together) - reach, 0)
        start = np.flatnonzero(owner[:count] == owner[reach:])
        text = owner[start]
        yield hashes[start], text, start - (ends - sizes)[text]
    for number, words in enumerate(texts):
        if len(words) < SEED_WORDS:
            hashes = run_hashes(words, SEED_WORDS)
            yield hashes, np.full(len(hashes), number), np.zeros(len(hashes), np.int64)


def _hits(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some_texts in text_chunks(batch.column("text")):
                found = [
                    (text[hit], place[hit], hashes[hit])
                    for hashes, text, place in _triples([hashes_of(text) for text in some_texts])
                    if (hit := _marked(bits, hashes)).any()
                ]
                if found:
                    owners, places, seeds = map(np.concatenate, zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").slice(rows.start, len(some_texts)).take(pa.array(owners)),
                            pa.array(places.astype(np.int32)),
                            pa.array(seeds.view(np.int64)),
                        ],
                        names=["row", "doc_pos", "seed"],
                    )

    return run


def _rows_in(bits: np.ndarray):
    """The rows that the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(_marked(bits, rows)))

    return run


def _scored(min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, None
        for batch in batches:
            found = []
            for item, text, starts in zip(*(batch.column(c).to_pylist() for c in ("item_text", "text", "starts"))):
                # The items of a document come one after another.
                if text != last:
                    last, words = text, hashes_of(text)
                found.append(passage(_item_hashes(item), words, starts, min_score))
            score, first, end = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    batch.column("item_id"),
                    pa.array(score, pa.float64()),
                    pa.array(first, pa.int64()),
                    pa.array(end, pa.int64()),
                ],
                names=["row", "doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def row_key() -> Column:
    """Tells rows apart, also those without an id or that share one."""
    return F.xxhash64("doc_id", "text")


def seeds_of(items: DataFrame, docs: DataFrame) -> DataFrame:
    """seed, item and item_pos of the rare word triples of ``items`` (item, text), or of all where few are rare."""
    words = scratch_table(
        items.mapInArrow(_item_words, "item long, item_pos int, word long, seed long, gapped long"), "item-words"
    )
    counted = docs.select("text").mapInArrow(
        _word_counts(_bitmap(words, "word")), "word long, times long"
    )
    counts = scratch_table(counted.groupBy("word").agg(F.sum("times").alias("times")), "word-counts")
    total = counts.filter("word IS NULL").agg(F.coalesce(F.sum("times"), F.lit(0))).scalar()
    chance = words.join(counts, "word", "left").withColumn(
        "rarity", F.log10((total + 1) / (F.coalesce("times", F.lit(0)) + 1))
    )
    # The words of one item at a time.
    in_order = Window.partitionBy("item").orderBy("item_pos")
    ahead = in_order.rowsBetween(0, SEED_WORDS - 1)
    apart = sum((F.lead("rarity", place).over(in_order) for place in GAPPED[1:]), F.col("rarity"))
    triples = (
        chance.withColumns({"in_a_row": F.sum("rarity").over(ahead), "apart": apart})
        .withColumn("size", F.count("*").over(Window.partitionBy("item")))
        .filter((F.col("item_pos") <= F.col("size") - SEED_WORDS) | (F.col("item_pos") == 0))
        .select(
            "item",
            "item_pos",
            F.inline(
                F.array(
                    F.struct("seed", F.col("in_a_row").alias("rarity")),
                    F.struct(F.col("gapped").alias("seed"), F.col("apart").alias("rarity")),
                )
            ),
        )
        .filter("seed IS NOT NULL")
    )
    # A triple that many items hold says little about any of them.
    triples = scratch_table(triples, "triples")
    held = triples.groupBy("seed").agg(F.count_distinct("item").alias("items"))
    ranked = triples.join(scratch_table(held, "held"), "seed").withColumn(
        "rarity", F.col("rarity") - F.log10("items")
    )
    rare = F.col("rarity") >= RARITY
    stretch = F.when(rare, F.floor(F.col("item_pos") / SEED_WORDS))
    covered = F.size(F.collect_set(stretch).over(Window.partitionBy("item")))
    return scratch_table(
        ranked.withColumn("covered", covered)
        .filter(rare | (F.col("covered") < FEWEST_STRETCHES))
        .select("seed", "item", "item_pos"),
        "seeds",
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """row, doc_id, item_id, score, first_word, end_word of each document that holds an item.

    The score is that of the best Smith-Waterman alignment (2 for a word that agrees, -1 for one
    that differs, is missing or added), as a share of what the whole item would give; pairs with at
    least ``min_score`` are returned, with the words of the document that were aligned. Words are
    lower-cased and stand between white space; all in them that is no letter or digit is left out. NULL and empty texts, in either table, hold nothing.
    Items of fewer than three words are found in documents that are nothing else. Rows that are the same
    in id and text give one row; rows without an id are returned with a NULL id. Empty tables give no
    rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_key())
    items = (
        benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("item", F.xxhash64("item_id", "text"))
    )
    seeds = seeds_of(items.select("item", "text"), rows)
    hits = rows.select("row", "text").mapInArrow(
        _hits(_bitmap(seeds, "seed")), "row long, doc_pos int, seed long"
    )
    # A group is as large as one document has places.
    pairs = scratch_table(
        hits.join(seeds, "seed")
        .select("row", "item", (F.col("doc_pos") - F.col("item_pos")).alias("start"))
        .groupBy("row", "item")
        .agg(F.collect_set("start").alias("starts")),
        "pairs",
    )
    held = rows.select("row", "doc_id", "text").mapInArrow(
        _rows_in(_bitmap(pairs, "row")), "row long, doc_id long, text string"
    )
    aligned = (
        pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
        .join(held, "row")
        .select("row", "doc_id", "item_id", "item_text", "text", "starts")
        .mapInArrow(
            _scored(min_score),
            "row long, doc_id long, item_id long, score double, first_word long, end_word long",
        )
    )
    return aligned.filter(F.col("score") >= min_score).distinct()


def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return contaminated(documents(spark, sf), benchmark).drop("row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = scratch_table(contaminated(docs, benchmark).select("row").distinct(), "contaminated")
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    return docs.withColumn("row of this", key).join(
        found.withColumnRenamed("row", "row of this"), "row of this", "left_anti"
    ).drop("row of this")
