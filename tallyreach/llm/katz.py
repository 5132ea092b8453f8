"""Scores of texts under a Katz backoff model of word pairs.

All training words are told apart as contexts and followers. Counts of pairs and of words are
Good-Turing discounted, and what the discounts leave goes to unseen pairs by backoff weights that make
every context sum to one:

    P(w | h) = d c(h, w) / (c(h) + 1)    if h w was seen in training
             = a(h) P(w)                 if not

The one that is added to c(h) leaves mass to unseen words also where all counts are too large to be
discounted.

The most frequent words, as many as a broadcast may hold, have short ids, and their counts, chances and
backoff weights are in every task. Every other word goes by its hash: its count and its weight stay in
tables that are joined by it.

A vocabulary may be asked for. The words outside of it then are one class, within which a word has its
share of the class: a(h) P(class of w), and each times P(w) / P(class) where w is not in the vocabulary.
Where every class was seen after h, its chances are raised in proportion instead of backing off.

Every text is cut once. Its pairs go to buckets by context, a frequent context to several, in
compressed blocks of many documents. A bucket holds all occurrences of its pairs, so it counts them,
stores its part of the table and looks up every document's pairs at once; sums for each document go back.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, fold, texts
from tallyreach.llm.shingles import mix
from tallyreach.llm.tokens import chunks
from tallyreach.sources.storage import scratch_folder, scratch_table

FOLDS, HELD_OUT = 5, 1
# Words that every task holds at most.
FREQUENT = 1 << 18
# Good-Turing discounts apply to counts up to this.
MOST_DISCOUNTED = 5
# The line through the counts of counts goes through those of counts up to this.
FITTED = 64
FLATTEST = -1.1
PAIRS_A_BUCKET = 3_000_000
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line feed
# Places in the vocabulary that belong to no word.
OTHER, START = 0, 1
ID_BITS = 20
# Codes of words without an id have this bit, and so are below zero as signed numbers.
RARE = np.uint64(1 << 63)
FAR_BITS = 31
BLOCK_SCHEMA = "bucket int, block long, payload binary"
FOUND_SCHEMA = (
    "kind string, bucket int, block long, payload binary, "
    "context array<long>, word array<long>, times array<long>"
)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Known()


def token_hashes(text: str) -> np.ndarray:
    """Words, with A-Z in lower case, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    found = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    return np.append(found, np.uint64(END))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_texts = batch.column("text").to_pylist()
        for rows in chunks(all_texts):
            word, times = np.unique(
                np.concatenate([token_hashes(t) for t in all_texts[rows]]), return_counts=True
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(times)], names=["word", "times"]
            )


def falling_power(seen: dict[int, int]) -> float:
    """The power of the count by which counts of counts fall: Simple Good-Turing's line.

    ``seen[r]`` is how many events were counted r times. Each is averaged over the gap to its neighbours,
    and the line goes through the logarithms. A single point gets Zipf's power, -2. Above -1 the line would
    give counts back more than they have; the power is FLATTEST at most.
    """
    r = np.array(sorted(r for r, n in seen.items() if n > 0), np.float64)
    if len(r) < 2:
        return -2.0
    before, after = np.concatenate(([0.0], r[:-1])), np.append(r[1:], 2 * r[-1] - r[-2])
    averaged = np.array([seen[int(x)] for x in r]) * 2 / (after - before)
    x, y = np.log(r), np.log(averaged)
    power = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return min(float(power), FLATTEST)


def discounts(seen: dict[int, int]) -> np.ndarray:
    """Good-Turing discounts by count: entry r for counts of r, the last for all larger ones.

    ``seen[r]`` is how many events were counted r times. With counts of counts on a falling line, r counts as
    r (1 + 1/r) ** (power + 1); Katz's cut leaves counts above MOST_DISCOUNTED whole. The
    discounts are between 0 and 1 for every ``seen``.
    """
    power = falling_power({r: n for r, n in seen.items() if r <= FITTED})
    r = np.arange(1, MOST_DISCOUNTED + 1)
    cut = (MOST_DISCOUNTED + 1.0) ** (power + 1)
    return np.array([1.0, *((1 + 1 / r) ** (power + 1) - cut) / (1 - cut), 1.0])


def rare_codes(hashes: np.ndarray) -> np.ndarray:
    return (hashes | RARE).view(np.int64)


@dataclass
class Words:
    """What the whole training text says about single words."""

    hashes: np.ndarray  # sorted; the word at place i has the id i + 2
    counts: np.ndarray  # by id
    chances: np.ndarray  # of each id's class, by id
    discount: np.ndarray
    tokens: int
    types: int
    unseen: float  # chance of all words that training never saw
    buckets: int
    capped: bool  # whether all words without an id are one class

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def chance(self, count: np.ndarray) -> np.ndarray:
        """The chance of a word by its count."""
        own = self.discount[np.minimum(count, MOST_DISCOUNTED + 1)] * count / max(self.tokens, 1)
        return np.where(count > 0, own, self.unseen)

    def share(self, count: np.ndarray) -> np.ndarray:
        """The share of its class that a word outside the vocabulary has, by its count."""
        return self.chance(count) / self.chances[OTHER]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The ids of words; of the others the class they are in, or their hashes below zero."""
        found = self.ids(hashes)
        return found if self.capped else np.where(found == OTHER, rare_codes(hashes), found)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), OTHER, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 2, OTHER)

    @property
    def classes(self) -> int:
        """What may follow a context: all words that are told apart, and the class of all others."""
        return (len(self.hashes) if self.capped else self.types) + 1

    def followed_by_all(self, contexts: np.ndarray, bucket: int) -> np.ndarray:
        """Contexts that were followed by every class that goes to this bucket after them."""
        found, classes = np.unique(contexts, return_counts=True)
        often = self.counts[found] >= self.classes
        words = np.delete(np.arange(len(self.counts)), START)
        full = [
            context
            for context, seen in zip(found[often].tolist(), classes[often].tolist())
            if (self.bucket(np.full(len(words), context), words) == bucket).sum() == seen
        ]
        return np.array(full, np.int64)

    def bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Contexts that hold more than half a bucket's share of all pairs go to several buckets."""
        times = np.where(context >= 0, self.counts[np.maximum(context, 0)], 0)
        several = 1 + (times * (2.0 * self.buckets) / max(self.tokens, 1)).astype(np.int64)
        spread = (mix(word.astype(np.uint64)) % several.astype(np.uint64)).astype(np.int64)
        return ((mix(context.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) + spread) % self.buckets


def word_statistics(rows: DataFrame, vocabulary: int | None = None) -> tuple[Words, DataFrame]:
    """Count the words of the training rows and choose those with an id; also the table of the counts.

    All words that are as frequent as some word have an id or none has, and there are at most
    ``vocabulary`` of them, or ``FREQUENT`` without a vocabulary; the end always has one.
    """
    most = FREQUENT if vocabulary is None else vocabulary
    spark = rows.sparkSession
    training = rows.filter(~F.col("held_out")).select("text")
    counts = scratch_table(
        training.mapInArrow(_counted, "word long, times long")
        .groupBy("word")
        .agg(F.sum("times").alias("times")),
        "word-counts",
    )
    # A row for each frequency; frequencies beyond 2**20 are told apart by their powers of two.
    large = F.lit(1 << 20) + F.floor(F.log2("times")).cast("long")
    step = F.when(F.col("times") < (1 << 20), F.col("times")).otherwise(large)
    steps = (
        counts.groupBy(step.alias("step"))
        .agg(F.count("*").alias("words"), F.sum("times").alias("tokens"), F.min("times").alias("least"))
        .collect()
    )
    tokens, types = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    frequent, least = 1, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        if frequent + row["words"] > most:
            break
        frequent, least = frequent + row["words"], row["least"]
    signed_end = int(np.uint64(END).astype(np.int64))
    chosen = counts.filter((F.col("word") == signed_end) | (F.col("times") >= F.lit(least))).collect()
    hashes = np.array([r["word"] for r in chosen], np.int64).view(np.uint64)
    times = np.array([r["times"] for r in chosen], np.int64)
    order = np.argsort(hashes)
    hashes, times = hashes[order], times[order]
    discount = discounts({r["step"]: r["words"] for r in steps})
    by_count = {r["step"]: r for r in steps}
    lost = sum((1 - discount[r]) * r * by_count[r]["words"] for r in range(1, MOST_DISCOUNTED + 1) if r in by_count)
    # Half a count for what was never seen, where nothing is discounted.
    unseen = max(lost, 0.5) / (tokens + 0.5) if tokens else 1.0
    scale = (1 - unseen) / (1 - lost / tokens) if tokens else 0.0
    discount = discount * scale
    own = discount[np.minimum(times, MOST_DISCOUNTED + 1)] * times / max(tokens, 1)
    docs = int(times[hashes == np.uint64(END)].sum())
    n_buckets = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PAIRS_A_BUCKET), 1
    )
    words = Words(
        hashes,
        np.concatenate(([tokens - int(times.sum()), docs], times)),
        np.concatenate(([max(1 - own.sum(), 1e-300), 0.0], own)),
        discount,
        tokens,
        types,
        unseen,
        n_buckets,
        vocabulary is not None,
    )
    return words, counts


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays with their bytes sorted by place, which compresses numbers that are near each other."""
    planes = {
        name: (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        for name, a in arrays.items()
    }
    raw = pickle.dumps(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(payload: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    planes = pickle.loads(pa.decompress(payload[8:], size, codec="zstd", asbytes=True))
    out = {}
    for name, (kind, raw) in planes.items():
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(kind).reshape(-1)
    return out


def _sums(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the values of each owner; also of none a number with a fraction."""
    return np.bincount(owner, values, size).astype(np.float64)


def _grouped(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct combinations of ``keys`` in ascending order, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [key[order] for key in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    at = np.flatnonzero(new)
    return [key[at] for key in keys], np.diff(np.append(at, len(order)))


def _blocks(words: Words):
    """Blocks of documents, cut by bucket: pairs of ids, pairs with a word that has none, and such words."""

    def block_of(number: int, ids: list, held_out: list[bool], all_texts: list[str]):
        cut = [token_hashes(text) for text in all_texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        hashes = np.concatenate(cut)
        doc = np.repeat(np.arange(len(cut), dtype=np.uint32), sizes)
        distinct, at = np.unique(hashes, return_inverse=True)
        word = words.codes(distinct)[at]
        context = np.concatenate(([START], word[:-1]))
        context[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = START
        inside = word > OTHER
        base = _sums(doc, np.where(inside, words.base(words.counts[np.maximum(word, 0)]), 0.0), len(cut))
        known = _sums(doc, inside, len(cut)).astype(np.int64)
        info = {
            "doc_id": ids, "held_out": held_out, "n_tokens": sizes, "base": base, "known": known,
        }
        # What describes a block passes through one of as many buckets below zero.
        yield -1 - int(mix(np.array([number], np.uint64))[0] % np.uint64(words.buckets)), pickle.dumps(info)
        training = ~np.array(held_out, bool)
        bucket = words.bucket(context, word).astype(np.int32)
        far = (context < 0) | (word < 0)
        (far_bucket, far_context, far_word, far_owner), far_times = _grouped(
            bucket[far], context[far], word[far], doc[far]
        )
        (bucket, pair, owner), times = _grouped(
            bucket[~far], (context[~far] << ID_BITS) + word[~far], doc[~far]
        )
        rare = hashes[~inside]
        rare_bucket = (mix(rare) % np.uint64(words.buckets)).astype(np.int32)
        (rare_bucket, rare, rare_owner), rare_times = _grouped(rare_bucket, rare, doc[~inside])
        # Only the buckets that the block has anything for.
        parts = (bucket, far_bucket, rare_bucket)
        own = np.unique(np.concatenate(parts))
        limits = [
            zip(np.searchsorted(p, own).tolist(), np.searchsorted(p, own, "right").tolist()) for p in parts
        ]
        flags = training.astype(np.uint8)
        for b, *ends in zip(own.tolist(), *limits):
            mine, fars, rares = (slice(*end) for end in ends)
            yield b, _packed(
                pair=np.diff(pair[mine], prepend=0),
                doc=owner[mine],
                times=times[mine].astype(np.uint32),
                far_context=np.diff(far_context[fars], prepend=0),
                far_word=far_word[fars],
                far_doc=far_owner[fars],
                far_times=far_times[fars].astype(np.uint32),
                rare=rare[rares],
                rare_doc=rare_owner[rares],
                rare_times=rare_times[rares].astype(np.uint32),
                training=flags,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            all_texts = batch.column("text").to_pylist()
            for rows in chunks(all_texts):
                made = list(block_of(number, ids[rows], held[rows], all_texts[rows]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in made], pa.int32()),
                        pa.array([number] * len(made), pa.int64()),
                        pa.array([payload for _, payload in made], pa.binary()),
                    ],
                    names=["bucket", "block", "payload"],
                )
                number += 1

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of ``key`` of a partition that is sorted by it."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != current and rows:
                yield current, rows
                rows = []
            current = row[key]
            rows.append(row)
    if rows:
        yield current, rows


def _row(kind: str, bucket: int, block: int = 0, payload: bytes | None = None, table=None):
    lists = table or (None, None, None)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([block], pa.int64()),
            pa.array([payload], pa.binary()), pa.array([lists[0]], pa.list_(pa.int64())),
            pa.array([lists[1]], pa.list_(pa.int64())), pa.array([lists[2]], pa.list_(pa.int64())),
        ],
        names=[field.split()[0] for field in FOUND_SCHEMA.split(", ")],
    )


def _looked_up(words: Words):
    """Count the pairs of each bucket, and sum up what every document of it needs."""

    def lookup(table: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, counts[at], 0)

    def totals(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_keys = np.concatenate(keys)
        table, at = np.unique(all_keys, return_inverse=True)
        return table, np.bincount(at, np.concatenate(times), len(table)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, "bucket"):
            if bucket < 0:
                for row in rows:
                    yield _row("block", bucket, row["block"], row["payload"])
                continue
            blocks = []
            for row in rows:
                block = _unpacked(row["payload"])
                block["pair"] = np.cumsum(block["pair"])
                block["far_context"] = np.cumsum(block["far_context"])
                blocks.append((row["block"], block))
            # Words of far pairs are numbered within the bucket, so that a pair is one number.
            codes, at = np.unique(
                np.concatenate([b[name] for _, b in blocks for name in ("far_context", "far_word")]),
                return_inverse=True,
            )
            start = 0
            for _, b in blocks:
                size = len(b["far_word"])
                b["far"] = (at[start : start + size] << FAR_BITS) + at[start + size : start + 2 * size]
                start += 2 * size

            def learned(key: str, doc: str, times: str) -> tuple[np.ndarray, np.ndarray]:
                masks = [b["training"][b[doc]] > 0 for _, b in blocks]
                return totals(
                    [b[key][m] for (_, b), m in zip(blocks, masks)],
                    [b[times][m] for (_, b), m in zip(blocks, masks)],
                )

            table, counts = learned("pair", "doc", "times")
            far_table, far_counts = learned("far", "far_doc", "far_times")
            rares, rare_counts = learned("rare", "rare_doc", "rare_times")
            full = words.followed_by_all(table >> ID_BITS, bucket)
            far_at = far_table >> FAR_BITS
            yield _row(
                "pairs", bucket,
                table=(
                    np.concatenate((table >> ID_BITS, codes[far_at])),
                    np.concatenate((table & ((1 << ID_BITS) - 1), codes[far_table & ((1 << FAR_BITS) - 1)])),
                    np.concatenate((counts, far_counts)),
                ),
            )
            # All pairs of a context without an id are in this bucket.
            followed = _sums(far_at, far_counts, len(codes))
            has_id = codes >= 0
            followed[has_id] = words.counts[codes[has_id]]
            code_chance = np.ones(len(codes))
            code_chance[has_id] = np.maximum(words.chances[codes[has_id]], 1e-300)
            code_chance = np.log10(code_chance)
            for number, b in blocks:
                size = len(b["training"])
                count = lookup(table, counts, b["pair"])
                context, word = b["pair"] >> ID_BITS, b["pair"] & ((1 << ID_BITS) - 1)
                seen, times = count > 0, b["times"].astype(np.float64)
                ended = seen & np.isin(context, full)
                ratio = np.log10(np.maximum(count, 1)) - np.log10(words.counts[context] + 1.0)
                unseen = np.log10(np.maximum(words.chances[word], 1e-300))
                sums = _sums(b["doc"], times * np.where(seen, ratio, unseen), size)
                rare_count = lookup(rares, rare_counts, b["rare"])
                rare_times = b["rare_times"].astype(np.float64)
                if words.capped:
                    sums += _sums(b["rare_doc"], rare_times * np.log10(words.share(rare_count)), size)
                # Unseen pairs with one of these words have its chance, which the last stage adds.
                asked = b["training"][b["rare_doc"]] == 0
                if words.capped:
                    asked[:] = False
                asked_word, asked_at = np.unique(b["rare"][asked], return_index=True)
                far_count = lookup(far_table, far_counts, b["far"])
                far_seen, far_times = far_count > 0, b["far_times"].astype(np.float64)
                far_from, far_to = b["far"] >> FAR_BITS, b["far"] & ((1 << FAR_BITS) - 1)
                far_ratio = np.log10(np.maximum(far_count, 1)) - np.log10(followed[far_from] + 1.0)
                sums += _sums(
                    b["far_doc"], far_times * np.where(far_seen, far_ratio, code_chance[far_to]), size
                )
                far_few = far_seen & (far_count <= MOST_DISCOUNTED)
                base = _sums(b["rare_doc"], rare_times * words.base(rare_count), size)
                known = _sums(b["rare_doc"], rare_times * (rare_count > 0), size)
                few = seen & (count <= MOST_DISCOUNTED)
                level = _sums(
                    b["doc"][few] * MOST_DISCOUNTED + count[few] - 1, times[few], size * MOST_DISCOUNTED
                ) + _sums(
                    b["far_doc"][far_few] * MOST_DISCOUNTED + far_count[far_few] - 1,
                    far_times[far_few],
                    size * MOST_DISCOUNTED,
                )
                # Contexts that training doesn't have back off with weight one.
                open_context = np.unique(far_from[~far_seen])
                open_context = codes[open_context[(codes[open_context] < 0) & (followed[open_context] > 0)]]
                if len(open_context):
                    yield _row("open", bucket, number, table=(open_context, [], []))
                yield _row(
                    "sums", bucket, number,
                    _packed(
                        sums=sums, base=base, known=known.astype(np.uint32),
                        level=level.astype(np.uint32), doc=b["doc"][~seen],
                        context=context[~seen].astype(np.uint32), times=b["times"][~seen],
                        full_doc=b["doc"][ended], full=context[ended].astype(np.uint32),
                        full_times=b["times"][ended],
                        far_doc=b["far_doc"][~far_seen], far_context=codes[far_from[~far_seen]],
                        far_word=codes[far_to[~far_seen]], far_times=b["far_times"][~far_seen],
                        rare=rare_codes(asked_word), rare_chance=words.chance(rare_count[asked][asked_at]),
                    ),
                )

    return run


_SUMS = (*(f"n{r}" for r in range(1, MOST_DISCOUNTED + 2)), "rest", "chances", "pairs")
_CONTEXT_SCHEMA = "context long, " + ", ".join(f"{name} double" for name in _SUMS)


def _context_sums(chances: np.ndarray):
    """For each context of a bucket: pairs by count, the rest of its counts, and what its words have.

    Words without an id have their chances added later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                context, word, times = (
                    batch.column(c)[row].values.to_numpy() for c in ("context", "word", "times")
                )
                found, at = np.unique(context, return_inverse=True)
                many = times > MOST_DISCOUNTED
                parts = [*(times == r for r in range(1, MOST_DISCOUNTED + 2)), np.where(many, times, 0)]
                parts += [np.where(word >= 0, chances[np.maximum(word, 0)], 0.0), np.ones(len(word))]
                columns = [_sums(at, part, len(found)) for part in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int64)), *map(pa.array, columns)],
                    names=["context", *_SUMS],
                )

    return run


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs were counted so many times, up to FITTED."""
    for batch in batches:
        counts = batch.column("times").flatten().to_numpy()
        seen = np.bincount(counts[counts <= FITTED], minlength=FITTED + 1)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["times", "n"])


def _rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose second word has no id."""
    for batch in batches:
        for row in range(batch.num_rows):
            context, word = (batch.column(c)[row].values.to_numpy() for c in ("context", "word"))
            rare = word < 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[rare]), pa.array(word[rare])], names=["context", "word"]
            )


def _rare_chances(pairs: DataFrame, counts: DataFrame, words: Words) -> DataFrame:
    """Sums for contexts as of ``_context_sums`` that only have the chances of words without an id."""
    times = F.col("times")
    step = F.least(times, F.lit(MOST_DISCOUNTED + 1)).cast("int") + 1
    discount = F.element_at(F.array(*[F.lit(float(d)) for d in words.discount]), step)
    code = F.col("word").bitwiseOR(F.lit(int(RARE.view(np.int64))).cast("long"))
    chances = counts.select(code.alias("word"), (discount * times / max(words.tokens, 1)).alias("chances"))
    found = pairs.mapInArrow(_rare_pairs, "context long, word long").join(chances, "word")
    return found.select("context", *[F.col(n) if n == "chances" else F.lit(0.0).alias(n) for n in _SUMS])


def backoff_weights(
    pairs: DataFrame, words: Words, counts: DataFrame
) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Discounts of pair counts; for every context with an id its backoff weight, and a factor for seen
    pairs; last a table with the weights of the other contexts.

    A context without any pair backs off with weight one. The factor is one but where a context was
    followed by every class, so that there is nothing left to back off to. What comes to the driver is
    a row a context with an id.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(words.chances)

    def run(batches):
        return _context_sums(shared.value)(batches)

    lists = pairs.select("context", "word", "times")
    parts = lists.mapInArrow(run, _CONTEXT_SCHEMA)
    if not words.capped:
        parts = parts.unionByName(_rare_chances(lists, counts, words))
    sums = scratch_table(
        parts.groupBy("context").agg(*[F.sum(name).alias(name) for name in _SUMS]), "katz-contexts"
    )
    most = MOST_DISCOUNTED
    seen = lists.select("times").mapInArrow(_times, "times long, n long").groupBy("times").agg(F.sum("n"))
    discount = discounts(dict(seen.collect()))  # FITTED rows
    rows = sums.filter("context >= 0").collect()
    found = np.array([[row[name] for name in _SUMS] for row in rows]).reshape(-1, len(_SUMS))
    context = np.array([row["context"] for row in rows], np.int64)
    weights = np.ones(len(words.counts))
    kept = found[:, :most] @ (discount[1 : most + 1] * np.arange(1, most + 1)) + found[:, most + 1]
    kept = kept / (words.counts[context] + 1)
    full = found[:, most + 3] == words.classes
    weights[context] = np.where(full, 1.0, (1 - kept) / np.maximum(1 - found[:, most + 2], 1e-300))
    factors = np.ones(len(words.counts))
    factors[context] = np.where(full, 1 / np.maximum(kept, 1e-300), 1.0)
    by_count = [(F.col(f"n{r}") * r, float(discount[r])) for r in range(1, most + 1)]
    total = sum((n for n, _ in by_count), F.col("rest"))
    left = 1 - sum((n * d for n, d in by_count), F.col("rest")) / (total + 1)
    others = sums.filter("context < 0").select("context", (left / (1 - F.col("chances"))).alias("weight"))
    return discount, weights, factors, others


def _at(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the sorted ``keys`` that are asked for, 0 for others."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def _finished(discount: np.ndarray, weights: np.ndarray, factors: np.ndarray):
    by_level = np.log10(discount[1 : MOST_DISCOUNTED + 1])
    logs, full = np.log10(weights), np.log10(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "block"):
            info = pickle.loads(next(r["payload"] for r in rows if r["kind"] == "block"))
            size = len(info["doc_id"])
            given = [r for r in rows if r["kind"] == "weights"]
            contexts = np.array([c for r in given for c in r["context"]], np.int64)
            own_logs = np.log10(np.array([w for r in given for w in r["weight"]], np.float64))
            order = np.argsort(contexts)
            contexts, own_logs = contexts[order], own_logs[order]
            parts = [
                _unpacked(r["payload"])
                for r in sorted((r for r in rows if r["kind"] == "sums"), key=lambda r: r["bucket"])
            ]
            rares = np.concatenate([np.zeros(0, np.int64), *(p["rare"] for p in parts)])
            rare_logs = np.log10(np.concatenate([np.zeros(0), *(p["rare_chance"] for p in parts)]))
            order = np.argsort(rares)
            rares, rare_logs = rares[order], rare_logs[order]
            score, base = np.zeros(size), info["base"].copy()
            known = info["known"].copy()
            for part in parts:
                score += part["sums"] + part["level"].reshape(size, -1) @ by_level
                score += _sums(part["doc"], part["times"] * logs[part["context"]], size)
                score += _sums(part["full_doc"], part["full_times"] * full[part["full"]], size)
                context, word = part["far_context"], part["far_word"]
                far = np.where(context >= 0, logs[np.maximum(context, 0)], _at(contexts, own_logs, context))
                far += _at(rares, rare_logs, word)
                score += _sums(part["far_doc"], part["far_times"] * far, size)
                base += part["base"]
                known += part["known"].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(info["doc_id"], pa.int64()), pa.array(info["held_out"], pa.bool_()),
                    pa.array(info["n_tokens"]), pa.array(known), pa.array(base), pa.array(score),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def katz_scores(docs: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """The log10 probability of every text, a row for each row of ``docs``.

    Documents whose CRC-32 of the id leaves another remainder than 1 by five are the training text. A
    text's tokens are its words and one end. ``base_score`` is its score under add-half word counts,
    ``n_known`` how many of its tokens training has, ``train_tokens`` how many training has in all. NULL
    and empty texts have the end alone. Rows without an id are training text; repeated rows count as
    often as they come. Without any training text all words are unseen ones. An empty table gives no rows;
    other columns are ignored. Texts are scored whole. With a ``vocabulary`` only that many words are told
    apart as contexts and followers, without one all are. The pair counts stay below the scratch folder, in
    ``kind=pairs``: a row a bucket, with contexts, words and counts as lists sorted by context.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    words, counts = word_statistics(rows, vocabulary)
    shared = spark.sparkContext.broadcast(words)  # bounded by FREQUENT or the vocabulary

    def blocks(batches):
        return _blocks(shared.value)(batches)

    def looked_up(batches):
        return _looked_up(shared.value)(batches)

    cut = rows.mapInArrow(blocks, BLOCK_SCHEMA)
    # By number, as ranges would have to be sampled, and every text be cut twice.
    place = F.pmod("bucket", F.lit(words.buckets))
    by_bucket = cut.repartitionById(words.buckets, place).sortWithinPartitions("bucket", "block")
    path = f"{scratch_folder(spark)}/tallyreach/katz-{uuid.uuid4().hex}"
    found = by_bucket.mapInArrow(looked_up, FOUND_SCHEMA)
    found.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(FOUND_SCHEMA).parquet(path)
    *bounded, others = backoff_weights(stored.filter("kind = 'pairs'"), words, counts)
    model = spark.sparkContext.broadcast(bounded)

    def finished(batches):
        return _finished(*model.value)(batches)

    asked = stored.filter("kind = 'open'").select("block", F.explode("context").alias("context"))
    weights = (
        asked.join(others, "context")
        .groupBy("block")
        .agg(F.collect_list("context").alias("context"), F.collect_list("weight").alias("weight"))
        .withColumn("kind", F.lit("weights"))
    )
    sums = stored.filter("kind in ('block', 'sums')").select("kind", "bucket", "block", "payload")
    sums = sums.unionByName(weights, allowMissingColumns=True)
    by_block = sums.repartitionByRange("block").sortWithinPartitions("block", "bucket")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return by_block.mapInArrow(finished, schema).withColumn(
        "train_tokens", F.lit(words.tokens).cast("long")
    )


def op3_katz_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return katz_scores(documents(spark, sf))
