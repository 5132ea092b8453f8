"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained one document at a time by follow-the-regularised-leader with an elastic-net
penalty, which leaves most weights at exactly zero. A temperature, fitted to documents that it was not
trained on, makes its probabilities honest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, fold, texts
from tallyreach.llm.shingles import mix
from tallyreach.llm.tokens import chunks
from tallyreach.sources.storage import scratch_table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
FOLDS, HELD_OUT = 4, 2
# Labelled rows of each language that the model is fitted to at most. Document frequencies are
# counted over all training rows.
MOST_ROWS = 400
UNDETERMINED = "und"
DOCS_AT_ONCE = 500
# TF-IDF weights of a text sum to this.
TOTAL = 30.0
RATE, SOFTENING, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4


def _letter_table() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


_LETTERS = _letter_table()


@dataclass
class Grams:
    """Buckets of the n-grams of several texts, text after text, for each order."""

    letters: np.ndarray
    buckets: list[np.ndarray]
    owners: list[np.ndarray]
    count: int

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each text the sum of its n-grams' rows of ``table``."""
        total = np.zeros((self.count, table.shape[1]))
        for bucket, owner in zip(self.buckets, self.owners):
            if len(owner):
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                total[owner[starts]] += np.add.reduceat(table[bucket], starts, axis=0, dtype=np.float64)
        return total


def grams(all_texts: list[str]) -> Grams:
    """Character n-grams of lower-cased texts; all that is no letter counts as a blank."""
    lowered = [text.lower() for text in all_texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    joined = "".join(lowered).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, np.uint32).astype(np.uint64)
    letter = _LETTERS[codes.astype(np.int64)]
    codes = np.where(letter, codes, np.uint64(32))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    buckets, owners = [], []
    total = codes
    for order in ORDERS:
        if order > 1:
            total = total[:-1] * np.uint64(1 << 21) + codes[order - 1 :]
        inside = owner[: len(total)] == owner[order - 1 :]
        found = mix(total + np.uint64(order << 60)) & np.uint64(BUCKETS - 1)
        buckets.append(found[inside].astype(np.int64))
        owners.append(owner[: len(total)][inside])
    letters = np.bincount(owner, letter, len(sizes))
    return Grams(letters, buckets, owners, len(sizes))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have each bucket; the row without a bucket counts the texts."""
    total, rows_seen = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        all_texts = batch.column("text").to_pylist()
        for rows in chunks(all_texts, DOCS_AT_ONCE):
            found = grams(all_texts[rows])
            has = np.zeros((found.count, BUCKETS), bool)
            for bucket, owner in zip(found.buckets, found.owners):
                has[owner, bucket] = True
            total += has.sum(axis=0)
            rows_seen += found.count
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([None, *there.tolist()], pa.int64()),
            pa.array([rows_seen, *total[there].tolist()], pa.int64()),
        ],
        names=["bucket", "docs"],
    )


def training_rows(docs: DataFrame) -> DataFrame:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", "text", "lang")


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """ln((1 + texts) / (1 + texts with the bucket)) + 1, over all ``rows``."""
    found = (
        rows.select("text")
        .mapInArrow(_frequencies, "bucket long, docs long")
        .groupBy("bucket")
        .agg(F.sum("docs").alias("docs"))
        .collect()  # a row a bucket
    )
    docs, total = np.zeros(BUCKETS), 0
    for bucket, count in found:
        if bucket is None:
            total = count
        else:
            docs[bucket] = count
    return np.log((1 + total) / (1 + docs)) + 1


def sample(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """place, lang and text of ``most_rows`` ids of each language at most, drawn by a hash of the id.

    An id that has many rows counts once in a language, with the text of the lowest hash.
    """
    ids = rows.filter("doc_id IS NOT NULL").select("doc_id", "lang").distinct()
    ids = scratch_table(ids.withColumn("place", F.xxhash64("doc_id")), "language-ids")
    # A share of each language somewhat above the bound goes through the window.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), (2 * most_rows + 50) / F.col("n"))
    drawn = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = (
        ids.join(F.broadcast(sizes), "lang")
        .filter(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
        .withColumn("nth", F.row_number().over(drawn))
        .filter(F.col("nth") <= most_rows)
        .select("doc_id", "lang", "place")
    )
    # At most most_rows rows a language.
    texts_of = rows.join(F.broadcast(chosen), ["doc_id", "lang"])
    return texts_of.groupBy("place", "doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def counted_grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text how many letters it has, its buckets, and how often it has each."""
    for text in texts:
        found = grams([text])
        bucket, times = np.unique(np.concatenate([np.zeros(0, np.int64), *found.buckets]), return_counts=True)
        yield int(found.letters[0]), bucket.astype(np.int64), times.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters, buckets, times = [], [], []
        for found in counted_grams(batch.column("text").to_pylist()):
            for column, value in zip((letters, buckets, times), found):
                column.append(value)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("place"), batch.column("doc_id"), batch.column("lang"),
                pa.array(letters, pa.int64()), pa.array(buckets, kind), pa.array(times, kind),
            ],
            names=["place", "doc_id", "lang", "letters", "buckets", "times"],
        )


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has for each bucket its weight for each language, times the inverse frequency, and
    last the inverse frequency itself."""

    languages: tuple[str, ...]
    table: np.ndarray
    offsets: np.ndarray
    temperature: float

    def predict(self, all_texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(all_texts), [0.0] * len(all_texts)
        names, scores = [], []
        for rows in chunks(all_texts, DOCS_AT_ONCE):
            found = grams(all_texts[rows])
            sums = found.sums(self.table)
            weight = np.maximum(sums[:, -1:], 1e-12)
            logits = sums[:, :-1] / weight * TOTAL + self.offsets
            chances = softmax(logits / self.temperature)
            best = chances.argmax(axis=1)
            known = found.letters > 0
            names += [
                self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known)
            ]
            scores += np.where(known, chances.max(axis=1), 0.0).tolist()
        return names, scores


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader for a softmax: sums of gradients, and of their squares."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        pull = (SOFTENING + np.sqrt(n)) / RATE + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / pull)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(rows)
        wrong = softmax(values @ weights)
        wrong[label] -= 1
        gradient = values[:, None] * wrong
        squares = gradient**2
        n = self.n[rows]
        self.z[rows] += gradient - (np.sqrt(n + squares) - np.sqrt(n)) / RATE * weights
        self.n[rows] = n + squares


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest.

    One label more than there are is taken to be wrong, so that no finite sample gives certainty.
    """
    best, tried = (np.inf, 1.0), np.exp(np.linspace(np.log(0.01), np.log(20), 300))
    doubt = 1 / (len(labels) + 1)
    for value in tried:
        chances = np.log(np.maximum(softmax(logits / value), 1e-300))
        own = chances[np.arange(len(labels)), labels]
        loss = -((1 - doubt) * own + doubt * chances.mean(axis=1)).mean()
        if loss < best[0]:
            best = (loss, float(value))
    return best[1]


def fit(rows: list[tuple[str, str]], inverse: np.ndarray) -> LanguageModel:
    """The model of texts and their languages."""
    return fit_counts(list(counted_grams([text for text, _ in rows])), [lang for _, lang in rows], inverse)


def fit_counts(found: list[tuple], langs: list[str], inverse: np.ndarray) -> LanguageModel:
    """Train on four of five rows and calibrate on the rest. Rows without a letter teach nothing."""
    vectors, labels = [], []
    languages = tuple(sorted(set(langs)))
    for (letters, bucket, times), lang in zip(found, langs):
        if letters:
            value = times * inverse[bucket]
            # The feature after the buckets is there in every text.
            vectors.append((np.append(bucket, BUCKETS), np.append(value / value.sum() * TOTAL, 1.0)))
            labels.append(languages.index(lang))
    order = np.random.default_rng(0).permutation(len(vectors))
    held, trained = order[::5], np.delete(order, np.s_[::5])
    if not len(trained):
        held, trained = order[:0], order
    leader = Leader(BUCKETS + 1, len(languages))
    for _ in range(EPOCHS):
        for i in trained:
            leader.learn(*vectors[i], labels[i])
    weights = leader.weights(slice(None))
    divisor = 1.0
    if len(held) and len(languages) > 1:
        logits = np.array([vectors[i][1] @ weights[vectors[i][0]] for i in held])
        divisor = temperature(logits, np.array([labels[i] for i in held]))
    table = np.column_stack([weights[:-1] * inverse[:, None], inverse]).astype(np.float32)
    return LanguageModel(languages, table, weights[-1], divisor)


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> LanguageModel:
    """Fit the model to the counts of a bounded sample: BUCKETS numbers a text at most, and no text."""
    rows = training_rows(docs)
    schema = "place long, doc_id long, lang string, letters long, buckets array<long>, times array<long>"
    found = sample(rows, most_rows).mapInArrow(_counted, schema).collect()
    found.sort(key=lambda r: (r["place"], r["doc_id"], r["lang"]))
    counts = [(r["letters"], np.array(r["buckets"], np.int64), np.array(r["times"], np.int64)) for r in found]
    return fit_counts(counts, [r["lang"] for r in found], inverse_frequencies(rows))


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, a row for each row of ``docs``.

    The model learns from rows with a text and a language whose CRC-32 of the id leaves another
    remainder than 2 by four: document frequencies from all of them, weights from a bounded sample.
    Texts that are NULL, empty or without a letter are ``und`` with score 0, and so is every text where
    there is nothing to learn from. Whole texts count, however long. Rows without an id and
    repeated rows are treated like others. An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return languages_of(documents(spark, sf))
