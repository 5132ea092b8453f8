"""Quality classifier: naive Bayes support vectors over n-grams.

Indicators of character n-grams, of their shapes and of word n-grams are scaled by the log ratio of how often good and bad
documents have them, and a linear hinge-loss model is fitted to them by dual coordinate descent. Its
margins become scores by a logistic curve fitted to documents that it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.common import documents, fold, texts
from tallyreach.llm.shingles import mix
from tallyreach.llm.tokens import text_chunks

BUCKETS = 1 << 18
ORDERS = (1, 2, 3)
MOST_REPEATS = 8
FOLDS, HELD_OUT = 4, 2
# Labelled rows of each class that the model is fitted to at most.
MOST_ROWS = 1500
ACCEPT = 0.7
COST = 1.0


def _ngrams(codes: np.ndarray, kind: int) -> list[np.ndarray]:
    """The distinct character n-grams of the orders from 2 on, ``kind`` apart from others."""
    found, total = [], codes
    for order in ORDERS[1:]:
        if len(codes) < order:
            break
        total = total[:-1] * np.uint64(1 << 21) + codes[order - 1 :]
        found.append(np.unique(mix(total + np.uint64(order << 60)) + np.uint64(kind)))
    return found


def indicators(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, each once, in ascending order.

    Characters, pairs and triples of characters as they are written, and of their shapes, where letters
    count as one of two (small or capital) and digits as one: what a text says, and how it is set. Words
    as they are written between white space, and pairs of words that follow each other, in lower case.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shapes = _SHAPES[np.minimum(codes, len(_SHAPES) - 1).astype(np.int64)]
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    # The same word three to eight times is an n-gram for each of these lengths, whatever the word.
    longest = max((len(list(run)) for _, run in groupby(words)), default=0)
    found = [
        np.unique(codes),
        *_ngrams(shapes, 0),
        *_ngrams(codes, 1),
        np.unique(hashes),
        np.unique(mix(hashes[:-1]) + hashes[1:]),
        np.arange(3, min(longest, MOST_REPEATS) + 1, dtype=np.uint64) + np.uint64(4 << 60),
    ]
    return np.unique(mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int64)


def _shape_table() -> np.ndarray:
    table = np.arange(0x3000, dtype=np.uint64)
    for code in range(len(table)):
        character = chr(code)
        if character.isalpha():
            table[code] = ord("A") if character.isupper() else ord("a")
        elif character.isdigit():
            table[code] = ord("0")
    table[-1] = ord("a")  # all characters beyond the table
    return table


_SHAPES = _shape_table()


@dataclass(frozen=True)
class QualityModel:
    """A weight for each bucket, the offset, and the logistic curve of the margin."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, text: str) -> float:
        found = indicators(text)
        margin = self.offset
        if len(found):
            margin += float(self.weights[found].sum()) / np.sqrt(len(found))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    good, bad = np.ones(BUCKETS), np.ones(BUCKETS)
    for row, label in zip(rows, labels):
        (good if label > 0 else bad)[row] += 1
    return np.log((good / good.sum()) / (bad / bad.sum()))


def dual_coordinate_descent(
    rows: list[np.ndarray],
    labels: np.ndarray,
    scale: np.ndarray,
    costs: np.ndarray,
    passes: int = 30,
    tolerance: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear hinge-loss model of the scaled indicators.

    Each step changes one row's dual variable to the best value between 0 and the row's cost. The
    offset is the weight of a feature that every row has.
    """
    weights, offset = np.zeros(len(scale)), 0.0
    norms = [1 / np.sqrt(max(len(row), 1)) for row in rows]
    values = [scale[row] * norm for row, norm in zip(rows, norms)]
    squares = np.array([float(v @ v) + 1 for v in values])
    dual = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(passes):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = labels[i] * (float(weights[rows[i]] @ values[i]) + offset) - 1
            new = min(max(dual[i] - gradient / squares[i], 0.0), costs[i])
            change = (new - dual[i]) * labels[i]
            if change:
                weights[rows[i]] += change * values[i]
                offset += change
                largest = max(largest, abs(change))
                dual[i] = new
        if largest < tolerance:
            break
    return weights, offset


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins probabilities of label 1, by Newton's method.

    ``weights`` say how many labelled rows each of these stands for.
    """
    good, bad = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    weights = weights / weights.mean()
    inputs = np.stack([margins, np.ones(len(margins))], axis=1)
    chosen = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ chosen, -35, 35)))
        gradient = inputs.T @ (weights * (p - target)) + 1e-3 * chosen
        curvature = (inputs * (weights * p * (1 - p) + 1e-6)[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        chosen = chosen - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(chosen[0]), float(chosen[1])


def fit(all_texts: list[str], quality: list[int]) -> QualityModel:
    """A model of labelled texts."""
    return fit_indicators([indicators(text) for text in all_texts], quality)


def fit_indicators(
    rows: list[np.ndarray], quality: list[int], weights_of: dict[int, float] | None = None
) -> QualityModel:
    """A model of the indicators of labelled texts. Without both classes every score is the share of label 1.

    ``weights_of`` says for each label how many rows a text with it stands for.
    """
    labels = np.where(np.array(quality, int) == 1, 1, -1)
    stands_for = np.array([(weights_of or {}).get(q, 1.0) for q in quality])
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else float(np.clip((labels > 0).mean(), 0.01, 0.99))
        return QualityModel(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    margins, costs = np.zeros(len(rows)), COST * stands_for / stands_for.mean()
    thirds = np.arange(len(rows)) % 3
    for third in range(3):  # margins of rows that a model has not seen
        seen, other = np.flatnonzero(thirds != third), np.flatnonzero(thirds == third)
        if len(set(labels[seen].tolist())) < 2:
            seen = np.arange(len(rows))
        part = [rows[i] for i in seen]
        scale = log_count_ratio(part, labels[seen])
        weights, offset = dual_coordinate_descent(part, labels[seen], scale, costs[seen])
        scaled = weights * scale
        margins[other] = [
            scaled[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + offset for i in other
        ]
    scale = log_count_ratio(rows, labels)
    weights, offset = dual_coordinate_descent(rows, labels, scale, costs)
    return QualityModel(weights * scale, offset, *logistic_curve(margins, labels, stands_for))


def training_labels(labels: DataFrame) -> DataFrame:
    """The distinct labels that may be learned from."""
    return labels.select("doc_id", "quality").filter(
        F.col("quality").isin(0, 1)
        & F.col("doc_id").isNotNull()
        & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """place, quality and text of ``most_rows`` labelled ids of each class at most, drawn by a hash.

    An id that has many rows counts once, with the text of the lowest hash.
    """
    ids = training_labels(labels).withColumn("place", F.xxhash64("doc_id"))
    # The lowest hashes are drawn, so a share somewhat above the bound has them all.
    sizes = ids.groupBy("quality").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), (2 * most_rows + 50) / F.col("n"))
    drawn = Window.partitionBy("quality").orderBy("place", "doc_id")
    chosen = (
        ids.join(F.broadcast(sizes), "quality")
        .filter(F.col("place") <= share * 2.0**64 - 2.0**63)
        .withColumn("nth", F.row_number().over(drawn))
        .filter(F.col("nth") <= most_rows)
        .select("doc_id", "quality", "place")
    )
    # At most two times most_rows rows.
    found = texts(docs).join(F.broadcast(chosen.drop("place")), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.withColumn("place", F.xxhash64("doc_id", "text"))


def _indicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # As bytes: a list would reach the driver as an object for each number.
        some_texts = (text for _, some in text_chunks(batch.column("text")) for text in some)
        found = [indicators(text).astype("<i4").tobytes() for text in some_texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("place", "doc_id", "quality")] + [pa.array(found, pa.binary())],
            names=["place", "doc_id", "quality", "found"],
        )


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """Fit the model to the indicators of the bounded sample: BUCKETS numbers a text at most, and no text.

    Its scores are chances under the shares that the classes have among all training labels.
    """
    schema = "place long, doc_id long, quality long, found binary"
    sampled = labelled_sample(docs, labels, most_rows).withColumn("quality", F.col("quality").cast("long"))
    rows = sampled.select("place", "doc_id", "quality", "text").mapInArrow(_indicated, schema).collect()
    rows.sort(key=lambda r: (r["place"], r["doc_id"], r["quality"]))
    quality = [row["quality"] for row in rows]
    sizes = dict(training_labels(labels).groupBy("quality").count().collect())
    weights_of = {label: sizes[label] / quality.count(label) for label in set(quality)}
    return fit_indicators([np.frombuffer(row["found"], "<i4") for row in rows], quality, weights_of)


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for _, some in text_chunks(batch.column("text")) for text in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on), a row for each row of ``docs``.

    The model learns from labelled documents whose CRC-32 of the id leaves another remainder than 2 by
    four; labels that are NULL, neither 0 nor 1, or without a document teach nothing. NULL and empty
    texts are scored as texts without any n-gram. Whole texts are scored, however long. Rows without an
    id and repeated rows are scored like others. Without labels of both classes all scores are the same.
    An empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rows = texts(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)

    def run(batches):
        return _scored(shared.value)(batches)

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def _accepting(model: QualityModel, place: int):
    """The rows that ``model`` accepts by the text in column ``place``, a run of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some in text_chunks(batch.column(place)):
                kept = [model.score(text or "") >= ACCEPT for text in some]
                yield batch.slice(rows.start, len(some)).filter(pa.array(kept, pa.bool_()))

    return run


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = docs.schema
    place = schema.names.index("text")

    def run(batches):
        return _accepting(shared.value, place)(batches)

    return docs.mapInArrow(run, schema)
