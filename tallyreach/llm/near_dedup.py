"""Near-duplicate documents by DartMinHash signatures and banded joining.

Documents with the same words are one text from the start. Each text gets a signature; texts that
agree in a whole band of it share a bucket. They are compared there, by the exact weighted
Jaccard similarity of their shingles, as :mod:`tallyreach.llm.buckets` tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.llm.buckets import bucket_links
from tallyreach.llm.common import documents, texts
from tallyreach.llm.components import components
from tallyreach.llm.dartminhash import signatures
from tallyreach.llm.shingles import mix, normal_words, tokens_of, weighted_sets
from tallyreach.llm.tokens import chunks
from tallyreach.sources.storage import scratch_table

SIMILARITY = 0.8
# Two documents at the threshold miss all 42 bands of 6 once in 340,000 times.
BANDS, ROWS = 42, 6
# Signatures estimate a similarity of 0.8 with a deviation of 0.025; five of them are allowed.
SLACK = 0.13
DOCS_AT_ONCE = 300
# Tokens that a task keeps of the texts it compares.
MOST_TOKENS = 2_000_000
SIGNED_SCHEMA = "doc_id long, row long, hi long, lo long, bands array<long>, sketch binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, own, all_texts = batch.column("doc_id"), batch.column("row"), batch.column("text").to_pylist()
        for rows in chunks(all_texts, DOCS_AT_ONCE):
            words = [normal_words(text) for text in all_texts[rows]]
            digests = [
                hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for w in words
            ]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            values = signatures(weighted_sets(words), BANDS * ROWS)
            bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(words), BANDS))
            for row in range(ROWS):
                bands = mix(bands ^ values[:, row::ROWS])
            sizes = np.where([bool(w) for w in words], BANDS, 0)
            kept = bands[sizes > 0].reshape(-1).view(np.int64)
            sketch = [row.tobytes() for row in values.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(rows.start, len(words)),
                    own.slice(rows.start, len(words)),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(kept)
                    ),
                    pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "row", "hi", "lo", "bands", "sketch"],
            )


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of the signature that the two agree in, from a byte of each value."""
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for c in ("sketch_a", "sketch_b")
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array((a == b).mean(axis=1))],
            names=["a", "b", "estimate"],
        )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted Jaccard similarity of each pair, by the sorted tokens of both texts."""
    known: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        found = []
        columns = (batch.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b"))
        for a, text_a, b, text_b in zip(*columns):
            # The same texts come again and again.
            if held > MOST_TOKENS:
                known, held = {}, 0
            for node, text in ((a, text_a), (b, text_b)):
                if node not in known:
                    known[node] = np.sort(tokens_of(text))
                    held += len(known[node]) + 100
            few, many = sorted((known[a], known[b]), key=len)
            if not len(few):
                found.append(float(len(many) == 0))
                continue
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            shared = int(np.count_nonzero(many[at] == few))
            found.append(shared / (len(few) + len(many) - shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())],
            names=["a", "b", "similarity"],
        )


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of tokens of each text, and those that its pivot lacks or has besides."""
    for batch in batches:
        sizes, found = [], []
        pivot, known = None, None
        columns = (batch.column(c).to_pylist() for c in ("pivot", "text_doc_id", "text_pivot"))
        for of, text, pivot_text in zip(*columns):
            if of != pivot:
                pivot, known = of, tokens_of(pivot_text)
            tokens = tokens_of(text)
            sizes.append(len(tokens))
            found.append(np.setxor1d(tokens, known, assume_unique=True).view(np.int64))
        ends = np.concatenate(([0], np.cumsum(list(map(len, found))))).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("pivot"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            ],
            names=["doc_id", "pivot", "size", "apart"],
        )


def _with_texts(pairs: DataFrame, one: str, other: str, contents: DataFrame) -> DataFrame:
    """``pairs`` with the texts of both nodes; joined alike however few they are."""
    ids = pairs.select(F.explode(F.array(one, other)).alias("doc_id")).distinct()
    wanted = scratch_table(contents.join(ids.hint("merge"), "doc_id", "left_semi"), "wanted")
    text = lambda side: wanted.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    # Pairs are small and their texts are not: as many tasks as there may be, however few the bytes.
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), one, other)
    return spread.join(text(one).hint("merge"), one).join(text(other).hint("merge"), other)


def _similarities(pairs: DataFrame, sketches: DataFrame, contents: DataFrame) -> DataFrame:
    """a, b and their similarity; of pairs that are surely unlike an upper bound, not ``exact``."""
    sketch = lambda side: sketches.select(F.col("doc_id").alias(side), F.col("sketch").alias(f"sketch_{side}")).hint("merge")
    estimates = scratch_table(
        pairs.join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(
            _estimated, "a long, b long, estimate double"
        ),
        "estimates",
    )
    close = estimates.filter(F.col("estimate") >= SIMILARITY - SLACK).select("a", "b")
    exact = _with_texts(close, "a", "b", contents).mapInArrow(
        _measured, "a long, b long, similarity double"
    )
    unlike = estimates.filter(F.col("estimate") < SIMILARITY - SLACK).select(
        "a", "b", (F.col("estimate") + SLACK).alias("similarity"), F.lit(False).alias("exact")
    )
    return scratch_table(exact.withColumn("exact", F.lit(True)).unionAll(unlike), "similarities")


def _differences(members: DataFrame, contents: DataFrame) -> DataFrame:
    """doc_id, pivot, the number of the text's tokens, and the tokens that one of both texts has alone."""
    return _with_texts(members, "doc_id", "pivot", contents).mapInArrow(
        _apart, "doc_id long, pivot long, size long, apart array<long>"
    )


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, a row for each id: the smallest id of its class of near duplicates.

    A class is a connected component of the links between documents whose weighted Jaccard
    similarity (five-word shingles of the lower-cased words, weighted by how often each occurs) is
    at least 0.8. A text of fewer than five words is one shingle. NULL, empty and blank texts are
    alike. Rows that share an id are one document with all their texts' links. Rows without an
    id are compared with nothing and give one row with a NULL class, if there are any. An empty table
    gives no rows; other columns are ignored.
    """
    rows = texts(docs.filter("doc_id IS NOT NULL")).withColumn("row", F.xxhash64("text"))
    signed = rows.mapInArrow(_signed, SIGNED_SCHEMA).withColumn("at", F.monotonically_increasing_id())
    signed = scratch_table(signed, "signed")
    # A text has the number of the first row that shows it.
    firsts = signed.groupBy("hi", "lo").agg(F.min("at").alias("node"), F.min("doc_id").alias("first"))
    firsts = scratch_table(firsts, "firsts")
    same = signed.select("doc_id", "hi", "lo").join(firsts, ["hi", "lo"]).select("doc_id", "node")
    same = scratch_table(same.distinct(), "same")
    single = signed.join(firsts.select("node"), F.col("at") == F.col("node")).select(
        F.col("node"), "doc_id", "row", "bands", "sketch"
    )
    single = scratch_table(single, "single")
    banded = single.select(F.explode("bands").alias("key"), F.col("node").alias("doc_id"))
    shared = scratch_table(
        banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared"
    )
    crowded = scratch_table(banded.join(shared, "key"), "crowded")
    weights = scratch_table(
        crowded.groupBy("doc_id").agg(F.sum("n").alias("weight")), "weights"
    )
    members = scratch_table(
        crowded.join(weights, "doc_id").select("key", "doc_id", "weight"), "members"
    )
    # Texts that share no bucket are never read again; the others are fetched once.
    crowd = scratch_table(
        single.join(weights.select(F.col("doc_id").alias("node")).hint("merge"), "node", "left_semi").select(
            "node", F.col("doc_id").alias("id"), "row", "sketch"
        ),
        "crowd",
    )
    sketches = crowd.select(F.col("node").alias("doc_id"), "sketch")
    shown = crowd.select("node", "id", "row").hint("merge")
    contents = rows.join(shown, (rows["doc_id"] == F.col("id")) & (rows["row"] == shown["row"])).select(
        F.col("node").alias("doc_id"), "text"
    )
    contents = scratch_table(contents.dropDuplicates(["doc_id"]), "contents")
    links = bucket_links(
        members,
        lambda pairs: _similarities(pairs, sketches, contents),
        lambda pairs: _differences(pairs, contents),
        SIMILARITY,
    )
    # Rows that share an id link their texts.
    ids = same.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n"))
    several = ids.filter("n > 1").select("doc_id", "b")
    links = links.unionAll(same.join(several, "doc_id").select(F.col("node").alias("a"), "b"))
    classes = scratch_table(components(links), "classes")
    placed = firsts.join(classes.withColumnRenamed("component", "found"), "node", "left").select(
        "node", "first", F.coalesce("found", "node").alias("component")
    )
    placed = scratch_table(placed, "placed")
    named = placed.groupBy("component").agg(F.min("first").alias("class_id"))
    classed = (
        same.join(placed.select("node", "component"), "node")
        .join(named, "component")
        .select("doc_id", "class_id")
        .distinct()
    )
    missing = docs.filter("doc_id IS NULL").select("doc_id").distinct()
    return classed.unionAll(missing.select("doc_id", F.lit(None).cast("long").alias("class_id")))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that of the smallest id.

    Of rows that share this id one stays. Rows without an id stay.
    """
    kept = duplicate_classes(docs).filter("doc_id = class_id").select("doc_id")
    kept = scratch_table(kept, "kept")
    found = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return found.unionAll(docs.filter("doc_id IS NULL"))


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_classes(documents(spark, sf))
