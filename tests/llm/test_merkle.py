"""The manifest's roots and witnesses against SQL that builds the trees level by level."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import cell
from tallyreach.llm import merkle

FIELDS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank string, node string"


def by_sql(rows):
    database = duckdb.connect()
    database.execute(
        "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)"
    )
    if rows:
        database.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    cursor = database.execute(merkle.OP13_SQL)
    names = [column[0] for column in cursor.description]
    return sorted((tuple(cell(v) for v in row) for row in cursor.fetchall()), key=str), names


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1)


def check(spark, rows, levels):
    want, names = by_sql(rows)
    frame = spark.createDataFrame([(*row, "a", "b", "c") for row in rows], SCHEMA)
    got = merkle.verified(merkle.manifest(frame, tampered(), levels)).select(*names).collect()
    assert sorted((tuple(cell(v) for v in row) for row in got), key=str) == want
    return got


def documents(count):
    rows = []
    for doc in range(count):
        lang = [None, "en", "de", "", "\u8a9e", "en", "en"][doc % 7] if doc % 11 else f"l{doc % 5}"
        text = [None, "", "x" * doc, "\u00e9\n \U0001f600", "same"][doc % 5]
        rows.append((doc * 31 % 1009, text, lang, None if doc % 3 else f"s{doc}", None if doc % 4 == 0 else doc))
    return rows


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(spark, levels):
    # Missing and repeated ids, and rows that are the same in everything.
    rows = documents(240) + [(None, "no id", "en", None, 3), (None, None, None, None, None)]
    rows += [rows[5]] * 9 + [(7, "other", "en", "s", 1), (7, "other", None, "s", 1)]
    found = check(spark, rows, levels)
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5])
def test_few_documents(spark, count):
    check(spark, [(doc, "a", "en", "s", 1) for doc in range(count)], 1)


def test_long_text(spark):
    check(spark, [(1, "\u00e9" * 300_000, "en", "s", 1), (2, None, "en", "s", 1)], 10)


def test_only_changed_documents_fail(spark):
    found = check(spark, [(doc, f"text {doc}", "en", "s", doc) for doc in range(100)], 3)
    import zlib

    for row in found:
        assert row["verified"] == (zlib.crc32(str(row["doc_id"]).encode()) % 7 != 0)


def test_appended_leaves_keep_their_witness_up_to_a_closed_subtree():
    nodes = [bytes([i]) * 32 for i in range(13)]
    for count in range(1, 14):
        forest = merkle.Forest()
        for node in nodes[:count]:
            forest.append(node)
        kept = [bytes(w) for w in forest.witnesses]
        root = forest.finish(None)
        for node, before, witness in zip(nodes, kept, forest.witnesses):
            assert bytes(witness).startswith(before)
            assert merkle.fold(node, bytes(witness)) == root
