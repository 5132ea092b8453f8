import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use within.
        T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("keep", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)


@pytest.fixture
def table(spark):
    """A table of documents with extra columns, from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = [
            (row[0], row[1], row[2] if len(row) > 2 else None, None, None, "a", None, "b", "c", "d")
            for row in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


#: Missing, empty and blank texts, a very long one, repeated rows, and a missing id.
ODD = [
    (None, "no id at all here, but a text"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n \t "),
    (4, "the same text twice over, word for word and line for line"),
    (4, "the same text twice over, word for word and line for line"),
    (5, "one two"),
    (6, "word " * 60_000),
    (7, "x" * 100_000),
    (8, "<|endoftext|> \0 é 語 \U0001f600"),
    (9, "the same text twice over, word for word and line for line"),
]


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture
def empty(table):
    return table([])
