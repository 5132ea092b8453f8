"""The pipeline on the smallest tables: every stage against what its input says it must do."""

import pytest

import corpus_pipeline
from tallyreach.llm.packing import token_pieces
from tallyreach.llm.quality import quality_scores
from tallyreach.sources.storage import scratch_table
from test_lines_and_pairs import plain_classes, plain_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's name, input and output."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch_table(stage(spark, docs, SF), f"test-{name}")
        result[name] = (docs, out)
        docs = out
    return result


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.dtypes == before.dtypes
            assert 0 < after.count() <= before.count()


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    scores = quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    kept = {r["doc_id"] for r in scores if r["predicted"]}
    assert texts(after) == {d: t for d, t in texts(before).items() if d in kept}


def test_line_stage(stages):
    import hashlib

    before, after = stages["line_dedup"]
    expected = {d: digest for d, _, _, digest in plain_lines(list(texts(before).items()))}
    found = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts(after).items()}
    assert found == expected
    assert after.filter("n_chars <> length(text)").count() == 0


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    classes = plain_classes(list(texts(before).items()))
    assert set(texts(after)) == set(classes.values())


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, t in texts(before).items() if any(item in t.lower() for item in items)}
    assert held <= set(texts(before)) - set(texts(after))


def test_packing_stage(stages):
    import public_tokenizers

    before, after = stages["packing"]
    pieces = token_pieces(before, public_tokenizers.path("byte_bpe_50k.json")).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert {tuple(r[c] for c in columns) for r in pieces} == {tuple(r[c] for c in columns) for r in after.collect()}


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() == stages["packing"][1].count()


def test_stages_give_python_small_batches(spark):
    """Whole texts go to Python a few thousand at a time; a session that asks for fewer keeps its number."""
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = spark.conf.get(name)
    try:
        for before, most in (("10000", 2000), ("0", 2000), ("300", 300)):
            spark.conf.set(name, before)
            corpus_pipeline.packing_stage(spark, docs, SF)
            sizes = spark.range(5000, numPartitions=1).mapInArrow(counted, "n long").collect()
            assert sum(r["n"] for r in sizes) == 5000 and max(r["n"] for r in sizes) == most
    finally:
        spark.conf.set(name, given)
