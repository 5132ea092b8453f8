"""Registered queries on the smallest tables: their SQL, or the columns and rows they promise."""

import pytest

import __spark_entry__ as entry
from compare import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_katz_backoff": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_spotsigs": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op8_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op10_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op1_minhash_near_dedup": {"doc_id", "class_id"},
    "op2_benchmark_decontamination": {"doc_id", "item_id", "score"},
    "op11_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op12_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op13_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
}


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    frame = entry.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(frame.columns)
    names, rows = spark_rows(frame)
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op10_best_fit_packing":
        assert sum(rows.values()) >= documents
    elif name == "op12_conversation_repair":
        conversations = spark.read.parquet(f"{SF}/conversations.parquet")
        assert sum(rows.values()) == conversations.select("conv_id").distinct().count()
    elif name != "op2_benchmark_decontamination":
        assert sum(rows.values()) == documents
    if name in entry.oracle_sql():
        expected_names, expected = duck_rows(connection(SF), entry.oracle_sql()[name])
        assert (names, rows) == (expected_names, expected)
