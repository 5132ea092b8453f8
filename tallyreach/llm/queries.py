"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyreach.llm import (
    conversations,
    decontamination,
    katz,
    language,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    personal_data,
    quality,
    simhash,
    spotsigs,
    token_files,
)

QUERIES = {
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op3_katz_backoff": katz.op3_katz_backoff,
    "op4_language_id": language.op4_language_id,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_spotsigs": spotsigs.op6_spotsigs,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_token_files": token_files.op8_token_files,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_simhash_near_dedup": simhash.op11_simhash_near_dedup,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
