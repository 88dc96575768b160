"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from brindle.llm import chat_format, embedding_itq, exact_dedup, line_dedup, ngram_join, packing, quality_qda, secret_scan, source_mix, substring_dedup

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_chat_format": chat_format.query,
    "op3_source_mix": source_mix.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_qda": quality_qda.query,
    "op6_embedding_itq": embedding_itq.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_secret_scan": secret_scan.query,
    "op9_line_dedup": line_dedup.query,
    "op10_best_fit_packing": packing.query,
}
ORACLES = {
    "op2_chat_format": chat_format.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_secret_scan": secret_scan.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
