"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import html_extract, importance_resampling, knn_join, language_id, media, ngram_join, pieces, secret_scan, source_mixing, substring_dedup, suffix_dedup, token_counts, whitening

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_knn_join": knn_join.query,
    "op3_media_columns": media.query,
    "op4_ngram_join": ngram_join.query,
    "op5_html_extract": html_extract.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_language_id": language_id.query,
    "op8_secret_scan": secret_scan.query,
    "op9_token_counts": token_counts.query,
    "op10_source_mixing": source_mixing.query,
    "op11_importance_resampling": importance_resampling.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_embedding_whitening": whitening.query,
}

SQL = {
    "op2_knn_join": knn_join.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_source_mixing": source_mixing.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
    "op12_suffix_dedup": suffix_dedup.SQL,
}
