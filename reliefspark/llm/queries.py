"""The queries of this subpackage and the SQL that DuckDB runs for those which SQL can express."""

from __future__ import annotations

from reliefspark.llm import centroids, chat_format, exact_dedup, html_extract, language_id, merkle, mixing, ngram_join, packing, quality, token_counts, topk, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_id": language_id.op8_language_id,
    "op9_topk": topk.op9_topk,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_merkle": merkle.op11_merkle,
    "op12_centroids": centroids.op12_centroids,
    "op13_html": html_extract.op13_html,
}

SQL = {
    "op3_chat_format": chat_format.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op9_topk": topk.SQL,
    "op11_merkle": merkle.SQL,
    "op12_centroids": centroids.SQL,
}
