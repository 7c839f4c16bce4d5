"""Queries of the subpackage over the given tables, and the SQL that checks them."""

from __future__ import annotations

from docweave.llm import centroids, chat, decontaminate, divergence, language_id, mixing, near_dup, pii, simhash, suffix_dedup, topk, warc, window_dedup

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_minhash_near_dedup": near_dup.query,
    "op4_exact_topk": topk.query,
    "op5_chat_format": chat.query,
    "op6_warc": warc.query,
    "op7_substring_dedup": window_dedup.query,
    "op8_pii_surrogates": pii.query,
    "op9_decontaminate": decontaminate.query,
    "op10_mixing": mixing.query,
    "op11_simhash_near_dedup": simhash.query,
    "op12_centroid_clustering": centroids.query,
    "op13_source_divergence": divergence.query,
}

ORACLES = {
    "op2_suffix_array_dedup": suffix_dedup.ORACLE,
    "op3_minhash_near_dedup": near_dup.ORACLE,
    "op4_exact_topk": topk.ORACLE,
    "op5_chat_format": chat.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_substring_dedup": window_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
