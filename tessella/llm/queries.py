"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, collocation, language, linededup, media, mixing, ngram_join, passages, quality, sanitise, secrets, topk_search, vector_codes

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": language.op2_language_id,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_media_columns": media.op6_media_columns,
    "op7_quality_classifier": passages.op7_quality_classifier,
    "op8_pii": sanitise.op8_pii,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_phrase_mining": collocation.op11_phrase_mining,
    "op12_exact_topk": topk_search.op12_exact_topk,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op11_phrase_mining": collocation.ORACLE,
    "op12_exact_topk": topk_search.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
