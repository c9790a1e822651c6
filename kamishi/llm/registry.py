"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from . import alignment, chat, decontamination, filter_audit, fm_dedup, langid, line_dedup, near_dedup, packing, quality, search, suffix_dedup, unigram

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_sentencepiece": unigram.op2,
    "op3_topk_search": search.op3,
    "op4_substring_dedup": fm_dedup.op4,
    "op5_chat_formatting": chat.op5,
    "op6_suffix_array_dedup": suffix_dedup.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_language_id": langid.op9,
    "op10_minhash_near_dedup": near_dedup.op10,
    "op11_decontamination": decontamination.op11,
    "op12_alignment": alignment.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op3_topk_search": search.ORACLE,
    "op4_substring_dedup": fm_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_suffix_array_dedup": suffix_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_minhash_near_dedup": near_dedup.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
