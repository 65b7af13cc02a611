"""Queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from factloom.llm import archives, decontamination, exact_topk, licences, near_dedup, packing, personal_data, resampling, suffix_dedup, url_lists

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_resampling": resampling.op3_resampling,
    "op4_personal_data": personal_data.op4_personal_data,
    "op5_url_lists": url_lists.op5_url_lists,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_legacy_archives": archives.op9_legacy_archives,
    "op10_exact_topk": exact_topk.op10_exact_topk,
}
ORACLE_SQL = {
    "op5_url_lists": url_lists.ORACLE,
    "op9_legacy_archives": archives.ORACLE,
    "op10_exact_topk": exact_topk.ORACLE,
}
