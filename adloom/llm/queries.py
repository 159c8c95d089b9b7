"""Queries of this folder and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import chat_format, decontaminate, lexical_search, merkle, packing, pii, quality_model, quality_rules, simhash, suffix_dedup, token_counts, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_quality_classifier": quality_model.op9_quality_classifier,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_pii": pii.op11_pii,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op3_chat_format": chat_format.ORACLE,
        "op5_decontamination": decontaminate.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op12_merkle_manifest": merkle.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
    }
