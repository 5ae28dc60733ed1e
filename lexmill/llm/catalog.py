"""Queries of this subpackage, with SQL where SQL can state the result."""

from __future__ import annotations

from importlib import import_module

#: query name: module
MODULES = {
    "op1_chat_formatting": "chat",
    "op1_chat_transcripts": "chat",
    "op2_pattern_packing": "packing",
    "op3_url_filters": "url_filter",
    "op4_language_id": "language_id",
    "op4_language_id_pages": "language_id",
    "op5_quality": "quality",
    "op6_jaccard_join": "jaccard_join",
    "op7_backoff_lm": "backoff_lm",
    "op8_decontamination": "decontaminate",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_exact_topk": "topk",
    "op11_fill_in_middle": "fill_middle",
    "op12_vp_neighbours": "vp_trees",
    "op13_importance_resampling": "resample",
}


def queries() -> dict:
    return {name: getattr(import_module(f"lexmill.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: sql for name, module in MODULES.items() if (sql := import_module(f"lexmill.llm.{module}").SQL)}
    return found | {"op1_chat_transcripts": import_module("lexmill.llm.chat").TRANSCRIPTS_SQL}
