"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

#: Module and query have the same name.
NAMES = [
    "op1_quality_rules",
    "op2_html_extraction",
    "op3_quality_classifier",
    "op4_license_scans",
    "op5_token_files",
    "op6_chat_formatting",
    "op7_benchmark_decontamination",
    "op8_ngram_jaccard_join",
    "op9_best_fit_packing",
    "op10_language_id",
    "op11_vector_codes",
    "op12_conversation_repair",
    "op13_substring_dedup",
]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{name}"), name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{name}"), "ORACLE_SQL", None) for name in NAMES}
    return {name: sql for name, sql in found.items() if sql}
