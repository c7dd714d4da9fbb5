"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this subpackage that defines it; its SQL, if any, is that module's SQL.
QUERIES = {
    "op1_suffix_array_dedup": "suffix_dedup",
    "op2_line_dedup": "line_dedup",
    "op3_minhash_near_dedup": "near_dedup",
    "op4_language_id": "language_id",
    "op5_url_filters": "url_filters",
    "op6_best_fit_packing": "packing",
    "op7_document_fingerprints": "fingerprints",
    "op8_quality_rules": "quality_rules",
    "op9_quality_classifier": "quality_classifier",
    "op10_mixing": "mixing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
