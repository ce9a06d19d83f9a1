"""Operators for training corpora. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("exact_dedup", "near_dedup", "license_scan", "line_dedup", "packing", "byte_bpe", "language_id", "quotation", "fingerprints", "token_counts", "conversation_repair", "decontaminate", "hard_negatives")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"kgloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"kgloom.llm.{m}").SQL.items()}
