"""Queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["spans_queries", "pack_queries", "docpairs_queries", "defects_queries", "secrets_queries", "parse_queries", "origin_queries", "mix_queries"]


def _modules() -> list:
    return [importlib.import_module(f"codeloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.oracle_sql().items()}
