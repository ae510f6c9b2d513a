"""Operators for training text. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("lookalike", "noise", "truncation", "personal", "languages", "tokens", "packing", "splitting")


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"leafscan.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"leafscan.llm.{m}").ORACLE.items()}
