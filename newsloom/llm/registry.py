"""Queries of the subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["capping", "lines", "truncation", "leakage", "neardup", "encoding", "names", "history", "mixing"]


def _all(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"newsloom.llm.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
