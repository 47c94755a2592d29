"""Named queries over the tables of a data folder, and the SQL that states the same."""

from __future__ import annotations

from importlib import import_module

MODULES = ["timestamps", "learning", "similarity", "coverage", "review", "history", "records", "streams"]
FLAGSHIP = "flagship_outcome_profile"


def _all(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"newsloom.plans.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
