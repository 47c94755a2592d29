"""Token expressions, all built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_list(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(WORD), F.lit(0))


def word_set(text: Column | str) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(word_list(text))


def token_set(text: Column | str, pattern: str, ascii_lower: bool = True) -> Column:
    """Distinct matches of a pattern in the lower-cased text; null text gives an empty array."""
    x = F.coalesce(_c(text), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(F.lower(x) if ascii_lower else x, F.lit(pattern), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements of two distinct arrays; two empty arrays give 0."""
    inter = F.size(F.array_intersect(a, b))
    return inter / F.greatest(F.lit(1), F.size(a) + F.size(b) - inter)
