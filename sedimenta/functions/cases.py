"""Flat CASE expressions; nested ones compile slowly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def case(pairs: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """First value whose condition holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return default if out is None else out.otherwise(default)


def sql_string(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_strings(values: Iterable[str]) -> str:
    """SQL array literal. Long constant tables are written as SQL text: one call instead of one per value."""
    return "cast(array(" + ", ".join(map(sql_string, values)) + ") as array<string>)"
