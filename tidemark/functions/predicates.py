"""Row predicates, built from plain Python values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import name

OPERATORS = {
    "=": lambda c, v: c == F.lit(v),
    "<>": lambda c, v: c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "LIKE": lambda c, v: c.cast("string").like(str(v)),
    "CONTAINS": lambda c, v: c.cast("string").contains(str(v)),
}


def conditions(filters: Mapping[str, Mapping[str, Any]] | None, columns: Iterable[str]) -> Column:
    """AND of ``{column: {"operator": op, "value": v}}``.

    A missing operator means ``=``; a condition without a value is skipped. Unknown columns and
    operators are errors, never silently dropped.
    """
    known = set(columns)
    parts = []
    for column, spec in (filters or {}).items():
        if column not in known:
            raise ValueError(f"filter on unknown column {column!r}")
        operator = str(spec.get("operator", "=")).upper()
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator!r}; use one of {sorted(OPERATORS)}")
        value = spec.get("value")
        if value is not None:
            parts.append(OPERATORS[operator](name(column), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_range(time: str, start: Any = None, end: Any = None) -> Column:
    """Both ends inclusive; stays a comparison on the bare column so that it reaches the scan."""
    column, parts = name(time), []
    if start is not None:
        parts.append(column >= F.lit(start))
    if end is not None:
        parts.append(column <= F.lit(end))
    return reduce(lambda a, b: a & b, parts, column.isNotNull())


def in_year(time: str, year: int) -> Column:
    """A whole calendar year as a half-open range on the bare column."""
    return (name(time) >= F.lit(date(year, 1, 1))) & (name(time) < F.lit(date(year + 1, 1, 1)))


def in_years(time: str, years: Iterable[int]) -> Column:
    return reduce(lambda a, b: a | b, [in_year(time, y) for y in years], F.lit(False))
