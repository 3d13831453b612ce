"""Scalar cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(column: str) -> Column:
    """A column reference that is safe for names with dots, blanks or back-ticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def log_abs(value: Column) -> Column:
    return F.ln(F.nullif(F.abs(value), F.lit(0.0)))


def to_number(value: Column, default: float = 0.0) -> Column:
    """Numeric coercion in which everything that is not a number becomes ``default``."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(number)


def finite(value: Column, default: float = 0.0) -> Column:
    """NaN and both infinities become ``default``; null stays null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(value)


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0).cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)
