"""Averages by calendar part, and totals over entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_label, first_of_month, month_label
from tidemark.functions.scalars import name
from tidemark.operators.common import require

PARTS = {
    "month": F.month,
    "day_of_week": F.weekday,
    "year": F.year,
    "quarter": F.quarter,
}


def _part(part: str, time: str) -> Column:
    if part not in PARTS:
        raise ValueError(f"unknown calendar part {part!r}; use one of {sorted(PARTS)}")
    return PARTS[part](name(time)).alias(part)


def mean_by_part(df: DataFrame, time: str, value: str, *parts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the value per calendar part (or combination of parts), with readable labels."""
    require(df, time, value, *keys)
    groups = [*[name(k) for k in keys], *[_part(p, time) for p in parts]]
    out = df.groupBy(*groups).agg(F.avg(name(value)).alias("mean"), F.count(name(value)).alias("count"))
    if "month" in parts:
        out = out.withColumn("month_label", month_label(F.col("month")))
    if "day_of_week" in parts:
        out = out.withColumn("day_label", day_label(F.col("day_of_week")))
    if "month" in parts and "year" in parts:
        out = out.withColumn("month_start", first_of_month(F.col("year"), F.col("month")))
    return out


def pivot_weekday_month(df: DataFrame, time: str, value: str) -> DataFrame:
    """Mean by weekday (rows) and month (columns ``m1`` .. ``m12``); the columns are known up front."""
    cells = [F.avg(F.when(F.month(name(time)) == m, name(value))).alias(f"m{m}") for m in range(1, 13)]
    return df.groupBy(F.weekday(name(time)).alias("day_of_week")).agg(*cells)


def seasonal_plot(series: DataFrame, time: str, value: str) -> DataFrame:
    """Every value with its year and month: one line per year over the months."""
    return series.select(F.year(name(time)).alias("year"), F.month(name(time)).alias("month"), name(time), name(value))


def daily_over_entities(
    df: DataFrame,
    *,
    date: str,
    entity: str,
    sums: Sequence[str],
    null_safe_sums: Sequence[str] = (),
    firsts: Sequence[str] = (),
    chosen: object = None,
) -> DataFrame:
    """One row per date over all entities (entity 0), or over the ``chosen`` one.

    ``firsts`` come from the row with the smallest entity on that date.
    """
    require(df, date, entity, *sums, *null_safe_sums, *firsts)
    rows = df if chosen is None else df.filter(name(entity) == F.lit(chosen))
    out = rows.groupBy(name(date)).agg(
        *[F.sum(name(c)).alias(c) for c in sums],
        *[F.sum(F.coalesce(name(c), F.lit(0))).alias(c) for c in null_safe_sums],
        *[F.min_by(name(c), F.struct(name(entity), name(c))).alias(c) for c in firsts],
    )
    return out.withColumn(entity, F.lit(0 if chosen is None else chosen).cast("bigint"))
