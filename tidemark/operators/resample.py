"""Bucketing to coarser periods, regular grids and future grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import period_start
from tidemark.functions.scalars import name
from tidemark.operators.common import aggregate, attach, join_keys, ordered, require

STEPS = {
    "hour": "INTERVAL 1 HOUR",
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAY",
    "iso_week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "month_end": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 1 YEAR",
}


def resample(
    df: DataFrame, time: str, values: Sequence[str], freq: str, *, fns: Sequence[str] = ("sum",), keys: Sequence[str] = ()
) -> DataFrame:
    """Aggregate to calendar periods: ``keys..., period, <value>_<fn>..., _count``."""
    require(df, time, *values, *keys)
    rows = df.filter(name(time).isNotNull())
    cells = [aggregate(fn, name(v)).alias(f"{v}_{fn}") for v in values for fn in fns]
    return rows.groupBy(*[name(k) for k in keys], period_start(name(time), freq).alias("period")).agg(
        *cells, F.count(F.lit(1)).alias("_count")
    )


def resample_days(
    df: DataFrame, time: str, values: Sequence[str], days: int = 7, *, fns: Sequence[str] = ("sum", "mean"), keys: Sequence[str] = ()
) -> DataFrame:
    """Fixed bins of ``days`` days counted from the first date of each key."""
    require(df, time, *values, *keys)
    rows = attach(df.filter(name(time).isNotNull()), {"__first": F.min(F.to_date(name(time)))}, keys)
    bin_no = F.floor(F.datediff(F.to_date(name(time)), F.col("__first")) / days).cast("int")
    label = F.date_add(F.col("__first"), bin_no * days).alias("period")
    cells = [aggregate(fn, name(v)).alias(f"{v}_{fn}") for v in values for fn in fns]
    return rows.groupBy(*[name(k) for k in keys], label).agg(*cells, F.count(F.lit(1)).alias("_count"))


def _steps(first: Column, last: Column, freq: str) -> Column:
    if freq == "month_end":
        # Steps from a short month would miss the ends of longer ones.
        return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr(STEPS[freq])), F.last_day)
    return F.sequence(first, last, F.expr(STEPS[freq]))


def regular_grid(series: DataFrame, time: str, keys: Sequence[str] = (), freq: str = "day") -> DataFrame:
    """The series with one row for every period between its first and last; new rows hold nulls."""
    require(series, time, *keys)
    ends = series.groupBy(*[name(k) for k in keys]).agg(F.min(name(time)).alias("__a"), F.max(name(time)).alias("__b"))
    grid = ends.select(*[name(k) for k in keys], F.explode(_steps(F.col("__a"), F.col("__b"), freq)).alias(time))
    return join_keys(grid, series, [*keys, time], "left")


def _steps_ahead(series: DataFrame, time: str, periods: int, keys: Sequence[str]) -> DataFrame:
    """The next dates by each key's most frequent gap; gaps of a calendar month, quarter or year step by months."""
    cols = [name(k) for k in keys]
    day = F.to_date(name(time))
    gap = F.datediff(day, F.lag(day).over(ordered(keys, time)))
    counted = series.select(*cols, day.alias("__d"), gap.alias("__g")).groupBy(*cols, "__g").agg(F.count("__g").alias("__n"), F.max("__d").alias("__m"))
    last = counted.groupBy(*cols).agg(F.max_by("__g", F.struct("__n", -F.col("__g"))).alias("__g"), F.max("__m").alias("__b"))
    out = last.select(*cols, "__b", F.coalesce("__g", F.lit(1)).alias("__g"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    months = F.when(F.col("__g").between(28, 31), 1).when(F.col("__g").between(90, 92), 3).when(F.col("__g").between(365, 366), 12)
    ahead = F.coalesce(F.add_months("__b", months * F.col("step")), F.date_add("__b", (F.col("__g") * F.col("step")).cast("int")))
    return out.select(*cols, "step", ahead.alias(time))


def future_grid(series: DataFrame, time: str, periods: int, keys: Sequence[str] = (), freq: str | None = "day") -> DataFrame:
    """The next ``periods`` periods after the last one: ``keys..., step, time``; ``freq=None`` infers dates from each key's gaps."""
    if freq is None:
        return _steps_ahead(series, time, periods, keys)
    last = series.groupBy(*[name(k) for k in keys]).agg(F.max(name(time)).alias("__b"))
    ahead = F.sequence(F.lit(1), F.lit(periods))
    out = last.select(*[name(k) for k in keys], "__b", F.explode(ahead).alias("step"))
    step = {
        "hour": F.col("__b") + F.make_interval(hours=F.col("step")),
        "day": F.date_add("__b", F.col("step")),
        "week": F.date_add("__b", F.col("step") * 7),
        "iso_week": F.date_add("__b", F.col("step") * 7),
        "month": F.add_months("__b", F.col("step")),
        "month_end": F.last_day(F.add_months("__b", F.col("step"))),
        "quarter": F.add_months("__b", F.col("step") * 3),
        "year": F.add_months("__b", F.col("step") * 12),
    }[freq]
    return out.select(*[name(k) for k in keys], "step", step.alias(time))
