"""Window features of a series table (one row per key and period, see :mod:`common`)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.common import ordered, whole


def lags(series: DataFrame, time: str, value: str, steps: Sequence[int] = (1, 7, 30), keys: Sequence[str] = ()) -> DataFrame:
    w = ordered(keys, time)
    return series.withColumns({f"lag_{k}": F.lag(name(value), k).over(w) for k in steps})


def percent_changes(series: DataFrame, time: str, value: str, steps: Sequence[int] = (1, 7, 30), keys: Sequence[str] = ()) -> DataFrame:
    """Relative change over k periods; null where the earlier value is missing or zero."""
    w = ordered(keys, time)
    v = name(value)
    return series.withColumns(
        {f"pct_change_{k}": F.try_divide(v - F.lag(v, k).over(w), F.lag(v, k).over(w)) for k in steps}
    )


def rolling(series: DataFrame, time: str, value: str, sizes: Sequence[int] = (7, 14, 30), keys: Sequence[str] = ()) -> DataFrame:
    """Rolling mean and sample standard deviation; null until the window holds ``size`` values."""
    out = {}
    for size in sizes:
        frame = ordered(keys, time).rowsBetween(1 - size, 0)
        full = F.count(name(value)).over(frame) == size
        out[f"rolling_mean_{size}"] = F.when(full, F.avg(name(value)).over(frame))
        out[f"rolling_std_{size}"] = F.when(full, F.stddev_samp(name(value)).over(frame))
    return series.withColumns(out)


def expanding_mean(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    frame = ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("expanding_mean", F.avg(name(value)).over(frame))


def short_trend(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sign of the change over two steps: 1, 0 or -1."""
    change = name(value) - F.lag(name(value), 2).over(ordered(keys, time))
    return series.withColumn("short_trend", F.signum(change).cast("int"))


def positions(series: DataFrame, time: str, keys: Sequence[str] = (), out: str = "position") -> DataFrame:
    """0-based row position within the series."""
    return series.withColumn(out, F.row_number().over(ordered(keys, time)) - 1)


def fourier_terms(
    series: DataFrame, time: str, keys: Sequence[str] = (), periods: Sequence[float] = (6, 12), orders: Sequence[int] = (1, 2)
) -> DataFrame:
    out = positions(series, time, keys)
    waves = {}
    for p in periods:
        for k in orders:
            angle = F.col("position") * F.lit(2.0 * math.pi * k / p)
            waves[f"sin_{p}_{k}"] = F.sin(angle)
            waves[f"cos_{p}_{k}"] = F.cos(angle)
    return out.withColumns(waves)


def shifted(series: DataFrame, time: str, columns: Sequence[str], steps: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Components moved by ``steps`` rows: positive steps look back, negative ones ahead."""
    w = ordered(keys, time)
    moved = {}
    for c in columns:
        for k in steps:
            moved[f"{c}_shift_{k}" if k >= 0 else f"{c}_shift_m{-k}"] = F.lag(name(c), k).over(w)
    return series.withColumns(moved)


def difference(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), order: int = 1) -> DataFrame:
    """Differences of the given order, each step starting with 0."""
    out, previous = series, value
    for i in range(1, order + 1):
        c = name(previous)
        out = out.withColumn(f"diff_{i}", F.coalesce(c - F.lag(c).over(ordered(keys, time)), F.lit(0.0)))
        previous = f"diff_{i}"
    return out


def forward_fill(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    frame = ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(out or value, F.last(name(value), ignorenulls=True).over(frame))


def interpolate(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Linear by row position; after the last value it is carried on, before the first stays null."""
    w = ordered(keys, time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = name(value)
    rows = series.withColumn("__r", F.row_number().over(w))
    at = F.when(v.isNotNull(), F.col("__r"))
    rows = rows.withColumns(
        {
            "__v0": F.last(v, ignorenulls=True).over(back),
            "__r0": F.last(at, ignorenulls=True).over(back),
            "__v1": F.first(v, ignorenulls=True).over(ahead),
            "__r1": F.first(at, ignorenulls=True).over(ahead),
        }
    )
    share = (F.col("__r") - F.col("__r0")) / (F.col("__r1") - F.col("__r0"))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share
    filled = F.when(v.isNotNull(), v).when(F.col("__v0").isNull(), None).when(F.col("__v1").isNull(), F.col("__v0")).otherwise(line)
    return rows.withColumn(out or value, filled).drop("__r", "__v0", "__r0", "__v1", "__r1")


def smooth_centered(series: DataFrame, time: str, value: str, size: int = 7, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Centred mean of the positive values around each row; a zero (closed day) stays zero."""
    half = size // 2
    frame = ordered(keys, time).rowsBetween(-half, half)
    v = F.coalesce(name(value), F.lit(0.0))
    mean = F.avg(F.when(v > 0, v)).over(frame)
    return series.withColumn(out or f"{value}_smoothed", F.when(v == 0, F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0))))


def split_tail(series: DataFrame, time: str, keys: Sequence[str] = (), *, share: float = 0.2, at_most: int | None = 30) -> DataFrame:
    """Mark the last rows of each series ``test`` and the rest ``train``; adds ``position`` and ``points``."""
    n = F.count(F.lit(1)).over(whole(keys))
    out = positions(series, time, keys).withColumn("points", n)
    size = F.floor(F.col("points") * share).cast("int")
    if at_most is not None:
        size = F.least(size, F.lit(at_most))
    return out.withColumn("split", F.when(F.col("position") >= F.col("points") - size, "test").otherwise("train"))


def cv_folds(series: DataFrame, time: str, keys: Sequence[str] = (), folds: int = 3, *, constant_size: bool = False) -> DataFrame:
    """Expanding-window folds: each row once per fold it takes part in, marked train or test."""
    rows = positions(series, time, keys).withColumn("points", F.count(F.lit(1)).over(whole(keys)))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    m = F.floor(F.col("points") / (folds + 1))
    start = F.col("points") - (F.lit(folds) - F.col("fold")) * m
    first = (start - m) if constant_size else F.lit(0)
    role = F.when((F.col("position") >= start) & (F.col("position") < start + m), "test").when(
        (F.col("position") < start) & (F.col("position") >= first), "train"
    )
    return rows.withColumn("role", role).filter("role is not null")


def flagged_runs(series: DataFrame, time: str, flag: Column, keys: Sequence[str] = (), *, at_least: int = 2) -> DataFrame:
    """Rows of runs of consecutive flagged points, with a run number ``run`` per series."""
    w = ordered(keys, time)
    marked = series.withColumn("__f", F.coalesce(flag.cast("int"), F.lit(0)))
    marked = marked.withColumn("run", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.filter("__f = 1").drop("__f")
    size = F.count(F.lit(1)).over(whole([*keys, "run"]))
    return runs.withColumn("run_length", size).filter(F.col("run_length") >= at_least)


def lookback(series: DataFrame, time: str, value: str, size: int = 52, keys: Sequence[str] = ()) -> DataFrame:
    """``x`` = array of the ``size`` values before each row; rows without a full history drop out."""
    frame = ordered(keys, time).rowsBetween(-size, -1)
    out = series.withColumn("x", F.collect_list(name(value)).over(frame))
    return out.filter(F.size("x") == size)


def feature_table(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """All lag, change, rolling, expanding, trend and Fourier features; one shuffle serves them all."""
    out = percent_changes(lags(series, time, value, keys=keys), time, value, keys=keys)
    out = expanding_mean(rolling(out, time, value, keys=keys), time, value, keys=keys)
    return fourier_terms(short_trend(out, time, value, keys=keys), time, keys=keys)
