"""Shared helpers: name checks, key joins, aggregates attached to rows, the series table.

Design rule of the package: windows never run over raw rows of unknown number. Raw rows are first
aggregated to one row per (key, period) by :func:`to_series`; a key then has as many rows as the
calendar has periods, however hot the key is. Raw rows that must keep their own timestamps go
through :mod:`tidemark.operators.blocks`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import period_start
from tidemark.functions.scalars import name
from tidemark.session import cut_lineage

# Rows of a per-key table that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 100_000

AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {df.columns}")


def aggregate(fn: str, column: Column) -> Column:
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fn!r}; use one of {sorted(AGGREGATES)}")
    return AGGREGATES[fn](column)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def ordered(keys: Sequence[str], time: str) -> WindowSpec:
    """One series per partition, in time order."""
    return Window.partitionBy(*[name(k) for k in keys]).orderBy(name(time).asc_nulls_last())


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[name(k) for k in keys])


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right copies of the keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [name(k).eqNullSafe(name(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def small(table: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """Store a per-key table and mark it for broadcast if its counted rows are few; else Spark decides.

    Joining the raw table with a broadcast side moves none of its rows, however hot a key is.
    """
    stored = cut_lineage(table)
    return F.broadcast(stored) if stored.count() <= at_most else stored


def tasks_for(df: DataFrame, rows_per_task: int = 1_000_000) -> int:
    """Partitions for work that is heavy per row: all cores are busy, and no task has more rows than that on average."""
    session = df.sparkSession
    least = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-df.count() // rows_per_task))


def attach(df: DataFrame, stats: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Add per-key aggregates of the rows as columns, for raw tables.

    Without keys the aggregates are one scalar subquery. With keys they are aggregated map-side,
    stored, and joined back, broadcast if there are few keys. Rows never gather by key in a window.
    """
    if keys:
        table = df.groupBy(*[name(k) for k in keys]).agg(*[c.alias(n) for n, c in stats.items()])
        return join_keys(df, small(table), keys, "left")
    packed = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("__stats"))
    out = df.withColumn("__stats", packed.scalar())
    return out.withColumns({n: F.col(f"__stats.`{n}`") for n in stats}).drop("__stats")


def attach_series(series: DataFrame, stats: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """The same for a series table, whose keys are short: windows that share the shuffle of their neighbours."""
    every = whole(keys)
    return series.withColumns({n: c.over(every) for n, c in stats.items()})


def to_series(
    df: DataFrame,
    *,
    time: str,
    value: str,
    keys: Sequence[str] = (),
    freq: str = "day",
    fn: str = "sum",
    digits: int | None = None,
) -> DataFrame:
    """One row per (key, period): columns ``keys..., time, value``.

    ``digits`` rounds the aggregate, which makes totals of money columns independent of the order
    in which the partial sums arrive.
    """
    require(df, time, value, *keys)
    total = aggregate(fn, name(value))
    if digits is not None:
        total = F.round(total, digits)
    grouped = df.filter(name(time).isNotNull()).groupBy(
        *[name(k) for k in keys], period_start(name(time), freq).alias(time)
    )
    return grouped.agg(total.alias(value))


def bounded(series: DataFrame, keys: Sequence[str], max_points: int) -> DataFrame:
    """Stop with a clear error before a series of more than ``max_points`` rows reaches Python.

    With keys the count is a spilling window on the partitioning the grouped step needs anyway;
    without keys it is a scalar subquery, known before any row moves.
    """
    limit = F.assert_true(
        F.col("__points") <= max_points,
        F.lit(f"a series has more than {max_points} points; aggregate it to a coarser period first"),
    )
    points = {"__points": F.count(F.lit(1))}
    checked = attach_series(series, points, keys) if keys else attach(series, points)
    return checked.filter(limit.isNull()).drop("__points")


def stack_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], label: str, value: str, kind: str) -> DataFrame:
    """Wide to long, all values cast to ``kind``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), name(c).cast(kind).alias("v")) for c in columns])
    long = df.select(*[name(i) for i in ids], F.explode(pairs).alias("__p"))
    return long.select(*[name(i) for i in ids], F.col("__p.k").alias(label), F.col("__p.v").alias(value))
