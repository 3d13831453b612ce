"""Filtered, sorted, paged and aggregated reads of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import conditions
from tidemark.functions.scalars import name
from tidemark.operators.common import aggregate, require

PAGE = 1000


def filter_rows(df: DataFrame, filters: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    return df.filter(conditions(filters, df.columns))


def entity_rows(df: DataFrame, key: str, entity: Any = None) -> DataFrame:
    """Rows of one entity, or all rows when no entity is chosen."""
    require(df, key)
    return df if entity is None else df.filter(name(key) == F.lit(entity))


def sort_rows(df: DataFrame, by: str, *, descending: bool = False, unique: Sequence[str] = ()) -> DataFrame:
    """Distributed sort, nulls last in both directions; ``unique`` columns settle ties."""
    require(df, by, *unique)
    first = name(by).desc_nulls_last() if descending else name(by).asc_nulls_last()
    return df.orderBy(first, *[name(c).asc_nulls_last() for c in unique])


def _behind(columns: Sequence[str], values: Sequence[Any], falling: Sequence[bool]) -> Column:
    """Rows that sort after the given values; nulls are last in both directions."""
    behind, same = F.lit(False), F.lit(True)
    for column, value, down in zip(columns, values, falling, strict=True):
        c = name(column)
        if value is not None:
            behind = behind | (same & (c.isNull() | (c < F.lit(value) if down else c > F.lit(value))))
        same = same & c.eqNullSafe(F.lit(value))
    first = name(columns[0])
    if values[0] is None:
        return first.isNull() & behind
    # The bound on the first column alone is what the scan can use.
    return (first.isNull() | (first <= F.lit(values[0]) if falling[0] else first >= F.lit(values[0]))) & behind


def page(
    df: DataFrame,
    by: str,
    *,
    descending: bool = False,
    unique: Sequence[str] = (),
    limit: int = PAGE,
    offset: int = 0,
    after: Any = None,
) -> DataFrame:
    """One page of a sorted table.

    ``after`` continues behind a row: its values of ``by`` and all ``unique`` columns, in this order (a single
    value without ``unique``, which then must be free of ties). Null values are part of the order. It is a
    filter that reaches the scan, so a deep page costs no more than the first; ``offset`` has to rank all rows before.
    """
    if after is not None:
        values = list(after) if isinstance(after, (list, tuple)) else [after]
        if len(values) != 1 + len(unique):
            raise ValueError("a page continues behind one value of the sort column and of each unique column")
        df = df.filter(_behind([by, *unique], values, [descending, *[False] * len(unique)]))
    out = sort_rows(df, by, descending=descending, unique=unique)
    return (out.offset(offset) if offset else out).limit(limit)


def total_by_date(
    df: DataFrame,
    *,
    date: str,
    target: str,
    filters: Mapping[str, Mapping[str, Any]] | None = None,
    fn: str = "sum",
) -> DataFrame:
    """``date, target`` aggregated over the filtered rows, before sorting and paging."""
    require(df, date, target)
    return filter_rows(df, filters).groupBy(name(date).alias(date)).agg(aggregate(fn, name(target)).alias(target))


def row_counts(df: DataFrame, filters: Mapping[str, Mapping[str, Any]] | None = None, *, aggregated: bool = False) -> DataFrame:
    """``total_rows, filtered_rows, aggregated`` in one pass; counted before any paging."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(conditions(filters, df.columns)).alias("filtered_rows"),
        F.lit(aggregated).alias("aggregated"),
    )


def group_values(df: DataFrame, key: str, value: str, fn: str = "mean") -> DataFrame:
    require(df, key, value)
    return df.groupBy(name(key).alias(key)).agg(aggregate(fn, name(value)).alias(value))


def custom_sql(df: DataFrame, statement: str, view: str = "parquet_data") -> DataFrame:
    """Run a SELECT over the table, visible under ``view``."""
    if not statement.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are allowed")
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(statement)


def top_by_magnitude(df: DataFrame, value: str, k: int = 10, *, unique: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest absolute value."""
    return df.orderBy(F.abs(name(value)).desc_nulls_last(), *[name(c) for c in unique]).limit(k)


def head_and_tail(df: DataFrame, by: str, k: int, *, unique: Sequence[str] = ()) -> DataFrame:
    """First and last k rows of a sorted table, marked in ``part``."""
    ties = [name(c) for c in unique]
    head = df.orderBy(name(by).asc_nulls_last(), *ties).limit(k).withColumn("part", F.lit("head"))
    tail = df.orderBy(name(by).desc_nulls_last(), *[t.desc() for t in ties]).limit(k).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
