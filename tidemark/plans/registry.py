"""Named queries over the standard tables, each with the SQL it must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.common import to_series
from tidemark.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL twins of the stand-in series below.
DAILY = "s AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)"
PANEL = (
    "s AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d, "
    "round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Total order value per day: ``d, v``."""
    orders = table(spark, folder, "orders", ["o_orderdate", "o_totalprice"]).withColumnsRenamed({"o_orderdate": "d", "o_totalprice": "v"})
    return to_series(orders, time="d", value="v", digits=2)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Total order value per priority and day: ``k, d, v``."""
    orders = table(spark, folder, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"])
    orders = orders.withColumnsRenamed({"o_orderpriority": "k", "o_orderdate": "d", "o_totalprice": "v"})
    return to_series(orders, time="d", value="v", keys=["k"], digits=2)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round result columns so that engines with another order of additions print the same number."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Means of cents over 8, 16 or 52 rows often end in an exact half of the last printed digit; a fixed
# nudge before rounding keeps the last bit of the sum from deciding which way they go.
NUDGE = 0.0326781


def steady(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE * 10**-digits), digits) for c in columns})


def steady_sql(expression: str, digits: int) -> str:
    return f"round({expression} + {NUDGE * 10**-digits!r}::DOUBLE, {digits})"


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
