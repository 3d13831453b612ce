"""Column discovery: which column is the time, which the target, which are usable features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import numeric_columns, require

# Words that mark a column name as a date.
DATE_WORDS = ["date", "time", "timestamp", "datetime", "day", "month", "year"]
# Name patterns of bookkeeping timestamps.
STAMP_NAMES = ["created_at", "timestamp"]
STAMP_PARTS = ["_at", "date", "time"]


def column_types(df: DataFrame) -> DataFrame:
    """``position, column, dtype``."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def detect_date_columns(df: DataFrame, sample: Column | None = None) -> DataFrame:
    """``column, rows, score, is_date`` over the rows chosen by ``sample`` (all rows by default).

    A row scores one point for a telling column name and one for a value that is or parses as a
    date; a column qualifies with at least half a point per row.
    """
    rows = df if sample is None else df.filter(sample)

    def score(f: T.StructField) -> Column:
        c = name(f.name)
        hint = any(w in f.name.lower() for w in DATE_WORDS)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fits = c.isNotNull()
        elif isinstance(f.dataType, T.StringType):
            fits = F.try_to_timestamp(c).isNotNull()
        else:
            fits = F.lit(False)
        points = F.count_if(fits) + (F.count(F.lit(1)) if hint else F.lit(0))
        return F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), points.cast("bigint").alias("score"))

    table = rows.agg(F.array(*[score(f) for f in df.schema.fields]).alias("s")).select(F.inline("s"))
    return table.withColumn("is_date", (F.col("rows") > 0) & (F.col("score") >= F.ceil(F.col("rows") / 2)))


def detect_target(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The numeric column with the largest variance, as ``column, variance``."""
    columns = [c for c in numeric_columns(df) if c not in exclude]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.var_samp(name(c)).alias("variance")) for c in columns])
    table = df.agg(entries.alias("s")).select(F.inline("s"))
    return table.orderBy(F.col("variance").desc_nulls_last(), "column").limit(1)


def numeric_and_boolean(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    require(df, *keep)
    wanted = [f.name for f in df.schema.fields if f.name in keep or isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return df.select(*[name(c) for c in wanted])


def without_columns(df: DataFrame, exclude: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns, but never the ones in ``keep`` (date and target)."""
    require(df, *keep)
    return df.drop(*[c for c in exclude if c not in keep])


def only_columns(df: DataFrame, include: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    require(df, *keep)
    return df.select(*[name(c) for c in df.columns if c in include or c in keep])


def is_stamp_name(column: str) -> bool:
    low = column.lower()
    return low in STAMP_NAMES or any(p in low for p in STAMP_PARTS)


def feature_columns(df: DataFrame, core: Sequence[str], *, date: str, target: str) -> DataFrame:
    """Date, target and the allowed core features; bookkeeping timestamps never pass."""
    return only_columns(df, [c for c in core if not is_stamp_name(c)], keep=[date, target])


def rename_columns(df: DataFrame, names: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    require(df, *names, *drop)
    return df.withColumnsRenamed(names).drop(*drop)
