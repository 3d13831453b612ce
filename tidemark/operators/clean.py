"""Normalising, filling, scaling and encoding of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name, nan_to_null
from tidemark.operators.common import attach, require
from tidemark.operators.windows import forward_fill, interpolate


def normalize_for_storage(df: DataFrame) -> DataFrame:
    """Numbers without nulls (0), everything that is not number, boolean or time as text without nulls ('')."""
    out = []
    for f in df.schema.fields:
        c = name(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.coalesce(nan_to_null(c), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif not isinstance(f.dataType, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def fill_constant(df: DataFrame, column: str, constant: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, F.coalesce(name(column), F.lit(constant)))


def fill_mean(df: DataFrame, column: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    filled = attach(df, {"__mean": F.avg(name(column))}, keys)
    return filled.withColumn(out or column, F.coalesce(name(column), F.col("__mean"))).drop("__mean")


def fill_all_ways(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The four fill strategies next to each other: constant 0, mean, forward, linear."""
    out = fill_constant(series, value, 0.0, "fill_zero")
    out = fill_mean(out, value, keys, "fill_mean")
    out = forward_fill(out, time, value, keys, "fill_forward")
    return interpolate(out, time, value, keys, "fill_linear")


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def drop_report(df: DataFrame) -> DataFrame:
    """``kept, total, share``: what dropping incomplete rows would leave."""
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & name(c).isNotNull()
    counts = df.agg(F.count_if(complete).alias("kept"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("share", F.try_divide(F.col("kept"), F.col("total")))


def zscore(df: DataFrame, column: str, keys: Sequence[str] = (), *, limit: float = 2.0) -> DataFrame:
    """``<column>_zscore`` (sample deviation) and a 0/1 flag for values beyond the limit."""
    out = attach(df, {"__m": F.avg(name(column)), "__s": F.stddev_samp(name(column))}, keys)
    z = F.try_divide(name(column) - F.col("__m"), F.col("__s"))
    out = out.withColumn(f"{column}_zscore", z)
    flag = F.coalesce((F.abs(name(f"{column}_zscore")) > limit).cast("int"), F.lit(0))
    return out.withColumn("is_outlier", flag).drop("__m", "__s")


def standardize(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean 0 and population deviation 1 as ``<column>_std``; a constant column becomes 0."""
    require(df, *columns, *keys)
    stats = {f"__m_{c}": F.avg(name(c)) for c in columns} | {f"__s_{c}": F.stddev_pop(name(c)) for c in columns}
    out = attach(df, stats, keys)
    scaled = {
        f"{c}_std": F.when(name(f"__s_{c}") == 0, name(c) - name(f"__m_{c}")).otherwise((name(c) - name(f"__m_{c}")) / F.nullif(name(f"__s_{c}"), F.lit(0.0)))
        for c in columns
    }
    return out.withColumns(scaled).drop(*stats)


def minmax_scale(df: DataFrame, column: str, keys: Sequence[str] = (), *, low: float = -1.0, high: float = 0.0) -> DataFrame:
    """``<column>_scaled`` in [low, high]; keeps ``__min`` and ``__max`` so it can be undone."""
    out = attach(df, {"value_min": F.min(name(column)), "value_max": F.max(name(column))}, keys)
    share = F.try_divide(name(column) - F.col("value_min"), F.col("value_max") - F.col("value_min"))
    return out.withColumn(f"{column}_scaled", F.coalesce(share, F.lit(0.0)) * F.lit(high - low) + F.lit(low))


def minmax_restore(df: DataFrame, column: str, out: str, *, low: float = -1.0, high: float = 0.0) -> DataFrame:
    """Undo :func:`minmax_scale` on ``column`` with the ends it left behind."""
    share = (name(column) - F.lit(low)) / F.lit(high - low)
    return df.withColumn(out, share * (F.col("value_max") - F.col("value_min")) + F.col("value_min"))


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for a known level list; the alphabetically first is dropped."""
    require(df, column)
    flags = {f"{column}_{v}": F.coalesce((name(column) == F.lit(v)).cast("int"), F.lit(0)) for v in sorted(levels)[1:]}
    return df.withColumns(flags)


def fit_one_hot(df: DataFrame, columns: Sequence[str], *, max_levels: int = 1000) -> tuple[list, list[str]]:
    """Fitted stages that encode text columns without their alphabetically first level, and the vector columns.

    Levels unknown to the fit become all zeros. The level lists live on the driver, so a column with
    more than ``max_levels`` levels is refused; pool its rare levels first.
    """
    counts = df.agg(*[F.count_distinct(name(c)).alias(c) for c in columns]).first()
    wide = [c for c in columns if counts[c] > max_levels]
    if wide:
        raise ValueError(f"columns {wide} have more than {max_levels} levels; pool rare levels or leave them out")
    index = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}__ix" for c in columns], stringOrderType="alphabetDesc", handleInvalid="keep"
    ).fit(df)
    encode = OneHotEncoder(inputCols=[f"{c}__ix" for c in columns], outputCols=[f"{c}__oh" for c in columns], dropLast=False)
    stages, out = [index, encode.fit(index.transform(df))], []
    for c, labels in zip(columns, index.labelsArray, strict=True):
        # In descending order the first level is the last label; behind it comes the slot of unknown levels.
        if len(labels) > 1:
            stages.append(VectorSlicer(inputCol=f"{c}__oh", outputCol=f"{c}__hot", indices=list(range(len(labels) - 1))))
            out.append(f"{c}__hot")
    return stages, out


def align_union(*parts: DataFrame, fill: float = 0.0) -> DataFrame:
    """Union by name; numeric columns missing from a part are filled."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.fillna(fill)
