"""Effect of an event on a series, against what the time before it predicts."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, require
from tidemark.operators.joins import nearest_dates
from tidemark.operators.stats import gram_table, solve_rows, unpack_gram


def snap_event(series: DataFrame, time: str, event: date, *, strict: bool = False) -> date | None:
    """The observed date nearest to the event; ``strict`` accepts only the date itself."""
    row = nearest_dates(series, time, [event]).first()
    nearest = row["nearest"] if row else None
    if strict and nearest != event:
        raise ValueError(f"no observation on {event}; the nearest one is on {nearest}")
    return nearest


def event_windows(
    series: DataFrame, time: str, event: date, keys: Sequence[str] = (), *,
    least: tuple[int, int] = (30, 10), shares: tuple[float, float] = (0.3, 0.1),
) -> DataFrame:
    """Points before and from the event on, the recommended minimum of each, and whether it is met."""
    require(series, time, *keys)
    before = name(time) < F.lit(event)
    out = series.groupBy(*[name(k) for k in keys]).agg(
        F.count_if(before).alias("pre"), F.count_if(~before).alias("post"), F.count(F.lit(1)).alias("n")
    )
    out = out.withColumns(
        {
            "min_pre": F.greatest(F.lit(least[0]), F.floor(F.col("n") * shares[0])).cast("bigint"),
            "min_post": F.greatest(F.lit(least[1]), F.floor(F.col("n") * shares[1])).cast("bigint"),
        }
    )
    return out.withColumn("sufficient", (F.col("pre") >= F.col("min_pre")) & (F.col("post") >= F.col("min_post")))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic (Abramowitz and Stegun 7.1.26, error < 1.5e-7)."""
    # Fixed values of the published approximation.
    p = 0.3275911
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (1.0 + p * x)
    series = F.lit(0.0)
    for c in reversed(a):
        series = (series + F.lit(c)) * t
    return series * F.exp(-x * x)


def event_impact(series: DataFrame, time: str, value: str, event: date, keys: Sequence[str] = ()) -> DataFrame:
    """Average, cumulative and relative effect per key against the linear trend before the event.

    One map-side-combined aggregate gives all sums: the trend line comes from the rows before the
    event, the effect from the sums after it, so no row is joined or predicted one by one. The
    interval uses the residual variance before the event and the uncertainty of the line at the
    mean of the time after it.
    """
    day = F.datediff(F.to_date(name(time)), F.lit(event)).cast("double")
    pre, post = name(time) < F.lit(event), name(time) >= F.lit(event)
    y = name(value)
    y0, x0 = F.when(pre, y), F.when(pre, day)
    s = series.filter(y.isNotNull()).groupBy(*[name(k) for k in keys]).agg(
        F.count(y0).alias("pre"),
        F.count(F.when(post, y)).alias("post"),
        F.regr_slope(y0, x0).alias("slope"),
        F.regr_intercept(y0, x0).alias("intercept"),
        F.regr_r2(y0, x0).alias("r2"),
        F.regr_syy(y0, x0).alias("syy"),
        F.regr_sxx(y0, x0).alias("sxx"),
        F.avg(x0).alias("x_pre"),
        F.sum(F.when(post, y)).alias("actual"),
        F.sum(F.when(post, day)).alias("x_post"),
    )
    predicted = F.col("intercept") * F.col("post") + F.col("slope") * F.col("x_post")
    s = s.withColumn("predicted", predicted).withColumn("cumulative_effect", F.col("actual") - F.col("predicted"))
    sigma2 = F.col("syy") * (1 - F.coalesce("r2", F.lit(0.0))) / F.nullif(F.col("pre") - 2, F.lit(0))
    gap = F.try_divide(F.col("x_post"), F.col("post")) - F.col("x_pre")
    share = F.try_divide(F.lit(1.0), F.col("post")) + F.try_divide(F.lit(1.0), F.col("pre")) + F.try_divide(gap * gap, F.col("sxx"))
    error = F.sqrt(sigma2 * share)
    s = s.withColumns(
        {
            "average_effect": F.try_divide(F.col("cumulative_effect"), F.col("post")),
            "relative_effect": F.try_divide(F.col("cumulative_effect"), F.col("predicted")),
            "standard_error": error,
        }
    )
    s = s.withColumn("p_value", normal_tail(F.try_divide(F.col("average_effect"), F.col("standard_error"))))
    return s.select(
        *[name(k) for k in keys], "pre", "post", "actual", "predicted", "average_effect", "cumulative_effect", "relative_effect", "standard_error", "p_value"
    )


# --- with season and weekday -------------------------------------------------------------------

Design = Callable[[Column], Mapping[str, Column]]


def weekday_design(event: date) -> Design:
    """A straight line in years from the event, and a level per weekday."""

    def columns(time: Column) -> dict[str, Column]:
        day = F.to_date(time)
        levels = {f"weekday_{i}": (F.weekday(day) == i).cast("double") for i in range(7)}
        return {"years": F.datediff(day, F.lit(event)) / F.lit(365.25), **levels}

    return columns


def _known(series: DataFrame, time: str, value: str, keys: Sequence[str], columns: Mapping[str, Column]) -> tuple[DataFrame, list[str]]:
    """Keys, time, value and the design as ``x0, x1, ...`` of the rows that have a value and a time."""
    rows = series.filter(name(value).isNotNull() & name(time).isNotNull())
    design = [c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())]
    rows = rows.select(*[name(k).alias(f"k{i}") for i, k in enumerate(keys)], name(time).alias("t"), name(value).cast("double").alias("y"), *design)
    return rows, [f"x{i}" for i in range(len(design))]


def counterfactual(
    series: DataFrame, time: str, value: str, event: date, keys: Sequence[str] = (), *, design: Design, ridge: Mapping[str, float] | None = None
) -> DataFrame:
    """Effect per key against least squares on any design, fitted to the time before the event; columns as of :func:`event_impact` and ``beta``.

    The fit needs the cross products of the rows before the event, the effect and its error only the sums of the design columns
    over the rows after it: the variance of a predicted sum is that of its noise and, through the inverse of the cross
    products, that of the coefficients. So no row is predicted. ``ridge`` penalises columns by name, for designs with many terms such as
    `forecast.seasonal_design`. A key with no more rows before the event than columns that matter has an effect but no error; without rows
    on both sides it has neither.
    """
    require(series, time, value, *keys)
    columns = design(name(time))
    rows, xs = _known(series, time, value, keys, columns)
    ids = [f"k{i}" for i in range(len(keys))]
    pre, post = rows.filter(F.col("t") < F.lit(event)), rows.filter(F.col("t") >= F.lit(event))
    sums = post.groupBy(*ids).agg(F.count(F.lit(1)).alias("post"), F.sum("y").alias("actual"), F.array(*[F.sum(x) for x in xs]).alias("later"))
    gram = gram_table(pre, [*xs, "y"], ids)
    table = _beside(sums, gram, ids)
    penalty = np.diag([float((ridge or {}).get(c, 0.0)) for c in columns])
    kinds = [T.StructField("pre", T.LongType()), T.StructField("post", T.LongType())]
    kinds += [T.StructField(c, T.DoubleType()) for c in ("actual", "predicted", "standard_error")] + [T.StructField("beta", T.ArrayType(T.DoubleType()))]
    count = pre.groupBy(*ids).agg(F.count(F.lit(1)).alias("pre"))
    table = _beside(table, count, ids)

    def solve(row: dict) -> list:
        before = int(row["pre"]) if row["pre"] == row["pre"] and row["pre"] is not None else 0
        after = int(row["post"]) if row["post"] == row["post"] and row["post"] is not None else 0
        if not before or not after:
            return [before, after, row["actual"] if after else None, None, None, None]
        g, s = unpack_gram(np.array(row["gram"], float), len(xs) + 1), np.array(row["later"], float)
        a, b = g[:-1, :-1] + penalty, g[:-1, -1]
        inverse = np.linalg.pinv(a, hermitian=True)
        beta = inverse @ b
        rss = max(float(g[-1, -1] - 2 * beta @ b + beta @ g[:-1, :-1] @ beta), 0.0)
        # Columns that the penalty holds back count less: the trace of the hat matrix.
        free = before - float(np.trace(inverse @ g[:-1, :-1]))
        error = float(np.sqrt(rss / free * (after + s @ inverse @ s)) / after) if free > 1e-9 else None
        return [before, after, float(row["actual"]), float(s @ beta), error, beta.tolist()]

    out = solve_rows(table, ids, kinds, solve)
    effect = F.col("actual") - F.col("predicted")
    out = out.withColumns({
        "average_effect": F.try_divide(effect, F.col("post")), "cumulative_effect": effect, "relative_effect": F.try_divide(effect, F.col("predicted")),
    })
    out = out.withColumn("p_value", normal_tail(F.try_divide(F.col("average_effect"), F.col("standard_error"))))
    return out.select(
        *[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], "pre", "post", "actual", "predicted", "average_effect", "cumulative_effect", "relative_effect",
        "standard_error", "p_value", "beta",
    )


def _beside(left: DataFrame, right: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Full outer join of two per-key tables; null keys meet. Without keys both have one row."""
    if not ids:
        packed = right.select(F.struct(*right.columns).alias("s")).scalar()
        return left.withColumn("s", packed).select(*left.columns, *[F.col(f"s.{c}").alias(c) for c in right.columns])
    theirs = right.withColumnsRenamed({i: f"r_{i}" for i in ids})
    on = [F.col(i).eqNullSafe(F.col(f"r_{i}")) for i in ids]
    both = left.withColumn("l", F.lit(1)).join(theirs, on, "full")
    both = both.withColumns({i: F.when(F.col("l").isNotNull(), F.col(i)).otherwise(F.col(f"r_{i}")) for i in ids})
    return both.drop("l", *[f"r_{i}" for i in ids])


def effect_on_rows(series: DataFrame, impact: DataFrame, time: str, value: str, event: date, keys: Sequence[str] = (), *, design: Design) -> DataFrame:
    """``keys..., time, value, predicted, effect, cumulative_effect`` of every row from the event on.

    ``impact`` is the result of :func:`counterfactual` with the same design: one row of coefficients per key, joined to the rows.
    """
    rows, xs = _known(series, time, value, keys, design(name(time)))
    ids = [f"k{i}" for i in range(len(keys))]
    rows = rows.filter(F.col("t") >= F.lit(event))
    fit = impact.select(*[name(k).alias(i) for i, k in zip(ids, keys, strict=True)], "beta")
    rows = join_keys(rows, fit, ids, "left") if keys else rows.withColumn("beta", fit.select("beta").scalar())
    products = F.zip_with(F.array(*xs), "beta", lambda x, b: x * b)
    predicted = F.when(F.col("beta").isNotNull(), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))
    rows = rows.withColumn("predicted", predicted).withColumn("effect", F.col("y") - F.col("predicted"))
    so_far = Window.partitionBy(*ids).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], F.col("t").alias(time), F.col("y").alias(value), "predicted", "effect",
        F.sum("effect").over(so_far).alias("cumulative_effect"),
    )


def verdict(impact: DataFrame, target: str) -> DataFrame:
    """A sentence per row of :func:`event_impact`."""
    change = F.format_string("%s %+.2f%% against expectation", F.lit(target), F.col("relative_effect") * 100)
    doubt = F.when(F.col("p_value") < 0.05, "beyond chance at 5%").otherwise("within chance at 5%")
    return impact.withColumn("verdict", F.format_string("%s; %s, p=%.4f", change, doubt, F.col("p_value")))
