"""Time-series statistics: autocorrelation, stationarity, decomposition.

All functions take a series table (one row per key and period). Per-key sums go through map-side
aggregates; what reaches Python per key is either one series of bounded length or a small matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import bounded, join_keys, ordered, whole
from tidemark.operators.spectrum import autocovariance
from tidemark.operators.windows import positions

MAX_POINTS = 1_000_000
# So many lags need the power spectrum.
SHORT = 60


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType) for k in keys]


def per_series(series: DataFrame, time: str, keys: Sequence[str], fn, fields: list[T.StructField], *, max_points: int = MAX_POINTS) -> DataFrame:
    """``fn(rows in time order) -> rows`` once per key, after the length check."""
    schema = T.StructType([*key_fields(series, keys), *fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values(time, kind="stable").reset_index(drop=True))
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0] if len(pdf) else None)
        return out

    return bounded(series, keys, max_points).groupBy(*[name(k) for k in keys]).applyInPandas(run, schema)


# --- autocorrelation ---------------------------------------------------------------------------


def acf(series: DataFrame, time: str, value: str, max_lag: int | None = 30, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., lag, acf`` for lags 0 to ``max_lag`` (half the series when None), at most the series' length less one.

    For fewer than SHORT lags every point meets the next ones in one window; more come from the power spectrum, see `spectrum`, at
    n log n operations instead of n times the lags. A constant series has no autocorrelation.
    """
    every, cols = whole(keys), [name(k) for k in keys]
    if max_lag is None or max_lag >= SHORT:
        sums = autocovariance(series, time, value, max_lag, keys)
        return sums.select(*cols, "lag", F.when(F.col("lag") == 0, F.try_divide("c0", "c0")).otherwise(F.try_divide("c", "c0")).alias("acf"))
    v = name(value).cast("double")
    placed = series.filter(v.isNotNull()).select(*cols, name(time).alias("__t"), (v - F.avg(v).over(every)).alias("__x"))
    ahead = ordered(keys, "__t")
    met = placed.withColumns({f"__y{k}": F.lead("__x", k).over(ahead) for k in range(1, max_lag + 1)})
    sums = [F.sum(F.col("__x") * F.col("__x"))] + [F.coalesce(F.sum(F.col("__x") * F.col(f"__y{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)]
    summed = met.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"), F.array(*sums).alias("__p"))
    lags = summed.filter("__n > 0").select(*cols, "__n", F.col("__p")[0].alias("__zero"), F.posexplode("__p").alias("lag", "__c"))
    return lags.filter("lag < __n").select(*cols, "lag", F.try_divide(F.col("__c"), F.col("__zero")).alias("acf"))


def pacf(series: DataFrame, time: str, value: str, max_lag: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the autocorrelations.

    The recursion is an array fold in Spark over ``max_lag`` numbers per key.
    """
    entries = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    rho = acf(series, time, value, max_lag, keys).groupBy(*[name(k) for k in keys]).agg(entries.alias("__e"))
    rho = rho.withColumn("__r", F.transform("__e", lambda s: s["acf"]))
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def dot(phi: Column, values: Column) -> Column:
        return F.aggregate(F.zip_with(phi, values, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        known = F.slice(F.col("__r"), F.lit(2), k - 1)
        last = F.try_divide(F.element_at(F.col("__r"), k + 1) - dot(phi, F.reverse(known)), F.lit(1.0) - dot(phi, known))
        updated = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(F.concat(updated, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step, lambda s: s["out"])
    return rho.select(*[name(k) for k in keys], F.posexplode(folded).alias("lag", "pacf"))


def auto_period(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, default: int = 12, threshold: float = 0.5) -> DataFrame:
    """``keys..., period``: the first local peak of the autocorrelation above the threshold.

    Lags run to half the series, the search from 2 to a third of the lags.
    """
    table = acf(series, time, value, None, keys)
    w = Window.partitionBy(*[name(k) for k in keys]).orderBy("lag")
    table = table.withColumns(
        {"__prev": F.lag("acf").over(w), "__next": F.lead("acf").over(w), "__lags": F.count(F.lit(1)).over(whole(keys))}
    )
    peak = (F.col("acf") > threshold) & (F.col("acf") > F.col("__prev")) & (F.col("acf") > F.col("__next"))
    searched = (F.col("lag") >= 2) & (F.col("lag") < F.floor(F.col("__lags") / 3))
    first = F.min(F.when(peak & searched, F.col("lag")))
    return table.groupBy(*[name(k) for k in keys]).agg(F.coalesce(first, F.lit(default)).cast("int").alias("period"))


# --- unit root ---------------------------------------------------------------------------------

# MacKinnon (1994, 2010) response surfaces, constant-only regression.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRITICAL = {
    "1%": [-3.43035, -6.5393, -16.786, -79.433],
    "5%": [-2.86154, -2.8903, -4.234, -40.040],
    "10%": [-2.56677, -1.5384, -2.809, 0.0],
}


def adf_p_value(tau: float) -> float:
    """Approximate p-value of the statistic."""
    if tau > ADF_TAU_MAX:
        return 1.0
    if tau < ADF_TAU_MIN:
        return 0.0
    coefficients = ADF_SMALL_P if tau <= ADF_TAU_STAR else ADF_LARGE_P
    z = sum(c * tau**i for i, c in enumerate(coefficients))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf_critical(level: str, n: int) -> float:
    return sum(c / n**i for i, c in enumerate(ADF_CRITICAL[level]))


def array_total(arrays: Column) -> Column:
    """The sum of a list of equally long arrays."""
    return F.aggregate(F.slice(arrays, 2, F.greatest(F.size(arrays) - 1, F.lit(0))), arrays[0], lambda s, g: F.zip_with(s, g, lambda a, b: a + b))


def gram_table(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """X'X of the columns per key as one array (upper triangle), for raw rows of any number.

    Each task multiplies its Arrow batches and hands on one array per key; the arrays of a 64th of the tasks are added up
    first, then the sums of all of them. Whole rows never move.
    """
    names, size = list(columns), len(columns)
    upper = np.triu_indices(size)
    selected = rows.select(*[name(k) for k in keys], *[name(c) for c in names])
    schema = T.StructType([*key_fields(selected, keys), T.StructField("g", T.ArrayType(T.DoubleType()))])
    ids = list(keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([[*k, v] for k, v in sums.items()], columns=[*ids, "g"])
            sums.clear()
            return out

        for pdf in batches:
            for key, part in pdf.groupby(ids, dropna=False, sort=False) if ids else [((), pdf)]:
                x = part[names].to_numpy(float)
                # Incomplete rows leave here: a filter on this many computed columns overloads the optimizer.
                x = x[~np.isnan(x).any(axis=1)]
                sums[key] = sums.get(key, 0.0) + (x.T @ x)[upper]
            if len(sums) > 1000:
                yield flush()
        if sums:
            yield flush()

    parts = selected.mapInPandas(partial, schema).withColumn("__task", F.pmod(F.spark_partition_id(), F.lit(64)))
    cols = [name(k) for k in keys]
    some = parts.groupBy(*cols, "__task").agg(F.collect_list("g").alias("g")).withColumn("g", array_total(F.col("g")))
    return some.groupBy(*cols).agg(F.collect_list("g").alias("g")).select(*cols, array_total(F.col("g")).alias("gram")).filter("gram IS NOT NULL")


def unpack_gram(flat: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def solve_rows(table: DataFrame, keys: Sequence[str], fields: list[T.StructField], solve) -> DataFrame:
    """``solve(row) -> values`` for each small per-key record of ``table``, in Arrow batches."""
    schema = T.StructType([*key_fields(table, keys), *fields])
    wanted = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            solved = pd.DataFrame([solve(r) for r in pdf.to_dict("records")], columns=wanted)
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), solved], axis=1)

    return table.mapInPandas(run, schema)


def _nested(a: np.ndarray, b: np.ndarray, yy: float) -> np.ndarray:
    """Residual sums of squares with the first 1, 2, ... columns, from the normal equations of all."""
    try:
        return yy - np.cumsum(np.linalg.solve(np.linalg.cholesky(a), b) ** 2)
    except np.linalg.LinAlgError:
        return np.array([yy - b[:p] @ np.linalg.pinv(a[:p, :p], hermitian=True) @ b[:p] for p in range(1, len(b) + 1)])


def adf_from_gram(gram: np.ndarray, edges: list, top: int) -> tuple[float, int, int]:
    """(statistic, lags, observations) from X'X of ``1, level, differences at lag 1.., difference`` over the rows with ``top`` lags.

    ``edges``: the ``top`` rows before those, (number, columns without the 1), which take part once fewer lags are chosen.
    """
    n, y = round(gram[0, 0]), len(gram) - 1
    rss = _nested(gram[: top + 2, : top + 2], gram[: top + 2, y], gram[y, y])[1:]
    lags = int(np.argmin(n * np.log(np.maximum(rss, 1e-300) / n) + 2 * np.arange(2, top + 3)))
    pick = [*range(lags + 2), y]
    chosen = gram[np.ix_(pick, pick)]
    for number, values in edges:
        if number >= lags:
            row = np.array([1.0, *values[: lags + 1], values[-1]], float)
            chosen = chosen + np.outer(row, row)
            n += 1
    inverse = np.linalg.pinv(chosen[:-1, :-1], hermitian=True)
    beta = inverse @ chosen[:-1, -1]
    variance = (chosen[-1, -1] - beta @ chosen[:-1, -1]) / (n - lags - 2) * inverse[1, 1]
    return (float(beta[1] / math.sqrt(variance)) if variance > 0 else float("nan")), lags, n


def adf_test(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant.

    ``keys..., statistic, p_value, lags, nobs, crit_1, crit_5, crit_10, stationary``. Lags compete by AIC up to
    ``12 (n / 100)^(1/4)`` on shared rows; the chosen ones are fitted to all rows that have them. A series of fewer than 8 points or of
    one value has no statistic. One window makes the lag columns of all models, one aggregate their cross products: the
    nested models are leading blocks of that one matrix, so Python sees a small matrix per key and never a series.
    """
    every, w, cols = whole(keys), ordered(keys, time), [name(k) for k in keys]
    rows = series.filter(name(value).isNotNull() & ~F.isnan(name(value).cast("double")))
    longest = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = math.ceil(12 * (longest / 100) ** 0.25) if max_lag is None else max_lag
    width = max(0, min(wanted, longest // 2 - 3))
    n = F.count(F.lit(1)).over(every)
    own = F.ceil(12 * F.pow(n / 100, F.lit(0.25))) if max_lag is None else F.lit(max_lag)
    v = name(value).cast("double")
    rows = rows.select(
        *cols, name(time).alias("__time"), n.alias("__n"), F.least(own, F.floor(n / 2) - 3).cast("int").alias("__top"),
        F.try_divide(v - F.avg(v).over(every), F.stddev_pop(v).over(every)).alias("__level"), (F.max(v).over(every) > F.min(v).over(every)).alias("__moves"),
    )
    w = ordered(keys, "__time")
    rows = rows.withColumns({"__before": F.lag("__level").over(w), "__s": F.row_number().over(w) - 2})
    rows = rows.withColumn("__step", F.col("__level") - F.col("__before"))
    past = {f"__d{i}": F.when(F.col("__top") >= i, F.lag("__step", i).over(w)).otherwise(F.lit(0.0)) for i in range(1, width + 1)}
    usable = (F.col("__n") >= 8) & F.col("__moves")
    # The rows before the shared ones have no 1, which keeps them out of the matrix.
    rows = rows.withColumns({**past, "__one": F.when(usable & (F.col("__s") >= F.col("__top")), F.lit(1.0))})
    design = ["__before", *past, "__step"]
    edge = usable & F.col("__s").between(0, F.col("__top") - 1)
    table = rows.groupBy(*cols).agg(
        F.first("__n").alias("n"), F.first("__top").alias("top"), F.array_sort(F.collect_list(F.when(edge, F.struct("__s", F.array(*design))))).alias("edges")
    )
    table = join_keys(table, gram_table(rows, ["__one", *design], keys), keys, "left") if keys else table.withColumn(
        "gram", gram_table(rows, ["__one", *design]).select("gram").scalar()
    )
    fields = [T.StructField("statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType())]
    fields += [T.StructField("lags", T.IntegerType()), T.StructField("nobs", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("crit_1", "crit_5", "crit_10")]
    fields += [T.StructField("stationary", T.BooleanType())]

    def solve(row: dict) -> list:
        tau, lags, count = float("nan"), 0, int(row["n"])
        # Series without a statistic have no complete row.
        if row["gram"] is not None and row["gram"][0] > 0:
            edges = [(e["__s"], e["col2"]) if isinstance(e, dict) else tuple(e) for e in row["edges"]]
            tau, lags, count = adf_from_gram(unpack_gram(np.array(row["gram"], float), width + 3), edges, int(row["top"]))
        known = tau == tau
        prob = adf_p_value(tau) if known else None
        return [tau if known else None, prob, lags, count, *[adf_critical(level, count) for level in ADF_CRITICAL], prob < 0.05 if known else None]

    return solve_rows(table.filter("n > 0"), keys, fields, solve)


def adf_level(tests: DataFrame) -> DataFrame:
    """The strictest level at which the unit root is rejected: 1%, 5%, 10% or none."""
    level = (
        F.when(F.col("statistic") <= F.col("crit_1"), "1%")
        .when(F.col("statistic") <= F.col("crit_5"), "5%")
        .when(F.col("statistic") <= F.col("crit_10"), "10%")
        .otherwise("none")
    )
    return tests.withColumn("level", level)


def adf_lag0(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The test without lagged differences, wholly as regression aggregates."""
    w = ordered(keys, time)
    rows = series.withColumn("__y1", F.lag(name(value)).over(w)).withColumn("__dy", name(value) - F.col("__y1"))
    out = rows.filter("__dy is not null").groupBy(*[name(k) for k in keys]).agg(
        F.regr_slope("__dy", "__y1").alias("gamma"),
        F.regr_syy("__dy", "__y1").alias("syy"),
        F.regr_sxx("__dy", "__y1").alias("sxx"),
        F.regr_r2("__dy", "__y1").alias("r2"),
        F.count("__dy").alias("nobs"),
    )
    error = F.sqrt(F.try_divide(F.try_divide(F.col("syy") * (1 - F.col("r2")), F.col("nobs") - 2), F.col("sxx")))
    return out.select(*[name(k) for k in keys], "nobs", "gamma", F.try_divide(F.col("gamma"), error).alias("statistic"))


def split_half(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and variance of the first and the second half of each series."""
    rows = positions(series, time, keys, "__t").withColumn("__n", F.count(F.lit(1)).over(whole(keys)))
    half = F.when(F.col("__t") < F.floor(F.col("__n") / 2), 1).otherwise(2)
    return rows.groupBy(*[name(k) for k in keys], half.alias("half")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(name(value)).alias("mean"), F.var_samp(name(value)).alias("variance")
    )


# --- decomposition -----------------------------------------------------------------------------


def decompose(series: DataFrame, time: str, value: str, period: int, keys: Sequence[str] = (), *, extrapolate: bool = False) -> DataFrame:
    """Classical additive decomposition: adds ``trend_component``, ``seasonal_component``, ``residual_component``.

    The trend is a centred moving average (half weights at the ends of an even window). Its edges
    are null, or with ``extrapolate`` lie on the least-squares line through the nearest
    ``period + 1`` trend values.
    """
    w = ordered(keys, time)
    v = name(value)
    rows = positions(series, time, keys, "__t")
    half = period // 2
    full = w.rowsBetween(-half, half)
    total = F.sum(v).over(full)
    if period % 2 == 0:
        total = total - (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2.0
    trend = F.when(F.count(v).over(full) == 2 * half + 1, total / F.lit(float(period)))
    rows = rows.withColumn("trend_component", trend)
    if extrapolate:
        rows = _extrapolate(rows, period, keys)
    rows = rows.withColumns({"__d": v - F.col("trend_component"), "__phase": F.col("__t") % period})
    means = F.avg("__d").over(whole([*keys, "__phase"]))
    rows = rows.withColumn("__mean", means)
    # Mean of the phase means: each phase counts once.
    first = F.row_number().over(Window.partitionBy(*[name(k) for k in keys], "__phase").orderBy("__t")) == 1
    rows = rows.withColumn("__once", F.when(first, F.col("__mean")))
    rows = rows.withColumn("seasonal_component", F.col("__mean") - F.avg("__once").over(whole(keys)))
    rows = rows.withColumn("residual_component", v - F.col("trend_component") - F.col("seasonal_component"))
    return rows.drop("__d", "__phase", "__mean", "__once", "__t")


def _extrapolate(rows: DataFrame, period: int, keys: Sequence[str]) -> DataFrame:
    known = F.col("trend_component").isNotNull()
    at = F.when(known, F.col("__t"))
    rows = rows.withColumns({"__a": F.min(at).over(whole(keys)), "__b": F.max(at).over(whole(keys))})
    near_a = F.when(known & (F.col("__t") <= F.col("__a") + period), F.col("trend_component"))
    near_b = F.when(known & (F.col("__t") >= F.col("__b") - period), F.col("trend_component"))
    stats = {}
    for side, y in (("a", near_a), ("b", near_b)):
        stats[f"__s{side}"] = F.regr_slope(y, F.col("__t").cast("double"))
        stats[f"__i{side}"] = F.regr_intercept(y, F.col("__t").cast("double"))
    lines = rows.groupBy(*[name(k) for k in keys]).agg(*[c.alias(n) for n, c in stats.items()])
    if keys:
        rows = join_keys(rows, lines, keys, "left")
    else:
        rows = rows.withColumn("__l", lines.select(F.struct(*stats).alias("s")).scalar()).select("*", "__l.*").drop("__l")
    left = F.col("__ia") + F.col("__sa") * F.col("__t")
    right = F.col("__ib") + F.col("__sb") * F.col("__t")
    trend = F.when(known, F.col("trend_component")).when(F.col("__t") < F.col("__a"), left).otherwise(right)
    return rows.withColumn("trend_component", trend).drop("__a", "__b", *stats)


def _loess(y: np.ndarray, span: int, degree: int = 1, ahead: int = 0) -> np.ndarray:
    """Tricube local regression on equally spaced points, evaluated ``ahead`` steps beyond both ends too."""
    n = len(y)
    at = np.arange(-ahead, n + ahead)
    width = min(span, n)
    start = np.clip(at - (width - 1) // 2, 0, n - width)
    index = start[:, None] + np.arange(width)[None, :]
    offset = index - at[:, None]
    reach = np.maximum(np.abs(offset).max(axis=1), 1) + max((span - n) // 2, 0)
    weight = np.clip(1 - (np.abs(offset) / (reach[:, None] * 1.0000001)) ** 3, 0, None) ** 3
    values = y[index]
    total = weight.sum(axis=1)
    mean = (weight * values).sum(axis=1) / total
    if degree == 0:
        return mean
    centre = (weight * offset).sum(axis=1) / total
    spread = (weight * (offset - centre[:, None]) ** 2).sum(axis=1)
    slope = (weight * (offset - centre[:, None]) * values).sum(axis=1) / np.where(spread > 1e-12, spread, np.inf)
    return mean - slope * centre


def _moving(y: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(y, np.ones(size) / size, mode="valid")


def stl_components(y: np.ndarray, period: int, seasonal: int = 7, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part by seasonal-trend decomposition with local regression."""
    n = len(y)
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / seasonal)) | 1
    low_span = (period + 1) | 1 if period % 2 == 0 else period + 2
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        detrended = y - trend
        cycle = np.empty(n + 2 * period)
        for phase in range(period):
            cycle[phase::period] = _loess(detrended[phase::period], seasonal, ahead=1)
        low = _loess(_moving(_moving(_moving(cycle, period), period), 3), low_span)
        season = cycle[period : period + n] - low
        trend = _loess(y - season, trend_span)
    return trend, season


def stl(series: DataFrame, time: str, value: str, period: int = 12, keys: Sequence[str] = (), *, seasonal: int = 7) -> DataFrame:
    """Decomposition by local regression, one series per task.

    Returns ``keys..., time, value, trend_component, seasonal_component, residual_component``; a
    series shorter than two periods gets nulls.
    """
    fields = [T.StructField(time, series.schema[time].dataType), T.StructField(value, T.DoubleType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("trend_component", "seasonal_component", "residual_component")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float)
        out = pdf[[time]].assign(**{value: y})
        if len(y) < 2 * period:
            return out.assign(trend_component=None, seasonal_component=None, residual_component=None)
        trend, season = stl_components(y, period, seasonal)
        return out.assign(trend_component=trend, seasonal_component=season, residual_component=y - trend - season)

    return per_series(series.filter(name(value).isNotNull()), time, keys, run, fields)


def seasonal_strength(components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``strength`` = 1 - var(residual) / var(seasonal + residual), with a verbal grade."""
    rows = components.filter("residual_component is not null")
    out = rows.groupBy(*[name(k) for k in keys]).agg(
        F.var_pop("residual_component").alias("__r"), F.var_pop(F.col("seasonal_component") + F.col("residual_component")).alias("__sr")
    )
    out = out.withColumn("strength", F.lit(1.0) - F.try_divide(F.col("__r"), F.col("__sr")))
    grade = F.when(F.col("strength") > 0.6, "strong").when(F.col("strength") > 0.3, "moderate").otherwise("weak")
    return out.withColumn("grade", grade).drop("__r", "__sr")
