"""Panel forecasting: hold-out evaluation, choice of model, future values.

Simple predictors and the regression model are window functions and aggregates. Exponential
smoothing and ARIMA are recursions over one series; they run as grouped-map functions over many
series at once, each with a bounded number of points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, whole
from tidemark.operators.resample import future_grid
from tidemark.operators.stats import adf_test, gram_table, per_series, solve_rows, unpack_gram
from tidemark.operators.windows import lookback, split_tail
from tidemark.session import cut_lineage, ensure_checkpoint_dir

STEP = T.StructField("step", T.IntegerType())
FORECAST = T.StructField("forecast", T.DoubleType())


# --- predictors made of windows and aggregates -------------------------------------------------


def baseline_predictions(split: DataFrame, value: str, period: int, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows of a split series with columns ``naive``, ``seasonal_naive`` and ``mean``."""
    train = F.col("split") == "train"
    every = whole(keys)
    last = F.max_by(F.when(train, name(value)), F.when(train, F.col("position"))).over(every)
    phase = Window.partitionBy(*[name(k) for k in keys], F.col("position") % period)
    seasonal = F.max_by(F.when(train, name(value)), F.when(train, F.col("position"))).over(phase)
    mean = F.avg(F.when(train, name(value))).over(every)
    rows = split.withColumns({"naive": last, "seasonal_naive": seasonal, "mean": mean})
    return rows.filter(~train)


def metrics(rows: DataFrame, value: str, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., model, rmse, mae`` of prediction columns."""
    entries = []
    for m in models:
        gap = name(value) - name(m)
        entries.append(F.struct(F.lit(m).alias("model"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae")))
    scored = rows.groupBy(*[name(k) for k in keys]).agg(F.array(*entries).alias("s"))
    return scored.select(*[name(k) for k in keys], F.inline("s"))


def best_model(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model with the lowest RMSE per key; ties go to the first name."""
    best = F.min_by(F.struct("model", "rmse"), F.struct(F.col("rmse").isNull(), F.col("rmse"), F.col("model")))
    return scored_columns(scores.groupBy(*[name(k) for k in keys]).agg(best.alias("b")), keys)


def scored_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[name(k) for k in keys], "b.*")


def trend_forecast(split: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows with the straight line through the training rows as ``forecast``."""
    y, x = F.when(F.col("split") == "train", name(value)), F.when(F.col("split") == "train", F.col("position").cast("double"))
    lines = split.groupBy(*[name(k) for k in keys]).agg(F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
    rows = split.filter("split = 'test'")
    if keys:
        rows = join_keys(rows, lines, keys)
    else:
        rows = rows.withColumn("__l", lines.select(F.struct("__a", "__b").alias("s")).scalar()).select("*", "__l.*").drop("__l")
    return rows.withColumn("forecast", F.col("__b") + F.col("__a") * F.col("position")).drop("__a", "__b")


# --- regression on trend, seasons and external columns -----------------------------------------


def seasonal_design(
    time: Column, start: date, span_days: int, *, knots: int = 10, yearly: int = 10, weekly: int = 3
) -> dict[str, Column]:
    """Design columns: constant, piecewise-linear trend over the first 80 % of the span, Fourier terms."""
    days = F.datediff(F.to_date(time), F.lit(start)).cast("double")
    x = days / F.lit(float(max(span_days, 1)))
    columns = {"c_one": F.lit(1.0), "c_trend": x}
    for i in range(1, knots + 1):
        at = 0.8 * i / (knots + 1)
        columns[f"c_knot_{i}"] = F.greatest(x - F.lit(at), F.lit(0.0))
    for label, length, order in (("year", 365.25, yearly), ("week", 7.0, weekly)):
        for k in range(1, order + 1):
            angle = days * F.lit(2.0 * math.pi * k / length)
            columns[f"c_{label}_sin_{k}"] = F.sin(angle)
            columns[f"c_{label}_cos_{k}"] = F.cos(angle)
    return columns


def fit_additive(
    train: DataFrame,
    time: str,
    value: str,
    keys: Sequence[str] = (),
    *,
    start: date,
    span_days: int,
    regressors: Sequence[str] = (),
    knots: int = 10,
    yearly: int = 10,
    weekly: int = 3,
    ridge: float = 1e-3,
    knot_ridge: float = 1.0,
) -> DataFrame:
    """``keys..., beta``: penalised least squares on trend, yearly and weekly terms and regressors.

    Rows are reduced to one Gram matrix per key by a map-side-combined aggregate, so the fit takes
    raw rows of any number; Python solves one small system per key.
    """
    design = seasonal_design(name(time), start, span_days, knots=knots, yearly=yearly, weekly=weekly)
    design |= {f"c_x_{r}": name(r).cast("double") for r in regressors}
    names = [*design, "c_y"]
    rows = train.select(*[name(k) for k in keys], *[c.alias(n) for n, c in design.items()], name(value).cast("double").alias("c_y"))
    size = len(names)
    penalty = np.array([0.0 if n == "c_one" else knot_ridge if n.startswith("c_knot") else ridge for n in names[:-1]])

    def solve(row: dict) -> list:
        flat = np.array(row["gram"], float)
        if not len(flat):
            return [None]
        g = unpack_gram(flat, size)
        beta = np.linalg.lstsq(g[:-1, :-1] + np.diag(penalty), g[:-1, -1], rcond=None)[0]
        return [beta.tolist()]

    return solve_rows(gram_table(rows, names, keys), keys, [T.StructField("beta", T.ArrayType(T.DoubleType()))], solve)


def predict_additive(
    rows: DataFrame, fit: DataFrame, time: str, keys: Sequence[str] = (), *, start: date, span_days: int,
    regressors: Sequence[str] = (), knots: int = 10, yearly: int = 10, weekly: int = 3,
) -> DataFrame:
    """``rows`` with ``forecast``: the dot product of the design columns and the fitted coefficients."""
    design = seasonal_design(name(time), start, span_days, knots=knots, yearly=yearly, weekly=weekly)
    design |= {f"c_x_{r}": name(r).cast("double") for r in regressors}
    joined = join_keys(rows, fit, keys, "left") if keys else rows.withColumn("beta", fit.select("beta").scalar())
    dot = None
    for i, c in enumerate(design.values()):
        term = F.col("beta")[i] * c
        dot = term if dot is None else dot + term
    return joined.withColumn("forecast", dot).drop("beta")


# --- exponential smoothing ---------------------------------------------------------------------


def _box_cox(y: np.ndarray, lam: float) -> np.ndarray:
    return np.log(y) if abs(lam) < 1e-9 else (y**lam - 1.0) / lam


def _inverse_box_cox(z: np.ndarray, lam: float) -> np.ndarray:
    if abs(lam) < 1e-9:
        return np.exp(z)
    return np.maximum(lam * z + 1.0, 1e-12) ** (1.0 / lam)


def box_cox_lambda(y: np.ndarray) -> float:
    """The power with the highest profile likelihood, on a grid; 1 for series with values <= 0."""
    if len(y) < 3 or y.min() <= 0 or y.min() == y.max():
        return 1.0
    grid = np.linspace(-1.0, 2.0, 31)
    logs = np.log(y).sum()
    scores = [-(len(y) / 2) * math.log(max(_box_cox(y, lam).var(), 1e-300)) + (lam - 1.0) * logs for lam in grid]
    return float(grid[int(np.argmax(scores))])


# Smoothing weights tried for level, trend and season.
HW_GRID = np.array(np.meshgrid([0.05, 0.15, 0.3, 0.5, 0.7, 0.9], [0.0, 0.01, 0.05, 0.1, 0.3], [0.0, 0.05, 0.1, 0.3, 0.6])).reshape(3, -1)


def holt_winters_forecast(y: np.ndarray, period: int, horizon: int, box_cox: bool = True) -> np.ndarray:
    """Additive trend and season; all weight combinations advance together through the series."""
    lam = box_cox_lambda(y) if box_cox else 1.0
    z = _box_cox(y, lam) if box_cox and lam != 1.0 else y.astype(float)
    cycles = len(z) // period
    # Start values: regression line over the first cycles, mean deviation from it per phase.
    first = z[: period * min(cycles, 4)]
    t = np.arange(len(first))
    season = np.array([first[k::period].mean() for k in range(period)])
    # The line is fitted to what is left after the phase means, twice, so that trend does not leak into the season.
    slope = 0.0
    for _ in range(20):
        level_slope = np.polyfit(t, first - season[t % period], 1)
        slope, level = level_slope[0], level_slope[1]
        season = np.array([(first - level - slope * t)[k::period].mean() for k in range(period)])
        season = season - season.mean()
    alpha, beta, gamma = HW_GRID
    level = np.full(alpha.shape, level - slope)
    trend = np.full(alpha.shape, slope)
    seasons = np.tile(season, (len(alpha), 1))
    error = np.zeros(alpha.shape)
    for i, v in enumerate(z):
        k = i % period
        gap = v - (level + trend + seasons[:, k])
        error += gap * gap
        level = level + trend + alpha * gap
        trend = trend + alpha * beta * gap
        seasons[:, k] += gamma * (1 - alpha) * gap
    best = int(np.argmin(error))
    steps = np.arange(1, horizon + 1)
    ahead = level[best] + trend[best] * steps + seasons[best, (len(z) + steps - 1) % period]
    return _inverse_box_cox(ahead, lam) if box_cox and lam != 1.0 else ahead


def holt_winters(series: DataFrame, time: str, value: str, horizon: int, period: int = 12, keys: Sequence[str] = (), *, box_cox: bool = True) -> DataFrame:
    """``keys..., step, forecast`` for the next ``horizon`` periods; series under two cycles get none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float)
        if len(y) < 2 * period:
            return pd.DataFrame({"step": pd.Series(dtype="int32"), "forecast": pd.Series(dtype=float)})
        return pd.DataFrame({"step": np.arange(1, horizon + 1, dtype="int32"), "forecast": holt_winters_forecast(y, period, horizon, box_cox)})

    return per_series(series.filter(name(value).isNotNull()), time, keys, run, [STEP, FORECAST])


# --- ARIMA -------------------------------------------------------------------------------------


def _arma_errors(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Conditional one-step errors, starting from zero errors behind the first p values."""
    p, q = len(phi), len(theta)
    base = w[p:].astype(float)
    for i in range(p):
        base = base - phi[i] * w[p - 1 - i : len(w) - 1 - i]
    if q == 0:
        return base
    out = np.zeros(len(base) + q)
    for i, b in enumerate(base):
        out[i + q] = b - theta @ out[i : i + q][::-1]
    return out[q:]


def fit_arma(w: np.ndarray, p: int, q: int, constant: bool) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Conditional sum of squares by damped Gauss-Newton: (phi, theta, mean, errors)."""
    x0 = np.zeros(p + q + int(constant))
    if constant:
        x0[-1] = w.mean()

    def errors(x: np.ndarray) -> np.ndarray:
        return _arma_errors(w - (x[-1] if constant else 0.0), x[:p], x[p : p + q])

    x, e = x0, errors(x0)
    damping = 1e-3
    for _ in range(40 if len(x0) else 0):
        scale = np.maximum(np.abs(x), 1.0) * 1e-6
        slopes = np.stack([(errors(x + np.eye(len(x))[i] * scale[i]) - e) / scale[i] for i in range(len(x))], axis=1)
        normal = slopes.T @ slopes
        step = -np.linalg.lstsq(normal + damping * np.diag(np.diag(normal) + 1e-12), slopes.T @ e, rcond=None)[0]
        tried = x + step
        tried[p : p + q] = np.clip(tried[p : p + q], -0.98, 0.98)
        fresh = errors(tried)
        if np.isfinite(fresh).all() and fresh @ fresh < e @ e:
            gained = 1.0 - (fresh @ fresh) / max(e @ e, 1e-300)
            x, e, damping = tried, fresh, damping / 3
            if gained < 1e-9:
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
    return x[:p], x[p : p + q], float(x[-1]) if constant else 0.0, e


def arima_forecast(y: np.ndarray, order: tuple[int, int, int], horizon: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(forecast, AIC, phi, theta). A constant is fitted only without differencing."""
    p, d, q = order
    w = np.diff(y, d) if d else y.astype(float)
    phi, theta, mean, e = fit_arma(w, p, q, d == 0)
    n, k = len(e), p + q + 1 + int(d == 0)
    aic = n * math.log(max(float(e @ e) / max(n, 1), 1e-300)) + 2 * k
    past, errs = list(w - mean), list(e)
    for _ in range(horizon):
        value = sum(phi[i] * past[-1 - i] for i in range(p)) + sum(theta[i] * errs[-1 - i] for i in range(min(q, len(errs))))
        past.append(value)
        errs.append(0.0)
    ahead = np.array(past[len(w) :]) + mean
    for level in range(d):
        ahead = np.diff(y, d - 1 - level)[-1] + np.cumsum(ahead)
    return ahead, aic, phi, theta


def arima(series: DataFrame, time: str, value: str, horizon: int, order: tuple[int, int, int] = (1, 1, 1), keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., step, forecast, aic, phi, theta`` of a fixed order."""
    fields = [STEP, FORECAST, T.StructField("aic", T.DoubleType())]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("phi", "theta")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float)
        if len(y) < sum(order) + 8:
            return pd.DataFrame({f.name: [] for f in fields})
        ahead, aic, phi, theta = arima_forecast(y, order, horizon)
        return pd.DataFrame(
            {"step": np.arange(1, horizon + 1, dtype="int32"), "forecast": ahead, "aic": aic, "phi": [phi.tolist()] * horizon, "theta": [theta.tolist()] * horizon}
        )

    return per_series(series.filter(name(value).isNotNull()), time, keys, run, fields)


def arima_candidates(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, max_p: int = 3, max_q: int = 3) -> DataFrame:
    """``keys..., ar, diff, ma, aic`` of all orders; diff is 0 where the unit-root test rejects, else 1.

    Every order is its own group, so the search over one series spreads over tasks too.
    """
    tests = adf_test(series, time, value, keys)
    steps = tests.select(*[name(k) for k in keys], F.when(F.col("stationary"), 0).otherwise(1).alias("diff"))
    rows = join_keys(series, steps, keys) if keys else series.withColumn("diff", steps.scalar())
    orders = F.array(*[F.struct(F.lit(p).alias("ar"), F.lit(q).alias("ma")) for p in range(max_p + 1) for q in range(max_q + 1)])
    spread = rows.filter(name(value).isNotNull()).withColumn("__o", F.explode(orders))
    spread = spread.select(*[name(k) for k in keys], name(time), name(value), "__o.ar", "diff", "__o.ma")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = (int(pdf["ar"].iloc[0]), int(pdf["diff"].iloc[0]), int(pdf["ma"].iloc[0]))
        y = pdf[value].to_numpy(float)
        aic = arima_forecast(y, order, 1)[1] if len(y) >= sum(order) + 8 else None
        return pd.DataFrame({"aic": pd.Series([aic], dtype=float)})

    return per_series(spread, time, [*keys, "ar", "diff", "ma"], run, [T.StructField("aic", T.DoubleType())])


def auto_arima(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, max_p: int = 3, max_q: int = 3) -> DataFrame:
    """The order with the lowest AIC per key."""
    tried = arima_candidates(series, time, value, keys, max_p=max_p, max_q=max_q)
    best = F.min_by(F.struct("ar", "diff", "ma", "aic"), F.struct("aic", F.col("ar") + F.col("ma"), "ar"))
    return scored_columns(tried.filter("aic is not null").groupBy(*[name(k) for k in keys]).agg(best.alias("b")), keys)


# --- regression on look-back windows -----------------------------------------------------------


def fit_lookback(series: DataFrame, time: str, value: str, size: int = 52, keys: Sequence[str] = (), *, trees: bool = False, rounds: int = 100):
    """A regression of the next value on the last ``size`` values, fitted on all series together."""
    ensure_checkpoint_dir(series.sparkSession)
    rows = lookback(series.filter(name(value).isNotNull()), time, value, size, keys)
    columns = [f"x_{i}" for i in range(size)]
    flat = rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)], name(value).cast("double").alias("y"))
    learner = (
        GBTRegressor(featuresCol="f", labelCol="y", maxIter=rounds, maxDepth=5, seed=42, checkpointInterval=10)
        if trees
        else LinearRegression(featuresCol="f", labelCol="y", regParam=0.0, solver="normal")
    )
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="f"), learner]).fit(flat)


def lookback_forecast(series: DataFrame, model, time: str, value: str, horizon: int, size: int = 52, keys: Sequence[str] = ()) -> DataFrame:
    """Feed each prediction back as the newest value: ``keys..., step, forecast``. One row per key moves."""
    last = series.filter(name(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*[name(k) for k in keys]).orderBy(name(time).desc())))
    recent = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), name(value).alias("v")))), lambda s: s["v"])
    state = last.filter(F.col("__r") <= size).groupBy(*[name(k) for k in keys]).agg(recent.alias("x")).filter(F.size("x") == size)
    state = state.withColumn("path", F.array().cast("array<double>"))
    for step in range(1, horizon + 1):
        flat = state.withColumns({f"x_{i}": F.col("x")[i] for i in range(size)})
        scored = model.transform(flat).withColumn("x", F.concat(F.slice("x", 2, size - 1), F.array("prediction")))
        state = scored.select(*[name(k) for k in keys], "x", F.concat("path", F.array("prediction")).alias("path"))
        if step % 10 == 0:
            state = cut_lineage(state)
    out = state.select(*[name(k) for k in keys], F.posexplode("path").alias("step", "forecast"))
    return out.withColumn("step", F.col("step") + 1)


# --- the combined forecast ---------------------------------------------------------------------

MODELS = ("holt_winters", "arima", "additive")


def _model_forecasts(series: DataFrame, grid: DataFrame, time: str, value: str, horizon: int, period: int, keys: Sequence[str]) -> DataFrame:
    """``keys..., step, model, forecast`` of all models; ``grid`` holds the steps with their times."""
    smooth = holt_winters(series, time, value, horizon, period, keys).withColumn("model", F.lit("holt_winters"))
    auto = arima(series, time, value, horizon, (1, 1, 1), keys).select(*[name(k) for k in keys], "step", "forecast").withColumn("model", F.lit("arima"))
    ends = series.agg(F.min(F.to_date(name(time))).alias("a"), F.max(F.to_date(name(time))).alias("b")).first()
    if ends["a"] is None:
        return smooth.unionByName(auto)
    shape = {"start": ends["a"], "span_days": (ends["b"] - ends["a"]).days}
    fit = fit_additive(series, time, value, keys, **shape)
    additive = predict_additive(grid, fit, time, keys, **shape).select(*[name(k) for k in keys], "step", "forecast").withColumn("model", F.lit("additive"))
    return smooth.unionByName(auto).unionByName(additive)


def evaluate_models(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, period: int = 12) -> DataFrame:
    """``keys..., model, rmse, mae`` on the last 20 % (at most 30) points of each series."""
    # Every model reads the series again; store it once.
    series = cut_lineage(series.filter(name(value).isNotNull()).select(*[name(k) for k in keys], name(time), name(value)))
    split = split_tail(series, time, keys)
    train = split.filter("split = 'train'").select(*[name(k) for k in keys], name(time), name(value))
    step = (F.col("position") - (F.col("points") - F.least(F.floor(F.col("points") * 0.2), F.lit(30))) + 1).cast("int")
    test = split.filter("split = 'test'").select(*[name(k) for k in keys], name(time), name(value).alias("actual"), step.alias("step"))
    grid = test.select(*[name(k) for k in keys], "step", name(time))
    paired = join_keys(_model_forecasts(train, grid, time, value, 30, period, keys), test, [*keys, "step"])
    gap = F.col("actual") - F.col("forecast")
    return paired.groupBy(*[name(k) for k in keys], "model").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def forecast_best(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, periods: int = 12, period: int = 12, freq: str | None = None) -> DataFrame:
    """Choose per key the model with the lowest hold-out error, refit on everything, predict ahead.

    Without ``freq`` the dates ahead follow each key's most frequent gap.
    """
    series = cut_lineage(series.select(*[name(k) for k in keys], name(time), name(value)))
    chosen = best_model(evaluate_models(series, time, value, keys, period=period), keys)
    grid = future_grid(series, time, periods, keys, freq)
    ahead = _model_forecasts(series, grid, time, value, periods, period, keys)
    ahead = join_keys(ahead, grid, [*keys, "step"])
    picked = join_keys(ahead, chosen, [*keys, "model"])
    return picked.select(*[name(k) for k in keys], "step", name(time), "model", "forecast")
