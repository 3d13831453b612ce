"""Queries on the stand-in series: calendar, resampling, windows, statistics, anomalies, impact, simple forecasts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import zero_to_null
from tidemark.operators import anomaly, blocks, clean, forecast, impact, joins, patterns, profile, resample, stats, windows
from tidemark.operators.common import to_series
from tidemark.operators.query import top_by_magnitude
from tidemark.plans.registry import DAILY, PANEL, daily, panel, query, rounded, steady, steady_sql
from tidemark.sources.files import table

# --- calendar ----------------------------------------------------------------------------------

_FLAGS = (
    "CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, CAST(day(d) = 1 AS INTEGER) AS is_month_start, CAST(d = last_day(d) AS INTEGER) AS is_month_end"
)


@query(
    "time_features",
    f"WITH {DAILY} SELECT d, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day_of_month, "
    "CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(week(d) AS INTEGER) AS week_of_year, "
    f"CAST(quarter(d) AS INTEGER) AS quarter, {_FLAGS}, CAST(d = date_trunc('quarter', d) AS INTEGER) AS is_quarter_start, "
    "CAST(d = last_day(d) AND month(d) % 3 = 0 AS INTEGER) AS is_quarter_end, CAST(dayofyear(d) = 1 AS INTEGER) AS is_year_start, "
    "CAST(month(d) = 12 AND day(d) = 31 AS INTEGER) AS is_year_end FROM s",
)
def time_features(spark: SparkSession, folder: str) -> DataFrame:
    return cal.calendar_features(daily(spark, folder).select("d"), "d")


@query(
    "time_features_js",
    "WITH s AS (SELECT event_id, ts, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, "
    "CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) AS INTEGER) AS day_of_week, CAST(dayofyear(d) AS INTEGER) AS day_of_year, "
    "CAST(ceil((dayofyear(d) - 1 + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::DOUBLE + dayofweek(date_trunc('year', d)) + 1) / 7.0::DOUBLE) AS INTEGER) AS week_of_year, "
    f"CAST(quarter(d) AS INTEGER) AS quarter, {_FLAGS} FROM s",
)
def time_features_js(spark: SparkSession, folder: str) -> DataFrame:
    return cal.calendar_features_sunday(table(spark, folder, "events", ["event_id", "ts"]), "ts").drop("ts")


@query(
    "season",
    "SELECT o_orderkey, CAST((month(o_orderdate) % 12) // 3 + 1 AS INTEGER) AS season, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin, "
    "round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders",
)
def season(spark: SparkSession, folder: str) -> DataFrame:
    sin, cos = cal.cyclical(F.month("o_orderdate"), 12)
    return table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", cal.season(F.col("o_orderdate")).alias("season"), F.round(sin, 6).alias("month_sin"), F.round(cos, 6).alias("month_cos")
    )


_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(d)]"
_DAYS = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(d)]"


def _pattern(key: str, parts: list[str], select: str, group: str) -> None:
    @query(key, f"WITH {DAILY} SELECT {select}, {steady_sql('avg(v)', 4)} AS mean, count(v) AS count FROM s GROUP BY {group}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return steady(patterns.mean_by_part(daily(spark, folder), "d", "v", *parts), 4, "mean")


_Y, _M, _W = "CAST(year(d) AS INTEGER) AS year", "CAST(month(d) AS INTEGER) AS month", "CAST(isodow(d) - 1 AS INTEGER) AS day_of_week"
_pattern("pattern_month", ["month"], f"{_M}, any_value({_MONTHS}) AS month_label", "1")
_pattern("pattern_dow", ["day_of_week"], f"{_W}, any_value({_DAYS}) AS day_label", "1")
_pattern("pattern_year", ["year"], _Y, "1")
_pattern("pattern_quarter", ["quarter"], "CAST(quarter(d) AS INTEGER) AS quarter", "1")
_pattern(
    "pattern_year_month", ["year", "month"],
    f"{_Y}, {_M}, any_value({_MONTHS}) AS month_label, any_value(CAST(date_trunc('month', d) AS DATE)) AS month_start", "1, 2",
)
_pattern("pattern_year_dow", ["year", "day_of_week"], f"{_Y}, {_W}, any_value({_DAYS}) AS day_label", "1, 2")


@query(
    "pivot_dow_month",
    f"WITH {DAILY} SELECT CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, "
    + ", ".join(f"{steady_sql(f'avg(v) FILTER (month(d) = {m})', 4)} AS m{m}" for m in range(1, 13))
    + " FROM s GROUP BY 1",
)
def pivot_dow_month(spark: SparkSession, folder: str) -> DataFrame:
    return steady(patterns.pivot_weekday_month(daily(spark, folder), "d", "v"), 4, *[f"m{m}" for m in range(1, 13)])


@query("seasonal_plot", f"WITH {DAILY} SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, d, v FROM s")
def seasonal_plot(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.seasonal_plot(daily(spark, folder), "d", "v")


@query(
    "pct_change_first_last",
    f"WITH {PANEL}, x AS (SELECT k, arg_min(v, d) AS a, arg_max(v, d) AS b FROM s WHERE v > 0 GROUP BY k) "
    "SELECT k, a AS first_value, b AS last_value, round((b - a) / a * 100, 4) AS pct_change FROM x",
)
def pct_change_first_last(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.percent_change_ends(panel(spark, folder), "d", "v", ["k"]), 4, "pct_change")


# --- resampling --------------------------------------------------------------------------------


def _resampled(key: str, freq: str, bucket: str, fns: list[str]) -> None:
    cells = ", ".join({"sum": "round(sum(o_totalprice), 2) AS v_sum", "mean": steady_sql("avg(o_totalprice)", 4) + " AS v_mean"}[f] for f in fns)

    @query(key, f"SELECT {bucket} AS period, {cells}, count(*) AS _count FROM orders GROUP BY 1")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        orders = table(spark, folder, "orders", ["o_orderdate", "o_totalprice"]).withColumnRenamed("o_totalprice", "v")
        out = resample.resample(orders, "o_orderdate", ["v"], freq, fns=fns)
        out = rounded(out, 2, "v_sum") if "sum" in fns else out
        return steady(out, 4, "v_mean") if "mean" in fns else out


_D = "CAST(o_orderdate AS DATE)"
_resampled("resample_day_sum", "day", _D, ["sum"])
_resampled("resample_week_sum", "week", f"{_D} - CAST(dayofweek({_D}) AS INTEGER)", ["sum"])
_resampled("resample_iso_week", "iso_week", f"CAST(date_trunc('week', {_D}) AS DATE)", ["sum", "mean"])
_resampled("resample_month_sum", "month", f"CAST(date_trunc('month', {_D}) AS DATE)", ["sum", "mean"])
_resampled("resample_month_end_mean", "month_end", f"last_day({_D})", ["mean"])
_resampled("resample_quarter", "quarter", f"CAST(date_trunc('quarter', {_D}) AS DATE)", ["sum", "mean"])


@query(
    "resample_7d",
    "WITH x AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, CAST(min(o_orderdate) OVER (PARTITION BY o_orderpriority) AS DATE) AS a FROM orders) "
    "SELECT o_orderpriority, a + CAST((d - a) // 7 * 7 AS INTEGER) AS period, round(sum(v), 2) AS v_sum, " + steady_sql("avg(v)", 4) + " AS v_mean, count(*) AS _count FROM x GROUP BY 1, 2",
)
def resample_7d(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"]).withColumnRenamed("o_totalprice", "v")
    out = resample.resample_days(orders, "o_orderdate", ["v"], 7, keys=["o_orderpriority"])
    return steady(rounded(out, 2, "v_sum"), 4, "v_mean")


_GRID = (
    f"{PANEL}, e AS (SELECT k, min(d) AS a, max(d) AS b FROM s GROUP BY k), g AS (SELECT k, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM e), "
    "r AS (SELECT g.k, g.d, s.v FROM g LEFT JOIN s ON g.k = s.k AND g.d = s.d)"
)


@query("regular_grid", f"WITH {_GRID} SELECT k, d, v FROM r")
def regular_grid(spark: SparkSession, folder: str) -> DataFrame:
    return resample.regular_grid(panel(spark, folder), "d", ["k"], "day")


@query(
    "future_grid",
    f"WITH {PANEL}, e AS (SELECT k, max(d) AS b FROM s GROUP BY k), n AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step) SELECT k, step, b + step AS d FROM e, n",
)
def future_grid(spark: SparkSession, folder: str) -> DataFrame:
    return resample.future_grid(panel(spark, folder), "d", 12, ["k"], "day")


@query(
    "future_grid_inferred",
    f"WITH {PANEL}, w AS (SELECT k, max(CAST(date_trunc('week', d) AS DATE)) AS b FROM s GROUP BY k), n AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step) "
    "SELECT k, step, b + 7 * step AS d FROM w, n",
)
def future_grid_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly values go on weekly without being told."""
    weekly = resample.resample(panel(spark, folder), "d", ["v"], "iso_week", keys=["k"]).withColumnRenamed("period", "d")
    return resample.future_grid(weekly, "d", 12, ["k"], None)


# --- windows -----------------------------------------------------------------------------------

_W1 = "WINDOW w AS (PARTITION BY k ORDER BY d)"


@query("lag_features", f"WITH {PANEL} SELECT k, d, v, lag(v, 1) OVER w AS lag_1, lag(v, 7) OVER w AS lag_7, lag(v, 30) OVER w AS lag_30 FROM s {_W1}")
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    return windows.lags(panel(spark, folder), "d", "v", keys=["k"])


@query(
    "pct_change",
    f"WITH {PANEL} SELECT k, d, " + ", ".join(f"round((v - lag(v, {i}) OVER w) / lag(v, {i}) OVER w, 6) AS pct_change_{i}" for i in (1, 7, 30)) + f" FROM s {_W1}",
)
def pct_change(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.percent_changes(panel(spark, folder), "d", "v", keys=["k"])
    return rounded(out.drop("v"), 6, *[f"pct_change_{i}" for i in (1, 7, 30)])


def _rolling_sql(size: int) -> str:
    frame = f"OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(v) {frame} = {size} THEN {steady_sql(f'avg(v) {frame}', 4)} END AS rolling_mean_{size}, "
        f"CASE WHEN count(v) {frame} = {size} THEN {steady_sql(f'stddev_samp(v) {frame}', 4)} END AS rolling_std_{size}"
    )


_SIZES = (7, 12, 14, 30, 52)


@query("rolling_stats", f"WITH {PANEL} SELECT k, d, " + ", ".join(_rolling_sql(i) for i in _SIZES) + " FROM s")
def rolling_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.rolling(panel(spark, folder), "d", "v", _SIZES, ["k"]).drop("v")
    return steady(out, 4, *[c for c in out.columns if c.startswith("rolling")])


@query("expanding_mean", f"WITH {PANEL} SELECT k, d, {steady_sql('avg(v) OVER w', 4)} AS expanding_mean FROM s {_W1}")
def expanding_mean(spark: SparkSession, folder: str) -> DataFrame:
    return steady(windows.expanding_mean(panel(spark, folder), "d", "v", ["k"]).drop("v"), 4, "expanding_mean")


@query("short_trend", f"WITH {PANEL} SELECT k, d, CAST(sign(v - lag(v, 2) OVER w) AS INTEGER) AS short_trend FROM s {_W1}")
def short_trend(spark: SparkSession, folder: str) -> DataFrame:
    return windows.short_trend(panel(spark, folder), "d", "v", ["k"]).drop("v")


@query(
    "fourier_terms",
    f"WITH {PANEL}, x AS (SELECT k, d, row_number() OVER w - 1 AS t FROM s {_W1}) SELECT k, d, CAST(t AS INTEGER) AS position, "
    + ", ".join(f"round({f}({o} * 2 * pi() * t / {p}), 6) + 0.0 AS {f}_{p}_{o}" for p in (6, 12) for o in (1, 2) for f in ("sin", "cos"))
    + " FROM x",
)
def fourier_terms(spark: SparkSession, folder: str) -> DataFrame:
    out = windows.fourier_terms(panel(spark, folder).drop("v"), "d", ["k"])
    return rounded(out, 6, *[c for c in out.columns if c[:3] in ("sin", "cos")])


@query(
    "shifted_components",
    f"WITH {PANEL} SELECT k, d, lead(v, 8) OVER w AS v_shift_m8, lead(v, 4) OVER w AS v_shift_m4, lag(v, 4) OVER w AS v_shift_4, lag(v, 8) OVER w AS v_shift_8, "
    f"lag(v, 12) OVER w AS v_shift_12 FROM s {_W1}",
)
def shifted_components(spark: SparkSession, folder: str) -> DataFrame:
    return windows.shifted(panel(spark, folder), "d", ["v"], [-8, -4, 4, 8, 12], ["k"]).drop("v")


@query(
    "difference",
    f"WITH {PANEL}, a AS (SELECT k, d, coalesce(v - lag(v) OVER w, 0) AS d1 FROM s {_W1}) SELECT k, d, round(d1, 4) AS diff_1, "
    f"round(coalesce(d1 - lag(d1) OVER w, 0), 4) AS diff_2 FROM a {_W1}",
)
def difference(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(windows.difference(panel(spark, folder), "d", "v", ["k"], order=2).drop("v"), 4, "diff_1", "diff_2")


@query("ffill", f"WITH {_GRID} SELECT k, d, last_value(v IGNORE NULLS) OVER w AS v FROM r {_W1}")
def ffill(spark: SparkSession, folder: str) -> DataFrame:
    return windows.forward_fill(resample.regular_grid(panel(spark, folder), "d", ["k"]), "d", "v", ["k"])


_HOLED = (
    "s AS (SELECT l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, nullif(max(CASE WHEN l_linenumber = 1 AND l_tax > 0.06 THEN l_quantity ELSE 0 END), 0) AS v FROM lineitem GROUP BY 1, 2)"
)
_LINE = (
    "n AS (SELECT k, d, v, row_number() OVER w AS r, last_value(v IGNORE NULLS) OVER w AS v0, "
    "last_value(CASE WHEN v IS NOT NULL THEN rr END IGNORE NULLS) OVER w AS r0, "
    "first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, "
    "first_value(CASE WHEN v IS NOT NULL THEN rr END IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r1 "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS rr FROM s) {_W1})"
)
_FILLED = "CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (r - r0) / (r1 - r0) END"


def holed(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly series per supplier in which zero means missing: ``k, d, v``."""
    rows = table(spark, folder, "lineitem", ["l_suppkey", "l_shipdate", "l_linenumber", "l_tax", "l_quantity"])
    value = F.when((F.col("l_linenumber") == 1) & (F.col("l_tax") > 0.06), F.col("l_quantity")).otherwise(0.0)
    rows = rows.select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("d"), value.alias("v"))
    return to_series(rows, time="d", value="v", keys=["k"], freq="month", fn="max").withColumn("v", zero_to_null(F.col("v")))


@query("interpolate", f"WITH {_HOLED}, {_LINE} SELECT k, d, v, round({_FILLED}, 6) AS filled FROM n")
def interpolate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(windows.interpolate(holed(spark, folder), "d", "v", ["k"], "filled"), 6, "filled")


@query(
    "fill_strategies",
    f"WITH {_HOLED}, {_LINE} SELECT k, d, v, coalesce(v, 0) AS fill_zero, round(coalesce(v, avg(v) OVER (PARTITION BY k)), 6) AS fill_mean, v0 AS fill_forward, round({_FILLED}, 6) AS fill_linear FROM n",
)
def fill_strategies(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.fill_all_ways(holed(spark, folder), "d", "v", ["k"]), 6, "fill_mean", "fill_linear")


@query(
    "smooth_centered",
    f"WITH {_HOLED}, z AS (SELECT k, d, coalesce(v, 0) AS v FROM s), m AS (SELECT k, d, v, avg(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM z) "
    "SELECT k, d, v, round(CASE WHEN v = 0 THEN 0 ELSE coalesce(m, 0) END, 6) AS v_smoothed FROM m",
)
def smooth_centered(spark: SparkSession, folder: str) -> DataFrame:
    rows = holed(spark, folder).withColumn("v", F.coalesce("v", F.lit(0.0)))
    return rounded(windows.smooth_centered(rows, "d", "v", 7, ["k"]), 6, "v_smoothed")


_PLACED = "p AS (SELECT k, d, v, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS t, count(*) OVER (PARTITION BY k) AS n FROM s)"
_SPLIT = "x AS (SELECT *, CASE WHEN t >= n - least(CAST(floor(n * 0.2::DOUBLE) AS BIGINT), 30) THEN 'test' ELSE 'train' END AS split FROM p)"


@query("train_test_tail", f"WITH {PANEL}, {_PLACED}, {_SPLIT} SELECT k, d, v, CAST(t AS INTEGER) AS position, n AS points, split FROM x")
def train_test_tail(spark: SparkSession, folder: str) -> DataFrame:
    return windows.split_tail(panel(spark, folder), "d", ["k"])


def _folds(key: str, constant: bool) -> None:
    low = "t >= n - (3 - fold) * m - m" if constant else "true"
    sql = (
        f"WITH {PANEL}, {_PLACED}, f AS (SELECT p.*, n // 4 AS m, CAST(unnest([0, 1, 2]) AS INTEGER) AS fold FROM p), r AS (SELECT k, d, fold, CASE WHEN t >= n - (3 - fold) * m AND t < n - (2 - fold) * m THEN 'test' "
        f"WHEN t < n - (3 - fold) * m AND {low} THEN 'train' END AS role FROM f) SELECT k, d, fold, role FROM r WHERE role IS NOT NULL"
    )

    @query(key, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return windows.cv_folds(panel(spark, folder), "d", ["k"], constant_size=constant).select("k", "d", "fold", "role")


_folds("cv_folds", False)
_folds("cv_folds_constant", True)


@query(
    "lookback_windows",
    f"WITH {PANEL}, x AS (SELECT k, d, v, list(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS x FROM s) "
    "SELECT k, d, v AS y, CAST(len(x) AS INTEGER) AS size, x[1] AS first, x[52] AS last, round(list_sum(x), 2) AS total FROM x WHERE len(x) = 52",
)
def lookback_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.lookback(panel(spark, folder), "d", "v", 52, ["k"])
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "k", "d", F.col("v").alias("y"), F.size("x").alias("size"), F.col("x")[0].alias("first"), F.col("x")[51].alias("last"), F.round(total, 2).alias("total")
    )


# --- raw rows in blocks ------------------------------------------------------------------------

_EV = "PARTITION BY event_type ORDER BY ts"


@query(
    "blocked_windows",
    f"SELECT event_id, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lead(value, 2) OVER w AS value_shift_m2, "
    f"CASE WHEN count(value) OVER f = 7 THEN round(avg(value) OVER f, 6) END AS rolling_mean_7 FROM events WINDOW w AS ({_EV}), f AS ({_EV} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
)
def blocked_windows(spark: SparkSession, folder: str) -> DataFrame:
    def features(rows: DataFrame, keys: list[str]) -> DataFrame:
        out = windows.lags(rows, "ts", "value", (1, 7), keys)
        out = windows.rolling(out, "ts", "value", (7,), keys)
        return windows.shifted(out, "ts", ["value"], [-2], keys)

    events = table(spark, folder, "events", ["event_id", "ts", "event_type", "value"])
    out = blocks.over_blocks(events, "ts", features, before=7, after=2, keys=["event_type"], size=5000, chunks=16)
    return rounded(out.select("event_id", "lag_1", "lag_7", "value_shift_m2", "rolling_mean_7"), 6, "rolling_mean_7")


@query("blocked_positions", f"SELECT event_id, row_number() OVER ({_EV}) - 1 AS position FROM events")
def blocked_positions(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", ["event_id", "ts", "event_type"])
    return blocks.numbered(events, "ts", ["event_type"], chunks=16).select("event_id", F.col("position").cast("bigint").alias("position"))


@query("blocked_running_mean", f"SELECT event_id, {steady_sql(f'avg(value) OVER ({_EV})', 6)} AS expanding_mean FROM events")
def blocked_running_mean(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", ["event_id", "ts", "event_type", "value"])
    return steady(blocks.running_mean(events, "ts", "value", ["event_type"], chunks=16).select("event_id", "expanding_mean"), 6, "expanding_mean")


@query(
    "blocked_ffill",
    f"SELECT event_id, last_value(CASE WHEN value > 40 THEN value END IGNORE NULLS) OVER ({_EV}) AS filled FROM events",
)
def blocked_ffill(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", ["event_id", "ts", "event_type", "value"])
    events = events.withColumn("value", F.when(F.col("value") > 40, F.col("value")))
    return blocks.carry_forward(events, "ts", "value", ["event_type"], chunks=16, out="filled").select("event_id", "filled")


# --- statistics --------------------------------------------------------------------------------

_CENTRED = "c AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS x, row_number() OVER (PARTITION BY k ORDER BY d) AS t FROM s)"


@query(
    "acf",
    f"WITH {PANEL}, {_CENTRED}, n AS (SELECT CAST(unnest(range(0, 31)) AS INTEGER) AS lag), p AS (SELECT a.k, lag, sum(a.x * b.x) AS p FROM c a, n, c b WHERE a.k = b.k AND b.t = a.t - lag GROUP BY 1, 2) "
    "SELECT p.k, p.lag, round(p.p / z.p, 6) + 0.0 AS acf FROM p JOIN p z ON z.k = p.k AND z.lag = 0",
)
def acf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.acf(panel(spark, folder), "d", "v", 30, ["k"]), 6, "acf")


_ALL_LAGS = (
    "c AS (SELECT v - avg(v) OVER () AS x, row_number() OVER (ORDER BY d) AS t, count(*) OVER () AS n FROM s), "
    "p AS (SELECT CAST(a.t - b.t AS INTEGER) AS lag, sum(a.x * b.x) AS p FROM c a JOIN c b ON b.t <= a.t AND b.t >= a.t - a.n // 2 GROUP BY 1), "
    "f AS (SELECT lag, p / (SELECT p FROM p WHERE lag = 0) AS acf FROM p)"
)


@query("acf_long", f"WITH {DAILY}, {_ALL_LAGS} SELECT lag, round(acf, 6) + 0.0 AS acf FROM f")
def acf_long(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.acf(daily(spark, folder), "d", "v", None), 6, "acf")


_MONTHLY = "s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1)"


def monthly_quantity(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity shipped per month: ``d, v``."""
    rows = table(spark, folder, "lineitem", ["l_shipdate", "l_quantity"]).withColumnsRenamed({"l_shipdate": "d", "l_quantity": "v"})
    return to_series(rows, time="d", value="v", freq="month", digits=2)


@query(
    "auto_period",
    f"WITH {_MONTHLY}, {_ALL_LAGS}, q AS (SELECT lag, acf, lag(acf) OVER (ORDER BY lag) AS a, lead(acf) OVER (ORDER BY lag) AS b, count(*) OVER () AS n FROM f) "
    "SELECT coalesce(min(lag) FILTER (acf > 0.5 AND acf > a AND acf > b AND lag >= 2 AND lag < n // 3), 12) AS period FROM q",
)
def auto_period(spark: SparkSession, folder: str) -> DataFrame:
    return stats.auto_period(monthly_quantity(spark, folder), "d", "v")


@query(
    "pacf",
    f"WITH RECURSIVE {PANEL}, {_CENTRED}, n AS (SELECT unnest(range(0, 13)) AS lag), p AS (SELECT a.k, lag, sum(a.x * b.x) AS p FROM c a, n, c b WHERE a.k = b.k AND b.t = a.t - lag GROUP BY 1, 2), "
    "r AS (SELECT p.k, list(p.p / z.p ORDER BY p.lag) AS r FROM p JOIN p z ON z.k = p.k AND z.lag = 0 GROUP BY p.k), "
    "e AS (SELECT k, r, 1 AS i, [r[2]] AS phi, r[2] AS last FROM r UNION ALL SELECT k, r, i + 1, list_append([phi[j] - nxt * phi[i + 1 - j] FOR j IN range(1, i + 1)], nxt), nxt FROM "
    "(SELECT *, (r[i + 2] - list_sum([phi[j] * r[i + 2 - j] FOR j IN range(1, i + 1)])) / (1 - list_sum([phi[j] * r[j + 1] FOR j IN range(1, i + 1)])) AS nxt FROM e WHERE i < 12)) "
    "SELECT k, CAST(i AS INTEGER) AS lag, round(last, 6) AS pacf FROM e UNION ALL SELECT k, 0, 1.0 FROM r",
)
def pacf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.pacf(panel(spark, folder), "d", "v", 12, ["k"]), 6, "pacf")


@query(
    "adf_lag0",
    f"WITH {PANEL}, x AS (SELECT k, lag(v) OVER w AS y1, v - lag(v) OVER w AS dy FROM s {_W1}), g AS (SELECT k, count(dy) AS nobs, regr_slope(dy, y1) AS gamma, "
    "regr_syy(dy, y1) AS syy, regr_sxx(dy, y1) AS sxx, regr_r2(dy, y1) AS r2 FROM x WHERE dy IS NOT NULL GROUP BY k) SELECT k, nobs, round(gamma, 6) AS gamma, "
    "round(gamma / sqrt(syy * (1 - r2) / (nobs - 2) / sxx), 4) AS statistic FROM g",
)
def adf_lag0(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(stats.adf_lag0(panel(spark, folder), "d", "v", ["k"]), 6, "gamma"), 4, "statistic")


@query("adf_test")
def adf_test(spark: SparkSession, folder: str) -> DataFrame:
    return stats.adf_level(stats.adf_test(panel(spark, folder), "d", "v", ["k"]))


# At most one lagged difference, by normal equations of centred sums; AIC on the rows that have the lag.
_ADF1 = (
    f"WITH {PANEL}, z AS (SELECT k, d, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS y FROM s WINDOW p AS (PARTITION BY k)), "
    "x AS (SELECT k, d, lag(y) OVER w AS l, y - lag(y) OVER w AS dy FROM z WINDOW w AS (PARTITION BY k ORDER BY d)), "
    "x1 AS (SELECT *, lag(dy) OVER (PARTITION BY k ORDER BY d) AS d1 FROM x), "
    "a AS (SELECT k, count(*) AS n0, regr_sxx(dy, l) AS ll, regr_syy(dy, l) AS yy, regr_sxy(dy, l) AS ly FROM x1 WHERE dy IS NOT NULL GROUP BY k), "
    "b AS (SELECT k, count(*) AS n, regr_sxx(dy, l) AS ll, regr_syy(dy, l) AS yy, regr_sxy(dy, l) AS ly, regr_syy(d1, l) AS dd, regr_sxy(d1, l) AS ld, regr_sxy(dy, d1) AS dy1 "
    "FROM x1 WHERE d1 IS NOT NULL GROUP BY k), "
    "c AS (SELECT *, ll * dd - ld * ld AS det, (dd * ly - ld * dy1) / (ll * dd - ld * ld) AS g1, (ll * dy1 - ld * ly) / (ll * dd - ld * ld) AS b1 FROM b), "
    "e AS (SELECT *, yy - g1 * ly - b1 * dy1 AS rss1, yy - ly * ly / ll AS rss0 FROM c), "
    "f AS (SELECT *, CASE WHEN n * ln(rss1 / n) + 6 < n * ln(rss0 / n) + 4 THEN 1 ELSE 0 END AS lags FROM e), "
    "g AS (SELECT f.k, lags, CASE WHEN lags = 1 THEN n ELSE n0 END AS nobs, CASE WHEN lags = 1 THEN g1 / sqrt(rss1 / (n - 3) * dd / det) "
    "ELSE a.ly / a.ll / sqrt((a.yy - a.ly * a.ly / a.ll) / (n0 - 2) / a.ll) END AS statistic FROM f JOIN a ON a.k = f.k), "
    "h AS (SELECT *, " + ", ".join(
        f"{' + '.join(f'({c!r})::DOUBLE / nobs ** {i}' for i, c in enumerate(stats.ADF_CRITICAL[level]))} AS crit_{level[:-1]}" for level in stats.ADF_CRITICAL
    ) + " FROM g) "
)


@query("adf_one_lag", _ADF1 + "SELECT k, lags, nobs, round(statistic, 4) AS statistic, round(crit_1, 6) AS crit_1, round(crit_5, 6) AS crit_5, round(crit_10, 6) AS crit_10 FROM h")
def adf_one_lag(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.adf_test(panel(spark, folder), "d", "v", ["k"], max_lag=1).select("k", "lags", "nobs", "statistic", "crit_1", "crit_5", "crit_10")
    return rounded(rounded(out, 4, "statistic"), 6, "crit_1", "crit_5", "crit_10")


@query("adf_level", _ADF1 + "SELECT k, CASE WHEN statistic <= crit_1 THEN '1%' WHEN statistic <= crit_5 THEN '5%' WHEN statistic <= crit_10 THEN '10%' ELSE 'none' END AS level FROM h")
def adf_level(spark: SparkSession, folder: str) -> DataFrame:
    return stats.adf_level(stats.adf_test(panel(spark, folder), "d", "v", ["k"], max_lag=1)).select("k", "level")


@query(
    "split_half_stats",
    f"WITH {PANEL}, {_PLACED} SELECT k, CASE WHEN t < n // 2 THEN 1 ELSE 2 END AS half, count(*) AS n, round(avg(v), 4) AS mean, round(var_samp(v), 0) AS variance FROM p GROUP BY 1, 2",
)
def split_half_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(stats.split_half(panel(spark, folder), "d", "v", ["k"]), 4, "mean"), 0, "variance")


def _decomposed(source: str, period: int) -> str:
    h = period // 2
    w = "PARTITION BY k ORDER BY d"
    total = f"sum(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    if period % 2 == 0:
        total += f" - (lag(v, {h}) OVER ({w}) + lead(v, {h}) OVER ({w})) / 2"
    return (
        f"{source}, t0 AS (SELECT k, d, v, row_number() OVER ({w}) - 1 AS t, CASE WHEN count(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {2 * h + 1} "
        f"THEN ({total}) / {period}.0::DOUBLE END AS tr FROM s), ph AS (SELECT k, t % {period} AS ph, avg(v - tr) AS m FROM t0 GROUP BY 1, 2), "
        "pm AS (SELECT k, ph, m - avg(m) OVER (PARTITION BY k) AS se FROM ph), "
        f"dc AS (SELECT t0.k, d, v, tr AS trend_component, se AS seasonal_component, v - tr - se AS residual_component FROM t0 JOIN pm ON pm.k = t0.k AND pm.ph = t % {period})"
    )


_DEC52, _DEC7 = _decomposed(PANEL, 52), _decomposed(PANEL, 7)
_PARTS = ("trend_component", "seasonal_component", "residual_component")


@query("decompose_additive", f"WITH {_DEC52} SELECT k, d, v, " + ", ".join(f"{steady_sql(c, 4)} AS {c}" for c in _PARTS) + " FROM dc")
def decompose_additive(spark: SparkSession, folder: str) -> DataFrame:
    return steady(stats.decompose(panel(spark, folder), "d", "v", 52, ["k"]), 4, *_PARTS)


@query("decompose_extrapolated")
def decompose_extrapolated(spark: SparkSession, folder: str) -> DataFrame:
    return stats.decompose(panel(spark, folder), "d", "v", 52, ["k"], extrapolate=True)


@query("stl_decomposition")
def stl_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    return stats.stl(panel(spark, folder), "d", "v", 12, ["k"], seasonal=13)


@query(
    "seasonal_strength",
    f"WITH {_DEC7}, x AS (SELECT k, 1 - var_pop(residual_component) / var_pop(seasonal_component + residual_component) AS f FROM dc WHERE residual_component IS NOT NULL GROUP BY k) "
    "SELECT k, round(f, 6) AS strength, CASE WHEN f > 0.6 THEN 'strong' WHEN f > 0.3 THEN 'moderate' ELSE 'weak' END AS grade FROM x",
)
def seasonal_strength(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.seasonal_strength(stats.decompose(panel(spark, folder), "d", "v", 7, ["k"]), ["k"]), 6, "strength")


@query(
    "lagged_corr",
    f"WITH {DAILY}, x AS (SELECT v, lead(v, 4) OVER w AS v_shift_m4, lag(v, 4) OVER w AS v_shift_4, lag(v, 12) OVER w AS v_shift_12 FROM s WINDOW w AS (ORDER BY d)) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS corr FROM x" + (" GROUP BY ALL HAVING count(*) > 1" if a == b else "")
        for a in ("v", "v_shift_m4", "v_shift_4", "v_shift_12")
        for b in ("v", "v_shift_m4", "v_shift_4", "v_shift_12")
    ),
)
def lagged_corr(spark: SparkSession, folder: str) -> DataFrame:
    moved = windows.shifted(daily(spark, folder), "d", ["v"], [-4, 4, 12])
    return rounded(profile.correlation_matrix(moved, ["v", "v_shift_m4", "v_shift_4", "v_shift_12"]), 6, "corr")


@query(
    "left_join_components",
    f"WITH {_decomposed(DAILY.replace('SELECT CAST', 'SELECT 0 AS k, CAST').replace('GROUP BY 1', 'GROUP BY 1, 2'), 7)} "
    "SELECT o_orderkey, round(trend_component, 4) AS trend_component, round(seasonal_component, 4) AS seasonal_component FROM orders LEFT JOIN dc ON CAST(o_orderdate AS DATE) = d",
)
def left_join_components(spark: SparkSession, folder: str) -> DataFrame:
    parts = stats.decompose(daily(spark, folder), "d", "v", 7).select("d", "trend_component", "seasonal_component")
    orders = table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    out = joins.add_components(orders, parts, ["d"]).drop("d")
    return rounded(out, 4, "trend_component", "seasonal_component")


# --- anomalies ---------------------------------------------------------------------------------


def _residual(width: float) -> str:
    return f"CAST(abs(residual_component) > {width} * stddev_samp(residual_component) OVER (PARTITION BY k) AS INTEGER)"


@query("residual_anomalies", f"WITH {_DEC7} SELECT k, d, v, coalesce({_residual(2.5)}, 0) AS a25, coalesce({_residual(3.0)}, 0) AS a30 FROM dc")
def residual_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    parts = stats.decompose(panel(spark, folder), "d", "v", 7, ["k"])
    out = anomaly.residual_flags(anomaly.residual_flags(parts, ["k"], width=2.5, out="a25"), ["k"], width=3.0, out="a30")
    return out.select("k", "d", "v", "a25", "a30")


@query(
    "anomaly_union",
    f"WITH {_DEC7}, z AS (SELECT k, d, residual_component AS r, coalesce({_residual(2.5)}, 0) AS a, coalesce(CAST(abs((v - avg(v) OVER p) / stddev_samp(v) OVER p) > 2 AS INTEGER), 0) AS b FROM dc WINDOW p AS (PARTITION BY k)) "
    "SELECT k, d, round(r, 4) AS residual_component, greatest(a, b) AS is_anomaly FROM z WHERE greatest(a, b) = 1 ORDER BY abs(r) DESC NULLS LAST, k, d LIMIT 10",
)
def anomaly_union(spark: SparkSession, folder: str) -> DataFrame:
    parts = anomaly.residual_flags(stats.decompose(panel(spark, folder), "d", "v", 7, ["k"]), ["k"])
    both = anomaly.any_flag(clean.zscore(parts, "v", ["k"]), ["anomaly_residual", "is_outlier"])
    top = top_by_magnitude(both.filter("is_anomaly = 1"), "residual_component", 10, unique=["k", "d"])
    return rounded(top.select("k", "d", "residual_component", "is_anomaly"), 4, "residual_component")


_DEVIATION = (
    "dv AS (SELECT k, d, v, trend_component + seasonal_component AS e, v - (trend_component + seasonal_component) AS g FROM dc), "
    "zs AS (SELECT *, (g - avg(g) OVER p) / stddev_samp(g) OVER p AS z FROM dv WINDOW p AS (PARTITION BY k)), fl AS (SELECT *, coalesce(CAST(abs(z) > 1.2 AS INTEGER), 0) AS f FROM zs)"
)


@query(
    "deviation_flags",
    f"WITH {_DEC7}, {_DEVIATION} SELECT k, d, round(e, 4) AS expected_value, round(g, 4) AS deviation, round(z, 6) AS deviation_zscore, f AS is_outlier_period FROM fl",
)
def deviation_flags(spark: SparkSession, folder: str) -> DataFrame:
    out = anomaly.deviations(stats.decompose(panel(spark, folder), "d", "v", 7, ["k"]), "v", ["k"], limit=1.2)
    out = out.select("k", "d", "expected_value", "deviation", "deviation_zscore", "is_outlier_period")
    return rounded(rounded(out, 4, "expected_value", "deviation"), 6, "deviation_zscore")


@query(
    "outlier_periods",
    f"WITH {_DEC7}, {_DEVIATION}, i AS (SELECT *, sum(1 - f) OVER {_W1[len('WINDOW w AS '):]} AS run FROM fl), o AS (SELECT k, run, min(d) AS a, max(d) AS b, count(*) AS n, avg(g) AS g, avg(e) AS e FROM i WHERE f = 1 GROUP BY 1, 2 HAVING count(*) >= 2) "
    "SELECT k, a AS start, b AS end, n AS points, round(g, 4) AS mean_deviation, CASE WHEN g > 0 THEN 'above' ELSE 'below' END AS direction, round(abs(g) / e * 100, 4) AS percent FROM o",
)
def outlier_periods(spark: SparkSession, folder: str) -> DataFrame:
    flagged = anomaly.deviations(stats.decompose(panel(spark, folder), "d", "v", 7, ["k"]), "v", ["k"], limit=1.2)
    return rounded(anomaly.outlier_periods(flagged, "d", ["k"]), 4, "mean_deviation", "percent")


@query(
    "changepoint_single",
    f"WITH {PANEL}, z AS (SELECT k, d, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS x FROM s WINDOW p AS (PARTITION BY k)), "
    "c AS (SELECT k, row_number() OVER w AS i, sum(x) OVER w AS s, count(*) OVER (PARTITION BY k) AS n, sum(x) OVER (PARTITION BY k) AS t, lead(d) OVER w AS nx FROM z WINDOW w AS (PARTITION BY k ORDER BY d)), "
    "g AS (SELECT k, nx, i, n, s * s / i + (t - s) * (t - s) / (n - i) - t * t / n AS gain, row_number() OVER (PARTITION BY k ORDER BY s * s / i + (t - s) * (t - s) / (n - i) - t * t / n DESC, i) AS r FROM c WHERE i >= 2 AND n - i >= 2) "
    "SELECT k, nx AS time, CAST(i AS INTEGER) AS at, round(gain, 4) AS gain, n FROM g WHERE r = 1",
)
def changepoint_single(spark: SparkSession, folder: str) -> DataFrame:
    out = anomaly.change_point(panel(spark, folder), "d", "v", ["k"])
    return rounded(out.select("k", "time", "at", "gain", "n"), 4, "gain")


@query(
    "change_points",
    f"WITH RECURSIVE {PANEL}, z AS (SELECT k, d, v, (v - avg(v) OVER p) / stddev_pop(v) OVER p AS x FROM s WINDOW p AS (PARTITION BY k)), "
    "c AS (SELECT k, d, v, row_number() OVER w AS i, sum(x) OVER w AS c FROM z WINDOW w AS (PARTITION BY k ORDER BY d)), "
    "seg AS (SELECT k, 0::BIGINT AS lo, count(*) AS hi, 0::DOUBLE AS clo, arg_max(c, i) AS chi FROM c GROUP BY k UNION ALL "
    "SELECT k, unnest([lo, pos]), unnest([pos, hi]), unnest([clo, mid]), unnest([mid, chi]) FROM (SELECT k, lo, hi, clo, chi, arg_max(i, gain) AS pos, arg_max(c, gain) AS mid, max(gain) AS best FROM ("
    "SELECT seg.*, i, c, (c - clo) * (c - clo) / (i - lo) + (chi - c) * (chi - c) / (hi - i) - (chi - clo) * (chi - clo) / (hi - lo) AS gain FROM seg JOIN c ON c.k = seg.k AND i - lo >= 2 AND hi - i >= 2) GROUP BY ALL) WHERE best > 5), "
    "cuts AS (SELECT DISTINCT k, lo FROM seg WHERE lo > 0) "
    "SELECT c.k, d, v, CAST(lo IS NOT NULL AS INTEGER) AS is_change_point FROM c LEFT JOIN cuts ON c.k = cuts.k AND c.i = cuts.lo + 1",
)
def change_points(spark: SparkSession, folder: str) -> DataFrame:
    series = panel(spark, folder)
    return anomaly.flag_change_points(series, anomaly.change_points(series, "d", "v", ["k"], penalty=5.0), "d", ["k"])


@query("isolation_forest")
def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    return anomaly.isolation_forest(table(spark, folder, "events", ["event_id", "value"]), "value", "event_id")


# --- simple forecasts --------------------------------------------------------------------------

_PREDICTED = (
    f"{PANEL}, {_PLACED}, {_SPLIT}, b AS (SELECT k, d, v, split, arg_max(v, t) FILTER (split = 'train') OVER (PARTITION BY k) AS naive, arg_max(v, t) FILTER (split = 'train') OVER (PARTITION BY k, t % 7) AS seasonal_naive, "
    "avg(v) FILTER (split = 'train') OVER (PARTITION BY k) AS mean FROM x), m AS ("
    + " UNION ALL ".join(
        f"SELECT k, '{m}' AS model, sqrt(avg((v - {m}) * (v - {m}))) AS rmse, avg(abs(v - {m})) AS mae FROM b WHERE split = 'test' GROUP BY k" for m in ("naive", "seasonal_naive", "mean")
    )
    + ")"
)
_BASELINES = ["naive", "seasonal_naive", "mean"]


def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = forecast.baseline_predictions(windows.split_tail(panel(spark, folder), "d", ["k"]), "v", 7, ["k"])
    return forecast.metrics(rows, "v", _BASELINES, ["k"])


@query("forecast_metrics", f"WITH {_PREDICTED} SELECT k, model, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM m")
def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(baseline_scores(spark, folder), 4, "rmse", "mae")


@query("best_model", f"WITH {_PREDICTED} SELECT k, arg_min(model, rmse) AS model, round(min(rmse), 4) AS rmse FROM m GROUP BY k")
def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.best_model(baseline_scores(spark, folder), ["k"]), 4, "rmse")


@query(
    "trend_forecast",
    f"WITH {PANEL}, {_PLACED}, {_SPLIT}, l AS (SELECT k, regr_slope(v, t) AS a, regr_intercept(v, t) AS b FROM x WHERE split = 'train' GROUP BY k) "
    "SELECT x.k, d, v, round(b + a * t, 4) AS forecast FROM x JOIN l ON x.k = l.k WHERE split = 'test'",
)
def trend_forecast(spark: SparkSession, folder: str) -> DataFrame:
    out = forecast.trend_forecast(windows.split_tail(panel(spark, folder), "d", ["k"]), "v", ["k"])
    return rounded(out.select("k", "d", "v", "forecast"), 4, "forecast")


# --- event impact ------------------------------------------------------------------------------

EVENT = date(2000, 6, 1)


@query(
    "event_windows",
    f"WITH {PANEL}, c AS (SELECT k, count_if(d < DATE '2000-06-01')::BIGINT AS pre, count_if(d >= DATE '2000-06-01')::BIGINT AS post, count(*) AS n FROM s GROUP BY k) "
    "SELECT k, pre, post, n, CAST(greatest(30, floor(n * 0.3)) AS BIGINT) AS min_pre, CAST(greatest(10, floor(n * 0.1)) AS BIGINT) AS min_post, "
    "pre >= greatest(30, floor(n * 0.3)) AND post >= greatest(10, floor(n * 0.1)) AS sufficient FROM c",
)
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return impact.event_windows(panel(spark, folder), "d", EVENT, ["k"])


_TAIL = "1.0 / (1.0 + 0.3275911 * z)"
_IMPACT = (
    f"{PANEL}, x AS (SELECT k, d >= DATE '2000-06-01' AS post, (d - DATE '2000-06-01')::DOUBLE AS t, v FROM s), l AS (SELECT k, regr_slope(v, t) AS a, regr_intercept(v, t) AS b, regr_r2(v, t) AS r2, "
    "regr_syy(v, t) AS syy, regr_sxx(v, t) AS sxx, avg(t) AS xp, count(*) AS pre FROM x WHERE NOT post GROUP BY k), p AS (SELECT x.k, count(*) AS post, sum(v) AS actual, sum(b + a * t) AS predicted, avg(t) AS xq FROM x JOIN l ON l.k = x.k WHERE x.post GROUP BY x.k), "
    "e AS (SELECT p.k, pre, post, actual, predicted, (actual - predicted) / post AS average_effect, actual - predicted AS cumulative_effect, (actual - predicted) / predicted AS relative_effect, "
    "sqrt(syy * (1 - r2) / (pre - 2) * (1.0 / post + 1.0 / pre + (xq - xp) * (xq - xp) / sxx)) AS standard_error FROM p JOIN l ON l.k = p.k), "
    "z AS (SELECT *, abs(average_effect / standard_error) / sqrt(2.0) AS z FROM e), "
    f"i AS (SELECT * EXCLUDE (z), ((((1.061405429 * ({_TAIL}) - 1.453152027) * ({_TAIL}) + 1.421413741) * ({_TAIL}) - 0.284496736) * ({_TAIL}) + 0.254829592) * ({_TAIL}) * exp(-z * z) AS p_value FROM z)"
)


@query(
    "event_impact",
    f"WITH {_IMPACT} SELECT k, pre, post, round(actual, 2) AS actual, round(predicted, 2) AS predicted, round(average_effect, 4) AS average_effect, round(cumulative_effect, 2) AS cumulative_effect, "
    "round(relative_effect, 6) AS relative_effect, round(standard_error, 4) AS standard_error, round(p_value, 8) AS p_value FROM i",
)
def event_impact(spark: SparkSession, folder: str) -> DataFrame:
    out = impact.event_impact(panel(spark, folder), "d", "v", EVENT, ["k"])
    out = rounded(rounded(out, 2, "actual", "predicted", "cumulative_effect"), 8, "p_value")
    return rounded(rounded(out, 4, "average_effect", "standard_error"), 6, "relative_effect")


@query(
    "event_verdict",
    f"WITH {_IMPACT} SELECT k, round(relative_effect, 6) AS relative_effect, round(p_value, 8) AS p_value, printf('order value %+.2f%% against expectation; %s, p=%.4f', relative_effect * 100, "
    "CASE WHEN p_value < 0.05 THEN 'beyond chance at 5%' ELSE 'within chance at 5%' END, p_value) AS verdict FROM i",
)
def event_verdict(spark: SparkSession, folder: str) -> DataFrame:
    out = impact.verdict(impact.event_impact(panel(spark, folder), "d", "v", EVENT, ["k"]), "order value")
    return rounded(rounded(out.select("k", "relative_effect", "p_value", "verdict"), 6, "relative_effect"), 8, "p_value")


# A line and a level per weekday before the event: the slope comes from deviations from the weekdays' means.
_WEEKDAYS = (
    f"{PANEL}, x AS (SELECT k, d, isodow(d) AS w, d >= DATE '2000-06-01' AS post, (d - DATE '2000-06-01') / 365.25::DOUBLE AS t, v FROM s), "
    "m AS (SELECT k, w, count(*) AS n, avg(t) AS mt, avg(v) AS mv FROM x WHERE NOT post GROUP BY 1, 2), "
    "q AS (SELECT x.k, count(*) AS pre, sum((t - mt) * (v - mv)) / sum((t - mt) * (t - mt)) AS slope, sum((t - mt) * (t - mt)) AS sxx, "
    "sum((v - mv) * (v - mv)) - sum((t - mt) * (v - mv)) * sum((t - mt) * (v - mv)) / sum((t - mt) * (t - mt)) AS rss FROM x JOIN m ON m.k = x.k AND m.w = x.w WHERE NOT post GROUP BY 1), "
    "e AS (SELECT x.k, x.d, x.v, mv + slope * (t - mt) AS predicted FROM x JOIN m ON m.k = x.k AND m.w = x.w JOIN q ON q.k = x.k WHERE post)"
)


@query(
    "impact_seasonal",
    f"WITH {_WEEKDAYS}, c AS (SELECT x.k, x.w, count(*) AS c, sum(t) AS st FROM x WHERE post GROUP BY 1, 2), "
    "u AS (SELECT c.k, sum(c * c / n) AS a, sum(st - c * mt) AS b, sum(c) AS post FROM c JOIN m ON m.k = c.k AND m.w = c.w GROUP BY 1), "
    "f AS (SELECT k, sum(v) AS actual, sum(predicted) AS predicted FROM e GROUP BY 1) "
    "SELECT f.k, pre, post::BIGINT AS post, round(actual, 2) AS actual, round(predicted, 2) AS predicted, round((actual - predicted) / post, 4) AS average_effect, "
    "round(sqrt(rss / (pre - 8) * (post + a + b * b / sxx)) / post, 4) AS standard_error FROM f JOIN q ON q.k = f.k JOIN u ON u.k = f.k",
)
def impact_seasonal(spark: SparkSession, folder: str) -> DataFrame:
    out = impact.counterfactual(panel(spark, folder), "d", "v", EVENT, ["k"], design=impact.weekday_design(EVENT))
    out = out.select("k", "pre", "post", "actual", "predicted", "average_effect", "standard_error")
    return rounded(rounded(out, 2, "actual", "predicted"), 4, "average_effect", "standard_error")


@query("impact_rows", f"WITH {_WEEKDAYS} SELECT k, d, v, round(predicted, 3) AS predicted, round(v - predicted, 3) AS effect, round(sum(v - predicted) OVER (PARTITION BY k ORDER BY d), 2) AS cumulative_effect FROM e")
def impact_rows(spark: SparkSession, folder: str) -> DataFrame:
    series, design = panel(spark, folder), impact.weekday_design(EVENT)
    fit = impact.counterfactual(series, "d", "v", EVENT, ["k"], design=design)
    out = impact.effect_on_rows(series, fit, "d", "v", EVENT, ["k"], design=design)
    return rounded(rounded(out, 3, "predicted", "effect"), 2, "cumulative_effect")
