"""Queries that fit models: panel forecasts, boosted trees with attribution, and the stream jobs."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import calendar_features
from tidemark.operators import attribution, forecast, learn, sampling, windows
from tidemark.operators.profile import rank_examples
from tidemark.operators.stats import gram_table, solve_rows, unpack_gram
from tidemark.plans.registry import panel, query, rounded
from tidemark.plans.table_queries import scratch
from tidemark.session import cut_lineage, stored_columns
from tidemark.sources.files import table, write_csv
from tidemark.streaming import jobs

# --- panel forecasts ---------------------------------------------------------------------------


@query("holt_winters")
def holt_winters(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.holt_winters(panel(spark, folder), "d", "v", 12, 12, ["k"])


@query("arima_111")
def arima_111(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.arima(panel(spark, folder), "d", "v", 12, (1, 1, 1), ["k"]).select("k", "step", "forecast", "aic")


@query("auto_arima")
def auto_arima(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.auto_arima(panel(spark, folder), "d", "v", ["k"])


def covered_time(series: DataFrame) -> dict:
    """First date and length in days of a series, in one aggregate."""
    first, last = series.agg(F.min("d"), F.max("d")).first()
    return {"start": first, "span_days": (last - first).days + 1}


@query("additive_forecast")
def additive_forecast(spark: SparkSession, folder: str) -> DataFrame:
    series = panel(spark, folder)
    span, split = covered_time(series), windows.split_tail(series, "d", ["k"])
    fit = forecast.fit_additive(split.filter("split = 'train'"), "d", "v", ["k"], **span)
    test = split.filter("split = 'test'").select("k", "d", "v")
    return forecast.predict_additive(test, fit, "d", ["k"], **span)


@query("additive_forecast_regressors")
def additive_forecast_regressors(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice", "o_custkey"])
    daily = orders.groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("d")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"), F.avg("o_custkey").alias("customer")
    )
    split = windows.split_tail(daily, "d", ["k"])
    shape = {**covered_time(daily), "regressors": ["n", "customer"]}
    fit = forecast.fit_additive(split.filter("split = 'train'"), "d", "v", ["k"], **shape)
    test = split.filter("split = 'test'").select("k", "d", "v", "n", "customer")
    return forecast.predict_additive(test, fit, "d", ["k"], **shape)


@query(
    "linear_regression_raw",
    "WITH x AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem) "
    "SELECT k, round(regr_intercept(y, x), 3) AS intercept, round(regr_slope(y, x), 4) AS slope FROM x GROUP BY k",
)
def linear_regression_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("k"), F.lit(1.0).alias("one"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )

    def solve(row: dict) -> list:
        g = unpack_gram(np.array(row["gram"], float), 3)
        return np.linalg.solve(g[:2, :2], g[:2, 2]).tolist()

    fields = [T.StructField("intercept", T.DoubleType()), T.StructField("slope", T.DoubleType())]
    return rounded(rounded(solve_rows(gram_table(rows, ["one", "x", "y"], ["k"]), ["k"], fields, solve), 3, "intercept"), 4, "slope")


@query("evaluate_models")
def evaluate_models(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.evaluate_models(panel(spark, folder), "d", "v", ["k"])


@query("forecast_best")
def forecast_best(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.forecast_best(panel(spark, folder), "d", "v", ["k"])


@query("lookback_forecast")
def lookback_forecast(spark: SparkSession, folder: str) -> DataFrame:
    series = panel(spark, folder)
    model = forecast.fit_lookback(series, "d", "v", 52, ["k"])
    return forecast.lookback_forecast(series, model, "d", "v", 12, 52, ["k"])


# --- boosted trees -----------------------------------------------------------------------------

TARGET = "l_extendedprice"
NUMBERS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
TEXTS = ["l_returnflag", "p_type"]
TREES = 100
_fitted: dict[tuple[str, ...], tuple] = {}
_tested: dict[tuple[str, ...], DataFrame] = {}


def wide(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with part attributes and a train/test mark by hash of the line."""
    lines = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", TARGET, "l_discount", "l_tax", "l_returnflag"])
    parts = table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice", "p_type"])
    line = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", TARGET, "l_discount", "l_tax", "l_returnflag")
    marked = sampling.hash_split(lines.withColumn("line", line), "line")
    joined = marked.join(parts, marked.l_partkey == parts.p_partkey).drop("p_partkey")
    return learn.prepare(joined, TARGET, NUMBERS)


def _files(spark: SparkSession, rows: DataFrame) -> list[tuple]:
    """Path and file system of the files that a table is read from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in rows.inputFiles()]
    return [(p, p.getFileSystem(conf)) for p in paths]


def _state_of(spark: SparkSession, rows: DataFrame) -> list[str]:
    """Name, length and time of change of the files that a table is read from."""
    found = [store.getFileStatus(p) for p, store in _files(spark, rows)]
    return sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found)


def _key(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """The session and the state of the files that the wide table is made of, told without a job."""
    states = [_state_of(spark, table(spark, folder, t)) for t in ("lineitem", "part")]
    return (spark.sparkContext.applicationId, *states[0], *states[1])


def fitted(spark: SparkSession, folder: str):
    """(wide table, model), fitted once per session and state of the files it is fitted on."""
    key = _key(spark, folder)
    if key not in _fitted:
        rows = wide(spark, folder)
        _fitted[key] = rows, learn.fit_boosted(rows.filter("split = 'train'"), TARGET, NUMBERS, TEXTS, trees=TREES)
    return _fitted[key]


def tested(spark: SparkSession, folder: str):
    """(test rows with prediction, model): line, features' columns and prediction are written once; what is asked of them reads only its columns.

    The split and the join behind the rows, and the trees, are not run again by each pass over them.
    """
    rows, model = fitted(spark, folder)
    key = _key(spark, folder)
    # Stored rows may have been cleared away since.
    if key not in _tested or not all(store.exists(p) for p, store in _files(spark, _tested[key])):
        scored = model.transform(rows.filter("split = 'test'").select("line", *NUMBERS, *TEXTS))
        _tested[key] = stored_columns(scored.select("line", *NUMBERS, *TEXTS, "prediction"))
    return _tested[key], model


@query("gbt_predict")
def gbt_predict(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = fitted(spark, folder)
    return model.transform(rows).select("line", "split", TARGET, F.round("prediction", 4).alias("prediction"))


@query("gbt_quality")
def gbt_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = fitted(spark, folder)
    return learn.quality(model.transform(rows), TARGET)


@query("gbt_importance")
def gbt_importance(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = fitted(spark, folder)
    return learn.importance(model.transform(rows), model)


@query("gbt_lag_importance")
def gbt_lag_importance(spark: SparkSession, folder: str) -> DataFrame:
    series = calendar_features(windows.feature_table(panel(spark, folder), "d", "v", ["k"]), "d").dropna()
    numbers, _ = learn.usable_columns(series, "v", exclude=["position"])
    rows = learn.prepare(series, "v", numbers)
    model = learn.fit_boosted(rows, "v", numbers, trees=TREES)
    return learn.strongest_by_kind(learn.importance(model.transform(rows), model))


@query("gbt_importance_sum", "SELECT 1.0::DOUBLE AS total")
def gbt_importance_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Importances are shares of one."""
    return gbt_importance(spark, folder).agg(F.round(F.sum("importance"), 9).alias("total"))


def with_features(rows: DataFrame, model) -> DataFrame:
    """Scored rows with the vector of their features; the prediction they have stays, the trees are not asked again."""
    return PipelineModel(model.stages[:-1]).transform(rows)


def attributed_rows(spark: SparkSession, folder: str):
    rows, model = tested(spark, folder)
    scored = with_features(rows, model)
    names = learn.feature_names(scored)
    return attribution.attributions(scored, model.stages[-1], ["line"]), names, scored, model


@query("shap_values")
def shap_values(spark: SparkSession, folder: str) -> DataFrame:
    attributed, names, _, _ = attributed_rows(spark, folder)
    return attribution.long_attributions(attributed, names, ["line"])


@query("shap_global")
def shap_global(spark: SparkSession, folder: str) -> DataFrame:
    attributed, names, _, _ = attributed_rows(spark, folder)
    return attribution.global_attribution(attributed, names)


@query("shap_examples")
def shap_examples(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = tested(spark, folder)
    examples = cut_lineage(rank_examples(rows.select("line", "prediction", F.col("line").alias("tie")), "prediction", "tie"))
    # A handful of lines is shown, and only they are attributed.
    shown = with_features(rows.join(F.broadcast(examples.select("line").distinct()), "line", "left_semi"), model)
    attributed = attribution.attributions(shown, model.stages[-1], ["line"])
    return attribution.explain_rows(attribution.long_attributions(attributed, learn.feature_names(shown), ["line"]), examples, ["line"])


@query("shap_additivity", "SELECT CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS rows, 0::BIGINT AS off FROM lineitem")
def shap_additivity(spark: SparkSession, folder: str) -> DataFrame:
    """Base value and attributions of every test row add up to its prediction."""
    attributed, _, _, _ = attributed_rows(spark, folder)
    total = F.aggregate("shap", F.col("base"), lambda a, b: a + b)
    gap = F.abs(total - F.col("prediction")) > 1e-6 * (1 + F.abs("prediction"))
    return attributed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("off"))


@query("shap_dependence")
def shap_dependence(spark: SparkSession, folder: str) -> DataFrame:
    attributed, names, scored, model = attributed_rows(spark, folder)
    return learn.dependence(attributed, names, ["line"], learn.importance(scored, model))


_LINE = (
    "line AS (SELECT concat_ws('-', o_orderkey, o_custkey) AS line, o_totalprice AS y, o_custkey AS x FROM orders), "
    "h AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(line), line) <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM line), "
    "l AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM h WHERE split = 'train'), p AS (SELECT h.*, b + a * x AS p FROM h, l)"
)


@query(
    "regression_metrics",
    f"WITH {_LINE} SELECT split, count(y) AS n, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM p GROUP BY split",
)
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    rows = sampling.hash_split(orders.withColumn("line", F.concat_ws("-", "o_orderkey", "o_custkey")), "line")
    out = learn.quality(learn.linear_fit(rows, "o_totalprice", "o_custkey"), "o_totalprice")
    return rounded(rounded(out, 4, "rmse"), 6, "r2")


# --- streams -----------------------------------------------------------------------------------


@query("stream_ingest", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder, ingested as they come and read back."""
    base = scratch(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    write_csv(orders, base + "/incoming")
    stream = jobs.watch_csv(spark, base + "/incoming", orders.schema)
    jobs.ingest(stream, base + "/stored", base + "/state", time="o_orderdate", freq="year").awaitTermination()
    return spark.read.parquet(base + "/stored").drop("period")


@query(
    "stream_daily_totals",
    "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, round(sum(value), 2) AS total, count(*) AS count FROM events "
    "WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2",
)
def stream_daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals from a stream over the event files; the days the watermark has closed."""
    base = scratch(spark)
    schema = table(spark, folder, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    totals = jobs.tumbling_totals(reader, "ts", "value", ["event_type"])
    jobs.write_totals(totals, base + "/totals", base + "/state").awaitTermination()
    out = spark.read.parquet(base + "/totals").withColumn("start", F.col("start").cast("timestamp_ntz"))
    return rounded(out, 2, "total")


@query(
    "stream_corrected_totals",
    "SELECT CAST(ts AS DATE) AS period, event_type, round(sum(value), 2) AS total, count(*) AS count FROM events GROUP BY 1, 2",
)
def stream_corrected_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Daily totals after two ingests, the second with rows of all days, and after its batch has come twice."""
    base = scratch(spark)
    events = table(spark, folder, "events", ["event_id", "ts", "event_type", "value"])
    first = F.col("event_id") % 3 > 0
    how = {"time": "ts", "value": "value", "keys": ["event_type"]}
    for part in (events.filter(first), events.filter(~first)):
        part.write.mode("append").parquet(base + "/incoming")
        stream = jobs.watch_parquet(spark, base + "/incoming", events.schema)
        jobs.standing_totals(stream, base + "/totals", base + "/state", **how).awaitTermination()
    jobs.keep_partials(events.filter(~first), 1, base + "/totals", **how)
    out = jobs.read_totals(spark, base + "/totals")
    return rounded(out.withColumn("period", F.to_date("period")), 2, "total")
