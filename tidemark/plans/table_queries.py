"""Queries on raw tables: sources, columns, filters, paging, summaries, samples and joins."""

from __future__ import annotations

import os
import uuid
from datetime import date, datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import predicates
from tidemark.functions.calendar import parse_time
from tidemark.functions.scalars import finite, log_abs, to_number, zero_to_null
from tidemark.operators import clean, joins, patterns, profile, sampling, schema
from tidemark.operators import query as q
from tidemark.operators.common import aggregate
from tidemark.plans.registry import longs, query, rounded
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import catalog, files
from tidemark.sources.files import table


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip, in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{os.urandom(8).hex()}"


# --- sources and sinks -------------------------------------------------------------------------


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    path = scratch(spark) + "/customer_csv"
    files.write_csv(customers, path)
    return files.read_csv(spark, path, schema=customers.schema)


@query("json_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    path = scratch(spark) + "/supplier_json"
    files.write_json(suppliers, path)
    return files.read_json(spark, path, schema=suppliers.schema)


@query(
    "ingest_normalized",
    "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), 0) AS discount, "
    "coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') AS flag, CAST(l_shipdate AS DATE) AS ship FROM lineitem",
)
def ingest_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        zero_to_null(F.col("l_discount")).alias("discount"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        F.to_date("l_shipdate").alias("ship"),
    )
    path = scratch(spark) + "/lineitem"
    files.store(rows, path, time="ship", freq="year")
    return files.read_parquet(spark, path, ["l_orderkey", "l_linenumber", "discount", "flag", "ship"])


@query("projected_scan", "SELECT l_shipdate, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def projected_scan(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", ["l_shipdate", "l_extendedprice"]).filter("l_extendedprice > 50000")


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "dataset_metadata",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset_id, (SELECT count(*) FROM {n}) AS row_count, "
        f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {n})) AS column_count"
        for n in NAMES
    ),
)
def dataset_metadata(spark: SparkSession, folder: str) -> DataFrame:
    out = catalog.describe_tables({n: table(spark, folder, n) for n in NAMES})
    return longs(out.select("dataset_id", "row_count", "column_count"), "column_count")


@query(
    "retention_filter",
    "SELECT event_id, ts, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def retention_filter(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.retained(table(spark, folder, "events", ["event_id", "ts", "value"]), "ts", timedelta(days=7))


@query(
    "expire_periods",
    "SELECT event_id, ts, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def expire_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Events kept in a folder per day, of which the old ones are dropped and one is rewritten."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    catalog.append_by_period(table(spark, folder, "events", ["event_id", "ts", "value"]), path, "ts")
    catalog.expire(spark, path, "ts", timedelta(days=7))
    return spark.read.parquet(path).drop(catalog.PERIOD)


# --- columns -----------------------------------------------------------------------------------


def _date_score(column: str, kind: str) -> str:
    hint = "count(*)" if any(w in column for w in ("date", "time", "day", "month", "year")) else "0"
    fits = {"ts": f"count({column})", "text": f"count(try_cast({column} AS TIMESTAMP))", "other": "0"}[kind]
    return f"SELECT '{column}' AS \"column\", count(*) AS \"rows\", CAST({hint} + {fits} AS BIGINT) AS score FROM x"


_DATE_COLUMNS = {
    "o_orderkey": "other", "o_custkey": "other", "o_orderstatus": "text", "o_totalprice": "other",
    "o_orderdate": "ts", "o_orderpriority": "text", "printed": "text",
}


@query(
    "detect_date_columns",
    "WITH x AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS printed FROM orders) "
    "SELECT \"column\", \"rows\", score, score >= ceil(\"rows\" / 2.0) AS is_date FROM ("
    + " UNION ALL ".join(_date_score(c, k) for c, k in _DATE_COLUMNS.items())
    + ")",
)
def detect_date_columns(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("printed", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return schema.detect_date_columns(orders)


@query(
    "auto_target",
    'SELECT "column", round(variance, 2) AS variance FROM (SELECT \'l_quantity\' AS "column", var_samp(l_quantity) AS variance FROM lineitem '
    "UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) "
    "FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem UNION ALL SELECT 'l_linenumber', var_samp(l_linenumber) "
    "FROM lineitem) ORDER BY variance DESC LIMIT 1",
)
def auto_target(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    return rounded(schema.detect_target(table(spark, folder, "lineitem"), exclude=keys), 2, "variance")


@query(
    "numeric_projection",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem",
)
def numeric_projection(spark: SparkSession, folder: str) -> DataFrame:
    return schema.numeric_and_boolean(table(spark, folder, "lineitem"), keep=["l_shipdate"])


@query("exclude_columns", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders")
def exclude_columns(spark: SparkSession, folder: str) -> DataFrame:
    drop = ["o_custkey", "o_orderpriority", "o_orderdate"]
    return schema.without_columns(table(spark, folder, "orders"), drop, keep=["o_orderdate", "o_totalprice"])


@query("core_features", "SELECT l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem")
def core_features(spark: SparkSession, folder: str) -> DataFrame:
    core = ["l_quantity", "l_discount", "l_shipdate"]
    return schema.feature_columns(table(spark, folder, "lineitem"), core, date="l_shipdate", target="l_extendedprice")


@query("rename_columns", "SELECT o_orderkey AS id, o_orderdate AS date, o_totalprice AS sales, o_orderstatus FROM orders")
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = {"o_orderkey": "id", "o_orderdate": "date", "o_totalprice": "sales"}
    return schema.rename_columns(table(spark, folder, "orders"), names, drop=["o_custkey", "o_orderpriority"])


# --- filters -----------------------------------------------------------------------------------


@query(
    "filter_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 AND o_orderpriority LIKE '1%'",
)
def filter_query(spark: SparkSession, folder: str) -> DataFrame:
    filters = {
        "o_orderstatus": {"value": "F"},
        "o_totalprice": {"operator": ">", "value": 250000},
        "o_orderpriority": {"operator": "LIKE", "value": "1%"},
        "o_custkey": {"operator": "=", "value": None},
    }
    return q.filter_rows(table(spark, folder, "orders"), filters).select("o_orderkey", "o_totalprice")


def _one_filter(key: str, column: str, operator: str, value: object, sql: str) -> None:
    @query(key, f"SELECT o_orderkey, {column} FROM orders WHERE {sql}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = q.filter_rows(table(spark, folder, "orders"), {column: {"operator": operator, "value": value}})
        return rows.select("o_orderkey", column)


_one_filter("filter_eq", "o_custkey", "=", 8, "o_custkey = 8")
_one_filter("filter_ne", "o_orderstatus", "<>", "F", "o_orderstatus <> 'F'")
_one_filter("filter_gt", "o_totalprice", ">", 400000, "o_totalprice > 400000")
_one_filter("filter_lt", "o_totalprice", "<", 5000, "o_totalprice < 5000")
_one_filter("filter_ge", "o_custkey", ">=", 1000, "o_custkey >= 1000")
_one_filter("filter_le", "o_custkey", "<=", 10, "o_custkey <= 10")
_one_filter("filter_like", "o_orderpriority", "LIKE", "%SPEC%", "o_orderpriority LIKE '%SPEC%'")
_one_filter("filter_contains", "o_orderpriority", "CONTAINS", "URGENT", "contains(o_orderpriority, 'URGENT')")


@query(
    "filter_range",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderkey < 100000000",
)
def filter_range(spark: SparkSession, folder: str) -> DataFrame:
    filters = {"o_totalprice": {"operator": ">=", "value": 100000}, "o_orderkey": {"operator": "<", "value": 100000000}}
    return q.filter_rows(table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), filters)


@query("date_range_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", ["o_orderkey", "o_orderdate"])
    return rows.filter(predicates.in_range("o_orderdate", datetime(1996, 3, 1), datetime(1997, 2, 28)))


@query("year_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1998")
def year_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]).filter(predicates.in_year("o_orderdate", 1998))


@query(
    "range_and_years",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN DATE '1996-03-01' AND DATE '2000-02-28' "
    "AND year(o_orderdate) IN (1996, 1998)",
)
def range_and_years(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", ["o_orderkey", "o_orderdate"])
    span = predicates.in_range("o_orderdate", datetime(1996, 3, 1), datetime(2000, 2, 28))
    return rows.filter(span & predicates.in_years("o_orderdate", [1996, 1998]))


@query("notnull_filter", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def notnull_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_discount"])
    return rows.filter(zero_to_null(F.col("l_discount")).isNotNull())


@query(
    "mask_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE isodow(o_orderdate) = 7 AND o_totalprice > 0 AND o_orderdate < DATE '1999-01-01'",
)
def mask_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    mask = (F.weekday("o_orderdate") == 6) & (F.col("o_totalprice") > 0) & (F.col("o_orderdate") < F.lit(date(1999, 1, 1)))
    return rows.filter(mask).select("o_orderkey", "o_totalprice")


@query(
    "dropna_report",
    "SELECT count_if(nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL)::BIGINT AS kept, count(*) AS total, "
    "round(count_if(nullif(l_discount, 0) IS NOT NULL AND nullif(l_tax, 0) IS NOT NULL) / count(*), 6) AS share FROM lineitem",
)
def dropna_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(zero_to_null(F.col("l_discount")).alias("a"), zero_to_null(F.col("l_tax")).alias("b"))
    return rounded(clean.drop_report(rows), 6, "share")


@query(
    "dropna_rows",
    "SELECT l_orderkey, l_linenumber, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0",
)
def dropna_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", zero_to_null(F.col("l_discount")).alias("discount"), zero_to_null(F.col("l_tax")).alias("tax")
    )
    return clean.drop_incomplete(rows)


@query(
    "custom_sql",
    "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority",
)
def custom_sql(spark: SparkSession, folder: str) -> DataFrame:
    statement = "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM parquet_data GROUP BY o_orderpriority"
    return q.custom_sql(table(spark, folder, "orders"), statement)


# --- sort, page, top k -------------------------------------------------------------------------


@query("sort_query", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_query(spark: SparkSession, folder: str) -> DataFrame:
    return q.sort_rows(table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]), "o_orderdate", unique=["o_orderkey"])


@query("page_query", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 250")
def page_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", ["o_orderkey", "o_totalprice"])
    return q.page(rows, "o_totalprice", descending=True, unique=["o_orderkey"], limit=100, offset=250)


@query("page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 1000")
def page_after(spark: SparkSession, folder: str) -> DataFrame:
    return q.page(table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", after=5000)


@query(
    "page_after_ties",
    "SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50) AS n FROM lineitem) "
    "WHERE n < 7 OR n IS NULL OR (n = 7 AND (l_orderkey > 300 OR (l_orderkey = 300 AND l_linenumber > 1))) ORDER BY n DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 5000",
)
def page_after_ties(spark: SparkSession, folder: str) -> DataFrame:
    """A page behind a row whose sort value many rows share."""
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    rows = rows.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(50)).alias("n"))
    return q.page(rows, "n", descending=True, unique=["l_orderkey", "l_linenumber"], after=(7, 300, 1), limit=5000)


@query(
    "topk_abs",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10",
)
def topk_abs(spark: SparkSession, folder: str) -> DataFrame:
    return q.top_by_magnitude(table(spark, folder, "customer", ["c_custkey", "c_acctbal"]), "c_acctbal", 10, unique=["c_custkey"])


@query(
    "head_tail",
    "(SELECT o_orderkey, o_orderdate, 'head' AS part FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5) UNION ALL "
    "(SELECT o_orderkey, o_orderdate, 'tail' AS part FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)",
)
def head_tail(spark: SparkSession, folder: str) -> DataFrame:
    return q.head_and_tail(table(spark, folder, "orders", ["o_orderkey", "o_orderdate"]), "o_orderdate", 5, unique=["o_orderkey"])


@query(
    "rank_examples",
    "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) "
    "SELECT p AS prob, o_orderkey, o_totalprice FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS x(p) WHERE r = CAST(floor(p * n) AS BIGINT) + 1",
)
def rank_examples(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rank_examples(table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice", "o_orderkey")


@query(
    "rank_examples_ties",
    "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity, row_number() OVER (ORDER BY l_quantity, l_orderkey * 10 + l_linenumber, l_partkey) AS r, "
    "count(*) OVER () AS n FROM lineitem) SELECT p AS prob, l_quantity FROM r, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS x(p) "
    "WHERE r = CAST(floor(p * n) AS BIGINT) + 1",
)
def rank_examples_ties(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity")
    return profile.rank_examples(rows, "l_quantity", "id").select("prob", "l_quantity")


# --- aggregates --------------------------------------------------------------------------------


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Total value of finished orders per date, first page in date order."""
    filters = {"o_orderstatus": {"operator": "=", "value": "F"}}
    orders = table(spark, folder, "orders", ["o_orderdate", "o_totalprice", "o_orderstatus"])
    totals = q.total_by_date(orders, date="o_orderdate", target="o_totalprice", filters=filters)
    return rounded(q.page(totals, "o_orderdate", limit=1000), 2, "o_totalprice")


query(
    "daily_sum",
    "SELECT o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "GROUP BY o_orderdate ORDER BY o_orderdate LIMIT 1000",
)(flagship)


@query(
    "query_counts",
    "SELECT count(*) AS total_rows, count_if(o_orderstatus = 'F')::BIGINT AS filtered_rows, true AS aggregated FROM orders",
)
def query_counts(spark: SparkSession, folder: str) -> DataFrame:
    return q.row_counts(table(spark, folder, "orders"), {"o_orderstatus": {"value": "F"}}, aggregated=True)


@query(
    "groupby_all_fns",
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS sum, count(o_totalprice) AS count, "
    "min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1",
)
def groupby_all_fns(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_orderpriority", "o_totalprice"])
    fns = ("mean", "sum", "count", "min", "max")
    out = orders.groupBy("o_orderpriority").agg(*[aggregate(fn, F.col("o_totalprice")).alias(fn) for fn in fns])
    return rounded(rounded(out, 4, "mean"), 2, "sum")


@query("groupby_one", "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1")
def groupby_one(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(q.group_values(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity", "mean"), 6, "l_quantity")


@query(
    "describe",
    "SELECT count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 4) AS q25, "
    "round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS max FROM (SELECT o_totalprice AS v FROM orders)",
)
def describe(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.describe(table(spark, folder, "orders", ["o_totalprice"]), "o_totalprice")
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


@query(
    "stats_population",
    "SELECT n AS count, round(mean, 6) AS mean, v AS median, lo AS min, hi AS max, round(sd, 6) AS std_dev FROM (SELECT l_discount AS v, "
    "row_number() OVER (ORDER BY l_discount) AS r, count(*) OVER () AS n, avg(l_discount) OVER () AS mean, min(l_discount) OVER () AS lo, "
    "max(l_discount) OVER () AS hi, stddev_pop(l_discount) OVER () AS sd FROM lineitem WHERE l_discount <> 0) WHERE r = CAST(floor(n / 2) AS BIGINT) + 1",
)
def stats_population(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(zero_to_null(F.col("l_discount")).alias("v"))
    return rounded(profile.describe_population(rows, "v"), 6, "mean", "std_dev")


_PROFILED = {"l_partkey": "bigint", "l_quantity": "double", "l_returnflag": "string", "discount": "double"}


def _profile_sql(c: str, t: str) -> str:
    head = f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, "
    if t == "string":
        nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min", "max", "mean", "median", "std"))
        return head + nothing + " FROM x"
    return (
        head + f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, "
        f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median, round(stddev_samp({c}), 4) AS std FROM x"
    )


@query(
    "profile_columns",
    "WITH x AS (SELECT l_partkey, l_quantity, l_returnflag, nullif(l_discount, 0) AS discount FROM lineitem) "
    + " UNION ALL ".join(_profile_sql(c, t) for c, t in _PROFILED.items()),
)
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", zero_to_null(F.col("l_discount")).alias("discount"))
    return rounded(profile.profile_columns(rows), 4, "mean", "median", "std")


@query(
    "missing_values",
    "WITH x AS (SELECT nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag FROM lineitem) "
    "SELECT 'discount' AS \"column\", count_if(discount IS NULL)::BIGINT AS missing FROM x UNION ALL SELECT 'tax', count_if(tax IS NULL)::BIGINT FROM x "
    "UNION ALL SELECT 'flag', count_if(flag IS NULL OR flag = '')::BIGINT FROM x",
)
def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        zero_to_null(F.col("l_discount")).alias("discount"),
        zero_to_null(F.col("l_tax")).alias("tax"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag"),
    )
    return profile.missing_values(rows)


@query(
    "missing_over_time",
    "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, count_if(l_discount = 0)::BIGINT AS discount, count_if(l_tax = 0)::BIGINT AS tax FROM lineitem GROUP BY 1",
)
def missing_over_time(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        "l_shipdate", zero_to_null(F.col("l_discount")).alias("discount"), zero_to_null(F.col("l_tax")).alias("tax")
    )
    return profile.missing_over_time(rows, F.to_date(F.trunc("l_shipdate", "month")), ["discount", "tax"])


@query("distinct_keys", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY l_suppkey")
def distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_values(table(spark, folder, "lineitem"), "l_suppkey")


@query("distinct_years", "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY 1 DESC")
def distinct_years(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_years(table(spark, folder, "orders"), "o_orderdate", descending=True)


@query("kpi_summary", "SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average, count(o_totalprice) AS count FROM orders")
def kpi_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(profile.total_and_mean(table(spark, folder, "orders"), "o_totalprice"), 2, "total"), 4, "average")


@query(
    "time_span",
    "SELECT a AS first, b AS last, CAST(floor(year(b) - year(a) + (month(b) - month(a)) / 12.0 + 0.5) AS INTEGER) AS years_by_parts, "
    "greatest(1, CAST(floor(datesub('month', a, b) / 12.0 + 0.5) AS INTEGER)) AS years_by_months FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)",
)
def time_span(spark: SparkSession, folder: str) -> DataFrame:
    return profile.time_span(table(spark, folder, "orders"), "o_orderdate")


@query(
    "daily_all_entities",
    "SELECT o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice, sum(coalesce(customers, 0))::BIGINT AS customers, "
    "arg_min(o_orderstatus, o_custkey * 10 + ascii(o_orderstatus) / 100.0) AS o_orderstatus, CAST(0 AS BIGINT) AS o_custkey "
    "FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS customers FROM orders) GROUP BY o_orderdate",
)
def daily_all_entities(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("customers", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7))
    out = patterns.daily_over_entities(
        orders, date="o_orderdate", entity="o_custkey", sums=["o_totalprice"], null_safe_sums=["customers"], firsts=["o_orderstatus"]
    )
    return rounded(out, 2, "o_totalprice")


@query(
    "daily_one_entity",
    "SELECT o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice, CAST(8 AS BIGINT) AS o_custkey FROM orders WHERE o_custkey = 8 GROUP BY o_orderdate",
)
def daily_one_entity(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return rounded(patterns.daily_over_entities(orders, date="o_orderdate", entity="o_custkey", sums=["o_totalprice"], chosen=8), 2, "o_totalprice")


@query(
    "histogram_by_year",
    "WITH x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS v, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders) "
    "SELECT year, CAST(least(30, floor(30.0::DOUBLE * (v - lo) / (hi - lo)) + 1) AS INTEGER) AS bucket, count(*) AS count FROM x GROUP BY 1, 2",
)
def histogram_by_year(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return profile.histogram(rows, "o_totalprice", ["year"], 30)


@query(
    "boxplot_by_year",
    "WITH x AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS v FROM lineitem), q AS (SELECT year, quantile_cont(v, 0.25) AS q1, "
    "quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY year), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, "
    "q3 + 1.5 * (q3 - q1) AS high_fence FROM q) SELECT year, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, "
    "round(any_value(q3), 4) AS q3, round(any_value(low_fence), 4) AS low_fence, round(any_value(high_fence), 4) AS high_fence, "
    "min(v) FILTER (v BETWEEN low_fence AND high_fence) AS low_whisker, max(v) FILTER (v BETWEEN low_fence AND high_fence) AS high_whisker, "
    "count_if(NOT (v BETWEEN low_fence AND high_fence))::BIGINT AS outliers FROM x JOIN f USING (year) GROUP BY year",
)
def boxplot_by_year(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("year"), "l_extendedprice")
    return rounded(profile.boxplot(rows, "l_extendedprice", ["year"]), 4, "q1", "median", "q3", "low_fence", "high_fence")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_with_target",
    "SELECT \"column\", round(c, 6) AS corr, CASE WHEN c > 0 THEN 'positive' WHEN c < 0 THEN 'negative' ELSE 'none' END AS sign FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", corr(l_extendedprice, {c}) AS c FROM lineitem" for c in _NUM if c != "l_extendedprice")
    + ") ORDER BY c DESC",
)
def corr_with_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlate_target(table(spark, folder, "lineitem"), "l_extendedprice", _NUM), 6, "corr")


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round({'1.0::DOUBLE' if x == y else f'corr({x}, {y})'}, 6) AS corr FROM lineitem"
        + (" GROUP BY ALL HAVING count(*) > 1" if x == y else "")
        for x in _NUM
        for y in _NUM
    ),
)
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.correlation_matrix(table(spark, folder, "lineitem"), _NUM), 6, "corr")


_HOLES = {"a": "nullif(l_quantity, 7)", "b": "nullif(l_discount, 0)", "c": "nullif(l_tax, 0)", "d": "l_extendedprice", "e": "CASE WHEN l_linenumber > 2 THEN l_linenumber END", "f": "l_quantity * 0 + 3"}


@query(
    "corr_matrix_holes",
    "WITH h AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in _HOLES.items()) + " FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {'1.0::DOUBLE' if x == y else 'NULL::DOUBLE' if 'f' in (x, y) else f'(SELECT round(corr({x}, {y}), 6) FROM h)'} AS corr"
        for x in _HOLES for y in _HOLES
    ),
)
def corr_matrix_holes(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair over the rows where both columns are known; one column is constant."""
    rows = table(spark, folder, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in _HOLES.items()])
    return rounded(profile.correlation_matrix(rows), 6, "corr")


@query(
    "regr_line",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(regr_slope(l_extendedprice, {c}), 4) AS slope, round(regr_intercept(l_extendedprice, {c}), 4) AS intercept, "
        f"round(regr_r2(l_extendedprice, {c}), 6) AS r2 FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    ),
)
def regr_line(spark: SparkSession, folder: str) -> DataFrame:
    features = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return rounded(rounded(profile.regression_lines(table(spark, folder, "lineitem"), "l_extendedprice", features), 4, "slope", "intercept"), 6, "r2")


_GAPS = "g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS g FROM events)"
_FREQUENCY = (
    "CASE WHEN s % 86400 = 0 THEN CASE WHEN s / 86400 = 1 THEN 'Daily' WHEN s / 86400 = 7 THEN 'Weekly' WHEN s / 86400 BETWEEN 28 AND 31 THEN 'Monthly' "
    "ELSE CAST(CAST(s / 86400 AS BIGINT) AS VARCHAR) || ' Days' END WHEN s % 3600 = 0 THEN CAST(CAST(s / 3600 AS BIGINT) AS VARCHAR) || ' Hours' ELSE 'Irregular' END"
)


@query(
    "infer_frequency",
    "WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT (d - lag(d) OVER (ORDER BY d)) * 86400.0::DOUBLE AS s FROM t), "
    "c AS (SELECT s, count(*) AS c FROM g WHERE s IS NOT NULL GROUP BY s), m AS (SELECT s, c FROM c ORDER BY c DESC, s LIMIT 1) "
    f"SELECT s AS seconds, c AS count, (SELECT sum(s * c) FROM c) AS total_seconds, (SELECT sum(c)::BIGINT FROM c) AS gaps, {_FREQUENCY} AS frequency FROM m",
)
def infer_frequency(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return profile.infer_frequency(days, "d", chunks=16)


@query(
    "event_gaps",
    f"WITH {_GAPS} SELECT event_type, count(*) AS gaps, round(sum(g) / 1e6, 3) AS total_seconds, round(max(g) / 1e6, 3) AS longest FROM g WHERE g IS NOT NULL GROUP BY 1",
)
def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    gaps = profile.interval_counts(table(spark, folder, "events"), "ts", ["event_type"], chunks=16)
    out = gaps.groupBy("event_type").agg(
        F.sum("count").alias("gaps"), F.sum(F.col("seconds") * F.col("count")).alias("total_seconds"), F.max("seconds").alias("longest")
    )
    return rounded(out, 3, "total_seconds", "longest")


@query(
    "rare_categories",
    "WITH n AS (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1), x AS (SELECT CASE WHEN c < 600 THEN 'RARE_CATEGORY' "
    "ELSE CAST(l_suppkey AS VARCHAR) END AS grouped FROM lineitem JOIN n USING (l_suppkey)) SELECT grouped, count(*) AS n FROM x GROUP BY 1",
)
def rare_categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"))
    pooled = profile.pool_rare(rows, "supplier", at_least=600, out="grouped")
    return pooled.groupBy("grouped").agg(F.count(F.lit(1)).alias("n"))


# --- scalars -----------------------------------------------------------------------------------


@query("log_abs", "SELECT c_custkey, round(ln(abs(nullif(c_acctbal, 0))), 6) AS log_abs FROM customer")
def log_abs_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.round(log_abs(F.col("c_acctbal")), 6).alias("log_abs"))


@query(
    "parse_dates",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS DATE) AS parsed FROM orders",
)
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("no date"))
    )
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.to_date(parse_time(F.col("text"), "dd/MM/yyyy", "yyyy-MM-dd")).alias("parsed"))


@query(
    "coerce_numeric",
    "SELECT o_orderkey, coalesce(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE), 0) AS number FROM orders",
)
def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", to_number(text).alias("number"))


@query(
    "sanitize",
    "SELECT c_custkey, CASE WHEN c_custkey % 7 < 3 THEN 0 ELSE c_acctbal END AS clean FROM customer",
)
def sanitize(spark: SparkSession, folder: str) -> DataFrame:
    bad = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 7 == 1, F.lit(float("inf")))
    dirty = bad.when(F.col("c_custkey") % 7 == 2, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    return table(spark, folder, "customer").select("c_custkey", finite(dirty).alias("clean"))


@query(
    "zscore_flag",
    "WITH x AS (SELECT o_orderkey, o_orderpriority, (o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w AS z FROM orders "
    "WINDOW w AS (PARTITION BY o_orderpriority)) SELECT o_orderkey, round(z, 6) AS z, CAST(abs(z) > 1.5 AS INTEGER) AS is_outlier FROM x",
)
def zscore_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    out = clean.zscore(rows, "o_totalprice", ["o_orderpriority"], limit=1.5)
    return out.select("o_orderkey", F.round("o_totalprice_zscore", 6).alias("z"), "is_outlier")


@query(
    "standardize",
    "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal_std FROM customer",
)
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    out = clean.standardize(table(spark, folder, "customer", ["c_custkey", "c_acctbal"]), ["c_acctbal"])
    return rounded(out.select("c_custkey", "c_acctbal_std"), 6, "c_acctbal_std")


@query(
    "minmax_scale",
    "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)) - 1, 6) "
    "AS c_acctbal_scaled, c_acctbal AS restored FROM customer",
)
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    scaled = clean.minmax_scale(table(spark, folder, "customer", ["c_custkey", "c_acctbal"]), "c_acctbal")
    out = clean.minmax_restore(scaled, "c_acctbal_scaled", "restored")
    return rounded(rounded(out.select("c_custkey", "c_acctbal_scaled", "restored"), 6, "c_acctbal_scaled"), 2, "restored")


@query(
    "one_hot",
    "SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R FROM lineitem",
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    return clean.one_hot(rows, "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query(
    "one_hot_fitted",
    "WITH f AS (SELECT l_returnflag AS flag, row_number() OVER (ORDER BY l_returnflag DESC) AS r, count(*) OVER () AS n FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN r = n THEN 0 ELSE r END AS BIGINT) AS slot, n - 1 AS slots FROM lineitem JOIN f ON l_returnflag = flag",
)
def one_hot_fitted(spark: SparkSession, folder: str) -> DataFrame:
    """The slot that each flag has in the fitted encoding, 0 for the level that is left out."""
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    stages, (encoded,) = clean.fit_one_hot(rows, ["l_returnflag"])
    flagged = PipelineModel(stages).transform(rows).select("l_orderkey", "l_linenumber", vector_to_array(encoded).alias("hot"))
    return flagged.select("l_orderkey", "l_linenumber", F.array_position("hot", 1.0).alias("slot"), F.size("hot").cast("bigint").alias("slots"))


@query(
    "column_types",
    "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS column, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS dtype FROM (DESCRIBE orders)",
)
def column_types(spark: SparkSession, folder: str) -> DataFrame:
    return schema.column_types(table(spark, folder, "orders"))


@query(
    "align_union",
    "SELECT o_orderkey AS id, o_totalprice AS price, 0.0::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, 0.0, c_acctbal FROM customer",
)
def align_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return clean.align_union(a, b)


# --- samples -----------------------------------------------------------------------------------

_HASHED = "h AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER () AS n FROM orders)"


@query("hash_sample", f"WITH {_HASHED} SELECT o_orderkey, o_totalprice FROM h WHERE r <= 500")
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hash_sample(table(spark, folder, "orders", ["o_orderkey", "o_totalprice"]), 500, "o_orderkey")


@query("hash_split", f"WITH {_HASHED} SELECT o_orderkey, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM h")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hash_split(table(spark, folder, "orders", ["o_orderkey"]), "o_orderkey")


_STRATIFIED = (
    "WITH c AS (SELECT event_type, count(*) AS c, sum(count(*)) OVER () AS t FROM events GROUP BY 1), e AS (SELECT *, 777 * c / t AS x FROM c), "
    "f AS (SELECT *, floor(x) AS b, round(x - floor(x), 9) AS fr FROM e), "
    "g AS (SELECT *, row_number() OVER (ORDER BY fr DESC, md5(event_type)) AS rr, 777 - sum(b) OVER () AS lft FROM f), "
    "k AS (SELECT event_type, b + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS k FROM g), "
    "r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events) "
)


@query("stratified_sample", _STRATIFIED + "SELECT event_id, event_type FROM r JOIN k USING (event_type) WHERE r <= k")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, folder, "events", ["event_id", "event_type"]), 777, "event_type", "event_id")


@query(
    "sample_report",
    _STRATIFIED + ", s AS (SELECT value FROM r JOIN k USING (event_type) WHERE r <= k) SELECT 'value' AS \"column\", round(a, 4) AS full_mean, round(b, 4) AS full_std, "
    "round(c, 4) AS sample_mean, round(d, 4) AS sample_std, round(abs(a - c), 4) AS mean_diff, round(abs(b - d), 4) AS std_diff FROM "
    "(SELECT avg(value) AS a, stddev_samp(value) AS b FROM events), (SELECT avg(value) AS c, stddev_samp(value) AS d FROM s)",
)
def sample_report(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", ["event_id", "event_type", "value"])
    sample = sampling.stratified_sample(events, 777, "event_type", "event_id")
    out = profile.compare_samples(events, sample, ["value"])
    return rounded(out, 4, *[c for c in out.columns if c != "column"])


@query("cluster_sample")
def cluster_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice"])
    return sampling.cluster_sample(rows, 100, "p_partkey")


@query(
    "cluster_sample_size",
    "SELECT CAST(least(100, count(*)) AS BIGINT) AS rows, CAST(least(100, count(*)) AS BIGINT) AS ids, 0::BIGINT AS strangers FROM part",
)
def cluster_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    """The sample is exactly as large as asked for, without repeats and only of given rows."""
    sample, parts = cluster_sample(spark, folder), table(spark, folder, "part", ["p_partkey", "p_size", "p_retailprice"])
    known = sample.select("p_partkey").join(parts.select("p_partkey"), "p_partkey").count()
    return sample.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("p_partkey").alias("ids"), (F.count(F.lit(1)) - known).alias("strangers"))


# --- joins -------------------------------------------------------------------------------------


@query(
    "flag_membership",
    "SELECT o_orderkey, CAST(o_orderdate IN (SELECT o_orderdate FROM orders GROUP BY 1 HAVING count(*) > 9) AS INTEGER) AS is_busy FROM orders",
)
def flag_membership(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_orderkey", "o_orderdate"])
    busy = orders.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n")).filter("n > 9")
    return joins.flag_members(orders, busy, ["o_orderdate"], "is_busy").select("o_orderkey", "is_busy")


@query(
    "fact_dim_join",
    "SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def fact_dim_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", ["o_custkey", "o_totalprice"])
    per_customer = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    with_customer = joins.add_attributes(per_customer, table(spark, folder, "customer", ["c_custkey", "c_nationkey"]), "o_custkey", "c_custkey")
    named = joins.add_attributes(with_customer, table(spark, folder, "nation", ["n_nationkey", "n_name"]), "c_nationkey", "n_nationkey")
    return named.groupBy("n_name").agg(F.round(F.sum("total"), 2).alias("total"), F.sum("n").alias("n"))


@query(
    "nearest_date",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT * FROM (VALUES (DATE '1994-06-01'), (DATE '1998-07-04'), (DATE '2002-01-01')) AS x(event_date)), "
    "r AS (SELECT event_date, d, abs(d - event_date) AS off, row_number() OVER (PARTITION BY event_date ORDER BY abs(d - event_date), d) AS r FROM d, e) "
    "SELECT event_date, d AS nearest, CAST(off AS INTEGER) AS days_off FROM r WHERE r = 1",
)
def nearest_date(spark: SparkSession, folder: str) -> DataFrame:
    events = [date(1994, 6, 1), date(1998, 7, 4), date(2002, 1, 1)]
    return joins.nearest_dates(table(spark, folder, "orders", ["o_orderdate"]), "o_orderdate", events)


@query(
    "nearest_lookup",
    "WITH o AS (SELECT o_orderkey, o_orderpriority AS k, o_orderdate AS t FROM orders), r AS (SELECT o_orderpriority AS k, o_orderdate AS t, min(o_orderkey) AS big FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2), "
    "b AS (SELECT o.*, r.t AS bt, r.big AS bb FROM o ASOF LEFT JOIN r ON o.k = r.k AND o.t >= r.t), a AS (SELECT o.o_orderkey, r.t AS nt, r.big AS ab FROM o ASOF LEFT JOIN r ON o.k = r.k AND o.t <= r.t) "
    "SELECT b.o_orderkey, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bb ELSE ab END AS nearest_big, "
    "(86400 * CASE WHEN nt IS NULL OR t - bt <= nt - t THEN date_diff('day', bt, t) ELSE date_diff('day', t, nt) END)::DOUBLE AS nearest_seconds FROM b JOIN a ON a.o_orderkey = b.o_orderkey",
)
def nearest_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For every order the nearest large order of its priority; equally near ones are frequent."""
    orders = table(spark, folder, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"]).withColumnsRenamed({"o_orderpriority": "k", "o_orderdate": "t"})
    large = orders.filter("o_totalprice > 400000").select("k", "t", F.col("o_orderkey").alias("big"))
    return joins.nearest_rows(orders, large, "t", "t", ["k"], chunks=8).select("o_orderkey", "nearest_big", "nearest_seconds")


_EVENT_SIDES = "l AS (SELECT event_id, user_id AS k, ts AS t FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id AS k, ts AS t, event_id AS hit FROM events WHERE event_type = 'purchase')"


@query(
    "nearest_event",
    f"WITH {_EVENT_SIDES}, b AS (SELECT l.*, r.t AS bt, hit AS bh FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t), a AS (SELECT l.event_id, r.t AS nt, hit AS ah FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t <= r.t) "
    "SELECT b.event_id, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) THEN bh ELSE ah END AS nearest_hit FROM b JOIN a ON a.event_id = b.event_id",
)
def nearest_event(spark: SparkSession, folder: str) -> DataFrame:
    """For every other event the purchase of the same user that is nearest in time."""
    events = table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type"])
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("hit"))
    return joins.nearest_rows(events.filter("event_type <> 'purchase'"), bought, "ts", "ts", ["user_id"], chunks=8).select("event_id", "nearest_hit")
