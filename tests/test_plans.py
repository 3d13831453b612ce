"""The plans that matter at scale: what reaches the scan, and what must not appear."""

import re
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import anomaly, clean, profile, stats, windows
from tidemark.operators.common import to_series

LAZY = [
    "daily_sum", "filter_query", "year_filter", "range_and_years", "groupby_all_fns", "histogram_by_year", "corr_matrix", "fact_dim_join",
    "standardize", "minmax_scale", "retention_filter", "query_counts", "missing_values", "resample_week_sum", "regular_grid", "future_grid",
    "lag_features", "rolling_stats", "interpolate", "cv_folds", "acf", "decompose_additive", "outlier_periods", "changepoint_single",
    "forecast_metrics", "event_impact", "nearest_date", "left_join_components",
]


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_product_joins(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(entry.queries()["year_filter"](spark, folder))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    text = plan(entry.queries()["projected_scan"](spark, folder))
    assert "GreaterThan(l_extendedprice,50000.0)" in text
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_totals_combine_before_the_shuffle(spark, folder):
    text = plan(entry.queries()["daily_sum"](spark, folder))
    assert "partial_sum" in text and "TakeOrderedAndProject" in text


def test_features_of_a_series_share_one_shuffle(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    series = to_series(rows, time="o_orderdate", value="o_totalprice", keys=["o_orderpriority"])
    text = plan(windows.feature_table(series, "o_orderdate", "o_totalprice", keys=["o_orderpriority"]))
    # One shuffle for the aggregate, one for all windows, which also share their sort.
    assert [len(re.findall(rf"^\(\d+\) {step}", text, re.M)) for step in ("Exchange", "Sort", "Window")] == [2, 1, 1]


def test_key_statistics_leave_raw_rows_in_place(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    for df in (
        clean.zscore(rows, "o_totalprice", ["o_orderpriority"]),
        clean.standardize(rows, ["o_totalprice"], ["o_orderpriority"]),
        profile.pool_rare(rows, "o_orderpriority"),
    ):
        text = plan(df)
        assert "BroadcastHashJoin" in text and "Window" not in text and "hashpartitioning(o_orderpriority" not in text


def test_python_only_where_a_series_needs_it(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    series = to_series(rows, time="o_orderdate", value="o_totalprice", keys=["o_orderpriority"])
    args = ("o_orderdate", "o_totalprice")
    keys = ["o_orderpriority"]
    lazy = [stats.acf(series, *args, 30, keys), stats.pacf(series, *args, 10, keys), stats.decompose(series, *args, 7, keys), anomaly.change_point(series, *args, keys)]
    assert all("Python" not in plan(df) and "Pandas" not in plan(df) for df in lazy)
    assert "FlatMapGroupsInPandas" in plan(stats.stl(series, *args, 12, keys))
    assert series.filter(F.col("o_totalprice").isNull()).count() == 0
