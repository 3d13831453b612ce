"""Every query with SQL must give the same rows, columns and types as that SQL."""

import pytest
from compare import check, connection

import __spark_entry__ as entry

WITH_SQL = sorted(entry.oracle_sql())
# Checked as registered below, by what is known about their rows.
CHECKS = {
    "adf_test": lambda d: d["p_value"].between(0, 1).all(),
    "stl_decomposition": lambda d: len(d) > 1000,
    "holt_winters": lambda d: (d.groupby("k").size() == 12).all(),
    "arima_111": lambda d: (d.groupby("k").size() == 12).all(),
    "auto_arima": lambda d: d["k"].nunique() == 5 and d.select_dtypes("number").notna().all().all(),
    "additive_forecast": lambda d: d["k"].nunique() == 5,
    "additive_forecast_regressors": lambda d: d["k"].nunique() == 5,
    "decompose_extrapolated": lambda d: d.notna().all().all(),
    "evaluate_models": lambda d: d["k"].nunique() == 5,
    "forecast_best": lambda d: d["k"].nunique() == 5,
    "lookback_forecast": lambda d: (d.groupby("k").size() == 12).all(),
    "cluster_sample": lambda d: len(d) == 100 and d["p_partkey"].is_unique,
    "isolation_forest": lambda d: d["event_id"].is_unique and 0.04 <= d["anomaly_iso"].mean() <= 0.05 and d.loc[d["anomaly_iso"] == 1, "iso_score"].min() > d.loc[d["anomaly_iso"] == 0, "iso_score"].max(),
    "gbt_quality": lambda d: set(d["split"]) == {"train", "test"} and d.loc[d["split"] == "train", "r2"].item() > 0.3,
    "gbt_importance": lambda d: abs(d["importance"].sum() - 1) < 1e-9,
    "gbt_predict": lambda d: d["prediction"].notna().all(),
    "shap_examples": lambda d: d["line"].nunique() == 3,
}


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, con, folder, name):
    problem, _, _ = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_known_about_rows(spark, folder, name):
    rows = entry.queries()[name](spark, folder).toPandas()
    assert len(rows) and CHECKS[name](rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, folder):
    df = entry.entry(spark)
    assert df.columns == ["o_orderdate", "o_totalprice"]
    assert df.count() > 0


def test_auto_arima_takes_the_daily_panel(spark, folder, monkeypatch):
    from tidemark.operators import forecast
    from tidemark.plans.registry import panel

    monkeypatch.setattr(forecast, "auto_arima", lambda series, *_: series)
    assert entry.queries()["auto_arima"](spark, folder).count() == panel(spark, folder).count()
