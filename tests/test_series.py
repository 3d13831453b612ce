"""Statistics, anomalies, forecasts, impact, streams: known answers and invariants."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, blocks, forecast, impact, resample, stats, windows
from tidemark.operators.common import to_series
from tidemark.plans.analysis import analyze
from tidemark.streaming import jobs

START = date(2020, 1, 1)


def days(n):
    return [START + timedelta(days=i) for i in range(n)]


def frame(spark, **series):
    pdf = pd.concat([pd.DataFrame({"k": k, "d": days(len(v)), "v": np.asarray(v, float)}) for k, v in series.items()])
    return spark.createDataFrame(pdf, "k string, d date, v double")


def wave(n=240):
    t = np.arange(n)
    return 10 + 0.5 * t + 5 * np.sin(2 * np.pi * t / 12)


def autoregressive(phi=0.7, n=2000, seed=7):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n), np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + e[i]
    return x


@pytest.fixture(scope="module")
def seeded(spark):
    rng = np.random.default_rng(7)
    return frame(spark, ar=autoregressive(), walk=np.cumsum(rng.normal(size=1000)), noise=rng.normal(size=1000)).cache()


def by_key(df, *columns):
    return {r["k"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


# --- windows on awkward series -----------------------------------------------------------------


def test_degenerate_series(spark):
    df = frame(spark, one=[3.0], flat=[2.0] * 5, none=[np.nan] * 4).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    rolled = windows.rolling(df, "d", "v", (3,), ["k"])
    assert rolled.filter("k = 'flat' and rolling_mean_3 = 2.0 and rolling_std_3 = 0.0").count() == 3
    assert rolled.filter("k <> 'flat' and rolling_mean_3 is not null").count() == 0
    assert windows.percent_changes(df.withColumn("v", F.lit(0.0)), "d", "v", (1,), ["k"]).filter("pct_change_1 is not null").count() == 0
    assert windows.interpolate(df, "d", "v", ["k"]).filter("k = 'none' and v is not null").count() == 0
    assert stats.acf(df, "d", "v", 3, ["k"]).filter("acf is not null").count() == 0
    empty = df.limit(0)
    assert windows.feature_table(empty, "d", "v", ["k"]).count() == 0
    assert stats.stl(empty, "d", "v", 12, ["k"]).count() == 0
    assert stats.decompose(empty, "d", "v", 4).count() == 0


def test_repeated_timestamps_are_summed_first(spark):
    df = spark.createDataFrame([("a", START, 1.0), ("a", START, 2.0), (None, START, 5.0), ("a", None, 9.0)], "k string, d date, v double")
    got = {r["k"]: r["v"] for r in to_series(df, time="d", value="v", keys=["k"]).collect()}
    assert got == {"a": 3.0, None: 5.0}


def test_interpolation_rules(spark):
    rows = [(d, v) for d, v in zip(days(7), [None, 1.0, None, None, 4.0, None, None], strict=True)]
    df = spark.createDataFrame(rows, "d date, v double")
    got = [r["v"] for r in windows.interpolate(df, "d", "v").orderBy("d").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_smoothing_keeps_closed_days(spark):
    df = frame(spark, a=[2, 0, 4, 6, 0])
    got = [r["v_smoothed"] for r in windows.smooth_centered(df, "d", "v", 3, ["k"]).orderBy("d").collect()]
    assert got == [2.0, 0.0, 5.0, 5.0, 0.0]


def test_runs_need_two_points(spark):
    df = frame(spark, a=[1, 0, 1, 1, 0, 1, 1, 1])
    runs = windows.flagged_runs(df, "d", F.col("v") == 1, ["k"])
    assert sorted((r["run"], r["run_length"]) for r in runs.collect()) == [(1, 2), (1, 2), (2, 3), (2, 3), (2, 3)]


def test_grid_fills_gaps_per_key(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 4), 2.0), (None, date(2024, 1, 1), 3.0)], "k string, d date, v double")
    grid = resample.regular_grid(df, "d", ["k"])
    assert grid.count() == 5 and grid.filter("v is null").count() == 2
    assert [r["d"] for r in resample.future_grid(df.filter("k = 'a'"), "d", 2, freq="month").orderBy("step").collect()] == [date(2024, 2, 4), date(2024, 3, 4)]


def test_blocks_equal_plain_windows(spark):
    rng = np.random.default_rng(1)
    # One key holds most rows, a few stamps lie far apart.
    stamps = np.concatenate([rng.choice(10**6, 3000, replace=False), [10**9, 4 * 10**9]])
    keys = np.where(rng.uniform(size=len(stamps)) < 0.8, "hot", "cold")
    base = datetime(2024, 1, 1)
    pdf = pd.DataFrame({"k": keys, "t": [base + timedelta(seconds=int(s)) for s in stamps], "v": rng.normal(size=len(stamps))})
    df = spark.createDataFrame(pdf, "k string, t timestamp_ntz, v double").cache()

    def features(rows, keys):
        return windows.shifted(windows.rolling(rows, "t", "v", (9,), keys), "t", ["v"], [-3, 5], keys)

    cut = blocks.over_blocks(df, "t", features, before=8, after=3, keys=["k"], size=50, chunks=8).toPandas()
    plain = features(df, ["k"]).toPandas()
    order = ["k", "t"]
    pd.testing.assert_frame_equal(
        cut.sort_values(order).reset_index(drop=True)[plain.columns], plain.sort_values(order).reset_index(drop=True), rtol=1e-9
    )
    with pytest.raises(ValueError, match="at least as long"):
        blocks.over_blocks(df, "t", features, before=80, size=50)


# --- statistics --------------------------------------------------------------------------------


def test_acf_paths_agree(seeded):
    few = stats.acf(seeded, "d", "v", 20, ["k"]).toPandas().sort_values(["k", "lag"])
    many = stats.acf(seeded, "d", "v", 100, ["k"]).filter("lag <= 20").toPandas().sort_values(["k", "lag"])
    assert np.allclose(few["acf"], many["acf"], atol=1e-10)


def test_pacf_of_an_autoregression(seeded):
    got = stats.pacf(seeded.filter("k = 'ar'"), "d", "v", 5, ["k"]).orderBy("lag").toPandas()["pacf"].to_numpy()
    assert got[0] == 1.0 and got[1] == pytest.approx(0.7, abs=0.05)
    assert (np.abs(got[2:]) < 0.07).all()


def test_adf_tells_walks_from_noise(seeded):
    out = by_key(stats.adf_level(stats.adf_test(seeded, "d", "v", ["k"])), "stationary", "level")
    assert out["noise"] == (True, "1%") and out["ar"] == (True, "1%") and out["walk"][0] is False


def plain_adf(y, max_lag=None):
    """(statistic, lags, observations) by fitting every model to its rows."""
    y = np.array([v for v in y if v is not None and not np.isnan(v)])
    n = len(y)
    if n < 8 or y.min() == y.max():
        return None, 0, n
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)) if max_lag is None else max_lag, n // 2 - 3)
    level = (y - y.mean()) / y.std()
    steps = np.diff(level)

    def fit(lags, skip, columns=None):
        past = [steps[skip - i : len(steps) - i] for i in range(1, lags + 1)]
        x, dy = np.stack([np.ones(len(steps) - skip), level[skip:-1], *past], axis=1)[:, :columns], steps[skip:]
        inverse = np.linalg.pinv(x.T @ x)
        beta = inverse @ x.T @ dy
        rss = ((dy - x @ beta) ** 2).sum()
        return beta, rss, inverse, len(dy)

    scores = []
    for p in range(top + 1):
        _, rss, _, m = fit(top, top, p + 2)
        scores.append((m * np.log(rss / m) + 2 * (p + 2), p))
    lags = min(scores)[1]
    beta, rss, inverse, m = fit(lags, lags)
    return beta[1] / np.sqrt(rss / (m - lags - 2) * inverse[1, 1]), lags, m


def test_adf_against_single_fits(spark):
    rng = np.random.default_rng(12)
    noise = rng.normal(size=400)
    ar = [0.0, 0.0, 0.0]
    for e in rng.normal(size=300):
        ar.append(0.5 * ar[-1] - 0.4 * ar[-2] + 0.3 * ar[-3] + e)
    shapes = {"walk": noise.cumsum(), "noise": noise, "ar": np.array(ar), "short": noise[:9], "seven": noise[:7], "flat": np.full(50, 2.0), "holes": np.where(np.arange(400) % 9 == 0, np.nan, noise)}
    rows = [(k, i, float(v)) for k, y in shapes.items() for i, v in enumerate(y)] + [("none", 0, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    for max_lag in (None, 0, 1, 4):
        got = {r.k: r for r in stats.adf_test(df, "d", "v", ["k"], max_lag=max_lag).collect()}
        assert got.keys() == shapes.keys() | {None}
        for k, y in shapes.items():
            tau, lags, n = plain_adf(y, max_lag)
            assert (got[k].lags, got[k].nobs) == (lags, n), k
            assert got[k].statistic == (pytest.approx(tau, rel=1e-6) if tau is not None else None)
    alone = stats.adf_test(df.filter("k = 'ar'"), "d", "v").first()
    assert alone.statistic == pytest.approx(plain_adf(shapes["ar"])[0], rel=1e-6)
    assert stats.adf_test(df.limit(0), "d", "v", ["k"]).count() == 0


def test_adf_lag0_is_the_special_case(seeded):
    full = by_key(stats.adf_test(seeded, "d", "v", ["k"], max_lag=0), "statistic", "nobs")
    short = by_key(stats.adf_lag0(seeded, "d", "v", ["k"]), "statistic", "nobs")
    for k in full:
        assert full[k][0] == pytest.approx(short[k][0], rel=1e-8) and full[k][1] == short[k][1]


def test_published_critical_values():
    assert [round(stats.adf_critical(c, 10**9), 2) for c in ("1%", "5%", "10%")] == [-3.43, -2.86, -2.57]
    for level, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
        assert stats.adf_p_value(stats.adf_critical(level, 10**9)) == pytest.approx(p, abs=0.002)


def test_auto_period(spark):
    df = frame(spark, wave=np.sin(2 * np.pi * np.arange(240) / 15), noise=np.random.default_rng(0).normal(size=240))
    assert by_key(stats.auto_period(df, "d", "v", ["k"]), "period") == {"wave": 15, "noise": 12}


@pytest.mark.parametrize("period", [7, 12])
def test_decompositions_add_up(spark, period):
    df = frame(spark, a=wave(), b=wave(150) * 2)
    sums = F.col("trend_component") + F.col("seasonal_component") + F.col("residual_component")
    for parts in (stats.decompose(df, "d", "v", period, ["k"], extrapolate=True), stats.stl(df, "d", "v", period, ["k"])):
        assert parts.count() == 390
        assert parts.filter(F.abs(sums - F.col("v")) > 1e-9).count() == 0
        assert parts.filter("trend_component is null").count() == 0


def test_decomposition_finds_the_wave(spark):
    df = frame(spark, a=wave())
    for parts in (stats.decompose(df, "d", "v", 12, ["k"]), stats.stl(df, "d", "v", 12, ["k"])):
        worst = parts.agg(F.max(F.abs("residual_component"))).first()[0]
        assert worst < 0.6
        assert stats.seasonal_strength(parts, ["k"]).first()["grade"] == "strong"


def test_short_series_stl_gives_nulls(spark):
    assert stats.stl(frame(spark, a=[1, 2, 3]), "d", "v", 12, ["k"]).filter("trend_component is null").count() == 3


# --- anomalies ---------------------------------------------------------------------------------


def test_isolation_forest_finds_spikes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=1000)
    v[::20] = np.where(rng.uniform(size=50) < 0.5, 10, -10) + rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "v": v})).union(spark.createDataFrame([(5000, None)], "id bigint, v double"))
    got = anomaly.isolation_forest(df, "v", "id").cache()
    flagged = [r["id"] for r in got.filter("anomaly_iso = 1").collect()]
    assert 40 <= len(flagged) <= 50
    assert sum(i % 20 == 0 for i in flagged) >= 0.9 * len(flagged)
    assert got.filter("id = 5000 and anomaly_iso = 0 and iso_score is null").count() == 1
    assert anomaly.isolation_forest(df.limit(0), "v", "id").count() == 0


def test_weighted_quantile_is_the_quantile():
    x = np.array([1.0, 1, 1, 2, 5, 5, 9])
    values, counts = np.unique(x, return_counts=True)
    for p in (0, 0.1, 0.5, 0.77, 1):
        assert anomaly.weighted_quantile(values, counts, p) == pytest.approx(np.quantile(x, p))


def test_change_points_in_steps(spark):
    rng = np.random.default_rng(3)
    two = np.concatenate([rng.normal(0, 1, 100), rng.normal(5, 1, 100)])
    four = np.concatenate([rng.normal(m, 0.5, 60) for m in (0, 6, 1, 8)])
    df = frame(spark, two=two, four=four, none=rng.normal(size=120), flat=np.ones(50))
    single = by_key(anomaly.change_point(df.filter("k = 'two'"), "d", "v", ["k"]), "time", "at")
    assert abs((single["two"][0] - START).days - 100) <= 2
    found = anomaly.change_points(df, "d", "v", ["k"])
    spots = {}
    for r in found.collect():
        spots.setdefault(r["k"], []).append((r["d"] - START).days)
    assert set(spots) == {"two", "four"}
    assert len(spots["two"]) == 1
    assert np.allclose(sorted(spots["four"]), [60, 120, 180], atol=2)
    assert anomaly.flag_change_points(df, found, "d", ["k"]).agg(F.sum("is_change_point")).first()[0] == 4
    assert anomaly.change_points(df.filter("k = 'none'").drop("k"), "d", "v").count() == 0


# --- forecasts ---------------------------------------------------------------------------------


def test_holt_winters_continues_a_clean_series(spark):
    df = frame(spark, a=wave(), b=wave() + 100, short=[1, 2, 3])
    got = forecast.holt_winters(df, "d", "v", 12, 12, ["k"], box_cox=False).toPandas()
    want = wave(252)[240:]
    assert set(got["k"]) == {"a", "b"}
    assert np.allclose(got[got["k"] == "a"].sort_values("step")["forecast"], want, atol=0.2)
    assert np.allclose(got[got["k"] == "b"].sort_values("step")["forecast"], want + 100, atol=0.2)


def test_box_cox_round_trip():
    y = np.exp(np.random.default_rng(0).normal(3, 1, 500))
    lam = forecast.box_cox_lambda(y)
    assert abs(lam) <= 0.15
    assert np.allclose(forecast._inverse_box_cox(forecast._box_cox(y, 0.3), 0.3), y)
    assert forecast.box_cox_lambda(np.array([1.0, -1.0, 2.0])) == 1.0


def test_arima_recovers_coefficients(spark):
    rng = np.random.default_rng(4)
    e, w = rng.normal(size=3000), np.zeros(3000)
    for i in range(1, 3000):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    r = forecast.arima(frame(spark, a=np.cumsum(w)), "d", "v", 3, (1, 1, 1), ["k"]).first()
    assert r["phi"][0] == pytest.approx(0.6, abs=0.06) and r["theta"][0] == pytest.approx(0.3, abs=0.07)


def test_auto_arima_prefers_the_true_order(spark):
    df = frame(spark, ar=autoregressive(0.8, 800, 1), walk=np.cumsum(np.random.default_rng(5).normal(size=800)))
    got = by_key(forecast.auto_arima(df, "d", "v", ["k"], max_p=2, max_q=1), "ar", "diff")
    assert got["ar"][0] >= 1 and got["ar"][1] == 0 and got["walk"][1] == 1


def test_additive_model_with_regressor(spark):
    rng = np.random.default_rng(6)
    t = np.arange(900)
    x = rng.normal(size=900)
    y = 50 + 0.05 * t + 4 * np.sin(2 * np.pi * t / 7) + 3 * x
    pdf = pd.DataFrame({"k": "a", "d": days(900), "v": y, "x": x})
    df = spark.createDataFrame(pdf)
    shape = {"start": START, "span_days": 900, "regressors": ["x"], "yearly": 2, "knots": 3}
    fit = forecast.fit_additive(df.limit(800), "d", "v", ["k"], **shape)
    rows = forecast.predict_additive(df, fit, "d", ["k"], **shape).orderBy("d").toPandas()
    assert np.abs(rows["forecast"] - rows["v"])[800:].max() < 1.0


def test_best_model_and_future(spark):
    df = frame(spark, a=wave(200) + np.random.default_rng(8).normal(0, 0.1, 200), b=wave(200) * 3)
    scores = forecast.evaluate_models(df, "d", "v", ["k"])
    assert scores.count() == 6 and scores.filter("rmse < 0 or mae > rmse + 1e-9").count() == 0
    ahead = forecast.forecast_best(df, "d", "v", ["k"], periods=5).toPandas()
    assert len(ahead) == 10 and ahead["d"].min() == START + timedelta(days=200)
    assert np.allclose(ahead[ahead["k"] == "b"].sort_values("step")["forecast"], wave(205)[200:] * 3, rtol=0.05)


@pytest.mark.parametrize("trees", [False, True])
def test_lookback_regression(spark, trees):
    df = frame(spark, a=np.sin(2 * np.pi * np.arange(200) / 12) * 5 + 20, b=np.sin(2 * np.pi * np.arange(150) / 12) * 5 + 20)
    model = forecast.fit_lookback(df, "d", "v", 12, ["k"], trees=trees)
    got = forecast.lookback_forecast(df, model, "d", "v", 6, 12, ["k"]).filter("k = 'a'").orderBy("step").toPandas()
    assert list(got["step"]) == [1, 2, 3, 4, 5, 6]
    gap = np.abs(got["forecast"] - (np.sin(2 * np.pi * np.arange(200, 206) / 12) * 5 + 20))
    assert gap.mean() < (0.6 if trees else 0.01)


# --- impact ------------------------------------------------------------------------------------


def test_normal_tail(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,)], "z double")
    got = [r["p"] for r in df.select(impact.normal_tail(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [1.0, 0.05, 0.01], atol=1e-6)


def test_event_impact_sees_a_jump(spark):
    rng = np.random.default_rng(9)
    t = np.arange(200)
    base = 100 + 0.1 * t + rng.normal(0, 1, 200)
    df = frame(spark, jump=base + np.where(t >= 150, 20, 0), none=base)
    out = impact.verdict(impact.event_impact(df, "d", "v", START + timedelta(days=150), ["k"]), "sales")
    got = by_key(out, "average_effect", "p_value", "verdict")
    assert got["jump"][0] == pytest.approx(20, abs=1) and got["jump"][1] < 0.001
    assert "sales +" in got["jump"][2] and "beyond chance" in got["jump"][2]
    assert got["none"][1] > 0.05
    enough = by_key(impact.event_windows(df, "d", START + timedelta(days=195), ["k"]), "sufficient")
    assert enough == {"jump": False, "none": False}
    assert impact.snap_event(df, "d", date(2030, 1, 1)) == START + timedelta(days=199)
    assert impact.snap_event(df, "d", START, strict=True) == START
    with pytest.raises(ValueError, match="no observation"):
        impact.snap_event(df, "d", date(2030, 1, 1), strict=True)


# --- streams -----------------------------------------------------------------------------------


def test_stream_totals_equal_batch_and_drop_late_rows(spark, tmp_path):
    schema = "t timestamp_ntz, k string, v double"
    source = str(tmp_path / "in")
    first = [(datetime(2024, 1, 1, 5), "a", 1.0), (datetime(2024, 1, 1, 6), "a", 2.0), (datetime(2024, 1, 5), "b", 4.0)]
    second = [(datetime(2024, 1, 1, 7), "a", 100.0), (datetime(2024, 1, 4, 1), "b", 8.0), (datetime(2024, 1, 9), "a", 1.0)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        totals = jobs.tumbling_totals(jobs.watch_parquet(spark, source, schema), "t", "v", ["k"])
        jobs.write_totals(totals, out, state).awaitTermination()
    got = {(r["start"].day, r["k"]): (r["total"], r["count"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "a"): (3.0, 2), (4, "b"): (8.0, 1), (5, "b"): (4.0, 1)}


def test_stream_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id int, name string, d date"
    for i in range(2):
        spark.createDataFrame([(i, None, date(2024, 1 + i, 1))], schema).write.mode("append").option("header", True).csv(source)
        jobs.ingest(jobs.watch_csv(spark, source, schema), target, state, time="d").awaitTermination()
    rows = spark.read.parquet(target)
    assert sorted((r["id"], r["name"]) for r in rows.collect()) == [(0, ""), (1, "")]


# --- all together ------------------------------------------------------------------------------


def test_analysis_runs_every_step(spark):
    df = frame(spark, a=wave(150), b=wave(150) + np.random.default_rng(1).normal(0, 1, 150))
    out = analyze(df, time="d", value="v", keys=["k"], event=START + timedelta(days=100))
    assert len(out) == 21
    for step, table in out.items():
        rows = table.count()
        assert rows > 0 or step in ("outlier_periods", "change_points"), step
    assert math.isclose(out["summary"].first()["count"], 300)


def test_counterfactual_is_least_squares(spark):
    rng = np.random.default_rng(31)
    start, event = date(2020, 1, 1), date(2020, 10, 1)
    rows = []
    for k, jump in (("up", 5.0), ("none", 0.0), (None, -3.0)):
        for i in range(400):
            d = start + timedelta(days=i)
            rows.append((k, d, 10 + 0.02 * i + (d.weekday() == 6) * 4 + jump * (d >= event) + float(rng.normal())))
    rows += [("late", date(2021, 1, 1) + timedelta(days=i), 1.0) for i in range(5)] + [("early", start, 1.0), ("up", None, 3.0), ("up", start, None)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    design = impact.weekday_design(event)
    out = {r.k: r for r in impact.counterfactual(df, "d", "v", event, ["k"], design=design).collect()}
    assert out.keys() == {"up", "none", None, "late", "early"}
    assert (out["late"].pre, out["late"].post, out["late"].predicted) == (0, 5, None) and (out["early"].pre, out["early"].post) == (1, 0)
    assert out["up"].average_effect == pytest.approx(5, abs=0.5) and out["up"].p_value < 0.001 and out["none"].p_value > 0.01
    mine = [(d, v) for k, d, v in rows if k == "up" and d and v is not None]
    x = np.array([[(d - event).days / 365.25, *[float(d.weekday() == i) for i in range(7)]] for d, _ in mine])
    y, pre = np.array([v for _, v in mine]), np.array([d < event for d, _ in mine])
    beta, rss, *_ = np.linalg.lstsq(x[pre], y[pre], rcond=None)
    total = x[~pre].sum(axis=0)
    error = np.sqrt(rss[0] / (pre.sum() - 8) * ((~pre).sum() + total @ np.linalg.inv(x[pre].T @ x[pre]) @ total)) / (~pre).sum()
    assert out["up"].predicted == pytest.approx(total @ beta) and out["up"].standard_error == pytest.approx(error)
    fit = impact.counterfactual(df.filter("k = 'up'"), "d", "v", event, design=design)
    each = impact.effect_on_rows(df.filter("k = 'up'"), fit, "d", "v", event, design=design).orderBy("d").collect()
    assert [r.effect for r in each] == pytest.approx((y - x @ beta)[~pre].tolist()) and each[-1].cumulative_effect == pytest.approx(out["up"].cumulative_effect)


def test_counterfactual_with_the_forecast_design(spark):
    start, event = date(2018, 1, 1), date(2020, 1, 1)
    rows = [(start + timedelta(days=i), 100 + 10 * float(np.sin(2 * np.pi * i / 365.25)) + 0.01 * i + (7.0 if i >= 730 else 0.0)) for i in range(900)]
    df = spark.createDataFrame(rows, "d date, v double")

    def design(time):
        return forecast.seasonal_design(time, start, 900, knots=0, yearly=3, weekly=1)

    row = impact.counterfactual(df, "d", "v", event, design=design, ridge={"c_trend": 1e-6}).first()
    assert row.average_effect == pytest.approx(7.0, abs=0.05)


def test_long_autocorrelations_of_many_lengths(spark):
    rng = np.random.default_rng(40)
    shapes = {"one": 1, "two": 2, "odd": 333, "long": 20_000, None: 700}
    values = {k: rng.normal(size=n).cumsum() for k, n in shapes.items()} | {"flat": np.full(90, 3.0)}
    pdf = pd.DataFrame([(k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)], columns=["k", "d", "v"])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("odd", -5, None), ("void", 1, None)], "k string, d bigint, v double"))
    for max_lag in (None, 100, 5):
        got = {}
        for r in stats.acf(df, "d", "v", max_lag, ["k"]).collect():
            got.setdefault(r.k, {})[r.lag] = r.acf
        assert got.keys() == values.keys()
        for k, v in values.items():
            n = len(v)
            top = n // 2 if max_lag is None else min(max_lag, n - 1)
            assert sorted(got[k]) == list(range(top + 1))
            x = v - v.mean()
            for lag in {0, 1, top // 3, top} & set(range(top + 1)):
                want = float(x[lag:] @ x[: n - lag] / (x @ x)) if x @ x > 0 else None
                assert got[k][lag] == (None if want is None else pytest.approx(want, abs=1e-9))
    alone = stats.acf(df.filter("k = 'long'"), "d", "v", None)
    assert alone.count() == 10_001 and stats.acf(df.limit(0), "d", "v", None, ["k"]).count() == 0


def test_a_million_points_to_half_their_lags(spark):
    n = 1_000_000
    df = spark.range(n).select("id", (F.sin(F.col("id") * 2 * math.pi / 1000) + F.rand(5) * 0.1).alias("v"))
    got = {r.lag: r.acf for r in stats.acf(df, "id", "v", None).filter("lag in (0, 500, 1000, 250000, 500000)").collect()}
    assert got[0] == 1.0 and got[500] == pytest.approx(-1.0, abs=0.01) and got[1000] == pytest.approx(1.0, abs=0.01)
    assert got[250_000] == pytest.approx(0.75, abs=0.01) and got[500_000] == pytest.approx(0.5, abs=0.01)


def test_late_rows_and_replays_correct_standing_totals(spark, tmp_path):
    base = str(tmp_path)
    schema = "k string, t timestamp, v double"
    day = datetime(2024, 5, 1)
    parts = [
        [("a", day, 1.0), ("a", day + timedelta(days=9), 2.0), (None, day, 5.0)],
        [("a", day + timedelta(hours=3), 10.0), ("b", day - timedelta(days=400), 7.0), ("b", None, 9.0)],
        [("a", day, 100.0)],
    ]
    with pytest.raises(ValueError, match="no totals"):
        jobs.read_totals(spark, base + "/totals")

    def totals():
        return {(r["k"], r["period"].date() if isinstance(r["period"], datetime) else r["period"]): (r["total"], r["count"]) for r in jobs.read_totals(spark, base + "/totals").collect()}

    want = {}
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(base + "/in")
        jobs.standing_totals(jobs.watch_parquet(spark, base + "/in", schema), base + "/totals", base + "/state", "t", "v", ["k"]).awaitTermination()
        for k, t, v in rows:
            if t is not None:
                s, c = want.get((k, t.date()), (0.0, 0))
                want[k, t.date()] = (s + v, c + 1)
        assert totals() == want
        jobs.keep_partials(spark.createDataFrame(rows, schema), i, base + "/totals", "t", "v", ["k"])
        assert totals() == want
        jobs.compact_totals(spark, base + "/totals")
        assert totals() == want
