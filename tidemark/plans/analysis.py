"""The whole analysis of a panel in one call: every step a lazy table over one stored series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_features
from tidemark.operators import anomaly, forecast, impact, patterns, profile, stats, windows
from tidemark.operators.common import numeric_columns, to_series
from tidemark.session import cut_lineage


def analyze(
    df: DataFrame,
    *,
    time: str,
    value: str,
    keys: Sequence[str] = (),
    freq: str = "day",
    period: int | None = None,
    event: date | None = None,
) -> dict[str, DataFrame]:
    """Result tables by name.

    The raw table is read once, for the series of one row per key and period; that series is stored
    and every step works on it. ``period`` is the season length; without it each step uses the one
    most often found in the autocorrelation of the series. Nothing but that number and the change
    points is computed before a result is used.
    """
    series = cut_lineage(to_series(df, time=time, value=value, keys=keys, freq=freq))
    periods = stats.auto_period(series, time, value, keys)
    if period is None:
        common = periods.groupBy("period").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "period").first()
        period = common["period"] if common else 12
    parts = stats.stl(series, time, value, period, keys)
    flagged = anomaly.deviations(anomaly.residual_flags(parts, keys), value, keys)
    features = calendar_features(windows.feature_table(series, time, value, keys), time)
    points = anomaly.change_points(series, time, value, keys)
    numbers = [c for c in numeric_columns(features) if c not in (value, *keys)]
    out = {
        "series": series,
        "summary": profile.describe(series, value),
        "missing": profile.missing_values(series),
        "frequency": profile.infer_frequency(series, time, keys),
        "by_month": patterns.mean_by_part(series, time, value, "month", keys=keys),
        "by_weekday": patterns.mean_by_part(series, time, value, "day_of_week", keys=keys),
        "by_year": patterns.mean_by_part(series, time, value, "year", keys=keys),
        "weekday_by_month": patterns.pivot_weekday_month(series, time, value),
        "stationarity": stats.adf_level(stats.adf_test(series, time, value, keys)),
        "acf": stats.acf(series, time, value, 30, keys),
        "pacf": stats.pacf(series, time, value, 30, keys),
        "periods": periods,
        "seasonality": stats.seasonal_strength(parts, keys),
        "anomalies": flagged,
        "outlier_periods": anomaly.outlier_periods(flagged, time, keys),
        "features": features,
        "correlations": profile.correlate_target(features, value, [value, *numbers]),
        "change_points": points,
        "forecast": forecast.forecast_best(series, time, value, keys, period=period, freq=freq),
    }
    if event is not None:
        snapped = impact.snap_event(series, time, event) or event
        out["event_windows"] = impact.event_windows(series, time, snapped, keys)
        out["event_impact"] = impact.verdict(impact.event_impact(series, time, value, snapped, keys), value)
    return out
