"""Results are whole: no step limit, no lost ties or nulls, one definition at every size."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import anomaly, blocks, impact, profile, query, resample, stats


def test_every_step_of_a_long_staircase_is_found(spark):
    rows, t = [], 0
    for step in range(20):
        for _ in range(6):
            rows.append((date(2020, 1, 1) + timedelta(days=t), float(step * step)))
            t += 1
    points = anomaly.change_points(spark.createDataFrame(rows, "d date, v double"), "d", "v", penalty=1e-12).collect()
    starts = {rows[6 * k][0] for k in range(1, 20)}
    assert starts - {p.d for p in points} <= {rows[6][0], rows[12][0]} and len(points) >= 19
    assert anomaly.change_points(spark.createDataFrame(rows[:0], "d date, v double"), "d", "v").count() == 0


def plain_change_points(x, penalty, least=2):
    c, found, open_ = np.concatenate([[0.0], np.cumsum((x - x.mean()) / x.std())]), set(), [(0, len(x))]
    while open_:
        lo, hi = open_.pop()
        at = np.arange(lo + least, hi - least + 1)
        if len(at):
            gain = (c[at] - c[lo]) ** 2 / (at - lo) + (c[hi] - c[at]) ** 2 / (hi - at) - (c[hi] - c[lo]) ** 2 / (hi - lo)
            best = int(at[gain.argmax()])
            if gain.max() > penalty:
                found.add(best)
                open_ += [(lo, best), (best, hi)]
    return found


@pytest.mark.parametrize("chunks", [1, 5])
def test_change_points_do_not_depend_on_chunks(spark, chunks):
    rng = np.random.default_rng(8)
    series = {k: np.concatenate([rng.normal(m, 1, rng.integers(10, 60)) for m in rng.integers(-4, 5, 12)]) for k in ("a", None)}
    start = date(2020, 1, 1)
    rows = [(k, start + timedelta(days=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    # Rows without a time or a value take no part.
    rows += [("a", None, 1000.0), ("a", date(2019, 1, 1), None), ("b", date(2019, 1, 1), None)]
    out = anomaly.change_points(spark.createDataFrame(rows, "k string, d date, v double"), "d", "v", ["k"], penalty=4.0, chunks=chunks).collect()
    got = {k: {(r["d"] - start).days for r in out if r["k"] == k} for k in series}
    assert got == {k: plain_change_points(x, 4.0) for k, x in series.items()} and len(out) == sum(map(len, got.values()))


@pytest.mark.parametrize("descending", [False, True])
def test_pages_add_up_with_ties_and_nulls(spark, descending):
    values = [(1, 1), (2, 2), (2, 3), (3, 4), (None, 5), (None, 6), (None, None)]
    table = spark.createDataFrame(values, "v int, id int")
    seen, after = [], None
    while page := query.page(table, "v", descending=descending, unique=["id"], limit=2, after=after).collect():
        seen += [tuple(r) for r in page]
        after = seen[-1]
    assert seen == [tuple(r) for r in query.sort_rows(table, "v", descending=descending, unique=["id"]).collect()] and len(seen) == 7


def test_rows_without_a_time_are_kept(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=i) if i % 4 else None, float(i) if i % 3 else None) for i in range(20)]
    table = spark.createDataFrame(rows, "id int, t timestamp, v double")
    for out, column in (
        (blocks.numbered(table, "t", chunks=3), "position"),
        (blocks.running_mean(table, "t", "v", chunks=3), "expanding_mean"),
        (blocks.carry_forward(table, "t", "v", chunks=3, out="filled"), "filled"),
        (blocks.over_blocks(table, "t", lambda r, k: r.withColumn("twice", r["v"] * 2), before=1, size=5, chunks=3), "twice"),
    ):
        found = {r.id: r[column] for r in out.collect()}
        assert len(found) == 20 and all(found[i] is None for i in range(0, 20, 4))


@pytest.mark.parametrize("most", [10, 60, 61, 500, None])
def test_acf_has_one_definition(spark, most):
    x = np.random.default_rng(3).normal(size=150).cumsum()
    table = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(x)], "d date, v double")
    got = {r.lag: r.acf for r in stats.acf(table, "d", "v", most).collect()}
    c = x - x.mean()
    top = 75 if most is None else min(most, 149)
    assert sorted(got) == list(range(top + 1))
    for k, v in got.items():
        assert v == pytest.approx((c[k:] * c[: len(c) - k]).sum() / (c * c).sum(), abs=1e-9)


def test_month_ends(spark):
    table = spark.createDataFrame([(date(2023, 2, 28), 1.0), (date(2023, 5, 31), 2.0)], "d date, v double")
    assert [r.d for r in resample.regular_grid(table, "d", freq="month_end").orderBy("d").collect()] == [date(2023, 2, 28), date(2023, 3, 31), date(2023, 4, 30), date(2023, 5, 31)]
    assert [r.d for r in resample.future_grid(table, "d", 3, freq="month_end").orderBy("d").collect()] == [date(2023, 6, 30), date(2023, 7, 31), date(2023, 8, 31)]


def test_infinities_have_classes_of_their_own(spark):
    values = [0.0, 5.0, 10.0, float("inf"), float("-inf"), float("nan")]
    got = {r.bucket: r["count"] for r in profile.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", bins=2).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2}


def test_both_zeros_are_one_value(spark):
    table = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "v double")
    assert profile.profile_columns(table).first()["unique_count"] == 2


def test_verdict_names_size_and_doubt(spark):
    table = spark.createDataFrame([(0.125, 0.01), (-0.5, 0.2)], "relative_effect double, p_value double")
    text = [r.verdict for r in impact.verdict(table, "sales").collect()]
    assert "+12.50%" in text[0] and "beyond" in text[0] and "-50.00%" in text[1] and "within" in text[1]
