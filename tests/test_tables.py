"""Filters, paging, discovery, quantiles, samples: known answers and edge cases."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.predicates import conditions
from tidemark.operators import clean, joins, profile, sampling, schema
from tidemark.operators import query as q
from tidemark.operators.common import bounded
from tidemark.operators.quantiles import order_statistics, quantiles
from tidemark.sources import catalog, files


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "anna", 3.0, True), (2, "bo'b", None, False), (3, None, -5.0, True), (4, "50%", 3.0, None)]
    return spark.createDataFrame(rows, "id bigint, name string, score double, ok boolean")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filter_defaults_and_typing(people):
    assert ids(q.filter_rows(people, {"id": {"value": 2}})) == [2]
    assert ids(q.filter_rows(people, {"name": {"value": "bo'b"}})) == [2]
    assert ids(q.filter_rows(people, {"ok": {"value": True}})) == [1, 3]
    assert ids(q.filter_rows(people, {"id": {"operator": ">", "value": None}})) == [1, 2, 3, 4]
    assert ids(q.filter_rows(people, {"name": {"operator": "contains", "value": "%"}})) == [4]
    assert ids(q.filter_rows(people, {"name": {"operator": "LIKE", "value": "%n%"}})) == [1]
    assert ids(q.filter_rows(people, None)) == [1, 2, 3, 4]


def test_filter_errors(people):
    with pytest.raises(ValueError, match="unknown column"):
        conditions({"nope": {"value": 1}}, people.columns)
    with pytest.raises(ValueError, match="unknown operator"):
        conditions({"id": {"operator": "; DROP", "value": 1}}, people.columns)
    with pytest.raises(ValueError, match="only SELECT"):
        q.custom_sql(people, "DROP TABLE x")
    with pytest.raises(ValueError, match="unknown aggregate"):
        q.group_values(people, "name", "score", "median")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b c` int, `x``y` double")
    assert q.filter_rows(df, {"a.b c": {"value": 1}}).count() == 1
    assert profile.missing_values(df).count() == 2


def test_sort_puts_nulls_last(people):
    assert [r["id"] for r in q.sort_rows(people, "score", unique=["id"]).collect()][-1] == 2
    assert [r["id"] for r in q.sort_rows(people, "score", descending=True, unique=["id"]).collect()] == [1, 4, 3, 2]


def test_paging_covers_everything_once(spark):
    df = spark.range(95).withColumn("k", F.col("id") % 7)
    pages = [q.page(df, "k", unique=["id"], limit=20, offset=o).collect() for o in range(0, 100, 20)]
    assert sorted(r["id"] for p in pages for r in p) == list(range(95))


def test_entity_filter_falls_back_to_all(people):
    assert q.entity_rows(people, "id", 3).count() == 1
    assert q.entity_rows(people, "id").count() == 4


def test_schema_rules(spark, people):
    assert [f.dataType.simpleString() for f in schema.numeric_and_boolean(people).schema] == ["bigint", "double", "boolean"]
    wide = spark.createDataFrame([(1, "x", "2020-01-01", 2.0, 3.0, 4.0)], "id int, created_at string, day string, sales double, promo double, open_time double")
    kept = schema.feature_columns(wide, ["promo", "created_at", "open_time"], date="day", target="sales")
    assert kept.columns == ["day", "sales", "promo"]
    assert schema.without_columns(wide, ["day", "promo"], keep=["day"]).columns == ["id", "created_at", "day", "sales", "open_time"]
    assert schema.detect_target(wide.unionByName(wide.withColumn("sales", F.lit(90.0)))).first()["column"] == "sales"
    types = {r["column"]: r["dtype"] for r in schema.column_types(people).collect()}
    assert types == {"id": "bigint", "name": "string", "score": "double", "ok": "boolean"}
    with pytest.raises(ValueError, match="unknown columns"):
        schema.rename_columns(wide, {"gone": "x"})


def test_detect_dates_by_name_or_value(spark):
    df = spark.createDataFrame([("2020-01-01", 1, "a"), ("2020-02-01", 2, "b")], "stamp string, birthday int, other string")
    assert {r["column"] for r in schema.detect_date_columns(df).filter("is_date").collect()} == {"stamp", "birthday"}
    assert schema.detect_date_columns(df.limit(0)).filter("is_date").count() == 0


@pytest.mark.parametrize("pick", ["linear", "upper"])
def test_quantiles_against_numpy(spark, pick):
    rng = np.random.default_rng(3)
    shapes = {
        "flat": rng.uniform(-5, 5, 9000), "heavy": rng.standard_cauchy(7000), "tied": np.where(rng.uniform(size=6000) < 0.7, 0.0, rng.normal(size=6000)),
        "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "same": np.full(5000, 2.5), "five": np.array([5.0, 1, 4, 2, 3]),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in shapes.items()])
    probs = [0.0, 0.1, 0.5, 0.8, 0.975, 1.0]
    got = order_statistics(spark.createDataFrame(pdf), "v", probs, ["k"], pick=pick).collect()
    assert len(got) == len(shapes) * len(probs)
    for r in got:
        v = np.sort(shapes[r["k"]])
        want = np.quantile(v, r["prob"]) if pick == "linear" else v[min(int(np.floor(r["prob"] * len(v))), len(v) - 1)]
        assert r["value"] == pytest.approx(want, rel=1e-12, abs=1e-12)
        assert r["n_below"] == (v < v[r["rank"] - 1]).sum()


def test_quantiles_without_rows_or_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "k string, v double")
    assert [(r["k"], r["m"]) for r in quantiles(df, "v", {"m": 0.5}, ["k"]).collect()] == [(None, 2.0)]
    assert [r["m"] for r in quantiles(df.limit(0), "v", {"m": 0.5}).collect()] in ([], [None])


def test_quantiles_keep_their_types(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big,), (big,), (big,), (-(2**63),), (2**63 - 1,), (None,)], "v bigint")
    assert [r["m"] for r in quantiles(df, "v", {"m": 0.5}).collect()] == [big]
    assert [(r["a"], r["b"]) for r in quantiles(df, "v", {"a": 0.0, "b": 1.0}, pick="upper").collect()] == [(-(2**63), 2**63 - 1)]
    row = profile.describe_population(df.filter("v > 0 and v < 9007199254740994"), "v").first()
    assert (row["count"], row["median"], row["min"], row["max"]) == (3, big, big, big)
    inf = float("inf")
    odd = spark.createDataFrame([(x,) for x in (-inf, -1e308, -0.0, 0.0, 5e-324, 1e-300, 1e308, inf, inf, float("nan"), None)], "v double")
    got = order_statistics(odd, "v", [i / 9 + 1e-9 for i in range(9)], pick="upper").orderBy("prob_id").collect()
    assert [r["value"] for r in got] == [-inf, -1e308, 0.0, 0.0, 5e-324, 1e-300, 1e308, inf, inf] and [r["n_below"] for r in got] == [0, 1, 2, 2, 4, 5, 6, 7, 7]
    close = spark.range(3000).select((F.lit(1.0) + F.col("id") * F.lit(2.0**-52)).alias("v"))
    assert [r["m"] for r in quantiles(close, "v", {"m": 1500 / 2999}).collect()] == [1.0 + 1500 * 2.0**-52]
    typed = spark.createDataFrame([("2020-01-05", "1.25"), ("2020-01-01", "-7.50"), ("2020-03-01", "99.99")], "d string, m string")
    typed = typed.select(F.to_date("d").alias("d"), F.col("m").cast("decimal(12,2)").alias("m"), F.to_timestamp("d").alias("t"), F.col("m").cast("float").alias("f"))
    for c, want in (("d", "2020-01-05"), ("m", "1.25"), ("t", "2020-01-05 00:00:00"), ("f", "1.25")):
        assert [str(r["q"]) for r in quantiles(typed, c, {"q": 0.5}, pick="upper").collect()] == [want]


def test_a_selection_reads_its_table_three_times_at_most(spark, tmp_path):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=40_000), np.full(360_000, 0.25), rng.standard_cauchy(20_000) * 1e9])
    spark.createDataFrame(pd.DataFrame({"v": values})).write.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    table = spark.read.parquet(f"{tmp_path}/t")
    row = profile.describe(table.select(counted.asNondeterministic()("v").alias("v")), "v").first()
    assert seen.value <= 3 * len(values)
    want = pd.Series(values).describe()
    for c, w in (("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("min", "min"), ("max", "max")):
        assert row[c] == want[w]
    assert row["mean"] == pytest.approx(want["mean"]) and row["std"] == pytest.approx(want["std"]) and row["count"] == len(values)


def test_rank_examples_with_a_hot_value(spark):
    df = spark.range(5000).withColumn("v", F.when(F.col("id") % 10 < 8, 0.0).otherwise(F.col("id").cast("double")))
    pdf = df.toPandas().sort_values(["v", "id"]).reset_index(drop=True)
    rows = profile.rank_examples(df, "v", "id").collect()
    assert len(rows) == 3
    for r in rows:
        assert r["id"] == pdf["id"][int(r["prob"] * 5000)]


def test_profile_edge_cases(spark):
    df = spark.createDataFrame([(None, ""), (None, "x"), (None, None)], "a double, b string")
    rows = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert (rows["a"]["count"], rows["a"]["null_count"], rows["a"]["unique_count"], rows["a"]["median"]) == (0, 3, 0, None)
    assert (rows["b"]["count"], rows["b"]["unique_count"]) == (2, 2)
    assert {r["column"]: r["missing"] for r in profile.missing_values(df).collect()} == {"a": 3, "b": 2}
    assert profile.profile_columns(df, approx=True).count() == 2


def test_describe_population_uses_upper_median(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 2.0, 3.0)], "v double")
    r = profile.describe_population(df, "v").first()
    assert (r["median"], r["count"]) == (3.0, 4)
    assert r["std_dev"] == pytest.approx(np.std([1, 2, 3, 4]))


def test_percent_change_rules(spark):
    rows = [("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, 6.0), ("b", 1, 0.0), ("b", 2, 0.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {r["k"]: r["pct_change"] for r in profile.percent_change_ends(df, "t", "v", ["k"]).collect()}
    assert got == {"a": 50.0, "b": None}


@pytest.mark.parametrize(
    "step,label", [(timedelta(days=1), "Daily"), (timedelta(days=7), "Weekly"), (timedelta(days=30), "Monthly"), (timedelta(days=3), "3 Days"),
                   (timedelta(hours=6), "6 Hours"), (timedelta(seconds=90), "Irregular")]
)
def test_frequency_names(spark, step, label):
    df = spark.createDataFrame([(datetime(2024, 1, 1) + i * step,) for i in range(12)], "t timestamp_ntz")
    assert profile.infer_frequency(df, "t").first()["frequency"] == label


def test_gaps_across_chunks_and_repeats(spark):
    stamps = [datetime(2024, 1, 1, 23, 0), datetime(2024, 1, 1, 23, 0), datetime(2024, 1, 2, 1, 0), datetime(2024, 1, 5)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    gaps = {r["seconds"]: r["count"] for r in profile.interval_counts(df, "t").collect()}
    assert gaps == {0.0: 1, 7200.0: 1, 255600.0: 1}


def test_correlation_with_a_constant_or_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 1.0)], "a double, b double, c double")
    got = {r["column"]: r["corr"] for r in profile.correlate_target(df, "a").collect()}
    assert got["b"] is None and got["c"] == pytest.approx(-1.0)
    assert profile.strongest(profile.correlate_target(df, "a"), 1).count() == 1
    assert profile.correlation_matrix(df).count() == 9


def test_boxplot_without_key(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 12), 100]], "v double")
    r = profile.boxplot(df, "v").first()
    assert (r["outliers"], r["high_whisker"], r["low_whisker"]) == (1, 11.0, 1.0)


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2995, "mid").otherwise(F.concat(F.lit("r"), F.col("id"))))
    for n in (1, 37, 2999, 5000):
        assert sampling.hash_sample(df, n, "id").count() == min(n, 3000)
    assert ids(sampling.hash_sample(df, 50, "id")) == ids(sampling.hash_sample(df.repartition(7), 50, "id"))
    sizes = {r["split"]: r["count"] for r in sampling.hash_split(df, "id", 0.25).groupBy("split").count().collect()}
    assert sizes == {"test": 750, "train": 2250}
    for n in (3, 100, 999):
        picked = sampling.stratified_sample(df, n, "g", "id").withColumn("rare", F.col("g").startswith("r")).collect()
        assert len(picked) == n
        assert abs(sum(r["g"] == "big" for r in picked) - n * 2 / 3) <= 1
    assert sampling.stratified_sample(df, 4000, "g", "id").count() == 3000


def test_stratified_sample_with_many_equal_strata(spark):
    df = spark.range(400).withColumn("g", (F.col("id") % 20).cast("string"))
    picked = sampling.stratified_sample(df, 30, "g", "id").groupBy("g").count().collect()
    assert sum(r["count"] for r in picked) == 30
    assert {r["count"] for r in picked} == {1, 2}


def test_stratified_sample_keeps_null_stratum(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 50, "a"))
    picked = sampling.stratified_sample(df, 10, "g", "id").collect()
    assert sum(r["g"] is None for r in picked) == 5


def test_cluster_sample(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(10 * (i % 3), 1), None if i % 50 == 0 else rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    picked = sampling.cluster_sample(df, 60, "id")
    assert 40 <= picked.count() <= 60
    assert picked.columns == df.columns
    assert sampling.cluster_sample(df, 600, "id").count() == 600


def test_pool_rare_and_report(spark):
    df = spark.createDataFrame([("a",)] * 12 + [("b",)] * 3 + [(None,)] * 2, "g string")
    pooled = {r["g_grouped"]: r["count"] for r in profile.pool_rare(df, "g").groupBy("g_grouped").count().collect()}
    assert pooled == {"a": 12, "RARE_CATEGORY": 5}
    assert clean.drop_report(df).first().asDict() == {"kept": 15, "total": 17, "share": 15 / 17}


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [r["v_std"] for r in clean.standardize(df, ["v"]).collect()] == [0.0, 0.0, None]
    assert [r["v_zscore"] for r in clean.zscore(df, "v").collect()] == [None, None, None]
    assert clean.minmax_scale(df, "v").first()["v_scaled"] == -1.0


def test_normalize(spark):
    df = spark.createDataFrame([(None, None, float("nan"), None)], "a int, b string, c double, d date")
    r = clean.normalize_for_storage(df).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (0, "", 0.0, None)


def test_calendar_dialects(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2021-01-02T12:00:00",), ("no date",)], "t string")
    rows = cal.calendar_features_sunday(df.withColumn("t", F.try_to_timestamp("t")), "t").collect()
    assert [(r["day_of_week"], r["week_of_year"], r["is_weekend"]) for r in rows[:2]] == [(0, 2, 1), (6, 2, 1)]
    assert rows[2]["year"] is None and rows[2]["is_weekend"] is None
    iso = cal.calendar_features(spark.createDataFrame([(date(2021, 1, 3),)], "t date"), "t").first()
    assert (iso["day_of_week"], iso["week_of_year"]) == (6, 53)
    with pytest.raises(ValueError, match="unknown period"):
        cal.period_start(F.col("t"), "decade")


def test_nearest_date_prefers_the_earlier(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),)], "t date")
    r = joins.nearest_dates(df, "t", [date(2024, 1, 2), date(2025, 1, 1)]).collect()
    assert [x["nearest"] for x in r] == [date(2024, 1, 1), date(2024, 1, 3)]


def test_flag_members_does_not_multiply(spark):
    df = spark.range(4)
    members = spark.createDataFrame([(1,), (1,), (3,)], "id bigint")
    assert [r["is_member"] for r in joins.flag_members(df, members, ["id"]).orderBy("id").collect()] == [0, 1, 0, 1]


def test_catalog_and_retention(spark, tmp_path):
    path = str(tmp_path / "catalog")
    catalog.register(spark.range(5), "one", "one.csv", path)
    catalog.register(spark.range(7), "one", "one.csv", path)
    entry = catalog.lookup(spark, path, "one").first()
    assert (entry["row_count"], entry["column_count"], entry["columns"]) == (7, 1, ["id"])
    assert catalog.exists(spark, path, "one") and not catalog.exists(spark, path, "two")
    assert catalog.column_names(spark, path, "one").first()["column"] == "id"
    data = tmp_path / "data"
    spark.range(3).write.parquet(str(data))
    catalog.unregister(spark, path, "one", str(data))
    assert not catalog.exists(spark, path, "one") and not data.exists()
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    catalog.retain(df, "t", timedelta(days=1), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_csv_with_bad_rows_and_encoding(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("id,name\n1,Müller\nx,bad\n".encode("latin-1"))
    df = files.read_csv(spark, str(path), schema=f"id int, name string, {files.CORRUPT} string", encoding="ISO-8859-1").cache()
    rows = df.collect()
    assert rows[0]["name"] == "Müller" and rows[0][files.CORRUPT] is None
    assert rows[1]["id"] is None and rows[1][files.CORRUPT] == "x,bad"
    assert dict(files.read_csv(spark, str(path), encoding="ISO-8859-1").dtypes)["id"] == "string"
    kept = files.read_csv(spark, str(path), schema="id int, name string", encoding="ISO-8859-1", keep_bad=True).cache()
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in rows]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(path), schema="id int, name string", encoding="ISO-8859-1").collect()


def test_store_by_period_prunes(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, m, 1), float(m)) for m in (1, 2, 3)], "d date, v double")
    files.store(df, str(tmp_path / "t"), time="d")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 3
    assert len(list((tmp_path / "t").glob("period=*"))) == 3


def test_point_limit(spark):
    df = spark.range(10).withColumn("k", F.lit("a"))
    assert bounded(df, ["k"], 10).count() == 10
    assert bounded(df, [], 10).count() == 10
    with pytest.raises(PySparkException, match="more than 9 points"):
        bounded(df, ["k"], 9).collect()
    with pytest.raises(PySparkException, match="more than 9 points"):
        bounded(df, [], 9).groupBy("k").count().collect()


def test_nearest_rows_against_all_pairs(spark):
    rng = np.random.default_rng(20)
    base = pd.Timestamp("2020-01-01")

    def rows(n, hot):
        keys = [None if x < 0.05 else "hot" if x < hot else f"k{int(x * 40)}" for x in rng.uniform(size=n)]
        return [(k, None if rng.random() < 0.03 else base + pd.Timedelta(minutes=int(m)), int(i)) for i, (k, m) in enumerate(zip(keys, rng.integers(0, 900, n)))]

    left, right = rows(400, 0.4), rows(150, 0.4)
    schema = "k string, t timestamp, `a.b` int"
    one = spark.createDataFrame([(k, None if t is None else t.to_pydatetime(), i) for k, t, i in left] + [("nowhere", base.to_pydatetime(), 1)] * 2, schema)
    two = spark.createDataFrame([(k, None if t is None else t.to_pydatetime(), i) for k, t, i in right], schema)
    for chunks in (1, 7, 40):
        got = joins.nearest_rows(one, two, "t", "t", ["k"], chunks=chunks).collect()
        assert len(got) == len(left) + 2
        for r in got:
            near = [(abs((t.to_pydatetime() - r["t"]).total_seconds()), t.to_pydatetime(), i) for k, t, i in right if r["t"] is not None and t is not None and k == r["k"]]
            want = min(near, default=(None, None, None))
            assert (r["nearest_seconds"], r["nearest_t"], r["nearest_a.b"]) == want
    assert joins.nearest_rows(one, two.limit(0), "t", "t", ["k"]).filter("nearest_t is not null").count() == 0
    assert joins.nearest_rows(one.limit(0), two, "t", "t").count() == 0
    alone = joins.nearest_rows(one, two, "t", "t", chunks=5).filter("t is not null and nearest_t is null").count()
    assert alone == 0


def test_nearest_rows_read_no_frame_to_the_end(spark):
    one = spark.range(30).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("t"), "id")
    found = joins.nearest_rows(one, one.filter("id % 7 = 3"), "t", "t", ["k"], chunks=3)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert sorted((r["id"], r["nearest_id"]) for r in found.collect()) == [(i, min((3, 10, 17, 24), key=lambda h: (abs(h - i), h))) for i in range(30)]


def test_correlations_of_four_hundred_columns(spark):
    rng = np.random.default_rng(50)
    x = rng.normal(size=(300, 400)) + 1e6
    x[:, 1] = x[:, 0] * 2 + 1
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 12.3
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(400)])
    pdf["c.3"] = None
    pdf["c.3"] = pdf["c.3"].astype(float)
    got = profile.correlation_matrix(spark.createDataFrame(pdf)).toPandas().pivot(index="x", columns="y", values="corr").loc[pdf.columns, pdf.columns].to_numpy(float)
    want = pdf.corr().to_numpy()
    want[7] = want[:, 7] = np.nan
    np.fill_diagonal(want, 1.0)
    want[3, 3] = np.nan
    assert np.allclose(got, want, atol=1e-8, equal_nan=True)
    empty = profile.correlation_matrix(spark.createDataFrame([], "`a.b` double, c int")).collect()
    assert len(empty) == 4 and {r["corr"] for r in empty} == {None}


def test_expiry_drops_folders_and_leaves_the_rest(spark, tmp_path):
    path = str(tmp_path / "by_day")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=5 * i)) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, t timestamp")
    assert catalog.expire(spark, path, "t", timedelta(days=3)) == {"dropped": [], "rewritten": []}
    catalog.append_by_period(df.filter("id < 20"), path, "t")
    catalog.append_by_period(df.filter("id >= 20 or id is null"), path, "t")

    def seen():
        return {f: (f.stat().st_mtime_ns, f.stat().st_ino) for f in tmp_path.glob("by_day/period=*/*.parquet")}

    before = seen()
    newest = max(t for _, t in rows if t)
    done = catalog.expire(spark, path, "t", timedelta(days=3))
    limit = newest - timedelta(days=3)
    border = limit.date().isoformat()
    assert done["rewritten"] == [border] and done["dropped"] == sorted({t.date().isoformat() for _, t in rows if t and t.date() < limit.date()})
    kept = {f: v for f, v in before.items() if f.parent.name.partition("=")[2] > border}
    assert kept and all(seen()[f] == v for f, v in kept.items())
    left = spark.read.parquet(path)
    assert {r["id"] for r in left.collect()} == {i for i, t in rows if t is None or t >= limit}
    noted = {r["period"]: r["rows"] for r in catalog.manifest(spark, path).collect()}
    assert noted == {r["period"]: r["count"] for r in left.withColumn("period", F.col("period").cast("string")).groupBy("period").count().collect()}
    assert catalog.expire(spark, path, "t", timedelta(days=3)) == {"dropped": [], "rewritten": []}
