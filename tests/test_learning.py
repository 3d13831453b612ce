"""Boosted trees and their attribution."""

from dataclasses import replace
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidemark.operators import attribution, boosting, learn, sampling
from tidemark.session import stored_columns


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(11)
    x1, x2, x3 = rng.uniform(-1, 1, (3, 500))
    pdf = pd.DataFrame({"id": range(500), "x1": x1, "x2": x2, "x3": x3, "g": rng.choice(["u", "v", "w"], 500)})
    pdf["y"] = 2 * pdf.x1 - pdf.x2 + 3 * (pdf.g == "w")
    df = sampling.hash_split(spark.createDataFrame(pdf), "id")
    rows = learn.prepare(df, "y", ["x1", "x2", "x3"]).cache()
    model = learn.fit_boosted(rows.filter("split = 'train'"), "y", ["x1", "x2", "x3"], ["g"], trees=20, depth=3)
    return rows, model, model.transform(rows).cache()


def test_quality_and_importance(fitted):
    _, model, scored = fitted
    quality = {r["split"]: r for r in learn.quality(scored, "y").collect()}
    assert quality["test"]["n"] == 100 and quality["test"]["r2"] > 0.85
    ranks = {r["feature"]: r["importance"] for r in learn.importance(scored, model).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert ranks["x3"] < 0.05 < ranks["x1"]
    assert len(learn.feature_names(scored)) == 5


def test_unknown_level_is_all_zero(spark, fitted):
    rows, model, _ = fitted
    odd = model.transform(rows.limit(1).withColumn("g", F.lit("new"))).first()["features"].toArray()
    first = model.transform(rows.limit(1).withColumn("g", F.lit("u"))).first()["features"].toArray()
    assert list(odd[3:]) == [0.0, 0.0] == list(first[3:])


def test_too_many_levels_are_refused(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="more than 1000 levels"):
        learn.fit_boosted(df, "y", [], ["g"], trees=1)


def test_values_add_up(fitted):
    _, model, scored = fitted
    out = attribution.attributions(scored, model.stages[-1], ["id"])
    total = F.aggregate("shap", F.col("base"), lambda a, b: a + b)
    assert out.count() == 500
    assert out.filter(F.abs(total - F.col("prediction")) > 1e-9).count() == 0


def test_values_against_the_definition(fitted):
    _, model, scored = fitted
    trees = attribution.load_trees(attribution.tree_nodes(model.stages[-1]))
    x = np.array([r["features"].toArray() for r in scored.limit(5).collect()])
    got = attribution.shapley(x, trees)
    m = x.shape[1]

    def worth(row, known):
        total = 0.0
        for t in trees:
            for leaf in t.leaves:
                part = leaf.value
                for f, splits, share in zip(leaf.features, leaf.splits, leaf.shares, strict=True):
                    if f in known:
                        passed = all(
                            (np.isin(row[f], t.cuts[s]) if t.categorical[s] else row[f] <= t.cuts[s][0]) == left for s, left in splits
                        )
                        part *= float(passed)
                    else:
                        part *= share
                total += part
        return total

    from math import factorial

    for i, row in enumerate(x):
        for f in range(m):
            others = [g for g in range(m) if g != f]
            want = sum(
                factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (worth(row, {*s, f}) - worth(row, set(s)))
                for size in range(m)
                for s in combinations(others, size)
            )
            assert got[i, f] == pytest.approx(want, abs=1e-9)


def test_leaf_tables_are_the_polynomials(fitted):
    _, model, scored = fitted
    trees = attribution.load_trees(attribution.tree_nodes(model.stages[-1]))
    x = np.array([list(r["features"].toArray()) for r in scored.select("features").limit(300).collect()])
    bare = [replace(t, leaves=tuple(replace(leaf, table=None) for leaf in t.leaves)) for t in trees]
    assert np.allclose(attribution.shapley(x, trees), attribution.shapley(x, bare), atol=1e-12)


def test_global_and_single_row_reports(fitted):
    _, model, scored = fitted
    names = learn.feature_names(scored)
    attributed = attribution.attributions(scored, model.stages[-1], ["id"]).cache()
    long = attribution.long_attributions(attributed, names, ["id"])
    ranking = attribution.global_attribution(attributed, names).collect()
    values = np.array([r["shap"] for r in attributed.collect()])
    for r in ranking:
        v = values[:, names.index(r["feature"])]
        assert r["mean_abs"] == pytest.approx(np.abs(v).mean()) and r["q25"] == pytest.approx(np.quantile(v, 0.25)) and r["q95"] == pytest.approx(np.quantile(v, 0.95))
    assert [r["mean_abs"] for r in ranking] == sorted((r["mean_abs"] for r in ranking), reverse=True)
    assert {r["feature"] for r in ranking[-2:]} == {"x3", "g__hot_v"}
    examples = scored.orderBy("prediction").limit(1).select("id", F.lit(0.1).alias("prob"))
    assert attribution.explain_rows(long, examples, ["id"]).count() == 5
    assert learn.dependence(attributed, names, ["id"], learn.importance(scored, model), 2).select("feature").distinct().count() == 2


def test_top_features_by_kind(spark):
    df = spark.createDataFrame([("lag_1", 0.5), ("month", 0.3), ("is_weekend", 0.1), ("price", 0.1)], "feature string, importance double")
    got = [(r["kind"], r["feature"]) for r in learn.strongest_by_kind(df, 5).collect()]
    assert sorted(got) == [("lag", "lag_1"), ("time", "is_weekend"), ("time", "month")]


def test_exact_split_for_a_line(spark):
    df = spark.range(100).select("id", (F.col("id") * 2.0 + 1).alias("y"))
    out = learn.quality(learn.linear_fit(sampling.hash_split(df, "id"), "y", "id"), "y")
    assert all(r["r2"] == pytest.approx(1.0) for r in out.collect())


def test_same_trees_as_sparks_learner(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 400), "b": rng.integers(0, 30, 400) / 7, "g": rng.choice(["u", "v", "w"], 400), "y": rng.normal(size=400)})
    pdf["y"] += pdf.a * (pdf.g == "v") - pdf.b
    # Level u is the first and has no feature, nor has a null.
    pdf.loc[:20, "g"] = None
    rows = spark.createDataFrame(pdf.where(pdf.notna(), None), "a long, b double, g string, y double")
    got = learn.fit_boosted(rows, "y", ["a", "b"], ["g"], trees=6, depth=3, rows=1.0, columns=1.0)
    flags = rows.withColumns({f"g_{v}": F.coalesce((F.col("g") == v).cast("int"), F.lit(0)) for v in "wv"})
    learner = GBTRegressor(labelCol="y", maxIter=6, maxDepth=3, stepSize=0.1)
    want = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "g_w", "g_v"], outputCol="features"), learner]).fit(flags)
    one, two = ([r["prediction"] for r in m.transform(d).select("prediction").collect()] for m, d in ((got, rows), (want, flags)))
    assert one == pytest.approx(two, abs=1e-9)
    assert got.stages[-1].featureImportances.toArray() == pytest.approx(want.stages[-1].featureImportances.toArray(), abs=1e-9)
    assert got.stages[-1].treeWeights == want.stages[-1].treeWeights


def test_tasks_of_a_fit_follow_the_rows(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    tasks, boost = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda state, *rest: tasks.append(state.getNumPartitions()) or boost(state, *rest))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        learn.fit_boosted(rows, "y", ["x"], trees=2, depth=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks == [1]
    with pytest.raises(Exception, match="must not be null"):
        learn.fit_boosted(rows.withColumn("x", F.when(F.col("x") > 3, F.col("x"))), "y", ["x"], trees=1)


def test_one_child_of_two_is_counted(spark, monkeypatch):
    """The sums of the child that is not counted are what is left of its parent, also where columns are counted together."""
    rng = np.random.default_rng(8)
    widths, n = [50, 11, 9, 3, 150], 5000
    codes, y = np.stack([rng.integers(0, w, n) for w in widths]).astype("uint8"), rng.normal(size=n)
    assert sorted(c for g in boosting.column_groups(widths) for c in g) == [0, 1, 2, 3, 4] and len(boosting.column_groups(widths)) < 5
    nodes = [boosting.Node(np.zeros(3), column=0, code=30, left=1), boosting.Node(np.zeros(3)), boosting.Node(np.zeros(3))]

    def sums(nodes, counted):
        found = next(boosting._count([((0, 0), codes, y)], nodes, counted, widths, 0.8, (1, 2), 2.0))
        return boosting._by_node(found, len(counted), widths)

    whole, both, one = sums([boosting.Node(np.zeros(3))], [0]), sums(nodes, [1, 2]), sums(nodes, [2])
    got = boosting.with_siblings([2], one, {1: whole[:, 0]}, [1, 2])
    assert np.allclose(got, both, atol=1e-9) and (got[0] == both[0]).all() and not got[:, got[0] == 0].any()
    drawn = np.random.default_rng([1, 2, 0, 0]).random(n, np.float32) < 0.8
    for c, h in enumerate(np.split(both, np.cumsum(widths)[:-1], axis=2)):
        for k, side in enumerate((codes[0] <= 30, codes[0] > 30)):
            here = drawn & side
            assert np.allclose(h[1, k], np.bincount(codes[c][here], 2 * y[here], widths[c]))

    counts, count = [], boosting.with_siblings
    monkeypatch.setattr(boosting, "with_siblings", lambda counted, *rest: counts.append((len(counted), len(rest[2]))) or count(counted, *rest))
    rows = spark.range(400).select((F.col("id") % 19).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    learn.fit_boosted(rows, "y", ["x"], trees=2, depth=3)
    assert all(c == max(1, o // 2) for c, o in counts) and max(o for _, o in counts) > 1


def test_stored_columns_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 0.5, None)], "`a.b` int, `c d` double, g string")
    back = stored_columns(df)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, None, "a"), (2, 0.5, None)]
    assert stored_columns(df.limit(0)).count() == 0


def test_attribution_tasks_follow_rows_and_cores(spark, fitted, monkeypatch):
    """Each task unpacks all trees, so there are no more of them than cores and rows ask for."""
    _, model, scored = fitted
    before, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", 5 * cores + 3)
    try:
        assert attribution.attributions(scored, model.stages[-1], ["id"]).rdd.getNumPartitions() == cores
        monkeypatch.setattr(attribution, "ROWS_PER_TASK", 1 + scored.count() // (3 * cores))
        assert attribution.attributions(scored, model.stages[-1], ["id"]).rdd.getNumPartitions() > 2 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
