"""The attribution queries at scale: what is run again by each pass, and the tables that rows are looked up in."""

import shutil
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution
from tidemark.plans import model_queries


def leaf_of(features, splits, shares, value):
    patterns = (np.arange(1 << len(features))[:, None] >> np.arange(len(features)) & 1).astype(float)
    return attribution.Leaf(value, 1.0, features, splits, shares, attribution.leaf_shares(patterns, value, shares))


def random_tree(rng, depth, categorical=False):
    """All splits of all nodes drawn anew, features again and again on one path."""
    features, cuts, leaves = [], [], []

    def walk(path):
        if len(path) == depth:
            own = {}
            for i, side, share in path:
                own.setdefault(features[i], []).append((i, side, share))
            shares = tuple(float(np.prod([s for *_, s in v])) for v in own.values())
            leaves.append(leaf_of(tuple(own), tuple(tuple((i, s) for i, s, _ in v) for v in own.values()), shares, float(rng.normal())))
            return
        features.append(int(rng.integers(0, 5)))
        cuts.append((1.0, 3.0) if categorical else (float(rng.integers(0, 9)),))
        i = len(features) - 1
        for side in (True, False):
            walk([*path, (i, side, float(rng.uniform(0.2, 0.8)))])

    walk([])
    return attribution.Tree(tuple(features), tuple(cuts), (categorical,) * len(features), tuple(leaves))


@pytest.mark.parametrize("most", [1, 16, 1 << 13])
def test_tables_of_cells_give_what_the_leaves_give(monkeypatch, most):
    monkeypatch.setattr(attribution, "MOST_CELLS", most)
    monkeypatch.setattr(attribution, "AT_ONCE", 64)
    rng = np.random.default_rng(most)
    trees = [random_tree(rng, depth) for depth in (0, 1, 3, 5)] + [random_tree(rng, 2, categorical=True)]
    x = rng.integers(-1, 10, (300, 6)).astype(float)
    x[::7, 2], x[3], x[4] = np.nan, np.inf, -np.inf
    lookup = attribution.tabulated(trees)
    assert all(c.given.shape[1] <= most for c in lookup.cells) and sum(any(t.categorical) for t in lookup.rest) == 1
    # By default nothing but the tree of categories is left to its leaves.
    assert len(lookup.rest) == 1 or most < 1 << 13
    plain = np.zeros((6, 300))
    attribution._add_by_leaf(np.ascontiguousarray(x.T), trees, plain)
    assert np.allclose(attribution.shapley(x, lookup), plain.T, atol=1e-12) and not plain[5].any()
    assert attribution.shapley(x[:0], lookup).shape == (0, 6)


def test_test_rows_are_scored_once(spark, folder, monkeypatch):
    """The ranks of `shap_examples` are read from stored predictions: no split, join or tree is run again by a pass."""
    seen = []
    plain = model_queries.rank_examples
    monkeypatch.setattr(model_queries, "rank_examples", lambda df, *a: seen.append(df) or plain(df, *a))
    model_queries.shap_examples(spark, folder).count()
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "UDF" not in plan and "Join" not in plan and "l_quantity" not in plan and "prediction" in plan


def test_attribution_queries_share_the_stored_rows(spark, folder, monkeypatch):
    rows, model = model_queries.tested(spark, folder)
    again, _ = model_queries.tested(spark, folder)
    assert again is rows
    # Whatever the store has lost is written anew; the split and the prediction are those of the model on the whole table.
    for f in rows.inputFiles():
        shutil.rmtree(Path(unquote(urlparse(f).path)).parent, ignore_errors=True)
    anew, _ = model_queries.tested(spark, folder)
    wide, _ = model_queries.fitted(spark, folder)
    want = model.transform(wide.filter("split = 'test'")).select("line", F.round("prediction", 6).alias("p"))
    got = anew.select("line", F.round("prediction", 6).alias("p"))
    assert want.count() == got.count() and want.exceptAll(got).isEmpty()
    # Neither the join nor the split is run by a query that meets the stored rows.
    monkeypatch.setattr(model_queries, "wide", None)
    attributed, names, _, _ = model_queries.attributed_rows(spark, folder)
    assert attributed.count() == want.count() and len(names) == len(attributed.first()["shap"])
    assert model_queries.shap_global(spark, folder).count() == len(names)
