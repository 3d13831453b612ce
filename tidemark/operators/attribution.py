"""Shapley attribution of boosted-tree predictions."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import require
from tidemark.operators.quantiles import quantiles
from tidemark.session import cut_lineage, ensure_checkpoint_dir


# A leaf with more features has no table.
WIDEST_TABLE = 10
# Rows that are looked up at a time, most rows of a task, most cells of a table of several leaves.
AT_ONCE, ROWS_PER_TASK, MOST_CELLS = 10_240, 400_000, 1 << 13


@dataclass(frozen=True)
class Leaf:
    """A leaf with the splits that lead to it, one entry per feature: (splits passed, share of rows).

    A row passes the splits of each feature or not: ``table[pattern, k]`` is what the leaf gives to its k-th feature then.
    """

    value: float
    share: float
    features: tuple[int, ...]
    splits: tuple[tuple[tuple[int, bool], ...], ...]
    shares: tuple[float, ...]
    table: np.ndarray | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Tree:
    features: tuple[int, ...]
    cuts: tuple[tuple[float, ...], ...]
    categorical: tuple[bool, ...]
    leaves: tuple[Leaf, ...]


def tree_nodes(model) -> DataFrame:
    """The node table of a fitted boosted model, as Spark stores it, with tree weights."""
    spark = SparkSession.active()
    path = os.path.join(ensure_checkpoint_dir(spark), f"trees-{os.urandom(8).hex()}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(path + "/data")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    flat = nodes.select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.rawCount").alias("rows"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )
    return flat.join(weights, "tree")


def load_trees(nodes: DataFrame) -> list[Tree]:
    """Trees in path form on the driver; their size is fixed by the model, not by the data."""
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        by_tree.setdefault(r["tree"], {})[r["id"]] = r
    return [_tree(n) for _, n in sorted(by_tree.items())]


def _tree(nodes: dict) -> Tree:
    inner = sorted(i for i, r in nodes.items() if r["left"] >= 0)
    place = {i: k for k, i in enumerate(inner)}
    leaves: list[Leaf] = []

    def walk(i: int, path: list[tuple[int, bool, float]]) -> None:
        r = nodes[i]
        if r["left"] < 0:
            grouped: dict[int, list] = {}
            for split, left, share in path:
                grouped.setdefault(nodes[inner[split]]["feature"], []).append((split, left, share))
            value, shares, d = r["prediction"] * r["weight"], tuple(math.prod(s for *_, s in v) for v in grouped.values()), len(grouped)
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float) if d <= WIDEST_TABLE else None
            leaves.append(
                Leaf(
                    value,
                    math.prod(s for *_, s in path),
                    tuple(grouped),
                    tuple(tuple((s, g) for s, g, _ in v) for v in grouped.values()),
                    shares,
                    leaf_shares(patterns, value, shares) if patterns is not None else None,
                )
            )
            return
        for child, left in ((r["left"], True), (r["right"], False)):
            walk(child, [*path, (place[i], left, nodes[child]["rows"] / r["rows"])])

    walk(0, [])
    return Tree(
        tuple(nodes[i]["feature"] for i in inner),
        tuple(tuple(nodes[i]["cut"]) for i in inner),
        tuple(nodes[i]["categories"] > 0 for i in inner),
        tuple(leaves),
    )


def base_value(trees: Sequence[Tree]) -> float:
    return sum(leaf.value * leaf.share for t in trees for leaf in t.leaves)


def leaf_shares(inside: np.ndarray, value: float, shares: Sequence[float]) -> np.ndarray:
    """Exact path-dependent Shapley values of one leaf: rows x features, from which features' splits each row passes (1 or 0).

    The value of the leaf under a feature subset is a product over the features on its path, so the
    weighted sum over subsets is read off the coefficients of a polynomial with one factor per feature.
    """
    d, out = len(shares), np.zeros(inside.shape)
    for k in range(d):
        poly = [np.ones(len(inside))]
        for j in range(d):
            if j != k:
                zero, one = shares[j], inside[:, j]
                poly = [(poly[m] * zero if m < len(poly) else 0.0) + (poly[m - 1] * one if m else 0.0) for m in range(len(poly) + 1)]
        weight = sum(math.factorial(m) * math.factorial(d - 1 - m) / math.factorial(d) * c for m, c in enumerate(poly))
        out[:, k] = value * (inside[:, k] - shares[k]) * weight
    return out


@dataclass(frozen=True)
class Cells:
    """Leaves of a tree as one table: ``given[k, cell]`` is what they give to their k-th feature where a row lies in the cell.

    The cell of a row is the sum over the features of ``steps[k]`` at the row's code, which counts the cuts of all trees below its value.
    """

    features: tuple[int, ...]
    steps: tuple[np.ndarray, ...]
    given: np.ndarray


@dataclass(frozen=True)
class Lookup:
    """All trees as tables over the cells between their cuts; ``rest`` are the leaves that have no table, with their trees."""

    cuts: dict[int, np.ndarray]
    cells: tuple[Cells, ...]
    rest: tuple[Tree, ...]


def tabulated(trees: Sequence[Tree]) -> Lookup:
    """Tables of the sums over leaves, none of more than ``MOST_CELLS`` cells: a tree too fine for one is halved along its leaves.

    A tree that splits by categories stays as it is.
    """
    whole = [t for t in trees if not any(t.categorical)]
    cuts: dict[int, np.ndarray] = {}
    for t in whole:
        for f, cut in zip(t.features, t.cuts, strict=True):
            cuts[f] = np.union1d(cuts.get(f, []), cut[0])
    cells, rest = [], [t for t in trees if any(t.categorical)]

    def add(t: Tree, leaves: Sequence[Leaf]) -> None:
        own: dict[int, set] = {}
        for leaf in leaves:
            for f, splits in zip(leaf.features, leaf.splits, strict=True):
                own.setdefault(f, set()).update(t.cuts[i][0] for i, _ in splits)
        size = math.prod(len(c) + 1 for c in own.values())
        if size > MOST_CELLS and len(leaves) > 1:
            add(t, leaves[: len(leaves) // 2])
            add(t, leaves[len(leaves) // 2 :])
        elif size > MOST_CELLS or any(leaf.table is None for leaf in leaves):
            rest.append(Tree(t.features, t.cuts, t.categorical, tuple(leaves)))
        elif own:
            cells.append(_cells(t, leaves, {f: np.array(sorted(c)) for f, c in own.items()}, cuts))

    for t in whole:
        add(t, t.leaves)
    return Lookup(cuts, tuple(cells), tuple(rest))


def _cells(t: Tree, leaves: Sequence[Leaf], own: dict[int, np.ndarray], cuts: dict[int, np.ndarray]) -> Cells:
    features, shape = tuple(own), tuple(len(c) + 1 for c in own.values())
    place, given = {f: k for k, f in enumerate(features)}, np.zeros((len(features), *shape))
    for leaf in leaves:
        pattern = np.zeros([1] * len(shape), np.int64)
        for bit, (f, splits) in enumerate(zip(leaf.features, leaf.splits, strict=True)):
            k, part = place[f], np.arange(len(own[f]) + 1)
            inside = np.logical_and.reduce([(part <= np.searchsorted(own[f], t.cuts[i][0])) == side for i, side in splits])
            pattern = pattern | (inside.astype(np.int64) << bit).reshape([-1 if j == k else 1 for j in range(len(shape))])
        for bit, f in enumerate(leaf.features):
            given[place[f]] += leaf.table[:, bit][pattern]
    # The step of the last feature is 1; values above all cuts lie in the last part.
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    parts = [np.append(np.searchsorted(own[f], cuts[f]), len(own[f])) for f in features]
    return Cells(features, tuple((p * n).astype(np.intp) for p, n in zip(parts, strides, strict=True)), given.reshape(len(features), -1))


def _add_by_leaf(columns: np.ndarray, trees: Sequence[Tree], part: np.ndarray) -> None:
    """Each leaf on its own, by the pattern of the features whose splits a row passes."""
    for t in trees:
        left = [np.isin(columns[f], cut) if cat else columns[f] <= cut[0] for f, cut, cat in zip(t.features, t.cuts, t.categorical, strict=True)]
        sides = {(i, side): (g if side else ~g).view(np.uint8) for i, g in enumerate(left) for side in (True, False)}
        passed: dict[tuple, np.ndarray] = {}
        for leaf in t.leaves:
            inside = []
            for splits in leaf.splits:
                if splits not in passed:
                    passed[splits] = sides[splits[0]] if len(splits) == 1 else np.bitwise_and.reduce([sides[s] for s in splits])
                inside.append(passed[splits])
            if leaf.table is None:
                found = leaf_shares(np.stack(inside, axis=1).astype(float), leaf.value, leaf.shares)
                for k, f in enumerate(leaf.features):
                    part[f] += found[:, k]
            elif inside:
                pattern = inside[0].astype(np.int64)
                for k, bit in enumerate(inside[1:], 1):
                    pattern |= bit.astype(np.int64) << k
                for k, f in enumerate(leaf.features):
                    part[f] += leaf.table[:, k].take(pattern)


def shapley(x: np.ndarray, trees: Sequence[Tree] | Lookup) -> np.ndarray:
    """Shapley values of a batch of rows: the tables are made once, rows only look up their cells."""
    lookup = trees if isinstance(trees, Lookup) else tabulated(trees)
    out = np.zeros((x.shape[1], len(x)))
    for low in range(0, len(x), AT_ONCE):
        columns, part = np.ascontiguousarray(x[low : low + AT_ONCE].T), out[:, low : low + AT_ONCE]
        codes = {f: np.searchsorted(cuts, columns[f]) for f, cuts in lookup.cuts.items()}
        for c in lookup.cells:
            cell = c.steps[0].take(codes[c.features[0]])
            for f, step in zip(c.features[1:], c.steps[1:], strict=True):
                cell += step.take(codes[f])
            for f, given in zip(c.features, c.given, strict=True):
                part[f] += given.take(cell)
        _add_by_leaf(columns, lookup.rest, part)
    return out.T


def attributions(scored: DataFrame, model, keep: Sequence[str], *, features: str = "features", prediction: str = "prediction") -> DataFrame:
    """``keep..., prediction, base, features array, shap array`` for every row.

    The trees travel with the task; rows stream through in Arrow batches. The work per row is heavy, so
    rows are first spread evenly over all cores.
    """
    require(scored, *keep, features, prediction)
    trees = load_trees(tree_nodes(model))
    base = base_value(trees)
    rows = scored.select(*[name(c) for c in keep], name(prediction), vector_to_array(name(features)).alias("features"))
    # As many tasks as there are cores, whatever the number of shuffle partitions: each of them unpacks all trees.
    rows = rows.repartition(max(scored.sparkSession.sparkContext.defaultParallelism, -(-scored.count() // ROWS_PER_TASK)))
    extra = [T.StructField("base", T.DoubleType()), T.StructField("shap", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*rows.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for batch in batches:
            n = batch.num_rows
            if n:
                lookup = lookup or tabulated(trees)
                x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(n, -1)
                values = shapley(x, lookup)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(x.shape[1]))
                shap = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, base)), shap], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def long_attributions(attributed: DataFrame, names: Sequence[str], keep: Sequence[str], only: Sequence[str] | None = None) -> DataFrame:
    """One row per (row, feature): ``keep..., feature, feature_value, shap``, of the features ``only`` if given."""
    entries = [
        F.struct(F.lit(n).alias("feature"), F.col("features")[i].alias("feature_value"), F.col("shap")[i].alias("shap"))
        for i, n in enumerate(names) if only is None or n in only
    ]
    return attributed.select(*[name(c) for c in keep], F.inline(F.array(*entries)))


def global_attribution(attributed: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute value per feature and the spread of the values, strongest first.

    Only the array of each row is written; all figures and the passes of the exact quantiles read it from there.
    """
    stored = cut_lineage(attributed.select("shap"))
    entries = [F.struct(F.lit(n).alias("feature"), F.col("shap")[i].alias("shap")) for i, n in enumerate(names)]
    long = stored.select(F.inline(F.array(*entries)))
    summary = long.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs"), F.avg("shap").alias("mean"), F.min("shap").alias("min"), F.max("shap").alias("max")
    )
    spread = quantiles(long, "shap", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, ["feature"])
    return summary.join(spread, "feature", "left").orderBy(F.col("mean_abs").desc(), "feature")


def explain_rows(long: DataFrame, examples: DataFrame, on: Sequence[str]) -> DataFrame:
    """The contributions of a few chosen rows, largest first within each."""
    require(examples, *on, "prob")
    picked = long.join(examples.select(*[name(c) for c in on], "prob"), list(on))
    return picked.orderBy("prob", F.abs("shap").desc(), "feature")
