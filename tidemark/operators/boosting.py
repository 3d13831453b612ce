"""Boosted regression trees from histograms: rows are kept as small codes, a pass over them counts per (open node, feature, code).

Values are cut into bins, texts into their levels; a row is one small code per column and its residual, in blocks
that each task holds as arrays. One pass a level adds up counts, sums and squares per code; the driver sees these sums only,
whose size is that of the model. Of two children only the one of fewer rows is counted, the other is what is left of its parent,
and columns of few codes are counted together. A text column costs one code however many levels it has, though each level is a
0/1 feature of its own. The result is an ordinary model of ``pyspark.ml``.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext, __version__
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.session import ensure_checkpoint_dir

# Rows of a block, rows that are worth a task of their own, most rows of a task (some 200 MB, read block by block), trees between two checkpoints.
BLOCK_ROWS, LEAST_ROWS, MOST_ROWS, KEEP_EVERY = 1 << 15, 20_000, 10_000_000, 20
# Columns are counted together while their codes make at most so many combinations.
GROUP_CODES = 1 << 11
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Node:
    """A node of a tree under construction: (count, sum, squares) of its rows, and its split if it has one.

    ``code`` is a level of a text column (``is_level``; rows that have it go right) or the last bin that goes left.
    ``left`` is the place of the left child, behind which the right one stands.
    """

    stats: np.ndarray
    gain: float = -1.0
    slot: int = -1
    column: int = -1
    code: int = -1
    is_level: bool = False
    left: int = -1

    @property
    def mean(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0


@dataclass(frozen=True)
class Splits:
    """All splits of all columns: the feature, column and code of each."""

    widths: list[int]
    numbers: int
    slot: np.ndarray
    column: np.ndarray
    code: np.ndarray
    slots: int


def bin_cuts(rows: DataFrame, numbers: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts per column: between all values where they are few, else at quantiles."""
    if not numbers:
        return []
    grid = [i / bins for i in range(1, bins)]
    seen = rows.agg(*[F.struct(F.approx_count_distinct(name(c)).alias("n"), F.percentile_approx(name(c), grid, 10_000).alias("q")) for c in numbers]).first()
    few = [i for i, s in enumerate(seen) if s["n"] <= 2 * bins]
    values = dict(zip(few, rows.agg(*[F.collect_set(name(numbers[i])) for i in few]).first(), strict=True)) if few else {}
    out = []
    for i, s in enumerate(seen):
        v = np.unique(values.get(i, []))
        out.append((v[:-1] + v[1:]) / 2 if 0 < len(v) <= bins else np.unique(s["q"]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], levels: Sequence[Sequence[str]], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows as numbered blocks of codes, column by column, and labels. The first column is the label, numbers come before texts."""
    known, task, made = [pa.array(v, pa.string()) for v in levels], TaskContext.get().partitionId(), count()

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        if any(c.null_count or pc.any(pc.is_nan(c)).as_py() for c in t.columns[: 1 + len(cuts)]):
            raise ValueError("labels and numbers must not be null or NaN; prepare the rows first")
        codes = [np.searchsorted(c, t.column(1 + i).to_numpy()).astype(kind) for i, c in enumerate(cuts)]
        for i, v in enumerate(known, 1 + len(cuts)):
            place = pc.fill_null(pc.index_in(t.column(i), value_set=v), len(v))
            codes.append(place.to_numpy().astype(kind))
        columns = [pa.array([x]) for x in (task, next(made), np.concatenate(codes).tobytes(), t.column(0).to_numpy().tobytes())]
        return pa.RecordBatch.from_arrays(columns, ["task", "number", "codes", "labels"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK_ROWS:
            yield block(held)
            held, n = [], 0
    if n:
        yield block(held)


def _opened(r, kind: str) -> tuple:
    y = np.frombuffer(r["labels"])
    return (r["task"], r["number"]), np.frombuffer(r["codes"], kind).reshape(-1, len(y)), y


def column_groups(widths: Sequence[int]) -> list[list[int]]:
    """Columns that are counted together, so that the codes of each group make few combinations."""
    groups: list[list[int]] = []
    for c in sorted(range(len(widths)), key=lambda c: -widths[c]):
        fits = (g for g in groups if math.prod(widths[i] for i in [*g, c]) <= GROUP_CODES)
        found = next(fits, None)
        if found is None:
            groups.append([c])
        else:
            found.append(c)
    return groups


def place_rows(codes: np.ndarray, nodes: Sequence[Node], n: int) -> np.ndarray:
    """The place in ``nodes`` of the node each row has come to; parents stand before their children."""
    at = np.zeros(n, np.uint16)
    for i, node in enumerate(nodes):
        if node.left >= 0:
            here, c = at == i, codes[node.column]
            at += here * np.uint16(node.left - i)
            at += here & (c == node.code if node.is_level else c > node.code)
    return at


def _count(blocks: Iterable, nodes: Sequence[Node], counted: Sequence[int], widths: Sequence[int], share: float, seed: Sequence[int], factor: float) -> Iterator[np.ndarray]:
    """(count, sum, squares) per counted node and code, columns one after the other, of the drawn rows of a task."""
    groups = column_groups(widths)
    held = [np.zeros((3, len(counted) * math.prod(widths[c] for c in g))) for g in groups]
    place = np.full(len(nodes), len(counted), np.int64)
    place[list(counted)] = np.arange(len(counted))
    for number, codes, rest in blocks:
        drawn = np.random.default_rng([*seed, *number]).random(len(rest), np.float32) < share if share < 1 else np.ones(len(rest), bool)
        if len(nodes) > 1:
            node = place[place_rows(codes, nodes, len(rest))]
            rows = np.flatnonzero(drawn & (node < len(counted)))
            node = node[rows]
        else:
            rows = np.flatnonzero(drawn)
            node = None
        y = rest[rows] * factor
        squares = y * y
        for group, out in zip(groups, held, strict=True):
            cell, size = codes[group[0]], widths[group[0]]
            for c in group[1:]:
                cell = cell * np.uint16(widths[c]) + codes[c]
                size *= widths[c]
            cell = cell[rows].astype(np.int64)
            if node is not None:
                cell += node * size
            for sums, weight in zip(out, (None, y, squares), strict=True):
                sums += np.bincount(cell, weight, len(sums))
    by_column: list = [None] * len(widths)
    for group, out in zip(groups, held, strict=True):
        cube = out.reshape(3, len(counted), *[widths[c] for c in group])
        for i, c in enumerate(group):
            by_column[c] = cube.sum(axis=tuple(2 + j for j in range(len(group)) if j != i)).reshape(3, -1)
    yield np.concatenate(by_column, axis=1)


def _by_node(sums: np.ndarray, counted: int, widths: Sequence[int]) -> np.ndarray:
    """Sums per (node, code of any column) from those of `_count`, where each column has all its nodes side by side."""
    ends = np.cumsum([w * counted for w in widths])[:-1]
    return np.concatenate([h.reshape(3, counted, w) for h, w in zip(np.split(sums, ends, axis=1), widths, strict=True)], axis=2)


def with_siblings(counted: Sequence[int], sums: np.ndarray, parents: dict[int, np.ndarray], open_: Sequence[int]) -> np.ndarray:
    """The sums of all open nodes; ``parents`` holds, by the place of the left child, those of nodes of which one child was counted."""
    known = {place: sums[:, k] for k, place in enumerate(counted)}
    for place in open_:
        if place not in known:
            left = place if place in parents else place - 1
            rest = parents[left] - known[2 * left + 1 - place]
            # No row is left where none is counted; what rounding leaves there would decide between equal splits.
            known[place] = np.where(rest[0] > 0, rest, 0.0)
    return np.stack([known[p] for p in open_], axis=1)


def _subtract(block: tuple, nodes: Sequence[Node], steps: np.ndarray) -> tuple:
    number, codes, rest = block
    return number, codes, rest - steps[place_rows(codes, nodes, len(rest))]


def all_splits(cuts: Sequence[np.ndarray], levels: Sequence[Sequence[str]]) -> Splits:
    counts = [*[len(c) for c in cuts], *[len(v) for v in levels]]
    slot, first = [np.full(len(c), i) for i, c in enumerate(cuts)], len(cuts)
    for v in levels:
        slot.append(np.arange(first, first + len(v)))
        first += len(v)
    return Splits(
        [c + 1 for c in counts], len(cuts), np.concatenate(slot), np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(c) for c in counts]), first,
    )


def split_nodes(nodes: list[Node], open_: Sequence[int], sums: np.ndarray, splits: Splits, columns: float, rng: np.random.Generator) -> list[int]:
    """Give each open node its best split (least squares) over a draw of the features; the places of the new children."""
    left, ends = [], np.cumsum(splits.widths)[:-1]
    for i, h in enumerate(np.split(sums, ends, axis=2)):
        if i == 0:
            totals = h.sum(axis=2)
        left.append(np.cumsum(h, axis=2)[:, :, :-1] if i < splits.numbers else totals[:, :, None] - h[:, :, :-1])
    left = np.concatenate(left, axis=2)
    right = totals[:, :, None] - left
    made = []
    for k, place in enumerate(open_):
        node, (n, total, squares) = nodes[place], totals[:, k]
        node.stats = totals[:, k].copy()
        drawn = np.zeros(splits.slots, bool)
        drawn[rng.choice(splits.slots, math.ceil(columns * splits.slots), replace=False)] = True
        fits = drawn[splits.slot] & (left[0, k] >= 1) & (right[0, k] >= 1)
        if not fits.any():
            continue
        gain = np.full(len(fits), -1.0)
        a, b = left[:, k, fits], right[:, k, fits]
        gain[fits] = (a[1] ** 2 / a[0] + b[1] ** 2 / b[0] - total**2 / n) / n
        best = int(gain.argmax())
        # Less is what rounding leaves of equal labels.
        if gain[best] <= 1e-12 * squares / n:
            continue
        node.gain, node.slot, node.column, node.code = float(gain[best]), int(splits.slot[best]), int(splits.column[best]), int(splits.code[best])
        node.is_level, node.left = node.column >= splits.numbers, len(nodes)
        made += [len(nodes), len(nodes) + 1]
        nodes += [Node(left[:, k, best].copy()), Node(right[:, k, best].copy())]
    return made


def boost(state: RDD, splits: Splits, trees: int, depth: int, rate: float, rows: float, columns: float, seed: int) -> list[list[Node]]:
    """Trees fitted one after the other to what the ones before leave, as Spark's learner does: the first to the labels with
    weight 1, the others to twice the residual with weight ``rate``; each on its own draw of the rows, each node on one of the features."""
    rng, out, older = np.random.default_rng(seed), [], None
    for t in range(trees):
        factor, weight = (1.0, 1.0) if t == 0 else (2.0, rate)
        nodes, open_, counted, parents = [Node(np.zeros(3))], [0], [0], {}
        for _ in range(depth):
            if not open_:
                break
            sums = state.mapPartitions(partial(_count, nodes=nodes, counted=counted, widths=splits.widths, share=rows, seed=(seed, t), factor=factor)).reduce(np.add)
            if older is not None:
                older.unpersist()
                older = None
            sums = with_siblings(counted, _by_node(sums, len(counted), splits.widths), parents, open_)
            before, open_ = open_, split_nodes(nodes, open_, sums, splits, columns, rng)
            parents = {nodes[p].left: sums[:, k] for k, p in enumerate(before) if nodes[p].left >= 0}
            counted = [min(p, p + 1, key=lambda i: nodes[i].stats[0]) for p in parents]
        out.append(nodes)
        if t + 1 < trees:
            older, state = state, state.map(partial(_subtract, nodes=nodes, steps=weight * np.array([n.mean for n in nodes])))
            state.persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % KEEP_EVERY == 0:
                state.checkpoint()
    state.unpersist()
    return out


def _tree_rows(tree: int, nodes: Sequence[Node], cuts: Sequence[np.ndarray]) -> list[tuple]:
    """The nodes in the order in which Spark numbers them: a node, what is left of it, what is right of it."""
    rows: list[tuple] = []

    def walk(place: int) -> int:
        node, number = nodes[place], len(rows)
        rows.append(())
        left, right = (walk(node.left), walk(node.left + 1)) if node.left >= 0 else (-1, -1)
        n, total, squares = (float(x) for x in node.stats)
        impurity = max(squares / n - (total / n) ** 2, 0.0) if n else 0.0
        cut = [] if left < 0 else [0.5] if node.is_level else [float(cuts[node.column][node.code])]
        rows[number] = (tree, (number, node.mean, impurity, [n, total, squares], int(n), node.gain, left, right, (node.slot, cut, -1)))
        return number

    walk(0)
    return rows


def as_model(rows: DataFrame, trees: Sequence[Sequence[Node]], cuts: Sequence[np.ndarray], slots: int, learner: GBTRegressor) -> GBTRegressionModel:
    """The trees as a model of ``pyspark.ml``, by way of the files in which such a model is stored."""
    spark = rows.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"boosted-{os.urandom(8).hex()}")

    def about(kind: str, uid: str, given: dict, **more) -> str:
        base = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": __version__, "uid": uid}
        return json.dumps({**base, "paramMap": given, "defaultParamMap": {"impurity": "variance"}, **more})

    given = {p.name: learner.getOrDefault(p) for p in learner.params if learner.isDefined(p)}
    spark.createDataFrame([(about("GBTRegressionModel", learner.uid, given, numFeatures=slots, numTrees=len(trees)),)], "value string").coalesce(1).write.text(path + "/metadata")
    weights = [(i, about("DecisionTreeRegressionModel", f"dtr_{learner.uid}_{i}", {}), learner.getStepSize() if i else 1.0) for i in range(len(trees))]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(path + "/treesMetadata")
    table = [r for i, nodes in enumerate(trees) for r in _tree_rows(i, nodes, cuts)]
    spark.createDataFrame(table, NODES).coalesce(1).write.parquet(path + "/data")
    return GBTRegressionModel.load(path)


def fit_trees(rows: DataFrame, target: str, numbers: Sequence[str], levels: dict[str, Sequence[str]], learner: GBTRegressor) -> GBTRegressionModel:
    """The model of ``learner``'s settings. Features are ``numbers``, then a 0/1 feature per level of each text column; other texts and nulls have none.

    ``rows`` must be stored; they are dealt over as many tasks as their number is worth, whatever the number of shuffle partitions.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.select(*[name(c).cast("double") for c in (target, *numbers)], *[name(c) for c in levels])
    n, cuts = rows.count(), bin_cuts(rows, numbers, learner.getMaxBins())
    if not n or not (numbers or levels):
        raise ValueError("nothing to fit: no rows or no features")
    splits = all_splits(cuts, list(levels.values()))
    tasks = max(math.ceil(n / MOST_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)))
    kind = "uint8" if max(splits.widths) <= 1 << 8 else "uint16"
    packed = partial(_blocks, cuts=cuts, levels=list(levels.values()), kind=kind)
    # Rows become blocks where they lie, and blocks are dealt evenly; the draws go by the number a block has before that.
    blocks = rows.coalesce(tasks).mapInArrow(packed, "task long, number long, codes binary, labels binary")
    state = blocks.repartition(tasks).rdd.map(partial(_opened, kind=kind)).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()
    state.count()
    trees = boost(
        state, splits, learner.getMaxIter(), learner.getMaxDepth(), learner.getStepSize(), learner.getSubsamplingRate(), float(learner.getFeatureSubsetStrategy()), learner.getSeed()
    )
    return as_model(rows, trees, cuts, splits.slots, learner)
