"""Helpers that several operators of this folder use: stored tables, components, ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# ASCII white space, the separators of words everywhere in this folder (also what bytes.split() splits at).
WORD = r"[^\x20\x09-\x0D]+"
# Graphs of so many edges are finished by one task.
LOCAL_EDGES = 1_000_000
# Odd constants of a well-known 64-bit mixing function.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """Some columns of one of the given tables; the path may be one that only Spark can open."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet").select(*columns)


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def word_number(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, so that each output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def row_batches(batches: Iterable[pa.RecordBatch], column: str, at_most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``at_most`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + at_most, "right")))
            yield batch.slice(first, last - first)
            first = last


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``range(start, start + length)`` for each pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` points reaches over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def _finish(edges: DataFrame) -> DataFrame:
    """``node, root`` of at most LOCAL_EDGES edges, found by one task."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(frame[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        return pd.DataFrame({"node": nodes, "root": nodes[local_roots(len(nodes), a, b)]})

    return edges.groupBy(F.lit(0).alias("all")).applyInPandas(join, "node bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: columns ``node, root`` for every node of the edges ``a, b`` (longs).

    Each round every node joins the neighbour (or itself) whose hash of this round is smallest, and
    the graph is contracted along these choices; a constant share of the nodes vanishes per round,
    on long chains too. A hub is aggregated map-side and its join is split by Spark's skew handling. A graph of
    at most LOCAL_EDGES edges (some 16 MB) is finished by one task. Roots are arbitrary members. No edges give an empty table.
    The result is stored.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, chosen = cut_lineage(edges), []
    while left.count() > LOCAL_EDGES:
        seed = F.lit(len(chosen))
        both = left.union(left.select("b", "a")).toDF("node", "other")
        best = both.groupBy("node").agg(F.min(F.struct(F.xxhash64(seed, "other").alias("h"), F.col("other").alias("id"))).alias("best"))
        own = F.struct(F.xxhash64(seed, "node").alias("h"), F.col("node").alias("id"))
        step = cut_lineage(best.select("node", F.least("best", own)["id"].alias("root")))
        chosen.append(step)
        ends = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").filter("x <> y")
        left = cut_lineage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    chosen.append(cut_lineage(_finish(left)))
    out = chosen[0]
    for step in chosen[1:]:
        out = out.join(step.toDF("root", "__next"), "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return cut_lineage(out) if len(chosen) > 1 else out
