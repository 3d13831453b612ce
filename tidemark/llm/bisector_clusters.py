"""Clusters around centroids, all in integers, each vector assigned by a tournament of bisectors.

Of two centroids the nearer one is told by the side of their bisecting plane on which a vector lies: the sign of a linear
form whose normal and threshold are integers made once per pair. A vector passes one such test per further
centroid, the loser leaves, and zero favours the smaller number; only the winner's distance is computed. Tasks add up
their vectors per cluster, so that a round moves a few sums per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named

# Rows of a task that are tested at once.
AT_ONCE = 8192


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``normals[a, b], thresholds[a, b]``: ``normal . x > threshold`` means that b is nearer to x than a."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller of equals, and its squared distance."""
    best = np.zeros(len(x), np.int64)
    for rival in range(1, len(centroids)):
        side = np.einsum("ij,ij->i", x, normals[best, rival]) - thresholds[best, rival]
        best[side > 0] = rival
    gap = x - centroids[best]
    return best, np.einsum("ij,ij->i", gap, gap)


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def integers(vectors: DataFrame, *, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``id, x``: vectors of the right length without null or non-finite components, as integers."""
    limit = 1 << ((61 - size.bit_length()) // 2 - 1)
    x = F.transform(named(vector_col), lambda v: v.cast("double"))
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(named(id_col).alias("id"), x.alias("x")).filter(F.coalesce(whole, F.lit(False)))
    fits = F.forall("x", lambda v: F.abs(v * float(scale)) < float(limit))
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a squared distance would not fit 64 bits; scale the vectors down")))
    return kept.select("id", F.transform(checked, lambda v: F.floor(v * float(scale)).cast("long")).alias("x"))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order; k is a parameter, so k rows come to the driver."""
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays."""
    planes = bisectors(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, x in _rows(batches, size):
            best, _ = nearest(x, centroids, *planes)
            order = np.argsort(best, kind="stable")
            found, first = np.unique(best[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(best, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some]), pa.array([sums[i].tolist() for i in some], pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    parts = points.mapInArrow(add, "cluster bigint, n bigint, sums array<bigint>")
    # A task's sums fit 64 bits, those of all tasks need not.
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = [[int(v) for v in row] for row in centroids]
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return np.array(out, np.int64)


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid``: one row per vector that takes part.

    A vector takes part if it has ``size`` components, none null or not finite; a component c becomes ``floor(scale * c)``. The first
    centroids are the k vectors with the smallest hashes of ``seed:id``; null ids come last, equal ids in the order of their vectors.
    Each of ``rounds`` rounds assigns all vectors (squared distance, the smaller number of equals) and moves every centroid to
    the floor of its mean; then all are assigned once more. ``distance`` is squared, ``cluster_inertia`` and ``inertia`` are its sums over the
    cluster and over all (null where a sum would not fit 64 bits), ``centroid`` is the final one.

    Repeated rows count each. Fewer vectors than k give fewer centroids, none give no rows. Components so large that a squared distance
    would not fit 64 bits raise an error. Other columns stay behind, whatever they are called.
    """
    # Stored once, read in every round.
    points = cut_lineage(integers(vectors, id_col=id_col, vector_col=vector_col, size=size, scale=scale))
    kind = points.schema["id"].dataType.simpleString()
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        none = points.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.withColumns({"cluster_inertia": F.col("distance"), "inertia": F.col("distance"), "centroid": F.array(F.col("distance"))}).limit(0)
    for _ in range(rounds):
        again = moved(points, centroids, size)
        if np.array_equal(again, centroids):
            # Nothing moves any more, in no later round either.
            break
        centroids = again
    planes = bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(batches, size):
            best, distance = nearest(x, centroids, *planes)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    assigned = cut_lineage(points.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = sum(int(r.s) for r in sums)
    table = [(r.cluster, int(r.s) if r.s < 1 << 63 else None, inertia if inertia < 1 << 63 else None, centroids[r.cluster].tolist()) for r in sums]
    of_cluster = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
