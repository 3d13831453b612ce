"""Clustering against SQL and against plain integers."""

import hashlib

import numpy as np
import pytest
from compare import check, connection
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import bisector_clusters


def test_sql(spark, folder):
    name = "op13_bisector_clusters"
    problem, _, _ = check(spark, connection(folder), name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None


def plain(rows, size, scale, k, rounds, seed):
    x = [(i, [int(np.floor(scale * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in x]

    for _ in range(rounds):
        best = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, b) in zip(x, best) if b == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    best = assign()
    total = {j: sum(d for d, b in best if b == j) for j in range(len(cents))}
    return [(i, b, d, total[b], sum(total.values()), cents[b]) for (i, _), (d, b) in zip(x, best)]


KINDS = "vec_id bigint, embedding array<double>, cluster string, `a.b` int"


def test_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(c) for c in rng.integers(-3, 4, 4) / 1024]) for i in range(60)]
    rows += [(3, rows[3][1]), (None, [0.5, -0.5, 0.1, 0.0]), (None, [0.0, -0.0, 0.0, 0.0]), (70, None), (71, []), (72, [1.0]), (73, [1.0, None, 1.0, 1.0])]
    rows += [(74, [float("nan"), 1.0, 1.0, 1.0]), (75, [float("inf"), 1.0, 1.0, 1.0]), (76, [1e-300, -1e-300, 5.0, -5.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS)
    for k, rounds in ((8, 10), (3, 1), (1, 2), (100, 2), (5, 0)):
        got = [tuple(r) for r in bisector_clusters.cluster(table, size=4, k=k, rounds=rounds).collect()]
        assert sorted(got, key=str) == sorted(plain(rows, 4, 1024, k, rounds, 3), key=str)
    assert bisector_clusters.cluster(table.limit(0), size=4).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        bisector_clusters.cluster(table.withColumn("embedding", F.array(*[F.lit(1e12)] * 4)), size=4)


def test_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(6)
    centroids = rng.integers(-4, 5, (9, 3))
    centroids[5] = centroids[2]
    x = rng.integers(-6, 7, (5000, 3))
    best, distance = bisector_clusters.nearest(x, centroids, *bisector_clusters.bisectors(centroids))
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
