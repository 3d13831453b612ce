"""Embedding near-duplicates against all pairs."""

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import embedding_dedup


def plain(rows, cosine=0.98):
    """rows: (id, vector, label)"""
    ok = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if k else None for k, (_, v, _) in zip(ok, rows)]
    unit = [u / np.sqrt((u * u).sum()) if u is not None else None for u in unit]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float((unit[i] * unit[j]).sum()) >= cosine
    ]
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    root, least = brute.roots(len(rows), links), {}
    for r, (id_, _, _) in zip(root, rows):
        if id_ is not None:
            least[r] = min(id_, least.get(r, id_))
    return sorted([(id_, n, least.get(r), id_ == least.get(r)) for (id_, _, _), n, r in zip(rows, count, root)], key=str)


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = entry.queries()["op4_embedding_dedup"](spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_tiles_and_lists(spark, monkeypatch):
    for name, value in (("BASE_TILE", 16), ("QUERY_TILE", 20), ("LIST_ROWS", 30)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(8)
    hub = rng.normal(size=16)
    rows = [(i, (hub + rng.normal(size=16) * 0.18).tolist(), 1) for i in range(90)]
    rows += [(100 + i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    rows += [(200 + i, (hub * (i + 1)).tolist(), 1) for i in range(20)] + [(300 + i, hub.tolist(), 1) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str) == plain(rows)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (8, [1.0, 2.0], 1),
        (None, [2.0, 4.0], 1), (9, [1e300, 2e300], 1), (10, [1e-300, 2e-300], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (None, [5.0, -4.0], 3), (13, [1.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({"id": F.lit("clash"), "v": F.lit(0), "list": F.lit(1)})
    got = sorted(map(tuple, embedding_dedup.near_duplicates(table).collect()), key=str)
    want = [(i, n, c, True if i is None and c is None else k) for i, n, c, k in plain(rows)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0 and embedding_dedup.near_duplicates(table.filter("vec_id < 8")).count() == 7
