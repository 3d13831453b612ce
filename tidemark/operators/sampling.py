"""Deterministic samples and splits of exact size.

Rows are ranked by the md5 of their id. The first 48 bits give a uniform number whose bins are
counted map-side; bins wholly below the cut are taken without moving a row and only the one bin that
holds the cut is ordered. The order is the same on every run and every cluster layout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, numeric_columns, require, small
from tidemark.session import cut_lineage

# Fixed value: the name rare levels are pooled under.
RARE = "RARE_CATEGORY"


def hash_text(row_id: str) -> Column:
    return F.md5(F.coalesce(name(row_id).cast("string"), F.lit("")))


def _bin(row_id: str, digits: int) -> Column:
    """The leading hex digits of the hash as a bin number, which keeps the hash order."""
    return F.conv(F.substring(hash_text(row_id), 1, digits), 16, 10).cast("int")


def _below_cut(df: DataFrame, row_id: str, quota: DataFrame | int, keys: Sequence[str], digits: int) -> DataFrame:
    """``df`` with ``__in``: whether the row is among the first rows of its key in hash order.

    ``quota`` is the number of rows, or a table with a number ``k`` per key.
    """
    cols = [name(k) for k in keys]
    rows = df.withColumn("__bin", _bin(row_id, digits))
    counts = rows.groupBy(*cols, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*cols).orderBy("__bin")))
    if isinstance(quota, int):
        cuts = counts.withColumn("k", F.lit(quota))
    else:
        cuts = join_keys(counts, small(quota), keys)
    reached = cuts.filter("__upto >= k and __upto - __c < k")
    cut = [F.col("__bin").alias("__cut"), (F.col("k") - F.col("__upto") + F.col("__c")).alias("__rest")]
    if keys:
        rows = join_keys(rows, small(reached.select(*cols, *cut)), keys, "left")
    else:
        edge = reached.select(*cut).first() or (-1, 0)
        rows = rows.withColumns({"__cut": F.lit(edge[0]), "__rest": F.lit(edge[1])})
    simple = rows.filter("__cut is null or __bin <> __cut").withColumn("__in", F.coalesce(F.col("__bin") < F.col("__cut"), F.lit(False)))
    order = Window.partitionBy(*cols, "__bin").orderBy(hash_text(row_id), name(row_id))
    edge_rows = rows.filter("__bin = __cut").withColumn("__in", F.row_number().over(order) <= F.col("__rest"))
    return simple.unionByName(edge_rows).drop("__bin", "__cut", "__rest")


def hash_sample(df: DataFrame, n: int, row_id: str) -> DataFrame:
    """Exactly ``n`` rows (the whole table if it has no more)."""
    require(df, row_id)
    if df.count() <= n:
        return df
    return _below_cut(df, row_id, n, [], 5).filter("__in").drop("__in")


def hash_split(df: DataFrame, row_id: str, test_share: float = 0.2) -> DataFrame:
    """All rows with ``split``: the first ``ceil(share * n)`` in hash order are the test part."""
    require(df, row_id)
    marked = _below_cut(df, row_id, math.ceil(df.count() * test_share), [], 5)
    return marked.withColumn("split", F.when(F.col("__in"), "test").otherwise("train")).drop("__in")


def quotas(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """Largest-remainder quotas of ``n`` rows: ``stratum, c, k``. One row per stratum comes in.

    Remainders are ranked over their distinct values, which are few; strata that tie at the cut are
    taken in hash order. A quota never exceeds its stratum.
    """
    total = counts.agg(F.sum("c")).first()[0]
    shares = counts.withColumn("__exact", F.lit(n) * F.col("c") / F.lit(total))
    shares = shares.withColumns({"__base": F.floor("__exact"), "__frac": F.round(F.col("__exact") - F.floor("__exact"), 9)})
    levels = shares.groupBy("__frac").agg(F.count(F.lit(1)).alias("__c"), F.sum("__base").alias("__b"))
    every = Window.partitionBy(F.lit(0))
    levels = levels.withColumns({"__upto": F.sum("__c").over(every.orderBy(F.col("__frac").desc())), "__left": F.lit(n) - F.sum("__b").over(every)})
    cut = levels.filter("__upto >= __left and __upto - __c < __left").selectExpr("__frac", "__left - __upto + __c").first()
    if cut is None:
        marked = shares.withColumn("__in", F.lit(False))
    else:
        clear = shares.filter(F.col("__frac") != cut[0]).withColumn("__in", F.col("__frac") > cut[0])
        marked = clear.unionByName(_below_cut(shares.filter(F.col("__frac") == cut[0]), stratum, int(cut[1]), [], 3))
    k = F.least(F.col("c"), F.col("__base") + F.col("__in").cast("bigint"))
    return marked.select(name(stratum), "c", k.alias("k"))


def stratified_sample(df: DataFrame, n: int, stratum: str, row_id: str, *, rare_below: int = 10) -> DataFrame:
    """Exactly ``n`` rows, spread over the levels of ``stratum`` by their share; rare levels pooled.

    A table of at most ``n`` rows comes back whole. The per-level counts and quotas are the only
    things kept between the passes; they are written to the checkpoint folder.
    """
    require(df, stratum, row_id)
    levels = df.groupBy(name(stratum).alias("__level")).agg(F.count(F.lit(1)).alias("c"))
    pooled = F.when(F.col("c") < rare_below, F.lit(RARE)).otherwise(F.col("__level").cast("string"))
    levels = cut_lineage(levels.withColumn("__stratum", pooled))
    counts = levels.groupBy("__stratum").agg(F.sum("c").alias("c"))
    quota = quotas(counts, "__stratum", n)
    rows = join_keys(df.withColumn("__level", name(stratum)), small(levels.drop("c")), ["__level"]).drop("__level")
    return _below_cut(rows, row_id, quota.drop("c"), ["__stratum"], 3).filter("__in").drop("__in", "__stratum")


def cluster_sample(df: DataFrame, n: int, row_id: str, columns: Sequence[str] | None = None, *, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows spread over k-means clusters of the standardised numeric columns by their share.

    Missing numbers are replaced by the column mean. Tables of at most ``n`` rows come back whole.
    """
    columns = list(columns or [c for c in numeric_columns(df) if c != row_id])
    size = df.count()
    if size <= n:
        return df
    if not columns:
        return hash_sample(df, n, row_id)
    clusters = max(2, min(int(math.sqrt(n)), size // 5))
    filled = [f"__f_{i}" for i in range(len(columns))]
    typed = df.withColumns({f"__n_{i}": name(c).cast("double") for i, c in enumerate(columns)})
    steps = [
        Imputer(strategy="mean", inputCols=[f"__n_{i}" for i in range(len(columns))], outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__x"),
        KMeans(k=clusters, seed=seed, featuresCol="__x", predictionCol="__cluster", maxIter=300),
    ]
    fitted = Pipeline(stages=steps).fit(typed)
    labelled = fitted.transform(typed).select(*[name(c) for c in df.columns], "__cluster")
    counts = labelled.groupBy("__cluster").agg(F.count(F.lit(1)).alias("c"))
    quota = quotas(counts, "__cluster", n).drop("c")
    return _below_cut(labelled, row_id, quota, ["__cluster"], 3).filter("__in").drop("__in", "__cluster")
