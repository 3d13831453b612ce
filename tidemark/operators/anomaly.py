"""Outliers, outlier periods and change points."""

from __future__ import annotations

import math
import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.blocks import time_chunks
from tidemark.operators.common import BROADCAST_ROWS, attach, attach_series, join_keys, ordered, whole
from tidemark.operators.sampling import hash_sample
from tidemark.operators.windows import flagged_runs
from tidemark.session import cut_lineage

EULER = 0.5772156649015329


# --- isolation forest --------------------------------------------------------------------------


def _average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, depth: int, limit: int, low: float, rng: np.random.Generator, out: list) -> None:
    """Append (left edge, path length) of each leaf interval of one random tree, left to right."""
    if depth >= limit or len(x) <= 1 or x.min() == x.max():
        out.append((low, depth + _average_path(len(x))))
        return
    cut = rng.uniform(x.min(), x.max())
    _grow(x[x <= cut], depth + 1, limit, low, rng, out)
    _grow(x[x > cut], depth + 1, limit, cut, rng, out)


def forest_steps(sample: np.ndarray, trees: int, tree_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The mean path length over all trees as a step function of the value: (left edges, lengths, rows per tree)."""
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(sample))
    limit = max(1, math.ceil(math.log2(max(rows, 2))))
    edges, changes = [np.array([-np.inf])], [np.array([0.0])]
    for _ in range(trees):
        leaves: list = []
        _grow(rng.choice(sample, rows, replace=False), 0, limit, -np.inf, rng, leaves)
        lengths = np.array([d for _, d in leaves])
        edges.append(np.array([e for e, _ in leaves]))
        changes.append(np.diff(lengths, prepend=0.0))
    edge, change = np.concatenate(edges), np.concatenate(changes)
    order = np.argsort(edge, kind="stable")
    edge, total = edge[order], np.cumsum(change[order]) / trees
    last = np.append(edge[1:] != edge[:-1], True)
    return edge[last], total[last], rows


def isolation_forest(
    df: DataFrame, value: str, row_id: str, *, contamination: float = 0.05, trees: int = 100, tree_rows: int = 256, seed: int = 42
) -> DataFrame:
    """Adds ``iso_score`` (higher = more isolated) and the 0/1 flag ``anomaly_iso``.

    Trees are grown on a hash sample of at most ``trees * tree_rows`` values. On one column a forest
    is a step function, so what every task needs is one short sorted array, searched per batch. The
    threshold is the exact score quantile over all rows, read from the counts of the few distinct
    scores a step function can have.
    """
    present = df.filter(name(value).isNotNull() & ~F.isnan(name(value)))
    picked = hash_sample(present.select(name(row_id).alias("id"), name(value).cast("double").alias("v")), trees * tree_rows, "id")
    sample = np.sort(np.array([r["v"] for r in picked.select("v").collect()], float))
    if not len(sample):
        return df.withColumns({"iso_score": F.lit(None).cast("double"), "anomaly_iso": F.lit(0)})
    edge, length, rows = forest_steps(sample, trees, tree_rows, seed)
    normal = max(_average_path(rows), 1e-12)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = v.to_numpy(float)
        # A value on a cut belongs to its left side, hence side="left".
        depth = length[np.maximum(np.searchsorted(edge, x, side="left") - 1, 0)]
        return pd.Series(np.where(np.isnan(x), np.nan, 2.0 ** (-depth / normal)))

    scored = df.withColumn("iso_score", F.nanvl(score(name(value).cast("double")), F.lit(None).cast("double")))
    counts = scored.filter("iso_score is not null").groupBy("iso_score").agg(F.count(F.lit(1)).alias("c")).orderBy("iso_score")
    steps = np.array([(r["iso_score"], r["c"]) for r in counts.collect()], float)
    limit = weighted_quantile(steps[:, 0], steps[:, 1], 1.0 - contamination)
    return scored.withColumn("anomaly_iso", F.coalesce((F.col("iso_score") > F.lit(limit)).cast("int"), F.lit(0)))


def weighted_quantile(values: np.ndarray, counts: np.ndarray, prob: float) -> float:
    """Interpolated quantile of sorted distinct values with their counts."""
    upto = np.cumsum(counts)
    at = prob * (upto[-1] - 1)
    low = values[np.searchsorted(upto, np.floor(at), side="right")]
    high = values[np.searchsorted(upto, np.ceil(at), side="right")]
    return float(low + (high - low) * (at - np.floor(at)))


# --- residual rules ----------------------------------------------------------------------------


def residual_flags(components: DataFrame, keys: Sequence[str] = (), *, width: float = 2.5, out: str = "anomaly_residual") -> DataFrame:
    """0/1 flag for residuals beyond ``width`` sample deviations of their series."""
    rows = attach_series(components, {"__s": F.stddev_samp("residual_component")}, keys)
    flag = F.abs("residual_component") > width * F.col("__s")
    return rows.withColumn(out, F.coalesce(flag.cast("int"), F.lit(0))).drop("__s")


def any_flag(df: DataFrame, flags: Sequence[str], out: str = "is_anomaly") -> DataFrame:
    return df.withColumn(out, F.greatest(*[F.coalesce(name(f), F.lit(0)) for f in flags], F.lit(0)).cast("int"))


def deviations(components: DataFrame, value: str, keys: Sequence[str] = (), *, limit: float = 2.0) -> DataFrame:
    """Expected value (trend + seasonal), deviation, its z-score and ``is_outlier_period``."""
    rows = components.withColumn("expected_value", F.col("trend_component") + F.col("seasonal_component"))
    rows = rows.withColumn("deviation", name(value) - F.col("expected_value"))
    rows = attach_series(rows, {"__m": F.avg("deviation"), "__s": F.stddev_samp("deviation")}, keys)
    rows = rows.withColumn("deviation_zscore", F.try_divide(F.col("deviation") - F.col("__m"), F.col("__s")))
    flag = F.coalesce((F.abs("deviation_zscore") > limit).cast("int"), F.lit(0))
    return rows.withColumn("is_outlier_period", flag).drop("__m", "__s")


def outlier_periods(flagged: DataFrame, time: str, keys: Sequence[str] = (), *, at_least: int = 2) -> DataFrame:
    """Runs of flagged points with start, end, direction, mean deviation and its share of the expected value."""
    runs = flagged_runs(flagged, time, F.col("is_outlier_period") == 1, keys, at_least=at_least)
    out = runs.groupBy(*[name(k) for k in keys], "run").agg(
        F.min(name(time)).alias("start"),
        F.max(name(time)).alias("end"),
        F.count(F.lit(1)).alias("points"),
        F.avg("deviation").alias("mean_deviation"),
        F.avg("expected_value").alias("mean_expected"),
    )
    out = out.withColumn("direction", F.when(F.col("mean_deviation") > 0, "above").otherwise("below"))
    percent = F.try_divide(F.abs("mean_deviation"), F.col("mean_expected")) * 100.0
    return out.withColumn("percent", percent).drop("mean_expected", "run")


# --- change points -----------------------------------------------------------------------------


def _best_splits(rows: DataFrame, time: str, segment: Sequence[str], least: int) -> DataFrame:
    """Per segment the split with the largest drop in squared error: ``time`` of its right part, ``at``, ``gain``, ``n``."""
    w = ordered(segment, time)
    cut = rows.select(
        *[name(c) for c in segment],
        "__sigma2",
        "__pen",
        F.row_number().over(w).alias("__i"),
        F.sum("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__left"),
        F.count(F.lit(1)).over(whole(segment)).alias("__n"),
        F.sum("__x").over(whole(segment)).alias("__total"),
        F.lead(name(time)).over(w).alias("__next"),
    )
    i, n, left, total = F.col("__i"), F.col("__n"), F.col("__left"), F.col("__total")
    cut = cut.filter((i >= least) & (n - i >= least))
    gain = left * left / i + (total - left) * (total - left) / (n - i) - total * total / n
    scored = F.try_divide(gain, F.col("__sigma2"))
    found = F.struct(F.col("__next").alias("time"), i.alias("at"), scored.alias("gain"), n.alias("n"), F.col("__pen").alias("pen"))
    return cut.groupBy(*[name(c) for c in segment]).agg(F.max_by(found, F.struct(gain, -i)).alias("__b")).select(*[name(c) for c in segment], "__b.*")


def change_point(series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, least: int = 2) -> DataFrame:
    """The best single mean shift per series: ``time`` of the first point after it, position and scaled gain."""
    rows = _standardised(series, value, keys).withColumn("__pen", F.lit(0.0))
    return _best_splits(rows, time, keys, least).drop("pen")


def _standardised(series: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    rows = attach_series(series.filter(name(value).isNotNull()), {"__m": F.avg(name(value)), "__v": F.var_pop(name(value))}, keys)
    x = (name(value) - F.col("__m")) / F.sqrt(F.nullif(F.col("__v"), F.lit(0.0)))
    return rows.withColumns({"__x": F.coalesce(x, F.lit(0.0)), "__sigma2": F.lit(1.0)}).drop("__m", "__v")


def _prefix_sums(rows: DataFrame, time: str, value: str, keys: Sequence[str], carried: str, chunks: int | None) -> DataFrame:
    """``keys..., time, carried, __i, __c``: position (from 1) and running sum; chunk totals give each chunk its start, rows add the rest."""
    cols = [name(k) for k in keys]
    part = time_chunks(rows, time, chunks)
    totals = part.groupBy(*cols, "__chunk").agg(F.sum(name(value)).alias("__s"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cols, "__chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("__s", "__n")])
    frame = ordered([*keys, "__chunk"], time).rowsBetween(Window.unboundedPreceding, 0)
    part = part.select(*cols, name(time), carried, "__chunk", F.sum(name(value)).over(frame).alias("__s"), F.count(F.lit(1)).over(frame).alias("__n"))
    placed = join_keys(part, starts, [*keys, "__chunk"])
    return placed.select(*cols, name(time), carried, (F.col("__n0") + F.col("__n")).alias("__i"), (F.col("__s0") + F.col("__s")).alias("__c"))


# Levels of the search between two stored copies of the open rows.
STORE_EVERY = 4


def change_points(
    series: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, penalty: float | None = None, least: int = 2, chunks: int | None = None
) -> DataFrame:
    """All mean shifts by binary segmentation: ``keys..., time, gain, level``.

    Each level looks for one more split in every open segment of all series in one job, until no segment
    gains more than the penalty (default ``3 ln n`` on the standardised series). Positions and running sums are made once, in time
    chunks, so a raw series may be of any length; with them a row knows the gain of a split behind it from the ends of its segment, and a
    level is an ordinary aggregate that is combined before it moves. Only rows of segments that were split go on. Rows without a time or
    value take no part; times are unique per series. Penalty values are not comparable with those of kernel cost functions.
    """
    cols = [name(k) for k in keys]
    known = series.filter(name(value).isNotNull() & name(time).isNotNull()).select(*cols, name(time), name(value).cast("double").alias("__v"))
    known = cut_lineage(known)
    known = attach(known, {"__m": F.avg("__v"), "__d": F.stddev_pop("__v"), "__hi": F.count(F.lit(1))}, keys)
    x = F.coalesce((F.col("__v") - F.col("__m")) / F.nullif(F.col("__d"), F.lit(0.0)), F.lit(0.0))
    base = cut_lineage(_prefix_sums(known.withColumn("__x", x), time, "__x", keys, "__hi", chunks))
    # Standardised values add up to zero.
    open_ = base.drop(time).withColumns({"__lo": F.lit(0).cast("bigint"), "__clo": F.lit(0.0), "__chi": F.lit(0.0)})
    open_ = open_.withColumn("__pen", 3.0 * F.ln("__hi") if penalty is None else F.lit(float(penalty)))
    i, c, lo, hi, clo, chi = (F.col(f"__{n}") for n in ("i", "c", "lo", "hi", "clo", "chi"))
    gain = (c - clo) * (c - clo) / (i - lo) + (chi - c) * (chi - c) / (hi - i) - (chi - clo) * (chi - clo) / (hi - lo)
    found = None
    for level in itertools.count(1):
        tried = open_.filter((i - lo >= least) & (hi - i >= least)).withColumn("__gain", gain)
        best = tried.groupBy(*cols, "__lo").agg(F.max(F.struct("__gain", (-i).alias("back"), "__c", "__pen")).alias("b"))
        best = best.filter("b.__gain > b.__pen").select(*cols, "__lo", (-F.col("b.back")).alias("__at"), F.col("b.__c").alias("__cat"), F.col("b.__gain").alias("gain"))
        best = cut_lineage(best.withColumn("level", F.lit(level)))
        found = best if found is None else found.unionByName(best)
        splits = best.count()
        if not splits:
            break
        cuts = best.drop("gain", "level")
        split = join_keys(open_, F.broadcast(cuts) if splits <= BROADCAST_ROWS else cuts, [*keys, "__lo"])
        right = i > F.col("__at")
        sides = {"__lo": (right, "__at", "__lo"), "__clo": (right, "__cat", "__clo"), "__hi": (right, "__hi", "__at"), "__chi": (right, "__chi", "__cat")}
        open_ = split.withColumns({n: F.when(side, F.col(a)).otherwise(F.col(b)) for n, (side, a, b) in sides.items()}).drop("__at", "__cat")
        if level % STORE_EVERY == 0:
            open_ = cut_lineage(open_)
    # The first point after the split carries its time.
    firsts = found.select(*cols, (F.col("__at") + 1).alias("__i"), "gain", "level")
    return join_keys(base.drop("__c", "__hi"), firsts, [*keys, "__i"]).select(*cols, name(time), "gain", "level")


def flag_change_points(series: DataFrame, points: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """The series with a 0/1 column ``is_change_point``."""
    marks = points.select(*[name(k) for k in keys], name(time)).distinct().withColumn("is_change_point", F.lit(1))
    return join_keys(series, marks, [*keys, time], "left").withColumn("is_change_point", F.coalesce("is_change_point", F.lit(0)))
