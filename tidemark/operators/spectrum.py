"""Autocovariances at all lags by a Fourier transform in four steps, spread over tasks.

A series of n points is padded to N = P Q points. Point ``Q j1 + j2`` and frequency ``k1 + P k2`` are cells of tables: the first
step transforms along j1 for some j2 at a time, the second along j2 for some k1 at a time, with a factor per cell in between. The
power spectrum is formed there, and the same two steps lead back. Tasks exchange square blocks of cells; none holds more
than some columns or rows of a table, about the square root of the series, and the work is N log N whatever the number of lags.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, ordered, small
from tidemark.session import cut_lineage

# Columns or rows of a table that a task takes at a time.
SIDE = 64
BLOCK = "id bigint, p int, q int, top bigint, jb int, kb int, re array<double>, im array<double>"


def _turn(n: int, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """exp(sign 2 pi i a b / n) for all pairs; the product is reduced first, so large tables lose no digits."""
    return np.exp(sign * 2j * np.pi * (np.outer(a, b) % n) / n)


def _sizes(table: pa.Table) -> tuple[int, int, int, int]:
    return tuple(table.column(c)[0].as_py() for c in ("id", "p", "q", "top"))


def _rows(id_: int, p: int, q: int, top: int, cells: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    n = len(cells)
    return pa.table({
        "id": pa.array([id_] * n, pa.int64()), "p": pa.array([p] * n, pa.int32()), "q": pa.array([q] * n, pa.int32()), "top": pa.array([top] * n, pa.int64()),
        "jb": pa.array([j for j, _, _ in cells], pa.int32()), "kb": pa.array([k for _, k, _ in cells], pa.int32()),
        "re": pa.array([c.real.ravel() for _, _, c in cells], pa.list_(pa.float64())), "im": pa.array([c.imag.ravel() for _, _, c in cells], pa.list_(pa.float64())),
    })


def _cells(table: pa.Table):
    for j, k, re, im in zip(table.column("jb").to_pylist(), table.column("kb").to_pylist(), table.column("re"), table.column("im"), strict=True):
        yield j, k, np.asarray(re.values) + 1j * np.asarray(im.values)


def _columns_forth(table: pa.Table) -> pa.Table:
    id_, p, q, top = _sizes(table)
    jb = table.column("jb")[0].as_py()
    js = np.arange(jb * SIDE, min(q, (jb + 1) * SIDE))
    t = table.column("t").to_numpy()
    x = np.zeros((p, len(js)))
    x[t // q, t % q - js[0]] = table.column("x").to_numpy()
    turned = np.fft.fft(x, axis=0) * _turn(p * q, np.arange(p), js, -1)
    return _rows(id_, p, q, top, [(jb, k // SIDE, turned[k : k + SIDE]) for k in range(0, p, SIDE)])


def _rows_there_and_back(table: pa.Table) -> pa.Table:
    id_, p, q, top = _sizes(table)
    kb = table.column("kb")[0].as_py()
    ks = np.arange(kb * SIDE, min(p, (kb + 1) * SIDE))
    x = np.zeros((len(ks), q), complex)
    for j, _, cell in _cells(table):
        x[:, j * SIDE : (j + 1) * SIDE] = cell.reshape(len(ks), -1)
    found = np.fft.fft(x, axis=1)
    back = np.fft.ifft(found.real**2 + found.imag**2, axis=1) * _turn(p * q, ks, np.arange(q), 1)
    return _rows(id_, p, q, top, [(j // SIDE, kb, back[:, j : j + SIDE]) for j in range(0, q, SIDE)])


def _columns_back(table: pa.Table) -> pa.Table:
    id_, p, q, top = _sizes(table)
    jb = table.column("jb")[0].as_py()
    js = np.arange(jb * SIDE, min(q, (jb + 1) * SIDE))
    x = np.zeros((p, len(js)), complex)
    for _, k, cell in _cells(table):
        x[k * SIDE : (k + 1) * SIDE] = cell.reshape(-1, len(js))
    lag = (np.arange(p)[:, None] * q + js[None, :]).ravel()
    sums = np.fft.ifft(x, axis=0).real.ravel()
    kept = lag <= top
    return pa.table({"id": pa.array([id_] * int(kept.sum()), pa.int64()), "lag": pa.array(lag[kept], pa.int64()), "c": pa.array(sums[kept])})


def autocovariance(series: DataFrame, time: str, value: str, max_lag: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys..., lag, c, c0``: sums of products of centred values ``lag`` steps apart, and that at lag 0.

    Lags run to ``max_lag`` (half the series when None), at most the series' length less one. Null values are left out.
    """
    cols, v = [name(k) for k in keys], name(value).cast("double")
    rows = series.filter(v.isNotNull())
    top = F.floor(F.col("n") / 2) if max_lag is None else F.least(F.lit(max_lag), F.col("n") - 1)
    per_key = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.count(F.lit(1)) * F.var_pop(v)).alias("c0"))
    bits = F.ceil(F.log2((F.col("n") + F.col("top") + 1).cast("double"))).cast("int")
    per_key = per_key.filter("n > 0").withColumn("top", top.cast("long")).withColumn("bits", bits)
    per_key = per_key.withColumns({"p": F.pow(F.lit(2.0), F.ceil(F.col("bits") / 2)).cast("int"), "q": F.pow(F.lit(2.0), F.floor(F.col("bits") / 2)).cast("int")})
    # Stored before the numbers are given, so that they stay the same.
    per_key = cut_lineage(cut_lineage(per_key).withColumn("id", F.monotonically_increasing_id()))
    numbered = rows.select(*cols, v.alias("__v"), (F.row_number().over(ordered(keys, time)) - 1).alias("t"))
    about = per_key.select(*cols, "id", "p", "q", "top", "mean")
    if keys:
        met = join_keys(numbered, small(about), keys)
    else:
        met = numbered.withColumn("s", about.select(F.struct("*").alias("s")).scalar()).select("t", "__v", "s.*")
    points = met.select("id", "p", "q", "top", F.floor((F.col("t") % F.col("q")) / SIDE).cast("int").alias("jb"), F.col("t").cast("long").alias("t"), (F.col("__v") - F.col("mean")).alias("x"))
    forth = points.groupBy("id", "jb").applyInArrow(_columns_forth, BLOCK)
    turned = forth.groupBy("id", "kb").applyInArrow(_rows_there_and_back, BLOCK)
    sums = turned.groupBy("id", "jb").applyInArrow(_columns_back, "id bigint, lag bigint, c double")
    return sums.join(per_key.select(*cols, "id", "c0"), "id").select(*cols, F.col("lag").cast("int").alias("lag"), "c", "c0")
