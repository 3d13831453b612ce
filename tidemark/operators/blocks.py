"""Window functions over raw rows of any number, cut into overlapping blocks.

A plain window puts all rows of a key into one task. Here rows get an exact position from block
counts, blocks of equal row count are formed from the positions, and the rows near a block's edge
are copied into the neighbour, so any window function with a fixed frame gives the same result
inside the blocks. Timestamps must be unique per key; rows without one have no place in the order, so they
are kept with a null result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, require

CHUNK_ROWS = 1_000_000


def with_untimed(out: DataFrame, df: DataFrame, time: str) -> DataFrame:
    """``out`` and the rows of ``df`` without a time, with nulls in the columns that were added."""
    return out.unionByName(df.filter(name(time).isNull()), allowMissingColumns=True)


def time_chunks(df: DataFrame, time: str, chunks: int | None = None) -> DataFrame:
    """Add ``__chunk``: time ranges with about equally many rows.

    The cuts come from a sample of a few hundred rows per chunk; they only balance the work, results
    do not depend on them. Their number follows the row count and is at least ``chunks``.
    """
    micros = F.unix_micros(name(time).cast("timestamp")).cast("double")
    rows = df.filter(name(time).isNotNull()).withColumn("__us", micros)
    n = rows.count()
    chunks = max(chunks or 1, math.ceil(n / CHUNK_ROWS))
    cuts: list[float] = []
    if chunks > 1:
        share = 200 * chunks / max(n, 1)
        picked = rows.sample(share, seed=42) if share < 0.5 else rows
        grid = [i / chunks for i in range(1, chunks)]
        cuts = picked.agg(F.percentile_approx("__us", grid, 4 * chunks).alias("c")).first()["c"] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        return rows.drop("__us").withColumn("__chunk", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="__us", outputCol="__chunk").transform(rows).drop("__us")


def numbered(df: DataFrame, time: str, keys: Sequence[str] = (), *, chunks: int | None = None, out: str = "position") -> DataFrame:
    """Exact 0-based ``position`` of every row in its series, without a window over the series."""
    require(df, time, *keys)
    cols = [name(k) for k in keys]
    rows = time_chunks(df, time, chunks)
    counts = rows.groupBy(*cols, "__chunk").agg(F.count(F.lit(1)).alias("__c"))
    earlier = F.sum("__c").over(Window.partitionBy(*cols).orderBy("__chunk")) - F.col("__c")
    offsets = counts.select(*cols, "__chunk", earlier.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*cols, "__chunk").orderBy(name(time)))
    placed = join_keys(rows.withColumn("__row", inside), offsets, [*keys, "__chunk"])
    placed = placed.withColumn(out, F.col("__before") + F.col("__row") - 1).drop("__before", "__row", "__chunk")
    return with_untimed(placed, df, time)


def over_blocks(
    df: DataFrame,
    time: str,
    fn: Callable[[DataFrame, list[str]], DataFrame],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = (),
    size: int = 100_000,
    chunks: int | None = None,
) -> DataFrame:
    """Apply ``fn(rows, keys)``, whose frames reach at most ``before`` / ``after`` rows, block by block."""
    if size < before + after:
        raise ValueError("blocks must be at least as long as the frame")
    rows = numbered(df.filter(name(time).isNotNull()), time, keys, chunks=chunks, out="__t")
    own = F.floor(F.col("__t") / size)
    place = F.col("__t") % size
    copies = F.array_compact(
        F.array(
            own,
            F.when(place >= size - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((place < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    spread = rows.withColumn("__own", own).withColumn("__block", F.explode(copies))
    return with_untimed(fn(spread, [*keys, "__block"]).filter("__block = __own").drop("__block", "__own", "__t"), df, time)


def running_mean(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, chunks: int | None = None, out: str = "expanding_mean") -> DataFrame:
    """Expanding mean of raw rows: chunk totals give each chunk its start, rows add the rest."""
    cols = [name(k) for k in keys]
    rows = time_chunks(df, time, chunks)
    totals = rows.groupBy(*cols, "__chunk").agg(F.sum(name(value)).alias("__s"), F.count(name(value)).alias("__c"))
    earlier = Window.partitionBy(*cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *cols, "__chunk", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c0")
    )
    frame = Window.partitionBy(*cols, "__chunk").orderBy(name(time)).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumns({"__s": F.coalesce(F.sum(name(value)).over(frame), F.lit(0.0)), "__c": F.count(name(value)).over(frame)})
    joined = join_keys(part, starts, [*keys, "__chunk"])
    mean = F.try_divide(F.col("__s0") + F.col("__s"), (F.col("__c0") + F.col("__c")).cast("double"))
    return with_untimed(joined.withColumn(out, mean).drop("__s", "__c", "__s0", "__c0", "__chunk"), df, time)


def carry_forward(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, chunks: int | None = None, out: str | None = None) -> DataFrame:
    """Forward fill of raw rows (rows without a time keep their own value): the last known value of earlier chunks is handed to the next ones."""
    cols = [name(k) for k in keys]
    rows = time_chunks(df, time, chunks)
    known = F.when(name(value).isNotNull(), name(time))
    lasts = rows.groupBy(*cols, "__chunk").agg(F.max_by(name(value), known).alias("__v"))
    earlier = Window.partitionBy(*cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = lasts.select(*cols, "__chunk", F.last("__v", ignorenulls=True).over(earlier).alias("__v0"))
    frame = Window.partitionBy(*cols, "__chunk").orderBy(name(time)).rowsBetween(Window.unboundedPreceding, 0)
    part = rows.withColumn("__v", F.last(name(value), ignorenulls=True).over(frame))
    joined = join_keys(part, starts, [*keys, "__chunk"])
    return with_untimed(joined.withColumn(out or value, F.coalesce("__v", "__v0")).drop("__v", "__v0", "__chunk"), df, time)
