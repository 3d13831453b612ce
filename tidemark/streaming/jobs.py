"""Structured Streaming jobs. Each takes its checkpoint location, so a restarted job goes on where it stopped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.calendar import period_start
from tidemark.functions.scalars import name
from tidemark.operators.clean import normalize_for_storage


def watch_csv(spark: SparkSession, folder: str, schema: StructType | str, *, files_per_batch: int = 1000) -> DataFrame:
    """New CSV files of a folder as a stream."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def watch_parquet(spark: SparkSession, folder: str, schema: StructType | str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str, *, time: str | None = None, freq: str = "month") -> StreamingQuery:
    """Normalise what has arrived and append it as Parquet, by period when ``time`` is given; then stop."""
    rows = normalize_for_storage(stream)
    if time is not None:
        rows = rows.withColumn("period", period_start(name(time), freq).cast("string"))
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    if time is not None:
        writer = writer.partitionBy("period")
    return writer.trigger(availableNow=True).start()


def tumbling_totals(stream: DataFrame, time: str, value: str, keys: Sequence[str] = (), *, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Totals per window and key; rows later than ``late`` behind the newest are dropped.

    A watermark needs a timestamp with time zone, so a zoneless column is read in session time.
    """
    stamped = stream.withColumn("__time", name(time).cast("timestamp")).withWatermark("__time", late)
    totals = stamped.groupBy(F.window("__time", width).alias("__w"), *[name(k) for k in keys]).agg(
        F.sum(name(value)).alias("total"), F.count(F.lit(1)).alias("count")
    )
    return totals.select(F.col("__w.start").alias("start"), *[name(k) for k in keys], "total", "count")


def write_totals(totals: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows as Parquet until all available input is read; open ones wait for the next run."""
    writer = totals.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


# --- totals that late rows correct -------------------------------------------------------------


def keep_partials(batch: DataFrame, batch_id: int, target: str, time: str, value: str, keys: Sequence[str] = (), *, freq: str = "day") -> None:
    """The sums of one batch per key and period, in a folder of the batch's own: a replayed batch replaces itself."""
    sums = batch.filter(name(time).isNotNull()).groupBy(*[name(k) for k in keys], period_start(name(time), freq).alias("period")).agg(
        F.sum(name(value)).alias("total"), F.count(F.lit(1)).alias("count")
    )
    sums.write.mode("overwrite").parquet(f"{target}/partials/batch_id={batch_id}")


def standing_totals(
    stream: DataFrame, target: str, checkpoint: str, time: str, value: str, keys: Sequence[str] = (), *, freq: str = "day"
) -> StreamingQuery:
    """Totals per key and period that stand at any time and are corrected by rows however late; read them with :func:`read_totals`.

    No watermark closes a period and no state is kept: every batch leaves its own mergeable sums, one row per key and
    period it touched. All available input is read, then the query stops.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        keep_partials(batch, batch_id, target, time, value, keys, freq=freq)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str, label: str) -> list[int]:
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = kind(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{label}="))


def _sources(spark: SparkSession, target: str) -> tuple[list[int], list[int]]:
    """The newest base, as the last batch it holds, and the batches behind it."""
    bases = _parts(spark, f"{target}/base", "upto")[-1:]
    return bases, [b for b in _parts(spark, f"{target}/partials", "batch_id") if not bases or b > bases[0]]


def read_totals(spark: SparkSession, target: str) -> DataFrame:
    """``keys..., period, total, count`` over all batches so far."""
    bases, batches = _sources(spark, target)
    paths = [f"{target}/base/upto={b}" for b in bases] + [f"{target}/partials/batch_id={b}" for b in batches]
    if not paths:
        raise ValueError(f"no totals at {target}")
    rows = spark.read.parquet(*paths)
    keys = [c for c in rows.columns if c not in ("total", "count")]
    return rows.groupBy(*[name(k) for k in keys]).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


def compact_totals(spark: SparkSession, target: str) -> None:
    """Put all but the newest batch, which may be replayed, into one base; the parts it replaces stay until the next time."""
    bases, batches = _sources(spark, target)
    if len(batches) < 2:
        return
    older = spark.read.parquet(*[f"{target}/base/upto={b}" for b in bases], *[f"{target}/partials/batch_id={b}" for b in batches[:-1]])
    keys = [c for c in older.columns if c not in ("total", "count")]
    merged = older.groupBy(*[name(k) for k in keys]).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    merged.write.mode("overwrite").parquet(f"{target}/base/upto={batches[-2]}")
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = kind(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # What the base before this one had replaced is read by no one any more.
    for b in _parts(spark, f"{target}/partials", "batch_id"):
        if bases and b <= bases[0]:
            system.delete(kind(f"{target}/partials/batch_id={b}"), True)
