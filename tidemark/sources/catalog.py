"""Dataset catalogue and retention."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import period_start
from tidemark.functions.scalars import name
from tidemark.operators.common import require

CATALOG_SCHEMA = "dataset_id string, filename string, timestamp timestamp, row_count bigint, column_count int, columns array<string>"


def metadata(df: DataFrame, dataset_id: str, filename: str) -> DataFrame:
    """One catalogue row. Parquet answers the row count from its footers."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(filename).alias("filename"),
        F.current_timestamp().alias("timestamp"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [metadata(df, n, f"{n}.parquet") for n, df in tables.items()])


def register(df: DataFrame, dataset_id: str, filename: str, catalog_path: str) -> None:
    metadata(df, dataset_id, filename).write.mode("append").parquet(catalog_path)


def lookup(spark: SparkSession, catalog_path: str, dataset_id: str | None = None) -> DataFrame:
    """The newest entry per dataset, or of one dataset; the data itself is not touched."""
    entries = spark.read.schema(CATALOG_SCHEMA).parquet(catalog_path)
    if dataset_id is not None:
        entries = entries.filter(F.col("dataset_id") == dataset_id)
    fields = [c for c in entries.columns if c != "dataset_id"]
    newest = F.max_by(F.struct(*fields), F.col("timestamp")).alias("e")
    return entries.groupBy("dataset_id").agg(newest).select("dataset_id", "e.*").filter("columns IS NOT NULL")


def unregister(spark: SparkSession, catalog_path: str, dataset_id: str, data_path: str | None = None) -> None:
    """Take a dataset out of the catalogue by an entry without columns, and delete its files if a path is given.

    Catalogue files are only ever added to, so readers never meet a half-written state.
    """
    entry = spark.range(1).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(None).cast("string").alias("filename"), F.current_timestamp().alias("timestamp"),
        F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("int").alias("column_count"), F.lit(None).cast("array<string>").alias("columns"),
    )
    entry.write.mode("append").parquet(catalog_path)
    if data_path is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, catalog_path: str, dataset_id: str) -> bool:
    return not lookup(spark, catalog_path, dataset_id).isEmpty()


def column_names(spark: SparkSession, catalog_path: str, dataset_id: str) -> DataFrame:
    return lookup(spark, catalog_path, dataset_id).select(F.posexplode("columns").alias("position", "column"))


def retained(df: DataFrame, time: str, ttl: timedelta) -> DataFrame:
    """Rows not older than ``ttl`` before the newest row; the bound is known before the scan starts."""
    newest = df.agg(F.max(name(time)).alias("m"))
    limit = newest.select(F.col("m") - F.lit(ttl)).scalar()
    return df.filter(name(time) >= limit)


def retain(df: DataFrame, time: str, ttl: timedelta, path: str) -> None:
    """Write the rows that stay to a new folder; the caller swaps folders when the job has succeeded."""
    retained(df, time, ttl).write.mode("errorifexists").parquet(path)


# --- expiry by period --------------------------------------------------------------------------

# Where a table by period keeps the ends of each folder; readers skip names that begin so.
MANIFEST = "_manifest"
PERIOD = "period"


def _files(spark: SparkSession, path: str):
    """Hadoop's path class, the file system of the path and the path itself."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = kind(path)
    return kind, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def period_folders(spark: SparkSession, path: str) -> list[str]:
    """The values of the period that have a folder."""
    _, system, place = _files(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(place) if f.isDirectory()] if system.exists(place) else []
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{PERIOD}="))


def append_by_period(df: DataFrame, path: str, time: str, freq: str = "day") -> None:
    """Append rows to a table with a folder per period, and note the ends of the folders that grew. Rows without a time go to a folder of their own."""
    require(df, time)
    spark = df.sparkSession
    before = manifest(spark, path)
    rows = df.withColumn(PERIOD, F.coalesce(F.to_date(period_start(name(time), freq)).cast("string"), F.lit("none")))
    rows.write.mode("append").partitionBy(PERIOD).parquet(path)
    grown = rows.groupBy(PERIOD).agg(F.min(name(time)).cast("timestamp").alias("oldest"), F.max(name(time)).cast("timestamp").alias("newest"), F.count(F.lit(1)).alias("rows"))
    both = grown if before is None else before.unionByName(grown)
    _write_manifest(both.groupBy(PERIOD).agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.sum("rows").alias("rows")), path)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``period, oldest, newest, rows`` of the folders, as last noted; None where nothing has been."""
    _, system, place = _files(spark, f"{path}/{MANIFEST}")
    versions = sorted(int(f.getPath().getName()) for f in system.listStatus(place)) if system.exists(place) else []
    return spark.read.parquet(f"{path}/{MANIFEST}/{versions[-1]}") if versions else None


def _write_manifest(table: DataFrame, path: str) -> None:
    """A new version beside the old one, which goes once the new one is complete."""
    spark = table.sparkSession
    kind, system, place = _files(spark, f"{path}/{MANIFEST}")
    old = sorted(int(f.getPath().getName()) for f in system.listStatus(place)) if system.exists(place) else []
    version = old[-1] + 1 if old else 0
    # One small row per folder.
    table.coalesce(1).write.parquet(f"{path}/{MANIFEST}/{version}")
    for v in old:
        system.delete(kind(f"{path}/{MANIFEST}/{v}"), True)


def expire(spark: SparkSession, path: str, time: str, ttl: timedelta) -> dict[str, list[str]]:
    """Drop the rows older than ``ttl`` before the newest one: ``{"dropped": periods, "rewritten": periods}``.

    Folders whose newest row is too old are dropped whole, without being read. Only the folder that the limit runs through is
    rewritten, into a new folder that takes its place when it is complete. All other folders, and rows without a time, are untouched.
    """
    known = manifest(spark, path)
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    if known is None:
        return done
    limits = known.agg((F.max("newest") - F.lit(ttl)).alias("limit"))
    judged = known.withColumn("limit", limits.scalar()).filter("oldest < limit")
    kind, system, _ = _files(spark, path)
    # One row per folder that is touched.
    for row in judged.withColumn("gone", F.col("newest") < F.col("limit")).collect():
        folder = f"{path}/{PERIOD}={row[PERIOD]}"
        if row["gone"]:
            system.delete(kind(folder), True)
            done["dropped"].append(row[PERIOD])
            continue
        spare = f"{path}/_spare-{row[PERIOD]}"
        spark.read.parquet(folder).filter(name(time).cast("timestamp") >= F.lit(row["limit"])).write.mode("overwrite").parquet(spare)
        system.delete(kind(folder), True)
        system.rename(kind(spare), kind(folder))
        done["rewritten"].append(row[PERIOD])
    if done["dropped"] or done["rewritten"]:
        left = known.filter(~F.col(PERIOD).isin(done["dropped"] + done["rewritten"]))
        if done["rewritten"]:
            again = spark.read.parquet(*[f"{path}/{PERIOD}={p}" for p in done["rewritten"]]).withColumn(PERIOD, F.lit(done["rewritten"][0]))
            again = again.groupBy(PERIOD).agg(F.min(name(time)).cast("timestamp").alias("oldest"), F.max(name(time)).cast("timestamp").alias("newest"), F.count(F.lit(1)).alias("rows"))
            left = left.unionByName(again)
        _write_manifest(left, path)
    return {k: sorted(v) for k, v in done.items()}
