"""CSV, JSON and Parquet in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.calendar import period_start
from tidemark.functions.scalars import name
from tidemark.operators.clean import normalize_for_storage
from tidemark.operators.common import require

CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession, path: str, *, schema: StructType | str | None = None, encoding: str = "UTF-8", multiline: bool = False, keep_bad: bool = False
) -> DataFrame:
    """CSV with a header row. Types are inferred unless given; give them to save a pass over big files.

    A row that does not fit a given schema is an error where it is read. With ``keep_bad``, or if the schema has the column
    ``_corrupt_record``, it is kept instead: its text stands in that column and fields that could not be read are null.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", multiline)
    if schema is None:
        return reader.option("mode", "PERMISSIVE").option("inferSchema", True).csv(path)
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_bad and CORRUPT not in typed.names:
        typed = StructType([*typed.fields, StructField(CORRUPT, StringType())])
    mode = "PERMISSIVE" if CORRUPT in typed.names else "FAILFAST"
    return reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).schema(typed).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, *, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; only the chosen columns leave the files."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    require(df, *columns)
    return df.select(*[name(c) for c in columns])


def table(spark: SparkSession, folder: str, table_name: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{folder}/{table_name}.parquet", columns)


def store(df: DataFrame, path: str, *, time: str | None = None, freq: str = "month", mode: str = "overwrite") -> None:
    """Normalise and write as Parquet; with ``time`` the files are partitioned by period.

    Rows are rebalanced by period first: Spark splits a busy period over many tasks and lets quiet
    ones share a task, so files come out of about equal size.
    """
    clean = normalize_for_storage(df)
    if time is None:
        clean.write.mode(mode).parquet(path)
        return
    marked = clean.withColumn("period", period_start(name(time), freq).cast("string"))
    marked.hint("rebalance", F.col("period")).write.mode(mode).partitionBy("period").parquet(path)
