"""Tables of a database, read in parallel ranges of a numeric column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """JDBC scan. Filters, aggregates and limits on the result are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", split_column).option("lowerBound", lower).option("upperBound", upper)
    reader = reader.option("numPartitions", partitions).option("pushDownAggregate", True).option("pushDownLimit", True)
    return reader.options(**(options or {})).load()
