"""Joins of the analysis steps: components, events, entity attributes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import name
from tidemark.operators.blocks import time_chunks, with_untimed
from tidemark.operators.common import join_keys, require


def add_components(df: DataFrame, components: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of derived columns back onto the table by (key, time)."""
    require(df, *on)
    require(components, *on)
    return join_keys(df, components, on, "left")


def flag_members(df: DataFrame, members: DataFrame, on: Sequence[str], out: str = "is_member") -> DataFrame:
    """0/1 flag: does the row's key occur in ``members``? Duplicates there do not multiply rows."""
    marked = members.select(*[name(c) for c in on]).distinct().withColumn(out, F.lit(1))
    return join_keys(df, marked, on, "left").withColumn(out, F.coalesce(name(out), F.lit(0)))


def add_attributes(facts: DataFrame, attributes: DataFrame, fact_key: str, attribute_key: str) -> DataFrame:
    """Inner equi-join on the entity id; Spark broadcasts the attributes while they are small."""
    return facts.join(attributes, name(fact_key) == name(attribute_key))


def nearest_dates(series: DataFrame, time: str, events: Sequence[date], keys: Sequence[str] = ()) -> DataFrame:
    """For each event date the nearest observed date per key, the earlier one on ties.

    The few events are a literal array in the aggregate: one map-side-combined pass, no join.
    """
    require(series, time, *keys)
    day = F.to_date(name(time))
    hits = F.array(
        *[
            F.struct(F.lit(e).alias("event_date"), F.min_by(day, F.struct(F.abs(F.datediff(day, F.lit(e))), day)).alias("nearest"))
            for e in events
        ]
    )
    grouped = series.groupBy(*[name(k) for k in keys]).agg(hits.alias("__hits"))
    out = grouped.select(*[name(k) for k in keys], F.inline("__hits"))
    return out.withColumn("days_off", F.abs(F.datediff("nearest", "event_date")))


def nearest_rows(
    left: DataFrame, right: DataFrame, time: str, right_time: str, keys: Sequence[str] = (), *, prefix: str = "nearest_", chunks: int | None = None
) -> DataFrame:
    """Each row of ``left`` with the columns of the row of ``right`` that is nearest in time and has the same key, named with ``prefix``.

    ``<prefix>seconds`` is the distance. On ties the earlier one wins; of several at one moment that with the smallest columns. Null keys are a
    key; rows without a time, or whose key does not occur on the right, get nulls. Repeated rows stay.

    Both sides may be large: they are united and sorted in chunks of time with about equally many rows, so a hot key is spread over all
    chunks. A row meets the last and next known one of its chunk; where it has none, those of the chunks before and
    after are handed over, one per key and chunk. No row meets more than two others, and nothing is joined by ranges.
    """
    require(left, time, *keys)
    require(right, right_time, *keys)
    ids, cols = [f"k{i}" for i in range(len(keys))], right.columns

    def micros(column: str):
        return F.unix_micros(name(column).cast("timestamp"))

    both = [name(k).alias(i) for k, i in zip(keys, ids, strict=True)]
    mine = left.filter(name(time).isNotNull()).select(*both, micros(time).alias("us"), F.struct(*[name(c) for c in left.columns]).alias("row"))
    known = right.filter(name(right_time).isNotNull()).select(*both, micros(right_time).alias("us"), F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(cols)]).alias("hit"))
    # One row per key and moment.
    known = known.groupBy(*ids, "us").agg(F.min("hit").alias("hit"))
    united = mine.unionByName(known, allowMissingColumns=True)
    placed = time_chunks(united.withColumn("at", F.timestamp_micros("us")), "at", chunks).drop("at")
    here = F.when(F.col("hit").isNotNull(), F.struct("us", "hit"))
    placed = placed.withColumn("here", here)
    ends = placed.filter("hit is not null").groupBy(*ids, "__chunk").agg(F.max_by("here", "us").alias("last"), F.min_by("here", "us").alias("first"))
    spots = placed.select(*ids, "__chunk").distinct().join(ends.withColumnsRenamed({i: f"r_{i}" for i in [*ids, "__chunk"]}), [
        *[F.col(i).eqNullSafe(F.col(f"r_{i}")) for i in ids], F.col("__chunk") == F.col("r___chunk")], "left")
    # What comes after is the last one seen in descending order: a frame that only grows is carried from row to row,
    # while one that reaches to the end would be read anew for every row.
    key, cell = Window.partitionBy(*ids), Window.partitionBy(*ids, "__chunk")
    handed = spots.select(
        *ids, "__chunk", F.last("last", True).over(key.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"),
        F.last("first", True).over(key.orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("from_after"),
    )
    late = F.col("hit").isNull()
    met = placed.withColumns({
        "before": F.last("here", True).over(cell.orderBy("us", late).rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.last("here", True).over(cell.orderBy(F.desc("us"), late.desc()).rowsBetween(Window.unboundedPreceding, 0)),
    }).filter("row is not null")
    met = join_keys(met, handed, [*ids, "__chunk"], "left")
    met = met.withColumns({"before": F.coalesce("before", "from_before"), "after": F.coalesce("after", "from_after")})
    back, ahead = F.col("us") - F.col("before.us"), F.col("after.us") - F.col("us")
    pick = F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    met = met.withColumn("pick", pick)
    found = met.select(
        *[F.col("row").getField(c).alias(c) for c in left.columns], *[F.col("pick.hit").getField(f"c{i}").alias(f"{prefix}{c}") for i, c in enumerate(cols)],
        (F.abs(F.col("pick.us") - F.col("us")) / F.lit(1e6)).alias(f"{prefix}seconds"),
    )
    return with_untimed(found, left, time)
