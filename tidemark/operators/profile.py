"""Column and table summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.blocks import time_chunks
from tidemark.operators.common import attach, join_keys, numeric_columns, require
from tidemark.operators.quantiles import number_of, order_statistics, quantiles, ranks, select_ranks
from tidemark.operators.stats import array_total


def _whole_column(df: DataFrame, value: str, probs: dict[str, float], pick: str) -> DataFrame:
    """One row: ``n``, the summary ``stats``, ``min``, ``max`` and the named quantiles, all from the passes of the selection."""
    require(df, value)
    x, d, restore = number_of(df.schema[value])
    rows = df.select(x.alias("x"), d.alias("d"), name(value).cast("double").alias("v"))
    out = order_statistics(df, value, list(probs.values()), pick=pick, found=lambda wanted: select_ranks(rows, [], wanted, summary=True))
    picks = [F.max(F.when(F.col("prob_id") == i, F.col("value"))).alias(c) for i, c in enumerate(probs)]
    ends = [F.first(restore(F.col(f"stats.x{e}"), F.col(f"stats.d{e}"))).alias(c) for e, c in (("a", "min"), ("b", "max"))]
    return out.agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), F.first("stats").alias("stats"), *ends, *picks)


def describe(df: DataFrame, value: str, *, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column (sample standard deviation); NaN is missing."""
    require(df, value)
    v = name(value)
    if approx:
        basic = df.agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v.cast("double"), [0.25, 0.5, 0.75], 10000).alias("q"),
        )
        return basic.select("count", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)])
    table = _whole_column(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "linear")
    return table.select(F.col("n").alias("count"), F.col("stats.mean").alias("mean"), F.col("stats.std_samp").alias("std"), "min", "max", "q25", "q50", "q75")


def describe_population(df: DataFrame, value: str) -> DataFrame:
    """The dashboard dialect: nulls dropped, upper median in the column's own type, population standard deviation."""
    table = _whole_column(df, value, {"median": 0.5}, "upper")
    return table.select(F.col("n").alias("count"), F.col("stats.mean").alias("mean"), "min", "max", F.col("stats.std_pop").alias("std_dev"), "median")


def profile_columns(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column: type, counts, distinct values and, for numbers, min/max/mean/median/std.

    Distinct values are counted in each column's own type, so a column with few values or one hot value moves few rows; medians of all
    columns come from common passes of the selection. ``approx`` uses sketches and one pass.
    """
    numbers = numeric_columns(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def summary(c: str) -> Column:
        number = c in numbers
        stat = (lambda fn: fn(name(c)).cast("double")) if number else (lambda fn: F.lit(None).cast("double"))
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("dtype"),
            F.count(name(c)).alias("count"),
            (F.count(F.lit(1)) - F.count(name(c))).alias("null_count"),
            (F.approx_count_distinct(name(c)) if approx else F.lit(None).cast("bigint")).alias("unique_count"),
            stat(F.min).alias("min"),
            stat(F.max).alias("max"),
            stat(F.avg).alias("mean"),
            (stat(lambda v: F.percentile_approx(v, 0.5, 10000)) if approx else F.lit(None).cast("double")).alias("median"),
            stat(F.stddev_samp).alias("std"),
        )

    wide = df.agg(F.array(*[summary(c) for c in df.columns]).alias("s"))
    table = wide.select(F.inline("s"))
    if approx:
        return table
    # Adding zero makes the two zeros of floating-point columns one value.
    signless = {f.name: name(f.name) + F.lit(0.0).cast(f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    counts = [F.struct(F.lit(c).alias("column"), F.count_distinct(signless.get(c, name(c))).alias("u")) for c in df.columns]
    distinct = df.agg(F.array(*counts).alias("s")).select(F.inline("s"))
    table = join_keys(table, distinct, ["column"], "left")
    table = join_keys(table, column_medians(df, numbers), ["column"], "left") if numbers else table.withColumn("m", F.lit(None).cast("double"))
    return table.select(
        "column", "dtype", "count", "null_count", F.coalesce("u", F.lit(0)).cast("bigint").alias("unique_count"),
        "min", "max", "mean", F.col("m").alias("median"), "std",
    )


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, m``: medians of several number columns, selected together in their own types and printed as doubles."""
    entries, units = [], []
    for c in columns:
        x, d, _ = number_of(df.schema[c])
        entries.append(F.struct(F.lit(c).alias("column"), x.alias("x"), d.alias("d")))
        kind = df.schema[c].dataType
        units += [F.lit(c), F.lit(kind.scale if isinstance(kind, T.DecimalType) else 0)]
    rows = df.select(F.inline(F.array(*entries)))
    found = select_ranks(rows, ["column"], lambda n: F.array(*[r.cast("long") for r in ranks(F.lit(0.5), n, "linear")[:2]]))
    first, second, _ = ranks(F.lit(0.5), F.col("n"), "linear")

    def at(rank: Column) -> Column:
        return F.try_element_at(F.filter("hits", lambda h: h["rank"] == rank), F.lit(1))

    found = found.withColumns({"a": at(first), "b": at(second), "unit": F.element_at(F.create_map(*units), F.col("column"))})
    whole = ((F.col("a.x").cast("decimal(20,0)") + F.col("b.x").cast("decimal(20,0)")) / 2).cast("double") / F.pow(F.lit(10.0), "unit")
    middle = F.when(F.col("a.d") == F.col("b.d"), F.col("a.d")).otherwise(F.col("a.d") + (F.col("b.d") - F.col("a.d")) * 0.5)
    return found.select("column", F.coalesce(whole, middle).alias("m"))


def missing_values(df: DataFrame, *, empty_is_missing: bool = True) -> DataFrame:
    """``column, missing``: nulls and, unless switched off, empty strings."""

    def absent(f: T.StructField) -> Column:
        null = name(f.name).isNull()
        return (null | (name(f.name) == "")) if empty_is_missing and isinstance(f.dataType, T.StringType) else null

    counts = [F.struct(F.lit(f.name).alias("column"), F.count_if(absent(f)).alias("missing")) for f in df.schema.fields]
    return df.agg(F.array(*counts).alias("s")).select(F.inline("s"))


def missing_over_time(df: DataFrame, bucket: Column, columns: Sequence[str], label: str = "bucket") -> DataFrame:
    """Missing counts of every column per time bucket: the data behind a missingness map."""
    return df.groupBy(bucket.alias(label)).agg(*[F.count_if(name(c).isNull()).alias(c) for c in columns])


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(name(key).alias(key)).distinct().orderBy(name(key).asc_nulls_last())


def distinct_years(df: DataFrame, time: str, *, descending: bool = False) -> DataFrame:
    years = df.filter(name(time).isNotNull()).select(F.year(name(time)).alias("year")).distinct()
    return years.orderBy(F.col("year").desc() if descending else F.col("year"))


def total_and_mean(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(name(value)).alias("total"), F.avg(name(value)).alias("average"), F.count(name(value)).alias("count"))


def time_span(df: DataFrame, time: str) -> DataFrame:
    """First and last time, and the span in years by the calendar-part and the whole-month formula."""
    ends = df.agg(F.min(name(time)).alias("first"), F.max(name(time)).alias("last"))
    parts = (F.year("last") - F.year("first")) + (F.month("last") - F.month("first")) / F.lit(12.0)
    whole = F.floor(F.months_between(F.to_date("last"), F.to_date("first"))) / F.lit(12.0)
    return ends.select(
        "first",
        "last",
        F.floor(parts + 0.5).cast("int").alias("years_by_parts"),
        F.greatest(F.lit(1), F.floor(whole + 0.5).cast("int")).alias("years_by_months"),
    )


def percent_change_ends(series: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Change in percent from the first to the last positive value; null without a positive value."""
    v, t = name(value), name(time)
    up = F.when(v > 0, t)
    out = series.groupBy(*[name(k) for k in keys]).agg(
        F.min_by(F.when(v > 0, v), up).alias("first_value"), F.max_by(F.when(v > 0, v), up).alias("last_value")
    )
    change = (F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100.0
    return out.withColumn("pct_change", F.when(F.col("first_value").isNotNull(), change))


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Counts per key in ``bins`` equal classes between the smallest and largest finite value of the table.

    Class 0 holds minus infinity, class ``bins + 1`` infinity and NaN.
    """
    v = name(value).cast("double")
    finite = F.when((F.abs(v) < float("inf")) & ~F.isnan(v), v)
    rows = attach(df.filter(v.isNotNull()), {"__lo": F.min(finite), "__hi": F.max(finite)})
    width = F.col("__hi") - F.col("__lo")
    bucket = F.when(width > 0, F.least(F.lit(bins), F.floor(F.lit(float(bins)) * (v - F.col("__lo")) / width) + 1)).otherwise(F.lit(1))
    bucket = F.when(v == float("-inf"), F.lit(0)).when((v == float("inf")) | F.isnan(v), F.lit(bins + 1)).otherwise(bucket)
    return rows.groupBy(*[name(k) for k in keys], bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def boxplot(df: DataFrame, value: str, keys: Sequence[str] = (), *, approx: bool = False) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends and the number of outliers per key."""
    quarters = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, approx=approx)
    iqr = F.col("q3") - F.col("q1")
    quarters = quarters.withColumns({"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr})
    v = name(value)
    rows = df.filter(v.isNotNull()).select(*[name(k) for k in keys], v)
    edges = [name(c) for c in ("q1", "median", "q3", "low_fence", "high_fence")]
    if keys:
        rows = join_keys(rows, quarters, keys)
    else:
        rows = rows.withColumn("__s", quarters.select(F.struct(*edges).alias("__s")).scalar()).select(v, "__s.*")
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    return rows.groupBy(*[name(k) for k in keys]).agg(
        *[F.first(c).alias(n) for c, n in zip(edges, ("q1", "median", "q3", "low_fence", "high_fence"), strict=True)],
        F.min(F.when(inside, v)).alias("low_whisker"),
        F.max(F.when(inside, v)).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def rank_examples(df: DataFrame, value: str, unique: str, probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Whole rows at 1-based rank ``int(p * n) + 1`` in (value, unique) order, marked in ``prob``.

    Rows that tie with the value at a rank are ranked by the ``unique`` number, by the same selection inside the ties.
    """
    spots = order_statistics(df, value, probs, pick="upper")
    spots = spots.select(F.col("prob_id").alias("__id"), F.col("prob").alias("__p"), F.col("value").alias("__v"), (F.col("rank") - F.col("n_below")).alias("__k"))
    found = spots.collect()
    few = F.broadcast(df.sparkSession.createDataFrame(found, spots.schema))
    # Rows of the few values only; equal zeros meet in the join as well.
    equal = df.filter(name(value).isin([r["__v"] for r in found]))
    plain = name(value) + F.lit(0.0).cast(df.schema[value].dataType) if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)) else name(value)
    ties = equal.withColumn("__v", plain).join(few, "__v")
    x, d, restore = number_of(df.schema[unique])
    places = ties.select("__id", "__k", x.alias("x"), d.alias("d")) if found else None
    if places is None:
        return df.limit(0).select(F.lit(0.0).alias("prob"), *[name(c) for c in df.columns])
    keyed = select_ranks(places.withColumn("__key", F.struct("__id", "__k")).select("__key", "x", "d"), ["__key"], lambda n: F.array(F.col("__key.__k")))
    at = F.try_element_at("hits", F.lit(1))
    nth = keyed.select(F.col("__key.__id").alias("__id"), restore(at["x"], at["d"]).alias("__u"))
    nth = F.broadcast(df.sparkSession.createDataFrame(nth.collect(), nth.schema))
    return ties.join(nth, "__id").filter(name(unique) == F.col("__u")).select(F.col("__p").alias("prob"), *[name(c) for c in df.columns])


def _pair_corr(a: str, b: str) -> Column:
    """Correlation over the rows where both are known; null when one of them is constant there."""
    both = name(a).isNotNull() & name(b).isNotNull()
    x, y = F.when(both, name(a).cast("double")), F.when(both, name(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate_target(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of the target with every other numeric column, strongest positive first."""
    require(df, target)
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    values = F.array(*[F.struct(F.lit(c).alias("column"), _pair_corr(target, c).alias("corr")) for c in columns])
    sign = F.when(F.col("corr") > 0, "positive").when(F.col("corr") < 0, "negative").otherwise("none")
    return df.agg(values.alias("s")).select(F.inline("s")).withColumn("sign", sign).orderBy(F.col("corr").desc_nulls_last(), "column")


def strongest(correlations: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest positive and k strongest negative entries of :func:`correlate_target`."""
    order = Window.partitionBy("sign").orderBy(F.abs("corr").desc(), "column")
    ranked = correlations.filter("sign <> 'none'").withColumn("__r", F.row_number().over(order))
    return ranked.filter(F.col("__r") <= k).drop("__r")


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, g``: per column number the sums over the rows where both it and each other column are known.

    ``g`` holds, one after the other for all columns b: rows, sum of a, sum of b, sum of a^2, sum of b^2, sum of a b, of values less a
    fixed shift near their mean. Each task multiplies its Arrow batches with the tables of known places, so that
    hundreds of columns take one scan, and hands on one array per column.
    """
    m = len(columns)
    values = df.select(*[name(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    # Any shift is right; one near the mean keeps the digits of columns that vary little.
    near = values.limit(1000).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))) for c in values.columns]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in near])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, 6, m))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            squares = x * x
            for i, product in enumerate((known.T @ known, x.T @ known, known.T @ x, squares.T @ known, known.T @ squares, x.T @ x)):
                total[:, i] += product
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(m), pa.int32()), pa.array(list(total.reshape(m, 6 * m)), pa.list_(pa.float64()))], names=["a", "g"]
        )

    parts = values.mapInArrow(add, "a int, g array<double>").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.groupBy("a", "task").agg(F.collect_list("g").alias("g")).select("a", array_total(F.col("g")).alias("g"))
    return some.groupBy("a").agg(F.collect_list("g").alias("g")).select("a", array_total(F.col("g")).alias("g"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``x, y, corr`` for all ordered pairs, over the rows where both are known, in one scan however many columns there are.

    Null when one of them is constant there. A column with itself has 1, if it is known twice. NaN is unknown.
    """
    columns = list(columns or numeric_columns(df))
    m = len(columns)
    sums = pair_sums(df, columns)
    labels = F.array(*[F.lit(c) for c in columns])
    pairs = sums.select("a", "g", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"))
    n, sa, sb, saa, sbb, sab = (F.col("g")[F.col("b") + i * m] for i in range(6))
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    # A constant leaves rounding behind, not zero.
    varies = (va > 1e-12 * saa) & (vb > 1e-12 * sbb)
    corr = F.when((n > 0) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sab - sa * sb / n) / F.sqrt(va * vb))))
    itself = F.when(n > 1, F.lit(1.0))
    return pairs.select(labels[F.col("a")].alias("x"), labels[F.col("b")].alias("y"), F.when(F.col("a") == F.col("b"), itself).otherwise(corr).alias("corr"))


def regression_lines(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Least-squares line of the target on each feature."""

    def line(c: str) -> Column:
        y, x = name(target).cast("double"), name(c).cast("double")
        return F.struct(
            F.lit(c).alias("feature"),
            F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"),
        )

    return df.agg(F.array(*[line(c) for c in features]).alias("s")).select(F.inline("s"))


def interval_counts(df: DataFrame, time: str, keys: Sequence[str] = (), *, chunks: int | None = None) -> DataFrame:
    """``keys..., seconds, count`` of the gaps between consecutive timestamps of each key.

    Works on raw rows in two levels: gaps inside a time chunk come from a window over the distinct
    timestamps of that chunk, gaps across chunks from the first and last timestamp of each chunk.
    Chunks hold about equally many rows. Repeated timestamps are counted as zero gaps on the way.
    """
    require(df, time, *keys)
    keyed = [name(k) for k in keys]
    rows = time_chunks(df.select(*keyed, name(time)), time, chunks)
    stamps = rows.groupBy(*keyed, "__chunk", name(time).alias("__t")).agg(F.count(F.lit(1)).alias("__c"))
    micros = F.unix_micros(F.col("__t").cast("timestamp"))
    inside = Window.partitionBy(*keyed, "__chunk").orderBy("__t")
    gap = (micros - F.lag(micros).over(inside)) / F.lit(1e6)
    steps = F.array_compact(
        F.array(
            F.when(gap.isNotNull(), F.struct(gap.alias("seconds"), F.lit(1).cast("bigint").alias("count"))),
            F.when(F.col("__c") > 1, F.struct(F.lit(0.0).alias("seconds"), (F.col("__c") - 1).alias("count"))),
        )
    )
    within = stamps.select(*keyed, steps.alias("__s")).select(*keyed, F.inline("__s"))
    raw = F.unix_micros(name(time).cast("timestamp"))
    across = rows.groupBy(*keyed, "__chunk").agg(F.min(raw).alias("__a"), F.max(raw).alias("__b"))
    before = F.lag("__b").over(Window.partitionBy(*keyed).orderBy("__chunk"))
    across = across.select(*keyed, ((F.col("__a") - before) / F.lit(1e6)).alias("seconds"), F.lit(1).cast("bigint").alias("count"))
    steps = within.unionByName(across.filter("seconds is not null"))
    return steps.groupBy(*keyed, "seconds").agg(F.sum("count").alias("count"))


def infer_frequency(df: DataFrame, time: str, keys: Sequence[str] = (), *, chunks: int | None = None) -> DataFrame:
    """The most frequent gap per key, its count, the sum and number of gaps, and a readable name."""
    gaps = interval_counts(df, time, keys, chunks=chunks)
    out = gaps.groupBy(*[name(k) for k in keys]).agg(
        F.max_by("seconds", F.struct(F.col("count"), -F.col("seconds"))).alias("seconds"),
        F.max("count").alias("count"),
        F.sum(F.col("seconds") * F.col("count")).alias("total_seconds"),
        F.sum("count").alias("gaps"),
    )
    return out.withColumn("frequency", frequency_name(F.col("seconds")))


def frequency_name(seconds: Column) -> Column:
    days = (seconds / 86400).cast("bigint")
    hours = (seconds / 3600).cast("bigint")
    by_day = (
        F.when(days == 1, F.lit("Daily"))
        .when(days == 7, F.lit("Weekly"))
        .when(days.between(28, 31), F.lit("Monthly"))
        .otherwise(F.concat(days.cast("string"), F.lit(" Days")))
    )
    return (
        F.when(seconds.isNull(), F.lit(None))
        .when(seconds % 86400 == 0, by_day)
        .when(seconds % 3600 == 0, F.concat(hours.cast("string"), F.lit(" Hours")))
        .otherwise(F.lit("Irregular"))
    )


def pool_rare(df: DataFrame, column: str, *, at_least: int = 10, into: str = "RARE_CATEGORY", out: str | None = None) -> DataFrame:
    """Add ``<column>_grouped`` in which levels with fewer than ``at_least`` rows share one name."""
    out = out or f"{column}_grouped"
    counted = attach(df, {"__count": F.count(F.lit(1))}, [column])
    return counted.withColumn(out, F.when(F.col("__count") < at_least, F.lit(into)).otherwise(name(column))).drop("__count")


def compare_samples(full: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of both tables side by side, with absolute differences."""

    def stats(df: DataFrame, prefix: str) -> DataFrame:
        entries = [
            F.struct(F.lit(c).alias("column"), F.avg(name(c)).alias(f"{prefix}_mean"), F.stddev_samp(name(c)).alias(f"{prefix}_std"))
            for c in columns
        ]
        return df.agg(F.array(*entries).alias("s")).select(F.inline("s"))

    both = join_keys(stats(full, "full"), stats(sample, "sample"), ["column"])
    return both.withColumns(
        {"mean_diff": F.abs(F.col("full_mean") - F.col("sample_mean")), "std_diff": F.abs(F.col("full_std") - F.col("sample_std"))}
    )
