"""Exact order statistics by radix selection: no sorting of rows, no group in one task.

Every value has a digit that rises with it. One pass counts the rows per digit, with the smallest and largest value
of each, map-side combined; cumulated counts tell which digits hold the wanted ranks. The next pass looks at the rows
between the ends of those digits only and cuts each of these ranges into digits again. A range with one value is
done, however many rows have it.

The first digit follows the binary logarithm of a floating-point value, or the upper bits of an integer; later digits are
equal parts of a range. With ``DIGITS`` of them a pass, three passes tell any two 64-bit values apart; narrow
integers and repeated values take two. Integers, decimals, dates and timestamps stay 64-bit integers throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import name
from tidemark.operators.common import join_keys, small
from tidemark.session import cut_lineage

# Parts of a range per pass, and parts of a factor of two in the first one.
DIGITS, PER_OCTAVE = 1 << 22, 512
UPPER_BITS = 22


def number_of(field: T.StructField) -> tuple[Column, Column, Callable[[Column, Column], Column]]:
    """A column as (64-bit integer or null, double or null), and how to get a value of its own type back from the two."""
    v, kind, none_l, none_d = name(field.name), field.dataType, F.lit(None).cast("long"), F.lit(None).cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # NaN is a missing value; adding zero makes the two zeros one.
        return none_l, F.when(~F.isnan(v), v.cast("double") + F.lit(0.0)), lambda x, d: d.cast(kind)
    if isinstance(kind, T.IntegralType):
        return v.cast("long"), none_d, lambda x, d: x.cast(kind)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        unit = F.lit(Decimal(1).scaleb(-kind.scale))
        return (v.cast(T.DecimalType(38, kind.scale)) * F.lit(Decimal(10**kind.scale))).cast("long"), none_d, lambda x, d: (x.cast("decimal(19,0)") * unit).cast(kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("long"), none_d, lambda x, d: F.date_from_unix_date(x.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(v), none_d, lambda x, d: F.timestamp_micros(x)
    raise ValueError(f"no order statistics of {kind.simpleString()} (column {field.name!r}); decimals have at most 18 digits")


def first_digit(x: Column, d: Column) -> Column:
    """Rises with the value: upper bits of an integer; sign and logarithm of a double, infinities at the ends."""
    size = F.floor(F.log2(F.abs(d)) * PER_OCTAVE) + 1100 * PER_OCTAVE
    end = F.lit(4096 * PER_OCTAVE).cast("long")
    of_double = F.when(d == float("inf"), end).when(d == float("-inf"), -end).when(d == 0, F.lit(0).cast("long")).otherwise(F.signum(d).cast("long") * size)
    return F.when(x.isNotNull(), F.shiftright(x, 64 - UPPER_BITS)).otherwise(of_double)


def later_digit(x: Column, d: Column, r: Column) -> Column:
    """Which of the equal parts of the range ``r`` (inside one first digit) a value lies in."""
    step = F.floor((r["xb"] - r["xa"]) / F.lit(DIGITS)) + 1
    of_double = F.floor((d - r["da"]) / (r["db"] - r["da"]) * DIGITS)
    return F.when(x.isNotNull(), F.floor((x - r["xa"]) / step)).otherwise(of_double).cast("long")


def ranks(p: Column, n: Column, pick: str) -> tuple[Column, Column, Column]:
    """1-based ranks of the two rows a probability lies between, and the weight of the second."""
    if pick == "linear":
        return F.floor(p * (n - 1)) + 1, F.ceil(p * (n - 1)) + 1, p * (n - 1) - F.floor(p * (n - 1))
    if pick == "upper":
        upper = F.least(n, F.floor(p * n) + 1)
        return upper, upper, F.lit(0.0)
    raise ValueError("pick is 'linear' or 'upper'")


RANGE = "struct<below:bigint,c:bigint,xa:bigint,xb:bigint,da:double,db:double>"


def _pass(rows: DataFrame, group: Sequence[str], digit: Column, *more: Column) -> DataFrame:
    """Rows per digit of each group, with the ends of their values."""
    ends = [F.count(F.lit(1)).alias("c"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("d").alias("da"), F.max("d").alias("db")]
    return rows.groupBy(*[name(g) for g in group], digit.alias("digit")).agg(*ends, *more)


def _held(bins: DataFrame, group: Sequence[str], keep: Sequence[str], base: Column) -> DataFrame:
    """The bins of each group that hold a wanted rank, as ranges ``r``; ``below``: rows of the key before the bin."""
    upto = base + F.sum("c").over(Window.partitionBy(*[name(g) for g in group]).orderBy("digit"))
    bins = bins.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("c"))
    inside = F.exists("w", lambda w: (w > F.col("below")) & (w <= F.col("upto")))
    r = F.struct("below", "c", "xa", "xb", "da", "db").cast(RANGE)
    return cut_lineage(bins.filter(inside).select(*[name(k) for k in keep], "n", "w", r.alias("r")))


def _summary(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, standard deviations and ends of each key, put together from those of its bins."""
    every = Window.partitionBy(*[name(k) for k in keys])
    bins = bins.withColumn("mean", F.try_divide(F.sum("s").over(every), F.col("n").cast("double")))
    gap = F.col("q") * F.col("c") + F.col("c") * (F.col("s") / F.col("c") - F.col("mean")) * (F.col("s") / F.col("c") - F.col("mean"))
    bins = bins.withColumn("m2", F.sum(gap).over(every))
    stats = [F.col("mean"), F.sqrt(F.try_divide("m2", F.col("n") - 1)).alias("std_samp"), F.sqrt(F.try_divide("m2", "n")).alias("std_pop")]
    ends = [fn(c).over(every).alias(c) for c, fn in (("xa", F.min), ("xb", F.max), ("da", F.min), ("db", F.max))]
    return bins.withColumn("stats", F.struct(*stats, *ends)).drop("mean", "m2", "s", "q")


def select_ranks(rows: DataFrame, keys: Sequence[str], wanted: Callable[[Column], Column], *, summary: bool = False) -> DataFrame:
    """``keys..., n, hits``: for each key the wanted ranks with value and rows strictly below it.

    ``rows`` has the columns ``keys..., x, d``: a 64-bit integer or a double, the other one null. ``wanted`` makes the array of the ranks
    (1-based) from the number of rows of a key. ``hits`` is an array of (rank, x, d, below). With ``summary`` also ``stats``:
    mean, std_samp, std_pop of the column ``v`` and the ends, taken in the first pass.
    """
    cols = [name(k) for k in keys]
    rows = rows.filter(F.col("x").isNotNull() | F.col("d").isNotNull())
    more = [F.sum("v").alias("s"), F.var_pop("v").alias("q")] if summary else []
    bins = _pass(rows, keys, first_digit(F.col("x"), F.col("d")), *more)
    bins = bins.withColumn("n", F.sum("c").over(Window.partitionBy(*cols))).withColumn("w", wanted(F.col("n")))
    kept = [*keys, "stats"] if summary else list(keys)
    done = _held(_summary(bins, keys) if summary else bins, keys, kept, F.lit(0).cast("long"))
    wide = ~F.col("r.xa").eqNullSafe(F.col("r.xb")) | ~F.col("r.da").eqNullSafe(F.col("r.db"))
    finished, open_, x, d = [done.filter(~wide)], done.filter(wide), F.col("x"), F.col("d")

    def inside(r: Column) -> Column:
        return F.when(x.isNotNull(), x.between(r["xa"], r["xb"])).otherwise(d.between(r["da"], r["db"]))

    while not open_.isEmpty():
        # A key has at most as many open ranges as wanted ranks.
        firsts = [F.first(c).alias(c) for c in ("n", "w", *kept[len(keys) :])]
        per_key = open_.groupBy(*cols).agg(*firsts, F.array_sort(F.collect_set("r")).alias("rs"))
        if keys:
            per_key = small(per_key)
            met = join_keys(rows, per_key.select(*cols, "rs"), keys)
        else:
            few = per_key.select("rs").first()["rs"]
            met = rows.withColumn("rs", F.array(*[F.struct(*[F.lit(v) for v in r]).cast(RANGE) for r in few]))
        met = met.withColumn("r", F.try_element_at(F.filter("rs", inside), F.lit(1))).filter(F.col("r").isNotNull())
        bins = _pass(met.withColumn("base", F.col("r.below")), [*keys, "base"], later_digit(x, d, F.col("r")))
        about = per_key.drop("rs")
        if keys:
            bins = join_keys(bins, about, keys)
        else:
            packed = about.select(F.struct("*").alias("a")).scalar()
            bins = bins.withColumn("a", packed).select(*bins.columns, "a.*")
        done = _held(bins, [*keys, "base"], kept, F.col("base"))
        finished.append(done.filter(~wide))
        open_ = done.filter(wide)
    found = reduce(DataFrame.unionByName, finished)
    in_range = (F.col("rank") > F.col("r.below")) & (F.col("rank") <= F.col("r.below") + F.col("r.c"))
    spots = found.select(*[name(k) for k in kept], "n", "r", F.explode("w").alias("rank")).filter(in_range)
    hits = F.collect_set(F.struct("rank", F.col("r.xa").alias("x"), F.col("r.da").alias("d"), F.col("r.below").alias("below")))
    firsts = [F.first(c).alias(c) for c in ("n", *kept[len(keys) :])]
    return spots.groupBy(*cols).agg(*firsts, hits.alias("hits"))


def order_statistics(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), *, pick: str = "linear", found: Callable | None = None
) -> DataFrame:
    """``keys..., prob_id, prob, n, rank, value, n_below`` for every probability.

    ``pick='linear'`` interpolates between the two neighbours of ``p * (n - 1)``, in decimals where the column is an
    integer or a decimal; ``pick='upper'`` takes the row at 1-based rank ``floor(p * n) + 1``, in the column's own type. ``n_below``
    counts the rows strictly below the value at ``rank``. Null and NaN values do not count. ``found`` replaces the selection
    by one that also sums up, whose ``stats`` then go along.
    """
    # Keys get private names inside, so that no key can clash with a working column.
    outer, keys = list(keys), [f"__k{i}" for i in range(len(keys))]
    x, d, restore = number_of(df.schema[value])
    rows = df.select(*[name(k).alias(i) for k, i in zip(outer, keys, strict=True)], x.alias("x"), d.alias("d"))

    def wanted(n: Column) -> Column:
        return F.array(*[r.cast("long") for p in probs for r in ranks(F.lit(float(p)), n, pick)[:2]])

    selected = found(wanted) if found else select_ranks(rows, keys, wanted)
    extra = [c for c in ("stats",) if c in selected.columns]
    entries = []
    for i, p in enumerate(probs):
        first, second, weight = ranks(F.lit(float(p)), F.col("n"), pick)
        entries.append(F.struct(F.lit(i).alias("prob_id"), F.lit(float(p)).alias("prob"), first.cast("long").alias("rank"), second.cast("long").alias("second"), weight.alias("weight")))
    long = selected.select(*[name(k) for k in keys], "n", "hits", *extra, F.inline(F.array(*entries)))

    def at(rank: str) -> Column:
        return F.try_element_at(F.filter("hits", lambda h: h["rank"] == F.col(rank)), F.lit(1))

    long = long.withColumns({"a": at("rank"), "b": at("second")})
    result = _between(df.schema[value].dataType, restore) if pick == "linear" else restore(F.col("a.x"), F.col("a.d"))
    named = [name(i).alias(k) for k, i in zip(outer, keys, strict=True)]
    return long.select(*named, "prob_id", "prob", "n", "rank", result.alias("value"), F.col("a.below").alias("n_below"), *extra)


def _between(kind: T.DataType, restore) -> Column:
    """Value between the neighbours ``a`` and ``b``, exact where they are equal or the weight is zero."""
    weight = F.col("weight")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        a, b = F.col("a.d"), F.col("b.d")
        return F.when((a == b) | (weight == 0), a).otherwise(a + (b - a) * weight)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        # A moment between two moments is rounded to the unit of the type.
        return restore(F.col("a.x") + F.floor((F.col("b.x") - F.col("a.x")) * weight).cast("long"), F.lit(None))
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    a, b = (F.col(c).cast("decimal(20,0)") for c in ("a.x", "b.x"))
    exact = a + (b - a) * weight.cast("decimal(12,11)")
    return (exact.cast("decimal(35,9)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{9 + scale})")


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    *,
    pick: str = "linear",
    approx: bool = False,
) -> DataFrame:
    """One row per key with one column per named probability.

    ``approx`` keeps only the sketch, which needs a single pass.
    """
    if approx:
        sketch = F.percentile_approx(name(value).cast("double"), list(probs.values()), 10000)
        table = df.groupBy(*[name(k) for k in keys]).agg(sketch.alias("__q"))
        return table.select(*[name(k) for k in keys], *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
    long = order_statistics(df, value, list(probs.values()), keys, pick=pick)
    picks = [F.max(F.when(F.col("prob_id") == i, F.col("value"))).alias(n) for i, n in enumerate(probs)]
    return long.groupBy(*[name(k) for k in keys]).agg(*picks)
