"""Line dedup: runs of lines that occur earlier in the corpus are deleted. DataFrame functions only.

The lines of a document that are not blank form a sequence of line ids. Suffixes are ranked by prefix
doubling: the rank of two lines is named from two line ranks, that of four from two ranks of two, and so on.
Names are hashes of what they stand for, so equal runs have equal ranks on all machines. Each round brings the
suffixes of equal rank together, which are an interval of the suffix array: their common prefix is as long as the round is deep. A suffix
whose rank is its own, or whose document ends there, is settled; the others go into the next round, until all are settled.
The first of an interval, by document and place, stays. Later suffixes of an interval are copies; those that follow each other
in a document merge to the maximal repeated run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named, word_number

BLANKS = " \t\r\x0b\x0c"


def _longer(ranks: Column, step: Column) -> Column:
    """From the two hashes of the runs from each line those of the runs ``step`` lines longer, for the lines that have enough after them."""
    count = F.greatest(F.size(ranks) - step, F.lit(0))
    return F.zip_with(
        F.slice(ranks, F.lit(1), count), F.slice(ranks, step + 1, count),
        lambda one, two: F.struct(F.xxhash64(one["h"], two["h"]).alias("h"), F.xxhash64(one["g"], two["g"]).alias("g")),
    )


def shared_runs(rows: DataFrame, least_lines: int = 1) -> DataFrame:
    """``id, hash, length, copies``: for each document and round the places from which a run of ``length`` lines goes that also starts earlier.

    ``rows`` are documents ``id, hash, lines`` with two hashes ``h, g`` per line; equal (id, hash) are one document. The lengths are
    1, 2, 4, ... up to ``least_lines`` itself, then its doubles; rounds end when no two suffixes share their rank. A round moves only the
    suffixes that shared theirs in the one before, and the first of an interval is an aggregate, however many suffixes it has.
    """
    where = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "place")
    # The length of the round travels in the rows, so that all rounds run the same compiled code.
    length = F.col("length")
    step = F.when(length < least_lines, F.least(length, F.lit(least_lines) - length)).otherwise(length)
    ranks = F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g")))
    state, found = rows.select("id", "hash", ranks.alias("ranks"), F.lit(1).alias("length")), []
    # In the first round all suffixes are open.
    suffixes = state.select("id", "hash", F.posexplode("ranks").alias("place", "rank"))
    while True:
        suffixes = suffixes.select("id", "hash", "place", "rank.*")
        intervals = suffixes.groupBy("h", "g").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        # A document may come in several rows; place and whether it is a copy are one number.
        mark = F.col("place").cast("long") * 2 + (where != F.col("first")).cast("long")
        shared = suffixes.join(intervals, ["h", "g"]).groupBy(F.col("id").alias("r_id"), F.col("hash").alias("r_hash")).agg(F.collect_set(mark).alias("marks"))
        met = state.drop("open").join(shared, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")))
        met = met.select("id", "hash", "ranks", "length", F.array_sort("marks").alias("marks"), (F.size("ranks") - step).alias("ends"))
        open_ = F.transform(F.filter("marks", lambda m: m < 2 * F.col("ends")), lambda m: F.shiftright(m, 1).cast("int"))
        copies = F.transform(F.filter("marks", lambda m: m % 2 == 1), lambda m: F.shiftright(m, 1).cast("int"))
        met = met.select("id", "hash", "ranks", "length", open_.alias("open"), copies.alias("copies"))
        longer = F.when(F.size("open") > 0, _longer(F.col("ranks"), step))
        met = cut_lineage(met.select("id", "hash", longer.alias("ranks"), "length", (length + step).alias("longer"), "open", "copies"))
        found.append(met.filter(F.size("copies") > 0).select("id", "hash", "length", "copies"))
        state = met.filter(F.size("open") > 0).select("id", "hash", "ranks", F.col("longer").alias("length"), "open")
        if state.isEmpty():
            return reduce(DataFrame.union, found).dropDuplicates(["id", "hash", "length"])
        at = F.transform("open", lambda p: F.struct(p.alias("place"), F.get("ranks", p).alias("rank")))
        suffixes = state.select("id", "hash", F.inline(at))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """All columns of ``docs`` and, with the prefix ``l_``: ``text`` (what is kept), ``lines``, ``removed``, ``runs``, ``depth``.

    A line is deleted if it lies in a run of ``least_lines`` lines (outer blanks apart, blank lines skipped)
    that also starts earlier: at a smaller id, or further up in the same document. With ``long_words``, a line of
    at least so many words is such a run by itself, wherever it stands. Null ids come last. Rows
    equal in id and text are one document and are treated alike; rows of one id and different texts come in
    the order of the text's hash. A null text stays null and has no lines; a text all of whose lines go becomes empty.
    Blank lines stay. ``runs`` counts the maximal deleted runs. ``depth`` is how far ranks are shared with earlier lines: the greatest
    length of a round (see :func:`shared_runs`) for which a run of the document also starts earlier, 0 without one; no repeated run is twice as long.
    An empty table gives an empty one. Very long texts are one row like any other; the work of a round on a text is linear in its lines,
    and rounds follow the logarithm of the longest repeated run. Other columns keep their values, whatever their names.
    """
    base = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    id_, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    whole = F.split(text, "\n", -1)
    trimmed = F.transform(whole, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    def of_line(x: Column) -> Column:
        fields = [x["at"].alias("at"), F.xxhash64(x["s"]).alias("h"), F.xxhash64(F.lit(1), x["s"]).alias("g")]
        if long_words is not None:
            # So many words have a character each and one between every two; most lines are too short to be counted.
            fields.append(((F.length(x["s"]) >= 2 * long_words - 1) & (word_number(x["s"]) >= long_words)).alias("long"))
        return F.struct(*fields)

    lines = F.transform(F.filter(trimmed, lambda x: x["s"] != ""), of_line)
    rows = cut_lineage(base.filter(text.isNotNull()).select(id_.alias("id"), F.xxhash64(text).alias("hash"), lines.alias("lines")))
    shared = shared_runs(rows, least_lines)

    def of_length(n: int) -> Column:
        copies = F.first(F.when(F.col("length") == n, F.col("copies")), ignorenulls=True)
        return F.coalesce(copies, F.array().cast("array<int>")).alias(f"of_{n}")

    shared = shared.groupBy(F.col("id").alias("r_id"), F.col("hash").alias("r_hash")).agg(
        F.max("length").alias("depth"), *[of_length(n) for n in {least_lines, 1}]
    )
    longs = [] if long_words is None else [F.transform("lines", lambda x: x["long"]).alias("longs")]
    numbers = rows.select("id", "hash", F.transform("lines", lambda x: x["at"]).alias("ats"), *longs).dropDuplicates(["id", "hash"])
    met = numbers.join(shared, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")))
    # A place is covered by the runs that start there or up to a run's length before; the places of a run are consecutive.
    covered = F.flatten(F.transform(f"of_{least_lines}", lambda p: F.sequence(p, p + least_lines - 1)))
    if long_words is not None:
        covered = F.concat(covered, F.filter("of_1", lambda p: F.get("longs", p)))
    starts = met.select("r_id", "r_hash", "ats", "depth", F.array_sort(F.array_distinct(covered)).alias("covered"))
    # Deleted places that follow each other belong to the same maximal run.
    later = F.zip_with("covered", F.slice("covered", F.lit(2), F.size("covered")), lambda p, q: q - p > 1)
    runs, any_ = F.size(F.filter(later, lambda apart: apart)) + 1, F.size("covered") > 0
    gone = F.transform("covered", lambda p: F.get("ats", p))
    gone = starts.select("r_id", "r_hash", F.when(any_, gone).alias("gone"), F.when(any_, runs).alias("runs"), "depth")
    joined = base.withColumn("hash", F.xxhash64(text)).join(
        gone, id_.eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")) & text.isNotNull(), "left"
    )
    # By hash, not line by line: a text may have very many lines.
    def without(w: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("gone")), lambda i: w[i])

    # The text is split once, not for each line.
    kept = F.array_join(F.transform(F.array(whole), without)[0], "\n")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias("l_text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(whole)).cast("long").alias("l_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("l_removed"),
        F.coalesce("runs", F.lit(0)).cast("long").alias("l_runs"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("l_depth"),
    )
