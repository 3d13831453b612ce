"""Audit of how filters interact: what each removes in every order of application.

Filters but one are conditions on a document's own measures; the last asks whether a smaller id has the same text. A counting
Bloom filter over all texts, merged from the counts of each task, clears texts that are certainly unique. Only possible
repeats are exchanged by their full text for the smallest id of each. A document's failures are then a mask, and documents are counted
per part and mask; everything an order of filters does follows from those counts by addition.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import MIX_B, cut_lineage, mix64, named, row_batches
from tidemark.llm.texts import BYTE_CODES, SLICE_BYTES, SpanHash, joined, per_text, words

MEASURES = ["n_words", "n_distinct", "n_upper", "n_chars", "n_symbols"]
IS_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*|"])
# The counting filter has so many counters per row, each text adds to so many of them, all within one block.
COUNTERS, PROBES, BLOCK = 32, 3, 512
# Tables of numbers with at most so many rows, or so many numbers in lists, are broadcast: some 24 MB.
BROADCAST_ROWS = 1_000_000


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def text_measures(texts: pa.Array) -> pa.Array:
    """Words, different words, capitals A-Z, code points and symbols of whole texts; a null text has none."""
    parts = []
    for piece in row_batches([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", SLICE_BYTES):
        data, at = joined(piece.column(0))
        starts, ends, of = words(data, at)
        code = SpanHash(BYTE_CODES[0][data])(starts, ends)
        owner = np.repeat(np.arange(piece.num_rows), np.diff(of))
        _, first = np.unique(mix64(code ^ owner.astype(np.uint64) * MIX_B), return_index=True)
        parts.append([
            np.diff(of), np.bincount(owner[first], minlength=piece.num_rows), per_text(IS_UPPER[data], at),
            per_text((data & 0xC0) != 0x80, at), per_text(IS_SYMBOL[data], at),
        ])
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)


def cells(name: Column, blocks: int) -> Column:
    """The counters of a text's name: places in one block of the filter."""
    block = F.pmod(name, F.lit(blocks))
    slots = [F.pmod(F.xxhash64(name, F.lit(i)), F.lit(BLOCK)) for i in range(PROBES)]
    return F.array_distinct(F.array(*[block * BLOCK + s for s in slots]))


def possible_repeats(names: DataFrame, rows: int) -> DataFrame:
    """The names ``h`` all whose counters are above one; the others stand for texts that occur once.

    Tasks count their own texts per counter and the counts are added up. Of the merged filter only the crowded counters go on,
    as one row per block.
    """
    blocks = max(1, -(-rows * COUNTERS // BLOCK))
    counts = names.select(F.explode(cells(F.col("h"), blocks)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = counts.groupBy(F.expr(f"cell div {BLOCK}").alias("block")).agg(F.collect_set("cell").alias("crowded"))
    crowded = sized(cut_lineage(crowded), F.size("crowded"))
    asked = names.withColumn("block", F.pmod("h", F.lit(blocks))).join(crowded, "block")
    return asked.filter(F.forall(cells(F.col("h"), blocks), lambda c: F.array_contains("crowded", c))).select("h").distinct()


def sized(stored: DataFrame, weight: Column | None = None) -> DataFrame:
    """A stored table, marked for broadcast if its rows (or the sum of their weights) are few."""
    size = stored.count() if weight is None else stored.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(stored) if size <= BROADCAST_ROWS else stored


def first_ids(docs: DataFrame, facts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """``h, g, least``: smallest id per name of a possible repeat; and ``text, h, g, least`` where texts share a name.

    Where the suspects are too many for a broadcast, Spark joins them with the texts by hash, which then move as well.
    """
    suspects = sized(cut_lineage(possible_repeats(facts.select("h"), rows)))
    met = docs.join(suspects, "h", "left_semi")
    # Copies meet on their own machine first, so that a text with very many of them moves a few times only.
    firsts = met.groupBy("text", "h", "g").agg(F.min("id").alias("least"))
    by_name = cut_lineage(firsts.groupBy("h", "g").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")))
    alone, shared = by_name.filter("texts = 1").drop("texts"), by_name.filter("texts > 1").select("h", "g")
    return alone, cut_lineage(firsts.join(shared, ["h", "g"], "left_semi"))


def step_table(docs: DataFrame, letters: str) -> DataFrame:
    """What a document with a mask of failures counts for, per order and step: a table whose size the number of filters fixes."""
    rows, n = [], factorial(len(letters))
    for mask in range(1 << len(letters)):
        fails = {c for i, c in enumerate(letters) if mask >> i & 1}
        for order in permutations(letters):
            for step, letter in enumerate(order, 1):
                before, here = bool(fails & set(order[: step - 1])), letter in fails
                rows.append((
                    mask, "".join(order), step, int(not before and not here), int(here and not before), int(here and before), int(fails == {letter}),
                    n // len(fails) if here else 0,
                ))
    kinds = "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, shapley int"
    return docs.sparkSession.createDataFrame(rows, kinds)


def audit(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], *, repeats: str = "E", id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang", name_bits: int = 64,
) -> DataFrame:
    """``part, filter_order, step`` and counts of documents, for every order of the filters and every step of it.

    ``filters`` gives each letter its failure as a condition on `MEASURES`; ``repeats`` is the letter of the filter against texts that also
    belong to a smaller id, removed or not. ``labels`` (``id_col, quality, toxic``) marks good and toxic documents; one of several rows
    suffices. Counts: ``kept`` after the step, ``removed`` here, ``redundant`` (fails, but was removed earlier), ``unique_fails`` (fails this
    filter only), ``good_lost`` and ``toxic_lost`` (removed here), ``shapley`` (removed by this filter, summed over all orders).

    A null text counts as empty, a null part as the empty part. Null ids stand behind all others; equal ids with equal texts
    do not repeat each other. Every row counts, repeated or not; very long texts are measured whole. Columns of other names
    do not matter. A table without rows has no parts and gives no rows.
    """
    letters = "".join(sorted([*filters, repeats]))
    if len(letters) > 6 or any(len(x) != 1 for x in filters):
        raise ValueError("at most six filters, each named by one letter")
    text = F.coalesce(named(text_col), F.lit(""))
    low = F.lit((1 << name_bits) - 1 if name_bits < 64 else -1).cast("long")
    base = docs.select(named(id_col).alias("id"), text.alias("text"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"))
    base = base.withColumns({"h": F.xxhash64("text").bitwiseAND(low), "g": F.xxhash64(F.lit(1), "text").bitwiseAND(low)})
    bits = [F.when(filters[c], F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters) if c in filters]
    measured = base.withColumn("m", text_measures("text")).select("id", "part", "h", "g", "m.*")
    facts = cut_lineage(measured.select("id", "part", "h", "g", reduce(lambda a, b: a + b, bits, F.lit(0)).alias("mask")))
    rows = facts.count()
    least, shared = first_ids(base.select("id", "text", "h", "g"), facts, rows)
    late = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    flagged = facts.join(sized(cut_lineage(least)), ["h", "g"], "left")
    if not shared.isEmpty():
        # Rows whose name stands for several texts are decided by the texts themselves.
        names = sized(cut_lineage(shared.select("h", "g").distinct()))
        again = base.join(names, ["h", "g"], "left_semi").join(shared.select("text", "least"), "text", "left")
        kept = flagged.join(names, ["h", "g"], "left_anti").drop("h", "g")
        again = again.withColumn("m", text_measures("text")).select("id", "part", "least", "m.*")
        flagged = kept.unionByName(again.select("id", "part", reduce(lambda a, b: a + b, bits, F.lit(0)).alias("mask"), "least"))
    flagged = flagged.select("id", "part", (F.col("mask") + F.when(late, F.lit(1 << letters.index(repeats))).otherwise(0)).alias("mask"))
    known = labels.select(named(id_col).alias("id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = sized(cut_lineage(known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))))
    counts = flagged.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic")
    )
    joined_ = counts.join(F.broadcast(step_table(docs, letters)), "mask")
    totals = [F.sum(F.col("n") * F.col(c)).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails")]
    lost = [F.sum(F.col(f"n_{c}") * F.col("removed")).cast("long").alias(f"{c}_lost") for c in ("good", "toxic")]
    return joined_.groupBy("part", "filter_order", "step").agg(*totals, *lost, F.sum(F.col("n") * F.col("shapley")).cast("long").alias("shapley"))
