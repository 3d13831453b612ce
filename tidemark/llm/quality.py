"""Quality rules: counts per document, and lines that too many documents of a host share.

Normalised lines are hashed and counted by the distinct documents of a host that hold them (documents with the same text count
once, and so do near copies of a text of several lines). Lines above the host's limit are boilerplate and are removed; a
document that is left with too little of itself is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import MIX_A, MIX_B, cut_lineage, mix64, named, row_batches, word_number
from tidemark.llm.texts import BYTE_CODES, IS_SPACE, SLICE_BYTES, SpanHash, joined, per_text, words

IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
# Tables of frequent lines with at most so many lines in all are broadcast.
BROADCAST_LINES = 500_000
# A line's key ends in its length, up to this many bits of it.
LENGTH_BITS = 12
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words per text that lie in a 3-word window found at least twice in the same text."""
    n = len(starts)
    covered = np.zeros(n, bool)
    if n >= 3:
        code = SpanHash(BYTE_CODES[0][data])(starts, ends)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        key = mix64(code[:-2] + MIX_A * mix64(code[1:-1] + MIX_B * code[2:]))
        key = mix64(key ^ owner[:-2].astype(np.uint64) * MIX_B)
        key, at = key[same := owner[:-2] == owner[2:]], np.flatnonzero(same)
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for i in range(3):
            covered[at[twice] + i] = True
    return per_text(covered, offsets)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    """The counts of whole texts; a null text has none of anything."""
    parts = []
    for piece in row_batches([pa.RecordBatch.from_arrays([texts], names=["text"])], "text", SLICE_BYTES):
        data, at = joined(piece.column(0))
        starts, ends, of = words(data, at)
        parts.append([
            np.diff(of),
            per_text(~IS_SPACE[data] & ((data & 0xC0) != 0x80), at),
            per_text(IS_SYMBOL[data], at),
            np.array([_repeated_lines(t) for t in piece.column(0).to_pylist()], np.int64),
            _repeat_words(data, starts, ends, of),
        ])
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


def line_key(line: Column) -> Column:
    """Hash of a line without case and outer blanks, with its length in the lowest bits."""
    plain = F.lower(F.btrim(line, F.lit(" \t\r\x0b\x0c")))
    return F.shiftleft(F.xxhash64(plain), LENGTH_BITS).bitwiseOR(F.least(F.length(plain), F.lit((1 << LENGTH_BITS) - 1)).cast("long"))


def line_keys(text: Column) -> Column:
    """The different lines of a text."""
    return F.array_distinct(F.transform(F.split(text, "\n", -1), line_key))


def per_host(lines: DataFrame) -> DataFrame:
    """``__host, __lines`` of a stored table ``host, line``, for broadcast if the lines are few in all."""
    lists = lines.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__lines"))
    return F.broadcast(lists) if lines.count() <= BROADCAST_LINES else lists


def frequent_lines(docs: DataFrame, *, text_col: str, host_col: str, share: float, at_least: int) -> DataFrame:
    """``host, line``: keys of the lines held by more documents of the host than its limit.

    The limit is ``share`` of the host's distinct texts, ``at_least`` at the least; lines of few documents are never above it, so
    a host has at most 1 / share times the lines of an average document on its list. A text with many near copies is no boilerplate: where
    two or more lines above the limit make up more than half of a document, the document goes by the least of these lines, which near
    copies of a text share but for a few. The others hold a line by themselves. Null hosts are one host.
    """
    lines = docs.select(named(host_col).alias("host"), named(text_col).alias("text")).filter("text IS NOT NULL")
    lines = lines.select("host", F.xxhash64("text").alias("doc"), F.length("text").alias("chars"), line_keys(F.col("text")).alias("lines"))
    lines = cut_lineage(lines.groupBy("host", "doc").agg(F.first("lines").alias("lines"), F.first("chars").alias("chars")))
    sizes = lines.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = lines.select("host", F.explode("lines").alias("line")).filter(F.col("line") != line_key(F.lit("")))
    # Lines below every limit leave before they meet the sizes.
    counts = counts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > at_least)
    above = counts.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))).filter(F.col("held") > F.col("docs") * share)
    above = cut_lineage(above.select("c.host", "line", (F.col("docs") * share).alias("limit")))
    met = lines.join(per_host(above.select("host", "line")), F.col("host").eqNullSafe(F.col("__host")))
    met = met.select("host", "doc", "chars", F.array_intersect("lines", "__lines").alias("hits")).filter(F.size("hits") > 0)
    length = F.aggregate("hits", F.lit(0).cast("long"), lambda n, k: n + k.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1).cast("long")))
    copy = (F.size("hits") > 1) & (2 * length > F.col("chars"))
    holders = met.select("host", F.when(copy, F.array_min("hits")).otherwise(F.col("doc")).alias("holder"), copy.alias("copy"), F.explode("hits").alias("line"))
    again = holders.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    limits = above.select(F.col("host").alias("a_host"), F.col("line").alias("a_line"), "limit")
    limits = F.broadcast(limits) if above.count() <= BROADCAST_LINES else limits
    again = again.join(limits, F.col("host").eqNullSafe(F.col("a_host")) & (F.col("line") == F.col("a_line")))
    return again.filter((F.col("held") > at_least) & (F.col("held") > F.col("limit"))).select("host", "line")


def judge(
    docs: DataFrame, *, text_col: str = "text", host_col: str = "source", share: float = 0.02, at_least: int = 20,
    least_words: int = 50, repeat_percent: int = 50, removed_percent: int = 50,
) -> DataFrame:
    """All columns of ``docs`` and, with the prefix ``q_``: ``text`` (frequent lines removed), the counts, ``base_failed``, ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` of them in repeated
    3-word windows. Of the rest a document is kept unless more than ``removed_percent`` of its words stood on
    removed lines. A null text counts as empty and fails; its ``q_text`` stays null. Repeated rows are judged alike, ids
    are not looked at; very long texts are judged whole.
    Columns of other names pass through, also if named like the counts; an empty table gives an empty one.
    """
    limits = per_host(cut_lineage(frequent_lines(docs, text_col=text_col, host_col=host_col, share=share, at_least=at_least)))
    base = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, host = (F.col(f"c{docs.columns.index(c)}") for c in (text_col, host_col))
    rows = base.join(limits, host.eqNullSafe(F.col("__host")), "left")

    def lines(frequent: bool) -> Column:
        return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.array_contains("q_hits", line_key(x)) == frequent), "\n")

    # A document's own frequent lines are few; only documents that have some are taken apart again.
    hits = F.when(F.col("__lines").isNotNull() & text.isNotNull(), F.array_intersect(line_keys(text), F.col("__lines")))
    rows = rows.withColumn("q_hits", hits)
    some = F.size("q_hits") > 0
    rows = rows.withColumns({
        "q_text": F.when(some, lines(False)).otherwise(text),
        "q_removed": F.when(some, word_number(lines(True))).otherwise(F.lit(0)),
        "q": text_counts(text),
    })
    failed = (F.col("q.n_words") < least_words) | (100 * F.col("q.n_repeat_words") > repeat_percent * F.col("q.n_words"))
    depleted = 100 * F.col("q_removed") > removed_percent * F.col("q.n_words")
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        "q_text", *[F.col(f"q.{c}").alias(f"q_{c}") for c in COUNTS],
        failed.alias("q_base_failed"), (~failed & ~depleted).alias("q_kept"),
    )
