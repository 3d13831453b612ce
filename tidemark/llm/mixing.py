"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size). A source's budget beyond whole rounds of all its
documents is shared over the sizes in proportion, what remains is filled by single steps down to a
bounded rest, and a bounded-knapsack program over the counts that are left fits the rest. Then as many
documents of each size as the counts say are taken, in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named, word_number

WEIGHTS = (5.0, 2.0, 1.0)
# Rows of one (source, size) are dealt over bins by hash: at least MIN_BINS, about BIN_ROWS rows of the whole table each.
MIN_BINS, BIN_ROWS = 256, 20_000
# The knapsack program runs over a budget of at most this many words (or the longest document, if longer).
MAX_PROGRAM = 1 << 16


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to ``budget`` as can be found.

    Sizes are distinct and positive. Exact subset sum over the last stretch of the budget, a sum above it included if nearer.
    """
    taken = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(sizes):
        return taken
    longest = int(sizes.max())
    room = max(MAX_PROGRAM, longest)
    # What is shared in proportion leaves the program some room, and all of it where the budget is small.
    shared = max(0, budget - room // 2) if budget > room else 0
    taken[:] = [int(c) * shared // total for c in counts]
    rest = budget - int((sizes * taken).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    # Every size whose share was rounded down has a document left, so one pass of single steps is enough.
    for i in order:
        if rest <= room:
            break
        if counts[i] > taken[i]:
            taken[i] += 1
            rest -= int(sizes[i])
    return taken + _knapsack(sizes, counts - taken, rest, order)


def _knapsack(sizes: np.ndarray, left: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded subset sum: for each reachable sum, the size and the copies that first reached it."""
    top = budget + int(sizes.max())
    item = np.full(top + 1, -1, np.int64)
    copies = np.zeros(top + 1, np.int64)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    bundles = []
    for i in order:
        for n in _binary(int(min(left[i], top // sizes[i]))):
            if reached[budget]:
                break
            weight = int(sizes[i]) * n
            at = np.flatnonzero(reached[: top + 1 - weight] & ~reached[weight:]) + weight
            item[at], copies[at] = len(bundles), n
            reached[at] = True
            bundles.append(i)
    taken = np.zeros(len(sizes), np.int64)
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = bundles[item[at]], copies[at]
        taken[i] += n
        at -= int(sizes[i]) * n
    return taken


def _binary(n: int) -> list[int]:
    """Bundles of copies whose subsets make every number up to ``n``."""
    out, step = [], 1
    while n > 0:
        out.append(min(step, n))
        n -= step
        step *= 2
    return out


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], limit: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    All targets grow in proportion to their weights until ``share`` of all words is given out; one that
    reaches ``limit`` times its source stops there. Sources are few: this table alone is ranked in one place.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("level", F.col("source_size") * limit / F.col("w"))
    order = Window.orderBy("level", "w", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    spent = F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0.0))
    # Were all sources from this one on open, they would stand at this level; the first that fits below its own stop sets it.
    open_level = (everything * share - spent) / F.sum("w").over(after)
    stepped = ranked.withColumn("open", F.when(open_level <= F.col("level"), open_level))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("open", ignorenulls=True).over(whole)
    target = F.least(F.col("source_size") * limit, F.coalesce(first * F.col("w"), F.col("source_size") * limit))
    return stepped.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
    weights: tuple[float, ...] = WEIGHTS, limit: int = 2, seed: int = 7,
) -> DataFrame:
    """All columns of ``docs`` and, with the prefix ``m_``: ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    Sizes are words. Sources in code-point order, null last, weigh ``weights`` in turn. ``copies`` says
    how often the mix holds a document, ``taken = copies * size``; a document without words has no copies beyond the
    rounds that all documents get. Equal rows are told apart by nothing, so which of them is taken is no matter.
    Reruns agree because order comes from a seeded hash of id and text. An empty table gives an empty one.
    """
    base = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    id_, text, source = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col, source_col))
    sized = base.withColumns({
        "size": word_number(text),
        "source": source,
        "key": F.coalesce(F.concat(F.lit("s"), source), F.lit("none")),
        "order": F.xxhash64(F.lit(seed), id_, F.xxhash64(text)),
    })
    bins = max(MIN_BINS, docs.count() // BIN_ROWS)
    sized = sized.withColumn("bin", F.pmod("order", F.lit(bins)))
    binned = cut_lineage(sized.groupBy("source", "key", "size", "bin").agg(F.count(F.lit(1)).alias("n")))
    counts = binned.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, limit)
    goals = cut_lineage(goals.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))).drop("source"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        """The counts of one source: one row per size, never one per document."""
        frame = frame.sort_values("size")
        total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        rounds = min(limit, int(target // total)) if total else 0
        budget = int(np.floor(target + 0.5)) - rounds * total
        words = frame["size"].to_numpy(np.int64) > 0
        extra = np.zeros(len(frame), np.int64)
        if budget > 0 and rounds < limit:
            extra[words] = fit_counts(frame["size"].to_numpy(np.int64)[words], frame["n"].to_numpy(np.int64)[words], budget, seed)
        return frame.assign(rounds=rounds, extra=extra)[["key", "size", "source_size", "target", "rounds", "extra"]]

    planned = cut_lineage(
        counts.join(goals, "key").select("key", "size", "n", "source_size", "target").groupBy("key").applyInPandas(
            fit, "key string, size bigint, source_size bigint, target double, rounds bigint, extra bigint"
        )
    )
    earlier = Window.partitionBy("key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    quota = binned.drop("source").join(planned, ["key", "size"]).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    quota = quota.select(
        "key", "size", "bin", "source_size", "target", "rounds",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("quota"),
    )
    placed = sized.join(quota, ["key", "size", "bin"])
    inside = Window.partitionBy("key", "size", "bin").orderBy("order")
    placed = placed.withColumn("copies", F.col("rounds") + (F.row_number().over(inside) <= F.col("quota")).cast("long"))
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.col("size").alias("m_size"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"),
        F.col("copies").alias("m_copies"), (F.col("copies") * F.col("size")).alias("m_taken"),
    )
