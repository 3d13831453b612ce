"""Word-level dedup of repeated passages by recompression.

Each round names runs of equal symbols and pairs of neighbouring symbols. A pair is merged if a hash of
the names puts its first symbol on the left side and its second on the right, so what is merged depends on
the symbols alone, and only symbols up to the round's length take part, so it depends on few
words around. Names are 64-bit hashes of what they stand for: every task gives equal runs and pairs the
same name without a dictionary being sent around. Equal passages thus have the same symbols inside. The least
named border between two interior symbols is a passage's anchor; Spark rounds count the
anchors, and those that are shared are verified over the whole passages around them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.repeats import NOTHING, Finder, Pack, find_repeats, spans_of, word_packs
from tidemark.llm.shared import MIX_A, MIX_B, mix64

# Longest symbols, in words, that take part in each round.
ROUNDS = (1, 2)
# A border between two symbols depends on this many words to each side at most: a round looks one symbol
# further for runs and one for pairs.
REACH = 2 * sum(ROUNDS)


def symbol_borders(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words begin a symbol after all rounds; texts (at ``offsets``) are compressed apart."""
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start, name = np.arange(n), codes.copy()
    for number, longest in enumerate(ROUNDS):
        for pairs in (False, True):
            size = np.diff(np.append(start, n))
            fits = size <= longest
            both = fits[1:] & fits[:-1] & (text[start[1:]] == text[start[:-1]])
            if pairs:
                side = (mix64(name + np.uint64(number)) & np.uint64(1)).astype(bool)
                merge = both & ~side[:-1] & side[1:]
            else:
                merge = both & (name[1:] == name[:-1])
            head = np.append(True, ~merge)[: len(start)]
            group = np.cumsum(head) - 1
            count = np.bincount(group, minlength=int(head.sum()))
            first, start = name[head], start[head]
            if pairs:
                second = np.zeros(len(first), np.uint64)
                second[group[~head]] = name[~head]
                merged = mix64(first * MIX_A ^ mix64(second + MIX_B))
            else:
                merged = mix64(first + count.astype(np.uint64) * MIX_B)
            name = np.where(count > 1, merged, first)
    out = np.zeros(n, bool)
    out[start] = True
    return out


def border_names(pack: Pack) -> tuple[np.ndarray, int, int]:
    """The name of each border: the hash of the words that fix the symbols on both sides."""
    n = int(pack.offsets[-1])
    names = np.full(n + 1, NOTHING)
    at = np.flatnonzero(symbol_borders(pack.codes[0], pack.offsets))
    at = at[(at >= REACH) & (at + REACH <= n)]
    names[at] = pack.first(at - REACH, at + REACH)
    return names, REACH, REACH


def dedup_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """One row per document: ``id, n_words, spans, kept``.

    ``spans`` are the maximal runs of words covered by a window of ``length`` words whose sequence also starts
    anywhere else, in the same document too, judged on the input; ``kept`` are the other words joined by
    blanks. A null text has no words. Repeated rows are repeats of each other whatever their ids; null ids are
    ids like others. An empty table gives an empty one. ``length`` must be at least twice REACH.
    """
    if length < 2 * REACH:
        raise ValueError(f"windows of fewer than {2 * REACH} words have no interior symbols")

    def result(f: Finder, covered: dict[int, np.ndarray]) -> pd.DataFrame:
        ids, rows = f.table.column("id").to_pylist(), []
        for i, (id_, text) in enumerate(zip(ids, f.table.column("text").to_pylist(), strict=True)):
            words = (text or "").encode().split()
            spans, kept = [], words
            if i in covered:
                spans = [{"start": int(a), "end": int(b)} for a, b in spans_of(covered[i])]
                kept = [words[k] for k in np.flatnonzero(~covered[i])]
            rows.append((id_, len(words), spans, b" ".join(kept).decode()))
        out = pd.DataFrame(rows, columns=["id", "n_words", "spans", "kept"])
        return out.assign(id=pd.Series(ids, dtype=object))

    kind = docs.schema[id_col].dataType.simpleString()
    return find_repeats(
        docs, id_col=id_col, text_col=text_col, window=length, make_packs=word_packs, namer=border_names, earlier=False, result=result,
        schema=f"id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string",
    )
