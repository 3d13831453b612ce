"""Ranks of line runs by prefix doubling, against plain slices."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from test_corpus_tables import DOCS, plain_lines
from tidemark.llm import line_dedup


def lengths(least: int, most: int) -> list[int]:
    """1, 2, 4, ... up to ``least`` itself, then its doubles."""
    out = [1]
    while out[-1] < most:
        out.append(min(2 * out[-1], least) if out[-1] < least else 2 * out[-1])
    return out


def plain_runs(texts: list[list[str]], least: int) -> dict[tuple[int, int], list[int]]:
    """(document, length): places from which a run of that length goes that also starts earlier."""
    out: dict = {}
    for length in lengths(least, max(map(len, texts))):
        seen = set()
        for d, lines in enumerate(texts):
            for p in range(len(lines) - length + 1):
                run = tuple(lines[p : p + length])
                if run in seen:
                    out.setdefault((d, length), []).append(p)
                seen.add(run)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 6])
def test_rounds_go_on_until_no_rank_is_shared(spark, least):
    rng = np.random.default_rng(least)
    long = [f"p{i}" for i in range(37)]
    texts = [[str(rng.choice(list("abc"))) for _ in range(rng.integers(1, 12))] for _ in range(20)]
    texts += [long, ["x", *long[3:30], "y", *long], ["only"], long[:16], ["z"] * 9]
    rows = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(texts)], "id bigint, text string")
    line = F.transform(F.split("text", "\n"), lambda s: F.struct(F.xxhash64(s).alias("h"), F.xxhash64(F.lit(1), s).alias("g")))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), line.alias("lines"))
    expected = plain_runs(texts, least)
    # Rows of one document that come twice are the same document.
    for given in (rows, rows.union(rows.limit(9))):
        got = {(r.id, r.length): list(r.copies) for r in line_dedup.shared_runs(given, least).collect()}
        assert got == expected
    assert max(n for _, n in expected) >= 24


@pytest.mark.parametrize("least", [1, 2])
def test_depth_of_shared_ranks(spark, least):
    passage = "\n".join(f"line {i}" for i in range(21))
    texts = [passage, f"head\n{passage}\nfoot", "head\nother", "alone", None, ""]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    rows = line_dedup.dedup_lines(docs, least_lines=least).collect()
    assert {r.doc_id: r.l_depth for r in rows} == {0: 0, 1: 16, 2: 1, 3: 0, 4: 0, 5: 0}
    assert sorted([(r.doc_id, r.l_text, r.l_removed) for r in rows], key=str) == plain_lines([(i, t) for i, t in enumerate(texts)], least)
