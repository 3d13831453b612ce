"""Byte and word dedup against plain versions."""

import hashlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from test_corpus_tables import DOCS, odd_docs

from tidemark.llm import repeats, substring_dedup, suffix_dedup

BIG = 2**63 - 1


def plain_bytes(rows, length=50):
    first = {}
    for id_, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, BIG), BIG if id_ is None else id_)
    out = []
    for id_, text in rows:
        raw = (text or "").encode()
        own = BIG if id_ is None else id_
        mark = brute.covered([(i, i + length) for i in range(len(raw) - length + 1) if first[raw[i : i + length]] < own], len(raw))
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        runs = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((id_, len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_words(rows, length=35):
    often = defaultdict(int)
    texts = [(id_, brute.words(text)) for id_, text in rows]
    for _, w in texts:
        for i in range(len(w) - length + 1):
            often[tuple(w[i : i + length])] += 1
    out = []
    for id_, w in texts:
        mark = brute.covered([(i, i + length) for i in range(len(w) - length + 1) if often[tuple(w[i : i + length])] > 1], len(w))
        kept = " ".join(x for x, m in zip(w, mark) if not m)
        out.append((id_, len(w), sum(mark), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got_bytes(docs):
    return sorted([(r.id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_bytes(docs).collect()], key=str)


def got_words(docs):
    rows = substring_dedup.dedup_passages(docs).collect()
    return sorted([(r.id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows], key=str)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_words(docs) == plain_words(rows)
    assert got_bytes(docs) == plain_bytes(rows)


def shuffled(seed):
    """Passages of all lengths around the match length, inside, at the ends, overlapping, and twice in one text."""
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "b", "ab", "ba", "é", "the", "of", "x" * 9]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (20, 33, 34, 35, 36, 37, 50, 80)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(0, 6)):
            parts.append(str(rng.choice(passages)) if rng.random() < 0.5 else " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(rng.integers(0, 30))))
        rows.append((int(rng.integers(0, 40)) if i % 9 else None, " ".join(parts), None, None, None, None, None))
    rows += [(100, "a " * 3000, None, None, None, None, None), (101, "b a " * 2000, None, None, None, None, None), (102, "a" * 5000, None, None, None, None, None), (90, "a" * 70, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "PACK_BYTES", 4096)
    docs = spark.createDataFrame(shuffled(seed), DOCS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_words(docs) == plain_words(rows)
    assert got_bytes(docs) == plain_bytes(rows)


def test_odd(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_words(docs) == plain_words(rows)
    assert got_bytes(docs) == plain_bytes(rows)
    assert suffix_dedup.dedup_bytes(docs.limit(0)).count() == 0 and substring_dedup.dedup_passages(docs.limit(0)).count() == 0


def test_borders_depend_on_few_words():
    rng = np.random.default_rng(4)
    reach = substring_dedup.REACH
    codes = rng.integers(0, 4, 4000).astype(np.uint64)
    whole = substring_dedup.symbol_borders(codes, np.array([0, len(codes)]))
    for _ in range(200):
        a = int(rng.integers(0, 3900))
        b = a + int(rng.integers(2 * reach, 100))
        part = substring_dedup.symbol_borders(codes[a:b], np.array([0, b - a]))
        assert (part[reach : b - a - reach + 1] == whole[a + reach : b - reach + 1][: len(part[reach : b - a - reach + 1])]).all()
    assert 0.4 < whole.mean() < 0.8
