"""Packing: ids, pieces, gapless sequences, and the number of sequences against the bound."""

import zlib

import numpy as np
import public_tokenizers
from test_corpus_tables import odd_docs
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tidemark.llm import packing
from tidemark.llm.queries import packed


def whole(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(seqs)


def expected(texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for key, text in texts:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        for n, (start, size) in enumerate(packing.cut(len(ids), 2048)):
            out.append((key, n, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
    return sorted(out, key=str)


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = entry.queries()["op1_best_fit_packing"](spark, folder).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == expected([(r.doc_id, r.text) for r in docs])
    bound = packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert whole(rows) <= bound + 1


def test_odd(spark):
    docs = odd_docs(spark)
    more = spark.createDataFrame([(50, "a  b \n c<|endoftext|> d   e ", None, None, None, None, None), (51, " lead", None, None, None, None, None), (52, " ", None, None, None, None, None)], docs.schema)
    docs = docs.union(more)
    rows = packed(docs).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])
    whole(rows)
    assert packed(docs.limit(0)).count() == 0


def test_many_partitions_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_TOKENS", 40_000)
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 2049, 2000), np.full(700, 700)])
    table = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "row_key bigint, length bigint")
    rows = table.join(packing.pack(table), "row_key").collect()
    assert len(rows) == len(sizes)
    bins = whole(rows)
    alone = packing.best_fit(sizes, 2048).max() + 1
    assert packing.lower_bound(sizes, 2048) <= alone <= bins <= 1.02 * alone


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 21, rng.integers(1, 40))
        assert packing.lower_bound(sizes, 20) <= packing.best_fit(sizes, 20).max() + 1
    assert packing.lower_bound(np.array([11] * 6), 20) == 6 and packing.lower_bound(np.array([7] * 9), 20) == 5


def test_ids_column(spark):
    files = {"tokenizer": public_tokenizers.path("byte_bpe_50k.json")}
    rows = packing.pack_documents(odd_docs(spark), capacity=64, with_ids=True, **files).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
