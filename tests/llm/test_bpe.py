"""Encoding by the transducer against the tiktoken library, decoding against Python's own decoder."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_corpus_tables import odd_docs

import __spark_entry__ as entry
from tidemark.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_query(spark, folder, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = entry.queries()["op11_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd(spark, plain):
    docs = odd_docs(spark)
    more = [(7, t) for t in ("a  b \n\n c\t\t", "don't WON'T 'll ²½ ٣٤ ไทย 漢字 👩‍👩‍👧  x", "<|endoftext|> x", "ab" * 200_000, " " * 3000 + "x", "é́" * 500)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).withColumnRenamed("size", "n_tokens")
    rows = bpe.decode(bpe.encode(docs, ranks=RANKS, pattern=public_tokenizers.PATTERN), ranks=RANKS).collect()
    want = [(r.doc_id, len(ids := plain.encode_ordinary(r.text or "")), digest(ids), r.text or "") for r in docs.collect()]
    assert sorted([(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in rows], key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), ranks=RANKS, pattern=public_tokenizers.PATTERN), ranks=RANKS).count() == 0


def test_decode_odd(spark):
    rows = [(1, None, "x"), (2, b"", "x"), (3, np.array([2**32 - 1, 60_000], "<u4").tobytes(), "x")]
    got = bpe.decode(spark.createDataFrame(rows, "`a.b` int, ids binary, decoded string"), ranks=RANKS).collect()
    assert [(r["a.b"], r.decoded) for r in got] == [(1, None), (2, ""), (3, "��")]


def test_pieces_of_any_bytes(plain):
    rng, ranks = random.Random(5), bpe.load_ranks(RANKS)
    tokens = list(ranks)
    small, full = bpe.Transducer(ranks, kept=500), bpe.Transducer(ranks)
    for _ in range(6000):
        kind = rng.random()
        if kind < 0.3:
            piece = bytes(rng.choice(b"ab cde'1.") for _ in range(rng.randint(1, 30)))
        elif kind < 0.6:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        else:
            piece = bytes(rng.randint(0, 255) for _ in range(rng.randint(1, 12)))
        want = plain._core_bpe.encode_single_piece(piece)
        assert full(piece) == want and small(piece) == want


def test_a_vocabulary_with_unreachable_tokens():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"xyz": 260, b"abcd": 261, b"bcd": 262, b"aa": 263, b"aaa": 264}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    ours, rng = bpe.Transducer(ranks), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abcdxyza") for _ in range(rng.randint(1, 14)))
        assert ours(text.encode()) == library.encode_ordinary(text), text


def test_every_character_beside_a_letter_a_number_and_a_sign(plain):
    """Pieces end where the library's end, for every character there is."""
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 1 << 15):
        text = "".join(f"a{c}b1{c}2 {c}.{c}" for c in points[low : low + (1 << 15)])
        assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text), hex(low)


def test_streams(spark):
    table, rng = bpe.TokenBytes(RANKS), random.Random(2)
    for _ in range(1500):
        ids = np.array([rng.randint(0, 50_300) if rng.random() < 0.5 else rng.randint(0, 300) for _ in range(rng.randint(0, 40))], np.uint32)
        raw = b"".join(table.bytes_of(table.known(np.array([i]))).tobytes() for i in ids)
        stream, at, out = bpe.Decoder(table), 0, ""
        while at < len(ids):
            step = rng.randint(1, 6)
            out += stream.feed(ids[at : at + step])
            at += step
        assert out + stream.close() == raw.decode("utf-8", "replace")


def test_neighbours_are_judged_without_merging_them(monkeypatch, plain):
    """Encoding runs merges on single tokens alone, once each, never on what two of them hold together."""
    coder, merged = bpe.Coder(RANKS, public_tokenizers.PATTERN), []
    own = bpe.Merges.__call__
    monkeypatch.setattr(bpe.Merges, "__call__", lambda self, data, *rest: merged.append(data) or own(self, data, *rest))
    rng = random.Random(5)
    words = ["".join(rng.choice(["the", "an", "stß", "ing", "ö", "qu", "x", "9", "中"]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    ids, _ = coder.encode([" ".join(words)])
    assert ids.tolist() == plain.encode_ordinary(" ".join(words))
    assert set(merged) <= set(coder.transducer.ranks) and len(merged) == len(set(merged))


@pytest.mark.parametrize("shuffled", [False, True])
def test_neighbours_fit_as_merging_says(shuffled):
    """Also where equal merges stand side by side, and where tokens are numbered otherwise than their merges come."""
    rng = random.Random(7)
    tokens = list(dict.fromkeys([bytes([b]) for b in range(256)] + [bytes(rng.choices(b"ab", k=k)) for k in (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 6, 7, 8) for _ in range(4)]))
    if shuffled:
        rng.shuffle(tokens)
    machine = bpe.Transducer({token: number for number, token in enumerate(tokens)})
    able = [n for n in range(len(tokens)) if machine._fits(-1, n) and set(tokens[n]) <= set(b"ab")]
    for before in able:
        for token in able:
            assert machine._fits(before, token) == (machine.merges(tokens[before] + tokens[token]) == [before, token])
