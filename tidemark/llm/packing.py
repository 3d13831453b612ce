"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are dealt over partitions of bounded size and packed there by best-fit decreasing. Dual feasible
functions give each partition a lower bound for its number of sequences: one that meets it is certified
and gives back only its half-empty sequences, one with a gap gives back every sequence with room. What is
given back is dealt anew over fewer partitions and packed again, until it fits one partition or no longer gains.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, named, row_batches
from tidemark.llm.texts import SLICE_BYTES

# A partition of the packing holds about so many tokens and so many pieces at most.
PART_TOKENS, PART_PIECES = 1 << 24, 200_000
# Sequences are exchanged again only while a round saves at least this share of them.
LEAST_GAIN = 0.001
# A longer text is encoded in parts; a blank between two characters that are no white space ends a token in every text.
PART_CHARS = 1 << 20
CLEAN_BLANK = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Token ids of whole texts, from the vocabulary's ranks where there are any.

    Texts that hold a special token's text, and the first ones of a worker as a check, go through the tokenizer file itself.
    """

    CHECKED, CHECKED_CHARS = 32, 4096

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.checked = 0

    def _part(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        ids = self.fast(text)
        if self.checked < self.CHECKED and len(text) <= self.CHECKED_CHARS:
            self.checked += 1
            if ids != self.full.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"the ranks do not belong to the tokenizer: {text!r}")
        return np.array(ids, "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; a null text has none."""
        if not text:
            return np.zeros(0, "<u4")
        parts, at = [], 0
        while len(text) - at > PART_CHARS:
            found = CLEAN_BLANK.search(text, at + PART_CHARS)
            if found is None:
                break
            parts.append(self._part(text[at : found.start()]))
            at = found.start()
        return np.concatenate([*parts, self._part(text[at:] if at else text)])


def encoder(tokenizer: str, ranks: str | None, pattern: str | None) -> Encoder:
    key = (tokenizer, ranks, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: all of full length but the first."""
    first = length if length <= capacity else length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(
    docs: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, row_key`` and ``ids`` if asked for.

    A document is its ids and ``end_id``. A null text counts as empty and gives the one piece with ``end_id`` alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, ranks, pattern)
        for batch in row_batches(batches, "text", 4 * SLICE_BYTES):
            rows, of = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(coder.encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                for n, (start, size) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + size]
                    of.append(i)
                    rows.append((n, start, size, zlib.crc32(part), part) if with_ids else (n, start, size, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [batch.column("id").take(pa.array(of, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    out = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(encode, schema)
    return out.withColumn("row_key", F.monotonically_increasing_id()).withColumnRenamed("id", id_col)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that the lengths need at least, by two families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]
    inner = np.concatenate([[0], np.cumsum(count * size)])
    for small in np.flatnonzero(count[: capacity // 2 + 1]):
        # Lengths below `small` count nothing, those that leave less than it count a whole sequence.
        large = int(above[capacity - small + 1]) if small else 0
        best = max(best, large + -(-int(inner[capacity - small + 1] - inner[small]) // capacity))
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * size, capacity)
        value = np.where(rest == 0, size * k, whole * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, by best-fit decreasing."""
    bins = np.zeros(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # a bit per room that some bin has
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            number = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, number = capacity, made
            made += 1
        bins[i] = number
        room -= size
        if room:
            if not open_[room]:
                rooms |= 1 << room
            open_[room].append(number)
    return bins


def pack(lengths: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``row_key, sequence_id, offset`` for a table ``row_key, length`` (``1 <= length <= capacity``).

    Offsets are gapless from 0 in each sequence. An empty table gives an empty one.
    """

    def repack(last: bool):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            size = frame["length"].to_numpy(np.int64)
            number = best_fit(size, capacity)
            order = np.argsort(number, kind="stable")
            frame, number, size = frame.iloc[order], number[order], size[order]
            filled = np.bincount(number, weights=size).astype(np.int64)
            first = np.concatenate([[True], number[1:] != number[:-1]])
            ends = np.cumsum(size)
            before = ends - size
            offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(size))))
            certified = len(filled) == lower_bound(size, capacity)
            room = (capacity - filled)[number]
            back = (room > capacity // 2) if certified else (room > 0)
            return pd.DataFrame({
                "row_key": frame["row_key"], "length": size, "back": back & (not last), "first": first,
                "sequence_id": (frame["part"].to_numpy(np.int64) << 22) | number, "offset": offset,
            })

        return one

    schema = "row_key bigint, length bigint, back boolean, first boolean, sequence_id bigint, offset bigint"
    left, done, before, base, rounds = lengths.select("row_key", "length"), [], None, 0, 0
    tokens, rows = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    while rows:
        parts = max(1, -(-tokens // PART_TOKENS), -(-rows // PART_PIECES))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("row_key", F.lit(rounds)), F.lit(parts)) + base)
        packed = cut_lineage(dealt.groupBy("part").applyInPandas(repack(parts == 1), schema))
        back = F.col("back")
        tokens, rows, again, made = packed.agg(
            F.coalesce(F.sum(F.when(back, F.col("length"))), F.lit(0)), F.count_if(back), F.count_if(back & F.col("first")), F.count_if("first")
        ).first()
        base, rounds = base + parts, rounds + 1
        if before is not None and made >= before[0]:
            # Another deal made nothing better: what was there before stays.
            done.append(before[1])
            break
        if before is not None and made > (1 - LEAST_GAIN) * before[0]:
            done.append(packed)
            break
        done.append(packed.filter(~back) if rows else packed)
        before = (again, packed.filter(back))
        left = packed.filter(back).select("row_key", "length")
    if not done:
        return lengths.select("row_key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("row_key", "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", capacity: int = 2048, **tokens) -> DataFrame:
    """The pieces of all documents with ``sequence_id, offset``; arguments as for :func:`pieces`.

    Null and repeated ids are as good as others: rows are told apart by a key of their own.
    """
    cut_ = cut_lineage(pieces(docs, id_col=id_col, capacity=capacity, **tokens))
    return cut_.join(pack(cut_, capacity=capacity), "row_key").drop("row_key")
