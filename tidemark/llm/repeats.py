"""Long repeats across a corpus: every window of W units (bytes or words) that occurs elsewhere, exactly.

Texts are dealt once into buckets of compressed blobs, stored where all executors can read them. Windows
are not exchanged one by one: an anchor, chosen by content alone, stands for the run of windows that choose
it, so equal windows have equal anchors at equal places. Then, with keys dealt over parts by Spark,

1. anchor names are counted; anchors seen once are done,
2. shared anchors compare their whole run of windows at once, and learn whether their name has other runs,
3. only windows of runs that differ from others with the same anchor are compared singly.

Keys travel as sorted blobs per (bucket, part); answers come back as a bit per key, since a bucket can work
out the same keys again. A key is sent once per bucket, however often it occurs there.
"""

from __future__ import annotations

import gc
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut_lineage, mix64, named, ragged_ranges
from tidemark.llm.texts import BYTE_CODES, IS_SPACE, SpanHash, joined, words

# Raw text per bucket and per part of the exchange, texts per pack (a stretch worked on at once), and least numbers.
BUCKET_BYTES, PART_BYTES, PACK_BYTES, LEAST_BUCKETS, LEAST_PARTS = 2 << 20, 16 << 20, 1 << 18, 16, 32
PLACE = np.uint64((1 << 24) - 1)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
LAST = np.int64(2**63 - 1)
ANCHORS, RUNS, MIXED, WINDOWS = 1, 2, 3, 4

Namer = Callable[["Pack"], tuple[np.ndarray, int, int]]


@dataclass
class Pack:
    """Segments of documents laid end to end: two codes per unit, and where each segment comes from."""

    codes: tuple[np.ndarray, np.ndarray] | None
    offsets: np.ndarray  # n + 1 unit offsets of the segments
    doc: np.ndarray  # document of each segment, by its place in the bucket
    base: np.ndarray  # first unit of each segment in its document

    def __post_init__(self) -> None:
        self.first, self.second = SpanHash(self.codes[0]), SpanHash(self.codes[1])


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the stretches of equal values."""
    if len(values):
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        yield from zip(starts.tolist(), np.append(starts[1:], len(values)).tolist(), strict=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def segments(sizes: np.ndarray, window: int, at_most: int) -> list[list[tuple[int, int, int]]]:
    """Packs of ``(document, start, end)``; parts of a long document overlap by ``window - 1`` units."""
    packs, current, filled = [], [], 0
    for doc, size in enumerate(sizes.tolist()):
        for start in range(0, max(size - window + 1, 0), at_most):
            end = min(size, start + at_most + window - 1)
            if current and filled + end - start > at_most + window:
                packs.append(current)
                current, filled = [], 0
            current.append((doc, start, end))
            filled += end - start
    return packs + [current] if current else packs


def byte_packs(column: pa.Array, window: int) -> tuple[np.ndarray, Iterator[Pack]]:
    data, at = joined(column)
    sizes = np.diff(at)

    def make() -> Iterator[Pack]:
        for pack in segments(sizes, window, PACK_BYTES):
            doc, start, end = (np.array(x, np.int64) for x in zip(*pack, strict=True))
            own = np.concatenate([data[at[d] + a : at[d] + b] for d, a, b in pack])
            yield Pack((BYTE_CODES[0][own], BYTE_CODES[1][own]), np.concatenate([[0], np.cumsum(end - start)]), doc, start)

    return sizes, make()


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two codes per word, and the ``n + 1`` word offsets of the texts; works through the bytes in stretches."""
    cuts = [0]
    while cuts[-1] < len(data):
        low = cuts[-1] + PACK_BYTES
        blank = np.flatnonzero(IS_SPACE[data[low : low + 4096]]) if low < len(data) else []
        while low < len(data) and not len(blank):
            low += 4096
            blank = np.flatnonzero(IS_SPACE[data[low : low + 4096]])
        cuts.append(min(len(data), low + int(blank[0])) if len(blank) else len(data))
    parts, counts = [], np.zeros(len(offsets), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = data[a:b]
        inner = np.clip(offsets, a, b) - a
        starts, ends, of = words(own, inner)
        counts += of
        parts.append([SpanHash(table[own])(starts, ends) for table in BYTE_CODES])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), counts


def word_packs(column: pa.Array, window: int) -> tuple[np.ndarray, Iterator[Pack]]:
    one, two, at = word_codes(*joined(column))
    sizes = np.diff(at)

    def make() -> Iterator[Pack]:
        for pack in segments(sizes, window, PACK_BYTES // 4):
            doc, start, end = (np.array(x, np.int64) for x in zip(*pack, strict=True))
            own = ragged_ranges(at[doc] + start, end - start)
            yield Pack((one[own], two[own]), np.concatenate([[0], np.cumsum(end - start)]), doc, start)

    return sizes, make()


@dataclass
class Records:
    """One row per anchor of a pack: the window starts ``low..high`` that choose it, its name, the hash of the whole run."""

    pack: Pack
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    name: np.ndarray
    run: np.ndarray
    run2: np.ndarray


def anchor_runs(pack: Pack, window: int, namer: Namer) -> Records:
    """Anchors of all windows: of the named places inside a window, the one with the least name, the first of equals.

    ``namer`` gives a name per unit (NOTHING where there is none) and how far inside a window a place must
    lie. A window without any named place is its own anchor under the name of its content.
    """
    names, left, right = namer(pack)
    n = int(pack.offsets[-1])
    starts = n - window + 1
    places = np.arange(len(names), dtype=np.uint64)
    least = np.where(names == NOTHING, NOTHING, (names & ~PLACE) | places)
    width, have = window - left - right + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[left : left + starts]
    segment = np.repeat(np.arange(len(pack.doc)), np.diff(pack.offsets))
    at = np.arange(starts)
    fits = segment[:starts] == segment[window - 1 :]
    at, least, segment = at[fits], least[fits], segment[:starts][fits]
    alone = least == NOTHING
    anchor = np.where(alone, -1 - at, (least & PLACE).astype(np.int64))
    first = np.append(True, (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1]))[: len(at)]
    low = at[first]
    high = at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)] if len(at) else low
    anchor = anchor[first]
    run = pack.first(low, high + window)
    # The place of the anchor in its run is part of the run's identity.
    run = mix64(run ^ np.where(anchor < 0, 0, anchor - low).astype(np.uint64))
    name = np.where(anchor < 0, run, names[np.maximum(anchor, 0)])
    second = pack.second(low, high + window) & np.uint64(0xFFFFFFFF)
    pack.codes = None  # the sums are all that is needed from here on
    return Records(pack, low, high, pack.doc[segment[first]], name, run, second)


def byte_names(q: int) -> Namer:
    def name(pack: Pack) -> tuple[np.ndarray, int, int]:
        h, n = pack.first, len(pack.codes[0])
        return mix64((h.sums[q:] - h.sums[:-q]) * h.down[: n - q + 1]), 0, q

    return name


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: an equal range of the 64-bit numbers per part, so sorted keys have sorted parts."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def short_keys(keys: np.ndarray, parts: int) -> np.ndarray:
    """32 bits that tell keys of a part apart: as good as the part's share of the key range allows."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ (keys & np.uint64(0xFFFF)).astype(np.uint32)


def pack_bytes(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array).tobytes(), codec="zstd", asbytes=True)


def unpack(blobs: pd.Series, sizes: pd.Series, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(pa.decompress(b, n * width, codec="zstd", asbytes=True), kind) for b, n in zip(blobs, sizes, strict=True)])


@dataclass
class Keys:
    """Distinct keys of a bucket in sorted order, and the key of each row."""

    first: np.ndarray  # row that stands for the key: the one of the smallest order
    of_row: np.ndarray
    count: np.ndarray


def distinct(order: np.ndarray, *keys: np.ndarray) -> Keys:
    """Distinct tuples of ``keys`` (most significant first)."""
    sort = np.lexsort((order, *keys[::-1]))
    new = np.ones(len(sort), bool)
    if len(sort):
        new[1:] = np.logical_or.reduce([k[sort][1:] != k[sort][:-1] for k in keys])
    group = np.cumsum(new) - 1
    of_row = np.empty(len(sort), np.int64)
    of_row[sort] = group
    return Keys(sort[new], of_row, np.bincount(group, minlength=int(new.sum())))


class Finder:
    """The steps of the search inside one bucket; every method works out the same keys again."""

    def __init__(self, make_packs: Callable, namer: Namer, window: int, earlier: bool, parts: int) -> None:
        self.make_packs, self.namer, self.window, self.earlier, self.parts = make_packs, namer, window, earlier, parts

    def load(self, blobs: pd.Series) -> None:
        tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
        self.table = pa.concat_tables(sorted(tables, key=lambda t: t.column("place")[0].as_py()))
        column = self.table.column("text").combine_chunks()
        self.column = column
        rank = self.table.column("rank").to_numpy()
        self.sizes, packs = self.make_packs(column, self.window)
        self.records = [anchor_runs(p, self.window, self.namer) for p in packs]
        joined_ = {f: np.concatenate([getattr(r, f) for r in self.records]) if self.records else np.zeros(0, np.int64) for f in ("doc", "name", "run", "run2")}
        self.name, self.run, self.run2 = (joined_[f].astype(np.uint64) for f in ("name", "run", "run2"))
        # What comes first: by document for copies of earlier ones, else any fixed order.
        self.order = rank[joined_["doc"]] if len(joined_["doc"]) else np.zeros(0, np.int64)
        self.names = distinct(self.order, self.name)

    def _send(self, kind: int, bucket: int, part_key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
        """Rows for the exchange; keys are sorted by part already."""
        part = parts_of(part_key, self.parts)
        for a, b in stretches(part):
            blobs = [pack_bytes(c[a:b]) for c in columns]
            yield (kind, int(part[a]), bucket, int(b - a), *blobs, *[None] * (3 - len(blobs)))

    def _info(self, keys: Keys, rows: np.ndarray | None = None) -> np.ndarray:
        """Per key what the other buckets must know: the first document that has it, or how often it occurs."""
        return self.order[keys.first if rows is None else rows[keys.first]] if self.earlier else keys.count.astype(np.int64)

    def send_names(self, bucket: int) -> Iterator[tuple]:
        name = self.name[self.names.first]
        yield from self._send(ANCHORS, bucket, name, short_keys(name, self.parts))

    def take_names(self, bits: dict[int, np.ndarray]) -> None:
        """Which anchors take part: those whose name another bucket has, or another place of this one."""
        elsewhere = bits[ANCHORS] if ANCHORS in bits else np.zeros(len(self.names.first), bool)
        self.active = np.flatnonzero((elsewhere | (self.names.count > 1))[self.names.of_row])
        rows = self.active
        self.runs = distinct(self.order[rows], self.run[rows], self.run2[rows])
        self.shared = distinct(self.order[rows], self.name[rows])

    def send_runs(self, bucket: int) -> Iterator[tuple]:
        rows, keys = self.active, self.runs
        run = self.run[rows][keys.first]
        yield from self._send(RUNS, bucket, run, run, self.run2[rows][keys.first].astype(np.uint32), self._info(keys, rows))
        name, run = self.name[rows], self.run[rows]
        low, high = np.full(len(self.shared.first), NOTHING), np.zeros(len(self.shared.first), np.uint64)
        np.minimum.at(low, self.shared.of_row, run)
        np.maximum.at(high, self.shared.of_row, run)
        yield from self._send(MIXED, bucket, name[self.shared.first], short_keys(name[self.shared.first], self.parts), low, low ^ high)

    def take_runs(self, bits: dict[int, np.ndarray]) -> None:
        """Which runs are repeats as a whole, and which windows must be compared singly."""
        rows = self.active
        repeated, speaks = self._answer(bits, RUNS, self.runs, self.order[rows])
        mixed = bits[MIXED] if MIXED in bits else np.zeros(len(self.shared.first), bool)
        self.repeated = np.zeros(len(self.name), bool)
        self.repeated[rows] = repeated
        single = np.zeros(len(self.name), bool)
        single[rows] = mixed[self.shared.of_row] & (~repeated | speaks)
        hashes, places, of_doc, of_pack, known, first = [], [], [], [], [], 0
        for i, r in enumerate(self.records):
            own = slice(first, first + len(r.low))
            first += len(r.low)
            chosen = np.flatnonzero(single[own])
            sizes = r.high[chosen] - r.low[chosen] + 1
            at = ragged_ranges(r.low[chosen], sizes)
            hashes.append((r.pack.first(at, at + self.window), r.pack.second(at, at + self.window) & np.uint64(0xFFFFFFFF)))
            places.append(at)
            of_doc.append(np.repeat(self.order[own][chosen], sizes))
            known.append(np.repeat(self.repeated[own][chosen], sizes))
            of_pack.append(np.full(len(at), i))
        empty = np.zeros(0, np.uint64)
        self.w1, self.w2 = (np.concatenate([h[k] for h in hashes] or [empty]).astype(np.uint64) for k in (0, 1))
        self.w_at, self.w_pack, self.w_order, self.w_known = (np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64) for x in (places, of_pack, of_doc, known))
        self.windows = distinct(self.w_order, self.w1, self.w2)

    def _answer(self, bits: dict[int, np.ndarray], kind: int, keys: Keys, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: whether it repeats something, and whether it speaks for its key (its windows are shown to others)."""
        elsewhere = bits[kind] if kind in bits else np.zeros(len(keys.first), bool)
        if self.earlier:
            repeated = elsewhere[keys.of_row] | (order > order[keys.first][keys.of_row])
            return repeated, np.zeros(len(order), bool)
        speaks = np.zeros(len(order), bool)
        if -kind in bits:
            speaks[keys.first] = bits[-kind]
        return (elsewhere | (keys.count > 1))[keys.of_row], speaks

    def send_windows(self, bucket: int) -> Iterator[tuple]:
        keys = self.windows
        info = self.w_order[keys.first]
        if not self.earlier:
            # A window that speaks for a repeated run occurs at least twice already.
            info = np.bincount(keys.of_row, weights=1 + self.w_known, minlength=len(keys.first)).astype(np.int64)
        w1 = self.w1[keys.first]
        yield from self._send(WINDOWS, bucket, w1, w1, self.w2[keys.first].astype(np.uint32), info)

    def covered(self, bits: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Documents with a repeat, and which of their units are covered."""
        found, _ = self._answer(bits, WINDOWS, self.windows, self.w_order)
        marks: dict[int, np.ndarray] = {}
        first = 0
        for i, r in enumerate(self.records):
            whole = self.repeated[first : first + len(r.low)]
            first += len(r.low)
            lone = self.w_at[(self.w_pack == i) & found]
            edge = np.zeros(int(r.pack.offsets[-1]) + 1, np.int64)
            np.add.at(edge, np.concatenate([r.low[whole], lone]), 1)
            np.add.at(edge, np.concatenate([r.high[whole], lone]) + self.window, -1)
            cover = np.cumsum(edge[:-1]) > 0
            some = np.add.reduceat(cover, r.pack.offsets[:-1]) > 0 if len(cover) else np.zeros(0, bool)
            for s in np.flatnonzero(some):
                doc, base = int(r.pack.doc[s]), int(r.pack.base[s])
                part = cover[r.pack.offsets[s] : r.pack.offsets[s + 1]]
                marks.setdefault(doc, np.zeros(int(self.sizes[doc]), bool))[base : base + len(part)] |= part
        yield from marks.items()


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.sort(keys)
    shared = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(shared):
        return np.zeros(len(keys), bool)
    del order
    return shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys


SENT = "kind int, part int, bucket bigint, n int, a binary, b binary, c binary"
ANSWER = "bucket bigint, kind int, part int, n int, bits binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def answer(earlier: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Compare the keys of one part: one row of answers per bucket and kind of key."""

    def split(kind: int, frame: pd.DataFrame, flags: np.ndarray) -> list[tuple]:
        ends = np.cumsum(frame["n"])
        return [(b, kind, p, n, _bits(flags[e - n : e])) for b, p, n, e in zip(frame["bucket"], frame["part"], frame["n"], ends, strict=True)]

    def one(every: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, frame in every.groupby("kind"):
            frame = frame.sort_values("bucket")
            if kind == ANCHORS:
                out += split(kind, frame, twice(unpack(frame["a"], frame["n"], np.uint32)))
            elif kind == MIXED:
                key, low, gap = unpack(frame["a"], frame["n"], np.uint32), unpack(frame["b"], frame["n"], np.uint64), unpack(frame["c"], frame["n"], np.uint64)
                keys = distinct(np.zeros(len(key), np.int8), key)
                least, most = np.full(len(keys.first), NOTHING), np.zeros(len(keys.first), np.uint64)
                np.minimum.at(least, keys.of_row, low)
                np.maximum.at(most, keys.of_row, low ^ gap)
                out += split(kind, frame, (least != most)[keys.of_row])
            else:
                k1, k2, info = unpack(frame["a"], frame["n"], np.uint64), unpack(frame["b"], frame["n"], np.uint32), unpack(frame["c"], frame["n"], np.int64)
                if earlier:
                    keys = distinct(info, k1, k2)
                    out += split(kind, frame, info > info[keys.first][keys.of_row])
                else:
                    keys = distinct(np.arange(len(k1)), k1, k2)
                    total = np.zeros(len(keys.first), np.int64)
                    np.add.at(total, keys.of_row, info)
                    out += split(kind, frame, (total > 1)[keys.of_row])
                    speaker = np.zeros(len(k1), bool)
                    speaker[keys.first] = True
                    out += split(-kind, frame, speaker)
        return pd.DataFrame(out, columns=["bucket", "kind", "part", "n", "bits"])

    return one


def stored_by(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """The rows stored by ``key``; later groupings by it find them in place.

    A stored table keeps its partitioning only if it was planned as a whole, so adaptive planning, which has
    nothing to decide here, is off for this one step.
    """
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(rows.repartition(partitions, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def deal(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``bucket, blob``: all texts as compressed blobs, dealt by bucket and stored; later joins by bucket need not move them."""
    id_ = named(id_col)
    rows = docs.select(
        F.pmod(F.xxhash64(id_, F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"), F.monotonically_increasing_id().alias("place"),
        id_.alias("id"), F.coalesce(id_.cast("long"), F.lit(int(LAST))).alias("rank"), named(text_col).alias("text"),
    )

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("bucket").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            bucket = batch.column("bucket").to_numpy()
            names, out = [], []
            for a, b in stretches(bucket):
                sink = io.BytesIO()
                part = batch.slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(part)
                names.append(int(bucket[a]))
                out.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    return stored_by(rows.mapInArrow(blobs, "bucket bigint, blob binary"), "bucket", max(1, buckets // 8))


def find_repeats(
    docs: DataFrame, *, id_col: str, text_col: str, window: int, make_packs: Callable, namer: Namer, earlier: bool,
    result: Callable[[Finder, dict[int, np.ndarray]], pa.Table], schema: str,
) -> DataFrame:
    """Run the three exchanges and hand each bucket's covered units to ``result``, whose rows are returned."""
    spark = docs.sparkSession
    raw = docs.agg(F.coalesce(F.sum(F.octet_length(named(text_col))), F.lit(0))).first()[0]
    buckets, parts = max(LEAST_BUCKETS, raw // BUCKET_BYTES), max(LEAST_PARTS, raw // PART_BYTES)
    dealt = deal(docs, id_col, text_col, buckets)
    release(spark)

    def finder(blobs: pd.Series, answers: pd.DataFrame) -> tuple[Finder, dict[int, np.ndarray]]:
        f = Finder(make_packs, namer, window, earlier, parts)
        f.load(blobs)
        bits = {}
        for kind, frame in answers.groupby("kind"):
            frame = frame.sort_values("part")
            bits[int(kind)] = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(frame["bits"], frame["n"], strict=True)]).astype(bool)
        return f, bits

    def step(number: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = [x.split()[0] for x in SENT.split(", ")]
            if not len(left):
                return pd.DataFrame([], columns=columns)
            f, bits = finder(left["blob"], right)
            bucket = int(left["bucket"].iloc[0])
            if number == 1:
                rows = f.send_names(bucket)
            else:
                f.take_names(bits)
                if number == 2:
                    rows = f.send_runs(bucket)
                else:
                    f.take_runs(bits)
                    rows = f.send_windows(bucket)
            return pd.DataFrame(list(rows), columns=columns)

        return one

    def last(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f, bits = finder(left["blob"], right)
        f.take_names(bits)
        f.take_runs(bits)
        return result(f, dict(f.covered(bits)))

    answers = spark.createDataFrame([], ANSWER)
    for number in (1, 2, 3):
        sent = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(step(number), SENT)
        new = cut_lineage(sent.groupBy("part").applyInPandas(answer(earlier), ANSWER))
        release(spark)
        answers = new if number == 1 else answers.union(new)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(last, schema)


def spans_of(mark: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of covered units."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
