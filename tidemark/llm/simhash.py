"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree in at least some of the blocks their bits are cut into, so those
that share a choice of blocks meet in a bucket and no near pair is missed. In a bucket bit planes are stored
vertically, 64 fingerprints to a word: one pass over the planes counts the differing bits of a
fingerprint to 64 others at once in carry-save counters, and words in which all 64 exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import pack_bytes, parts_of, short_keys, stretches, unpack
from tidemark.llm.shared import components, cut_lineage, local_roots, mix64, named, ragged_ranges, row_batches
from tidemark.llm.texts import SLICE_BYTES

# A bucket of more fingerprints is dealt over tiles, and every two of its tiles meet.
TILE = 1 << 13
# Rows of a comparison task; fingerprints expected per bucket by chance; comparisons of a fingerprint with a word at a time.
PART_ROWS, BUCKET_ROWS, AT_ONCE, BLOCKS_AT_ONCE = 50_000, 1 << 14, 1 << 15, 1024
# Candidates that a row names first, and how many times more in each later round, cells in which shingles are counted (512 KB), rows of numbers that may be broadcast.
FIRST_CANDIDATES, MORE_CANDIDATES, CELL_BITS, BROADCAST_ROWS = 1, 16, 16, 1_000_000
# Keys of a part of the exchange that finds sets with a rare shingle in common.
PART_KEYS = 500_000
# Sets that meet in a task to find the first links.
TILE_SETS = 512
# Bits of the sketch that goes with a set into the tasks that name candidates (512 bytes at most), pairs compared there at a time.
BRIEF_BITS, SKETCHES_AT_ONCE = 1 << 12, 1 << 13
# 8 counters of 8 bits, one per bit of a byte: up to 255 hashes are added before the counters must be emptied.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
LANE_LIMIT = 255


def shingle_digests(text: str | None, shingle: int, seed: int) -> list[bytes]:
    """The XXH64 hashes of a text's word shingles, lower-cased in A-Z, one per place; a shorter text is one shingle."""
    hash_ = xxhash.xxh64_digest
    found = text.encode().lower().split() if text else []
    if len(found) <= shingle:
        return [hash_(b" ".join(found), seed)] if found else []
    line = b" ".join(found)
    starts = np.cumsum([0] + [len(w) + 1 for w in found])
    return [hash_(line[a:b], seed) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist(), strict=True)]


def shingle_set(digests: list[bytes]) -> np.ndarray:
    """The distinct shingles of a text in ascending order."""
    return np.unique(np.frombuffer(b"".join(digests), np.int64))


def fingerprints(texts: list[str | None], shingle: int, seed: int) -> np.ndarray:
    """The majority bits of the XXH64 hashes of each text's word shingles, lower-cased in A-Z."""
    return majority([shingle_digests(text, shingle, seed) for text in texts])


def majority(digests: list[list[bytes]]) -> np.ndarray:
    """The majority bits of each list of hashes; zero for an empty one."""
    counts = np.array([len(d) for d in digests], np.int64)
    out = np.zeros(len(digests), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        lanes = LANES[np.frombuffer(b"".join(chain.from_iterable(digests)), np.uint8).reshape(-1, 8)]
        first = (np.cumsum(counts) - counts)[some]
        groups = -(-counts[some] // LANE_LIMIT)
        at = ragged_ranges(np.zeros(len(some), np.int64), groups) * LANE_LIMIT + np.repeat(first, groups)
        bits = np.add.reduceat(lanes, at, axis=0).view(np.uint8).astype(np.int64)
        ones = np.add.reduceat(bits, np.cumsum(groups) - groups, axis=0)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``id, text_hash, fp``: the fingerprint as a signed long; zero for a text without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", SLICE_BYTES):
            found = fingerprints(batch.column("text").to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["id", "text_hash", "fp"]
            )

    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("text_hash"))
    return slim.mapInArrow(compute, f"id {kind}, text_hash bigint, fp bigint")


def tables_for(rows: int, radius: int, bits: int = 64) -> list[list[tuple[int, int]]]:
    """Choices of bit ranges: two fingerprints within the radius agree on all ranges of at least one choice.

    More blocks make the agreeing part longer; the fewest are taken that leave at most BUCKET_ROWS random rows in a bucket.
    """
    for same in range(1, 6):
        edges = np.linspace(0, bits, radius + same + 1).astype(int)
        ranges = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if rows <= BUCKET_ROWS << (same * bits // (radius + same)):
            break
    return [list(choice) for choice in combinations(ranges, same)]


def _planes(fps: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes ``[bit, block]`` of 64 fingerprints per word, and the lanes in use per block."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    grid = np.zeros((64, blocks, 64), np.uint8)
    grid[:, block, lane] = bits.T
    used = np.zeros((blocks, 64), np.uint8)
    used[block, lane] = 1
    return np.packbits(grid, axis=2, bitorder="little").view("<u8")[:, :, 0], np.packbits(used, axis=1, bitorder="little").view("<u8")[:, 0]


def _within(planes, used, flips, row_at, row: np.ndarray, blk: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of each ``row`` and the 64 rows of the block beside it, in this order."""
    over = ~used[blk]
    counter = [np.zeros(len(row), np.uint64) for _ in range((radius + 1).bit_length())]
    for p in range(64):
        # Ones where the bit differs; adding them ripples through the counters of all 64 lanes.
        carry = planes[p][blk] ^ (np.uint64(0) - flips[p][row])
        for i, c in enumerate(counter):
            counter[i], carry = c ^ carry, c & carry
        full = ~over
        for i, c in enumerate(counter):
            full &= c if (radius + 1) >> i & 1 else ~c
        over |= full
        if p % 8 == 7:
            live = ~over != 0
            if not live.all():
                row, blk, over = row[live], blk[live], over[live]
                counter = [c[live] for c in counter]
    near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, k = np.nonzero(near)
    return row[i], row_at[blk[i], k]


def _laid_out(fps: np.ndarray, runs: np.ndarray) -> tuple:
    """Rows of runs in blocks of 64: planes, used lanes, flips, row at (block, lane), block of a row, blocks of its run from there on."""
    sizes = np.diff(runs)
    words = -(-sizes // 64)
    of_run = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - runs[of_run]
    first_word = np.cumsum(words) - words
    block, lane = first_word[of_run] + place // 64, place % 64
    row_at = np.full((int(words.sum()), 64), -1, np.int64)
    row_at[block, lane] = np.arange(len(fps))
    planes, used = _planes(fps, block, lane, len(row_at))
    flips = (fps[None, :] >> np.arange(63, -1, -1, dtype=np.uint64)[:, None]) & np.uint64(1)
    # A row meets the blocks of its run from its own block on.
    return planes, used, flips, row_at, block, first_word[of_run] + words[of_run] - block


def near_in_runs(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among rows of the same run; ``runs`` holds the ``n + 1`` run offsets."""
    planes, used, flips, row_at, block, ahead = _laid_out(fps, runs)
    found_a, found_b = [], []
    begin = np.cumsum(ahead) - ahead
    for low in range(0, int(ahead.sum()), AT_ONCE):
        at = np.arange(low, min(low + AT_ONCE, int(ahead.sum())))
        row = np.searchsorted(begin, at, "right") - 1
        blk = block[row] + at - begin[row]
        a, b = _within(planes, used, flips, row_at, row, blk, radius)
        later = b > a
        found_a.append(a[later])
        found_b.append(b[later])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


def next_near(fps: np.ndarray, label: np.ndarray, after: np.ndarray, runs: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the next ``most`` rows of its run within the radius that have another label and lie behind row ``after``.

    Index pairs, and the rows that have more of them. Rows whose ``after`` lies behind the run ask for none.
    """
    planes, used, flips, row_at, block, ahead = _laid_out(fps, runs)
    got, more = np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    end = np.repeat(runs[1:], np.diff(runs))
    open_ = np.flatnonzero(after < end)
    step = 0
    while len(open_ := open_[(ahead[open_] > step) & ~more[open_]]):
        for low in range(0, len(open_), AT_ONCE):
            row = open_[low : low + AT_ONCE]
            a, b = _within(planes, used, flips, row_at, row, block[row] + step, radius)
            take = (b > a) & (b > after[a]) & (label[a] != label[b])
            a, b = a[take], b[take]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) + got[a]
            more[a[rank >= most]] = True
            a, b = a[rank < most], b[rank < most]
            got += np.bincount(a, minlength=len(fps)) if len(a) else 0
            found_a.append(a)
            found_b.append(b)
        step += 1
    return np.concatenate(found_a), np.concatenate(found_b), more


def near_edges(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the near fingerprints of each bucket: each to the first of its local component."""
    order = np.lexsort((fps, bucket))
    fps, bucket = fps[order], bucket[order]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(fps) else np.zeros(0, np.int64)
    runs = np.concatenate([[0], ends])
    out: list[np.ndarray] = []
    first = 0
    words = np.cumsum(-(-np.diff(runs) // 64))
    while first < len(runs) - 1:
        done = words[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(words, done + BLOCKS_AT_ONCE, "right")))
        part = fps[runs[first] : runs[last]]
        if len(part) > last - first:
            root = local_roots(len(part), *near_in_runs(part, runs[first : last + 1] - runs[first], radius))
            moved = root != np.arange(len(part))
            out.append(np.stack([part[moved], part[root[moved]]], axis=1))
        first = last
    edges = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)
    return edges[:, 0], edges[:, 1]


def link(classes: DataFrame, radius: int) -> DataFrame:
    """``node, root`` for the distinct fingerprints ``fp`` that are linked to another one."""
    dealt = bucketed(classes, radius, "fp")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = near_edges(frame["fp"].to_numpy(np.int64).view(np.uint64), frame["bucket"].to_numpy(np.int64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return components(dealt.groupBy("part").applyInPandas(compare, "a bigint, b bigint"))


def bucketed(classes: DataFrame, radius: int, *columns: str) -> DataFrame:
    """``columns, bucket, part``: two rows with fingerprints within the radius meet in at least one bucket."""
    rows = classes.count()
    tables = tables_for(rows, radius)
    keys = []
    for number, ranges in enumerate(tables):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in ranges)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("table"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    placed = classes.select(*columns, F.explode(F.array(*keys)).alias("k")).select(*columns, "k.table", "k.key")
    counts = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("rows"))
    crowded = cut_lineage(counts.filter(F.col("rows") > TILE))
    known = placed.join(crowded, ["table", "key"], "left") if not crowded.isEmpty() else placed.withColumn("rows", F.lit(0).cast("long"))
    return tiled(known, rows * len(tables), *columns)


def tiled(known: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``columns, bucket, part`` of rows ``columns, table, key, rows``: keys of many ``rows`` are dealt over tiles, every two of which meet."""
    tiles = F.when(F.col("rows") > TILE, F.ceil(F.col("rows") / TILE).cast("int"))
    known = known.withColumn("tiles", tiles)
    own = F.pmod(F.xxhash64(*columns), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, own) * 1_000_000 + F.greatest(t, own))
    spread = known.select(*columns, "table", "key", F.explode(F.coalesce(meets, F.array(F.lit(-1)))).alias("tile"))
    spread = spread.withColumn("bucket", F.xxhash64("table", "key", "tile"))
    return spread.select(*columns, "bucket", F.pmod("bucket", F.lit(max(1, rows // PART_ROWS))).alias("part"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4
) -> DataFrame:
    """One row per document: ``id, text_hash, fp, component_id`` (the smallest id of its group).

    Equal fingerprints are one node, however many documents share it. A null text has no words and the
    fingerprint zero, which is linked like any other. Null ids never name a group that has another
    id. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    slim = cut_lineage(with_fingerprint(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    classes = cut_lineage(slim.groupBy("fp").agg(F.min("id").alias("least")))
    linked = link(classes, radius)
    grouped = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = cut_lineage(grouped)
    # Stored, so that a group of very many fingerprints can be split in the join.
    least = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    return slim.join(grouped.join(least, "root").select("fp", "component_id"), "fp").select("id", "text_hash", "fp", "component_id")


def with_sets(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``id, text_hash, fp, node, n``: the fingerprint, and the name and size of the set of shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", SLICE_BYTES):
            digests = [shingle_digests(text, shingle, seed) for text in batch.column("text").to_pylist()]
            sets = [shingle_set(d) for d in digests]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(majority(digests).view(np.int64)), pa.array(names.view(np.int64)), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "fp", "node", "n"])

    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("text_hash"))
    return slim.mapInArrow(compute, f"id {kind}, text_hash bigint, fp bigint, node bigint, n bigint")


def sets_of(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``node, shingles`` of the rows ``node, text``; the shingles in ascending order."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches, "text", SLICE_BYTES):
            sets = [shingle_set(shingle_digests(text, shingle, seed)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], names=["node", "shingles"])

    return texts.mapInArrow(compute, "node bigint, shingles array<bigint>")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64()))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def shingle_weights(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, counted in cells: a table of fixed size. It only orders shingles, so sharing a cell does no harm."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            held += np.bincount(_cells(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["cell", "n"])

    out = np.zeros(1 << CELL_BITS, np.int64)
    for row in sets.select("shingles").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out


def prefixes(placed: DataFrame, weights: np.ndarray, percent: int, parts: int) -> DataFrame:
    """The rarest shingles of each set ``place, shingles``, so many that two sets of the wanted similarity share one of them.

    Of two such sets, each holds at least ``percent`` of the other's shingles, so that among the first ``n - ceil(percent n) + 1`` in one
    order of all shingles there is a common one. A set without shingles has the key of empty sets. A row holds the keys of a batch that
    go to a part, ``part, n, keys, first, places``: 32 bits a key, and how far the place of its set lies behind the first one.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, places = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, weights[_cells(flat)], owner))
            place = np.arange(len(flat)) - np.repeat(ends[:-1], sizes)
            take = place < np.repeat(sizes - -(-percent * sizes // 100) + 1, sizes)
            empty = np.flatnonzero(sizes == 0)
            # Scrambled, since rare shingles are those of some ranges of numbers.
            keys = mix64(np.append(flat[order][take], empty * 0).view(np.uint64))
            behind = (places - places.min())[np.append(owner[take], empty)].astype(np.uint32)
            part = parts_of(keys, parts)
            by_part = np.argsort(part, kind="stable")
            short, behind, part = short_keys(keys, parts)[by_part], behind[by_part], part[by_part]
            rows = [(int(part[x]), y - x, pack_bytes(short[x:y]), int(places.min()), pack_bytes(behind[x:y])) for x, y in stretches(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "n", "keys", "first", "places"])

    return placed.select("place", "shingles").mapInArrow(compute, "part bigint, n bigint, keys binary, first bigint, places binary")


def sized(stored: DataFrame) -> DataFrame:
    """A stored table of numbers, marked for broadcast if its rows are few."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def sharing(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, bucket, part``, stored: two sets of the wanted similarity meet in a bucket of at most two tiles' rows.

    Keys travel once, 32 bits each within their part; keys of different shingles that look alike there only add candidates.
    Those of one set, which are most, end there.
    """
    placed = sets.withColumn("place", F.monotonically_increasing_id())
    weights = shingle_weights(sets)
    parts = 1 + int(weights.sum()) * (100 - percent) // 100 // PART_KEYS

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        keys, places = unpack(frame["keys"], frame["n"], np.uint32), unpack(frame["places"], frame["n"], np.uint32).astype(np.int64)
        places += np.repeat(frame["first"].to_numpy(np.int64), frame["n"])
        order = np.argsort(keys, kind="stable")
        ends = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1
        rows = np.repeat(np.diff(ends, prepend=0), np.diff(ends, prepend=0))
        more = rows > 1
        return pd.DataFrame({"place": places[order][more], "table": frame["part"].iloc[0], "key": keys[order][more].astype(np.int64), "rows": rows[more]})

    met = prefixes(placed, weights, percent, parts).groupBy("part").applyInPandas(shared, "place bigint, table bigint, key bigint, rows bigint")
    numbers = sized(cut_lineage(placed.select("place", "node", F.size("shingles").cast("long").alias("n"))))
    spread = cut_lineage(tiled(met.join(numbers, "place"), 1, "node", "n").drop("part"))
    return spread.withColumn("part", F.pmod("bucket", F.lit(max(1, spread.count() // PART_ROWS))))


def next_other(
    size: np.ndarray, label: np.ndarray, after: np.ndarray, runs: np.ndarray, most: int, percent: int, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the next ``most`` rows of its run with another label behind row ``after``, while their sizes allow the similarity.

    Rows of a run are in ascending order of size. Index pairs, and the rows that have more of them. Pairs that are not ``allowed`` do not count.
    """
    got, more = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    end = np.repeat(runs[1:], np.diff(runs))
    # Runs of one label have nothing left to ask.
    mixed = np.add.reduceat((label != label[np.repeat(runs[:-1], np.diff(runs))]).astype(np.int64), runs[:-1]) > 0 if len(size) else np.zeros(0, bool)
    row = np.flatnonzero(np.repeat(mixed, np.diff(runs)))
    other = np.maximum(row, after[row]) + 1
    while len(row):
        live = other < end[row]
        row, other = row[live], other[live]
        live = 100 * size[row] >= percent * size[other]
        row, other = row[live], other[live]
        hit = label[row] != label[other]
        if allowed is not None:
            hit[hit] = allowed(row[hit], other[hit])
        over = hit & (got[row] >= most)
        more[row[over]] = True
        take = hit & ~over
        found_a.append(row[take])
        found_b.append(other[take])
        got[row[take]] += 1
        row, other = row[~over], other[~over] + 1
    return np.concatenate(found_a), np.concatenate(found_b), more


def similar_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, radius: int = 4, percent: int = 80
) -> DataFrame:
    """One row per document: ``id, text_hash, root``; documents of one root are linked by pairs of similar texts.

    A pair is a link if its sets of word shingles have at least ``percent`` of their union in common; texts of one set are one
    node. Fingerprints within the radius are the first candidates and join most groups. Then all nodes that share one of their rarest
    shingles are candidates, which no similar pair escapes, unless their sketches rule it out where they meet. In a round every node names
    its next few candidates per bucket that are not in its group yet, these are compared, and groups are joined; nodes with more candidates go
    on behind the last one, so a group of many near copies is joined without all its pairs, and no candidate is left out.
    """
    slim = cut_lineage(with_sets(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    nodes = cut_lineage(slim.groupBy("node").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.min(F.struct("text_hash", "id")).alias("one")))
    # One document of each node; rows equal in id and text make the same set again.
    wanted = sized(cut_lineage(nodes.select("node", F.col("one.text_hash").alias("text_hash"), F.col("one.id").alias("one_id"))))
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, (texts["text_hash"] == wanted["text_hash"]) & F.col("id").eqNullSafe(F.col("one_id"))).select("node", "text")
    sets = cut_lineage(sets_of(texts, shingle, seed))
    drawn = cut_lineage(sketches(sets))
    # Rows equal in id and text have made a set more than once.
    brief = cut_lineage(briefs(drawn).dropDuplicates(["node"]))

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, fps, node, size = (frame[c].to_numpy(np.int64) for c in ("bucket", "fp", "node", "n"))
        order = np.lexsort((node, fps, bucket))
        bucket, fps, node, size = bucket[order], fps[order], node[order], size[order]
        runs = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        words, first, out = np.cumsum(-(-np.diff(runs) // 64)), 0, []
        while first < len(runs) - 1:
            done = words[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(words, done + BLOCKS_AT_ONCE, "right")))
            low, high = runs[first], runs[last]
            part, none = slice(low, high), np.full(high - low, -1)
            a, b, _ = next_near(fps[part].view(np.uint64), node[part], none, runs[first : last + 1] - low, radius, FIRST_CANDIDATES)
            a, b = a + low, b + low
            fits = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            out.append(pd.DataFrame({"a": node[a[fits]], "b": node[b[fits]]}).drop_duplicates())
            first = last
        return pd.concat(out)

    found = bucketed(nodes, radius, "fp", "node", "n").groupBy("part").applyInPandas(near, "a bigint, b bigint")
    dealt, most = sharing(sets, percent), FIRST_CANDIDATES
    roots = sized(components(first_links(found, sets, percent)))
    state = dealt.withColumn("after", F.lit(-1).cast("long"))
    while True:

        def share(frame: pd.DataFrame, drawn_here: pd.DataFrame) -> pd.DataFrame:
            bucket, node, size, label, after = (frame[c].to_numpy(np.int64) for c in ("bucket", "node", "n", "label", "after"))
            order = np.lexsort((node, size, bucket))
            bucket, node, size, label, after = bucket[order], node[order], size[order], label[order], after[order]
            runs = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            start = np.repeat(runs[:-1], np.diff(runs))
            allowed = brief_test(drawn_here["of"].to_numpy(np.int64), drawn_here["brief"], node, size, percent)
            a, b, more = next_other(size, label, start + after, runs, most, percent, allowed)
            pairs = pd.DataFrame({"a": node[a], "b": node[b], "bucket": 0, "after": -1}).drop_duplicates()
            # The last candidate of a row that has more is where it goes on.
            final = np.full(len(node), -1, np.int64)
            np.maximum.at(final, a, b)
            on = np.flatnonzero(more)
            return pd.concat([pairs, pd.DataFrame({"a": node[on], "b": node[on], "bucket": bucket[on], "after": (final - start)[on]})])

        labelled = state.join(roots.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        # A sketch goes once to each part, however many buckets of its node lie there.
        there = state.select("part", "node").distinct().join(brief, "node").toDF("of", "at", "brief")
        found = cut_lineage(labelled.groupBy("part").cogroup(there.groupBy("at")).applyInPandas(share, "a bigint, b bigint, bucket bigint, after bigint"))
        roots = join_groups(found.filter("after < 0").select("a", "b"), roots, sets, drawn, percent)
        more = found.filter("after >= 0").select(F.col("a").alias("node"), "bucket", "after")
        if more.isEmpty():
            break
        most *= MORE_CANDIDATES
        again = dealt.join(more.select("bucket").distinct(), "bucket", "left_semi").join(more, ["node", "bucket"], "left")
        # Rows that have named all their candidates are only met by others.
        state = again.withColumn("after", F.coalesce("after", F.lit(1 << 40)))
    # Stored, so that a group of very many nodes can be split in the join.
    rooted = cut_lineage(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return slim.join(rooted, "node").select("id", "text_hash", "root")


def sketches(sets: DataFrame) -> DataFrame:
    """``node, n, sketch``: the size of each set, and whether the shingles that share a cell are odd in number, a bit per cell.

    There are 64 cells or more, a power of two of at least the size; half as many are made of them by xor. A shingle that one of two sets has
    changes one bit, so the sketches differ in at most as many bits as the sets in shingles.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(1), []
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            for low, high in zip([0, *ends], ends):
                cells = max(64, 1 << (high - low - 1).bit_length())
                odd = np.bincount(flat[low:high] & (cells - 1), minlength=cells) & 1
                found.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            n = np.diff(ends, prepend=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(found)], names=["node", "n", "sketch"])

    return sets.select("node", "shingles").mapInArrow(compute, "node bigint, n bigint, sketch array<bigint>")


def briefs(drawn: DataFrame) -> DataFrame:
    """``node, brief``: the sketches, of BRIEF_BITS cells at most."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            kept = [np.bitwise_xor.reduce(flat[low:high].reshape(-1, min(high - low, BRIEF_BITS // 64))).tobytes() for low, high in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["node", "brief"])

    return drawn.select("node", "sketch").mapInArrow(compute, "node bigint, brief binary")


def brief_test(names: np.ndarray, brief: pd.Series, node: np.ndarray, size: np.ndarray, percent: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether the brief sketches of rows ``a, b`` leave it open that their sets have the similarity; row ``i`` is of ``node[i]``, whose set has ``size[i]`` shingles.

    Sketches of one length are rows of a matrix; each is there in half the length too, for the pairs whose other sketch is shorter.
    """
    words = brief.str.len().to_numpy(np.int64) // 8
    at = pd.Index(names).get_indexer(node)
    planes, place = {}, {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        full = np.frombuffer(b"".join(brief.iloc[own]), np.uint64).reshape(-1, w)
        for length, rows in ((w, full), (w // 2, full[:, : w // 2] ^ full[:, w // 2 :])):
            if length:
                where = place.setdefault(length, np.full(len(names), -1))
                where[own] = np.arange(len(own)) + sum(map(len, planes.get(length, [])))
                planes.setdefault(length, []).append(rows)
    planes = {length: np.concatenate(rows) for length, rows in planes.items()}

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = at[a], at[b]
        least, out = np.minimum(words[x], words[y]), np.ones(len(a), bool)
        for length in np.unique(least).tolist():
            i, j = place[length][x], place[length][y]
            # Sketches of other lengths are not compared here.
            both = np.flatnonzero((least == length) & (i >= 0) & (j >= 0))
            for low in range(0, len(both), SKETCHES_AT_ONCE):
                pair = both[low : low + SKETCHES_AT_ONCE]
                apart = np.bitwise_count(planes[length][i[pair]] ^ planes[length][j[pair]]).sum(axis=1, dtype=np.int64)
                out[pair] = (100 + percent) * apart <= (100 - percent) * (size[a[pair]] + size[b[pair]])
        return out

    return allowed


def sketches_allow(percent: int) -> Column:
    """Whether the sketches ``x, y`` of sets of ``n, m`` shingles leave it open that these have the similarity."""

    def half(c: Column) -> Column:
        words = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda p, q: p.bitwiseXOR(q))

    x, y = F.col("x"), F.col("y")
    x, y = F.when(F.size(x) == 2 * F.size(y), half(x)).otherwise(x), F.when(F.size(y) == 2 * F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    # Sketches of other sizes are not compared: then the sets are.
    return (F.size(x) != F.size(y)) | ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))


def similar_pairs(found: DataFrame, sets: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs ``a, b`` of nodes whose sets of shingles have at least ``percent`` of their union in common.

    Pairs meet as sketches first, which rules out most; only sets of those left move.
    """
    met = drawn.toDF("a", "n", "x").join(found, "a").join(drawn.toDF("b", "m", "y"), "b")
    pairs = sized(cut_lineage(met.filter(sketches_allow(percent)).select("a", "b")))
    both = sets.toDF("a", "x").join(pairs, "a").join(sets.toDF("b", "y").join(pairs.select("b"), "b", "left_semi"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def join_groups(found: DataFrame, roots: DataFrame, sets: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The groups ``node, root`` after all candidates ``found`` were compared, as far as they do not lie within a group.

    Of the candidates between two groups one is compared first. Most groups that belong together are joined by it, so that their
    other candidates need not be compared; those that are left then are compared at once. Each of the two steps
    takes a fixed number of jobs, and earlier links are known by the groups they made.
    """
    open_ = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for first in (True, False):
        open_ = open_.join(roots.toDF("a", "la"), "a", "left").join(roots.toDF("b", "lb"), "b", "left")
        open_ = open_.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).filter("la <> lb")
        open_ = cut_lineage(open_.select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")))
        asked = open_.select("a", "b")
        if first:
            lot = F.min(F.struct(F.xxhash64("a", "b").alias("lot"), "a", "b")).alias("m")
            asked = cut_lineage(open_.groupBy("la", "lb").agg(lot).select("m.a", "m.b"))
        rows = asked.count()
        if not rows:
            break
        asked = F.broadcast(asked) if rows <= BROADCAST_ROWS else asked
        links = similar_pairs(asked, sets, drawn, percent)
        roots = sized(components(links.union(roots.toDF("a", "b"))))
        open_ = open_.select("a", "b").join(asked, ["a", "b"], "left_anti")
    return roots


def first_links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the candidates ``a, b`` that join most groups: each set moves once, however many candidates it has.

    Sets whose candidates hang together meet, TILE_SETS of them at a time. The first open one is compared with all others there, those similar
    to it are linked to it, and so on with what is left. Links of other pairs are found later.
    """
    roots = cut_lineage(components(found))
    tiles = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE_SETS).alias("tiles"))
    placed = roots.join(tiles, "root").select("node", F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("tiles"))).alias("tile"))
    met = sets.join(sized(cut_lineage(placed)), "node")

    def stars(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        lists = table.column("shingles").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        begin, open_, a, b = np.cumsum(sizes) - sizes, np.ones(len(nodes), bool), [], []
        for i in range(len(nodes)):
            if open_[i]:
                open_[i] = False
                own = flat[begin[i] : begin[i] + sizes[i]]
                spot = np.searchsorted(own, flat)
                common = np.bincount(owner[(spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == flat)] if len(own) else [], minlength=len(nodes))
                near = np.flatnonzero(open_ & (100 * common >= percent * (sizes + sizes[i] - common)))
                open_[near] = False
                a.append(nodes[near])
                b.append(np.full(len(near), nodes[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return met.groupBy("tile").applyInArrow(stars, "a bigint, b bigint")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents of ``docs`` without all but one (that of the smallest id) of each group of `similar_groups`.

    Null ids come last; ids that repeat name different documents if their texts differ.
    """
    found = cut_lineage(similar_groups(docs, id_col=id_col, text_col=text_col, **how))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("least")
    stay = cut_lineage(found.groupBy("root").agg(least).select("root", F.col("least.id").alias("__id"), F.col("least.text_hash").alias("__hash")))
    rows = docs.join(stay.withColumnRenamed("root", "__root"), named(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(named(text_col)) == F.col("__hash")))
    twice = found.join(stay, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).count() > stay.count()
    # Rows equal in id and text are one document.
    rows = rows.dropDuplicates(["__root"]) if twice else rows
    return rows.select(*[named(c) for c in docs.columns])
