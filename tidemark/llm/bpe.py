"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes if and only if every token, and every two neighbours, are the
encoding of their own bytes: merges inside two neighbours happen in the same order alone as among others. So encodings
form a language that an automaton with the last token as its state accepts, and each prefix of a text has just one
encoding. Several ways to go on are open at a time, one per place where the token that is being read may have begun;
the deterministic state is the set of them with what each has read. Tokens are emitted as soon as
all open ways share them, at most the length of the longest token later. States and moves are made when first met.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import named, ragged_ranges, row_batches
from tidemark.llm.texts import SLICE_BYTES

# So many states and so many pieces are kept per Python worker; results do not depend on it.
KEPT_STATES, KEPT_PIECES = 100_000, 600_000
# Longer pieces are not kept, and longer texts are cut into matches a part at a time.
KEPT_BYTES, PART_CHARS, DECODE_TOKENS = 64, 1 << 20, 1 << 20
# An id outside the vocabulary decodes to the replacement character.
UNKNOWN = "�".encode()

# Letters and numbers that are younger than Unicode 16, to which the encodings of this vocabulary keep. They are
# neither letters nor numbers to it.
YOUNGER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""

_coders: dict[tuple, Coder] = {}
_decoders: dict[str, TokenBytes] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ranks file: a line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """The merges of a vocabulary: which two tokens make which token, the lowest id first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.singles = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.singles:
            raise ValueError("a byte-level vocabulary needs a token for each of the 256 bytes")

    def __call__(self, data: bytes, least: int = 1) -> list[int]:
        """The encoding of a few bytes by merging, as far as ``least`` tokens."""
        ids, pairs = [self.singles[b] for b in data], self.pairs
        while len(ids) > least:
            made = [pairs.get(two, 1 << 40) for two in zip(ids[:-1], ids[1:], strict=True)]
            best = min(made)
            if best == 1 << 40:
                break
            at = made.index(best)
            ids[at : at + 2] = [best]
        return ids


class State:
    """The open ways and the moves made so far.

    A way is the place in the tree of tokens that the token being read has come to, the token before it (-1 at the start), and
    the tokens before it that are not certain yet.
    """

    __slots__ = ("moves", "ways")

    def __init__(self, ways: tuple) -> None:
        self.ways, self.moves = ways, {}


class Transducer:
    """Bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_STATES) -> None:
        self.ranks, self.merges, self.kept = ranks, Merges(ranks), kept
        # The tree of tokens: a number per beginning, the token that ends there, whether tokens go on from there.
        self.tree: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, number in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                after = self.tree.get(node << 8 | byte)
                if after is None:
                    after = self.tree[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = after
            self.token_at[node] = number
        self.tokens = {number: token for token, number in ranks.items()}
        self.parts: dict[int, tuple[int, ...] | None] = {}
        self.in_order: dict[int, bool] = {}
        ways = ((0, -1, ()),)
        self.start = State(ways)
        self.states = {ways: self.start}

    def _parts(self, token: int) -> tuple[int, ...] | None:
        """The two tokens that the last merge of a token joins, none for a single byte; ``None`` if merging does not give the token."""
        if token in self.parts:
            return self.parts[token]
        data, found = self.tokens[token], ()
        if len(data) > 1:
            two = self.merges(data, 2)
            found = tuple(two) if len(two) == 2 and self.merges.pairs.get((two[0], two[1])) == token else None
        self.parts[token] = found
        # Whether all merges that make the token come in the order of their numbers.
        self.in_order[token] = found is not None and all(self._parts(t) is not None and self.in_order[t] and (t < token or not self.parts[t]) for t in found)
        return found

    def _fits(self, before: int, token: int) -> bool:
        """Whether the token may stand behind another one (or first), that is, whether merging gives just these two.

        Their merges are undone from the last one on. The two tokens at the border at each time must not have been merged before the next
        merge of one of them: a merge of a lower number comes first, of equal ones the left one.
        """
        known, pairs = self.parts, self.merges.pairs
        parts = known[token] if token in known else self._parts(token)
        if parts is None or before < 0:
            return parts is not None
        if before not in known and self._parts(before) is None or not (self.in_order[before] and self.in_order[token]):
            return self.merges(self.tokens[before] + self.tokens[token]) == [before, token]
        limit, left = 1 << 40, known[before]
        while True:
            if pairs.get((before, token), limit) < limit:
                return False
            if left and (before > token or not parts):
                limit, before = before, left[1]
                left = known[before]
            elif parts:
                limit, token = token + 1, parts[0]
                parts = known[token]
            else:
                return True

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        ended, open_, tree, token_at = None, [], self.tree, self.token_at
        for node, before, pending in state.ways:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0 and ended is None and self._fits(before, token):
                ended = (0, token, (*pending, token))
            if self.inner[node]:
                open_.append((node, before, pending))
        if ended is not None:
            open_.append(ended)
        # What all open ways share is certain.
        emitted = open_[0][2]
        if emitted:
            for _, _, pending in open_:
                if pending[: len(emitted)] != emitted:
                    shared = 0
                    while shared < len(pending) and pending[shared] == emitted[shared]:
                        shared += 1
                    emitted = emitted[:shared]
        if emitted:
            n = len(emitted)
            open_ = [(node, before, pending[n:]) for node, before, pending in open_]
        ways = tuple(open_)
        after = self.states.get(ways)
        if after is None:
            after = State(ways)
            # The first states stay, those met after them are made again whenever they are needed.
            if len(self.states) >= self.kept:
                return after, emitted
            self.states[ways] = after
        found = state.moves[byte] = after, emitted
        return found

    def __call__(self, data: bytes) -> list[int]:
        """The encoding of one piece; bytes that are a token themselves are that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out, state = [], self.start
        for byte in data:
            state, emitted = state.moves.get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        # The way that ends with the last byte is the last one of the state.
        return out + list(state.ways[-1][2])


class Coder(dict):
    """Ids of texts, piece by piece; maps a piece to the number of its encoding, which is kept."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex

        super().__init__()
        self.transducer, self.pattern, self.blank = Transducer(load_ranks(ranks)), regex.compile(pattern), re.compile(r"(?<=\S) (?=\S)")
        ranges = [r.partition("-") for r in YOUNGER.split()]
        # Most texts hold no character as late as these; that is seen much faster.
        self.late = re.compile(f"[{chr(int(ranges[0][0], 16))}-{chr(sys.maxunicode)}]")
        self.younger = re.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b or a, 16))}" for a, _, b in ranges) + "]")
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.ids, self.starts = array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        self.ids.extend(self.transducer(data))
        number = len(self.starts) - 1
        self.starts.append(len(self.ids))
        if len(data) <= KEPT_BYTES:
            self[piece] = number
        return number

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of bounded length; a blank between two non-blanks begins a piece, so no piece is cut."""
        at = 0
        while len(text) - at > PART_CHARS:
            found = self.blank.search(text, at + PART_CHARS)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def pieces(self, part: str) -> list[str]:
        """The matches of the pattern, in which younger characters are neither letters nor numbers."""
        if part.isascii() or not self.late.search(part) or not self.younger.search(part):
            return self.pattern.findall(part)
        return [part[m.start() : m.end()] for m in self.pattern.finditer(self.younger.sub("\ufffd", part))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the ``n + 1`` offsets of the texts; a null text has none."""
        if len(self.starts) > KEPT_PIECES:
            self._reset()
        numbers, counts = [], []
        for text in texts:
            count = 0
            for part in self.parts(text) if text else ():
                pieces = self.pieces(part)
                numbers.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
                count += len(pieces)
            counts.append(count)
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        # Copies, so that the arrays may grow again.
        starts, table = np.array(self.starts, np.int64), np.array(self.ids, np.uint32)
        sizes = starts[number + 1] - starts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return table[ragged_ranges(starts[number], sizes)].astype("<u4"), ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def _utf8_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state by state and byte, and the bytes of an unfinished character that each state holds.

    The second byte of four lead bytes has a narrower range. A byte that does not fit begins anew.
    """
    start, one, e0, e1, ed, two, f0, f1, f4, half, three = range(11)
    table = np.zeros((11, 256), np.int8)
    for state in range(11):
        row = table[state]
        row[0xC2:0xE0], row[0xE1:0xF0], row[0xF1:0xF4] = one, e1, f1
        row[0xE0], row[0xED], row[0xF0], row[0xF4] = e0, ed, f0, f4
    for state, low, high, then in (
        (one, 0x80, 0xBF, start), (two, 0x80, 0xBF, start), (three, 0x80, 0xBF, start), (e1, 0x80, 0xBF, two), (half, 0x80, 0xBF, three),
        (f1, 0x80, 0xBF, half), (e0, 0xA0, 0xBF, two), (ed, 0x80, 0x9F, two), (f0, 0x90, 0xBF, half), (f4, 0x80, 0x8F, half),
    ):
        table[state, low : high + 1] = then
    return table, np.array([0, 1, 1, 1, 1, 2, 1, 1, 1, 2, 3])


UTF8_NEXT, UTF8_HELD = _utf8_machine()


class TokenBytes:
    """The bytes of each token, and the moves of the UTF-8 machine over whole tokens."""

    def __init__(self, ranks: str) -> None:
        table = load_ranks(ranks)
        tokens = [UNKNOWN] * (max(table.values()) + 2)
        for token, rank in table.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        # moves[state, token]; a token is firm if all states lead to the same one over it.
        self.moves = np.repeat(np.arange(11, dtype=np.int8)[:, None], len(tokens), axis=1)
        for place in range(int(self.sizes.max())):
            live = np.flatnonzero(self.sizes > place)
            self.moves[:, live] = UTF8_NEXT[self.moves[:, live], self.data[self.starts[live] + place][None, :]]
        self.firm = (self.moves == self.moves[0]).all(axis=0)

    def known(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(ids, len(self.sizes) - 1).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged_ranges(self.starts[ids], self.sizes[ids])]


class Decoder:
    """Text of a stream of ids: ``feed`` returns all finished characters, ``close`` what is left.

    Bytes that are no UTF-8 become replacement characters, one for each longest part that could have begun a character.
    """

    def __init__(self, tokens: TokenBytes) -> None:
        self.tokens, self.state, self.held = tokens, 0, b""

    def feed(self, ids: np.ndarray) -> str:
        ids = self.tokens.known(np.asarray(ids))
        firm = np.flatnonzero(self.tokens.firm[ids])
        begin = int(firm[-1]) if len(firm) else 0
        state = self.state
        for token in ids[begin:].tolist():
            state = int(self.tokens.moves[state, token])
        self.state = state
        data = self.held + self.tokens.bytes_of(ids).tobytes()
        done = len(data) - int(UTF8_HELD[state])
        self.held = data[done:]
        return data[:done].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.state, self.held = self.held, 0, b""
        return held.decode("utf-8", "replace")


def _coder(ranks: str, pattern: str) -> Coder:
    if (ranks, pattern) not in _coders:
        _coders[ranks, pattern] = Coder(ranks, pattern)
    return _coders[ranks, pattern]


def _token_bytes(ranks: str) -> TokenBytes:
    if ranks not in _decoders:
        _decoders[ranks] = TokenBytes(ranks)
    return _decoders[ranks]


def encode(docs: DataFrame, *, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids``: the ids of every whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is a vocabulary file that lies on every machine, ``pattern`` cuts a text into pieces that are encoded separately; characters
    that it leaves out are lost. Special tokens are ordinary text. A null text counts as empty and has no tokens. Very
    long texts are cut into pieces a part at a time, very long pieces pass the transducer like others. Nothing depends on another
    row, so ties and repeated rows do not matter; other columns stay behind, whatever they are called. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    label = id_col.replace("`", "``")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in row_batches(batches, "text", 4 * SLICE_BYTES):
            ids, ends = coder.encode(batch.column("text").to_pylist())
            blobs = pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends), pa.int64()), blobs], names=[id_col, "n_tokens", "ids"])

    slim = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{label}` {kind}, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, *, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and the text ``out`` of the ids in ``ids_col`` (binary, as :func:`encode` makes them).

    Null ids give a null text, no ids an empty one. Ids outside the vocabulary, and bytes that are no UTF-8, become
    replacement characters. Long sequences are decoded part by part. A column named like ``out`` is replaced.
    """
    columns = [c for c in tokens.columns if c != out]
    place = columns.index(ids_col)
    plain = tokens.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks)
        for batch in row_batches(batches, f"c{place}", 4 * SLICE_BYTES):
            texts = []
            for blob in batch.column(place):
                if not blob.is_valid:
                    texts.append(None)
                    continue
                ids, stream = np.frombuffer(blob.as_buffer(), "<u4"), Decoder(table)
                parts = [stream.feed(ids[i : i + DECODE_TOKENS]) for i in range(0, len(ids), DECODE_TOKENS)]
                texts.append("".join(parts) + stream.close())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    found = plain.mapInArrow(run, plain.withColumn("text", F.lit(None).cast("string")).schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("text").alias(out))
