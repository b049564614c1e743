"""Byte-level BPE encoding by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges give for its bytes exactly if every two neighbours would stay apart were they alone (`Merges.apart`).
Hence each prefix of a piece has one last token. The nondeterministic machine guesses where tokens begin and reads each along the trie of
the vocabulary; its determinised state is the set of places where a token may still begin or go on, each with the node reached and the
token before it. Each byte read emits the last token of the prefix. Tokens behind the place where the ways back from all live places meet can
no longer change: the lookahead ends there, in practice within a token's length. States and their moves are made when first met and dropped
together when they outgrow a bound in bytes.
Ids of short pieces, which repeat, are remembered within a bound in bytes too.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches

#: Estimated bytes of states that a Python worker holds before it starts anew.
STATE_BYTES = 96 << 20
#: Estimated bytes of pieces whose ids it remembers, and the greatest length in bytes of such a piece.
PIECE_BYTES = 96 << 20
SHORT = 64
#: Texts of more characters are cut lazily, and ids are decoded in runs of this many.
RUN = 1 << 16
ROOT = 0
#: Emitted tokens of a piece that wait before those settled are taken off.
SETTLE = 4096


def unicode_blanks(pattern: str) -> str:
    """The pattern with white space named by its Unicode property, which is what `\\s` means to the ranks' own library."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Merges:
    """Ranks of a byte-level vocabulary: a pair merges at the rank of its joined bytes, the leftmost of equals first."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ranks = tokens
        self.bytes_of = {i: t for t, i in tokens.items()}
        if len(self.bytes_of) != len(tokens) or any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("ranks must differ and every byte must be a token")
        self.halves: dict[int, tuple[int, int]] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes `token`."""
        found = self.halves.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    raise ValueError(f"no merges of lower rank lead to token {token}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.halves[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        Their merges are undone at the seam, the later one first. Two symbols that once met there lay side by side until the merge that is
        undone next; had their own merge come before it, the seam would have closed. Of equal ranks the one further left comes first.
        """
        until = len(self.ranks) << 1
        while True:
            a, b = self.bytes_of[left], self.bytes_of[right]
            rank = self.ranks.get(a + b)
            if rank is not None and rank < until:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(b) == 1 or (len(a) > 1 and left > right):
                until, left = left, self.split(left)[1]
            else:
                until, right = right + 1, self.split(right)[0]


class Transducer:
    """Bytes of a piece in, tokens out; states are numbers, a move emits the last token of what was read so far.

    A live place is a trie node and the token that ends where this node's reading began (-1 at the start of a piece); the last live place is
    the end of what was read, at the root. An emitted token is settled once the ways back from all live places meet behind it.
    """

    def __init__(self, merges: Merges, bound: int = STATE_BYTES, settle: int = SETTLE):
        self.merges = merges
        self.bound = bound
        self.settle = settle
        self.bits = max(merges.bytes_of).bit_length()
        self.sizes = {i: len(t) for i, t in merges.bytes_of.items()}
        self.below: dict[int, int] = {}
        self.token_at = [-1]
        self.depth = [0]
        self.inner = bytearray(1)
        for token, i in merges.ranks.items():
            node = ROOT
            for b in token:
                self.inner[node] = 1
                key = node << 8 | b
                above, node = node, self.below.get(key, -1)
                if node < 0:
                    node = self.below[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[above] + 1)
                    self.inner.append(0)
            self.token_at[node] = i
        self.renew()

    def renew(self) -> None:
        """Start without states. Number 0 is the start of a piece."""
        self.numbers: dict[tuple[int, ...], int] = {}
        self.live: list[tuple[int, ...]] = []
        #: state and byte -> next state and the token emitted.
        self.moves: dict[int, int] = {}
        self.apart: dict[int, bool] = {}
        self.held = 0
        self.number((ROOT, -1))

    def number(self, live: tuple[int, ...]) -> int:
        found = self.numbers.get(live)
        if found is None:
            found = self.numbers[live] = len(self.live)
            self.live.append(live)
            self.held += 200 + 8 * len(live)
        return found

    def move(self, state: int, byte: int) -> int:
        """Make the move of a state, which is then remembered."""
        live, ended = [], -1
        get, token_at, inner, apart = self.below.get, self.token_at, self.inner, self.apart
        places = iter(self.live[state])
        for node, left in zip(places, places):
            node = get(node << 8 | byte, -1)
            if node < 0:
                continue
            if ended < 0 and (token := token_at[node]) >= 0:
                if left < 0:
                    ended = token
                else:
                    pair = left << 32 | token
                    stay = apart.get(pair)
                    if stay is None:
                        stay = apart[pair] = self.merges.apart(left, token)
                        self.held += 130
                    if stay:
                        ended = token
            if inner[node]:
                live += (node, left)
        live += (ROOT, ended)
        found = self.moves[state << 8 | byte] = self.number(tuple(live)) << self.bits | ended
        self.held += 150
        return found

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        if self.held > self.bound:
            self.renew()
        moves, state, ends, out = self.moves, 0, [], []
        bits, mask = self.bits, (1 << self.bits) - 1
        for byte in data:
            found = moves.get(state << 8 | byte)
            if found is None:
                if self.held > 2 * self.bound:  # within one piece: go on from the same state under a new number
                    live = self.live[state]
                    self.renew()
                    moves, state = self.moves, self.number(live)
                found = self.move(state, byte)
            state = found >> bits
            ends.append(found & mask)
            if len(ends) >= self.settle:
                ends = self.settled(ends, self.live[state], out)
        out += self.walk(ends, len(ends), 0)
        return out

    def walk(self, ends: list[int], at: int, stop: int) -> list[int]:
        """Tokens on the way back from `at` to `stop`, in order."""
        back = []
        while at > stop:
            token = ends[at - 1]
            back.append(token)
            at -= self.sizes[token]
        back.reverse()
        return back

    def settled(self, ends: list[int], live: tuple[int, ...], out: list[int]) -> list[int]:
        """Move tokens that can no longer change to `out`; gives the emitted tokens behind them."""
        ways = {len(ends) - self.depth[node] for node in live[::2]}
        while len(ways) > 1:
            at = max(ways)
            ways.remove(at)
            ways.add(at - self.sizes[ends[at - 1]])
        met = ways.pop()
        out += self.walk(ends, met, 0)
        return ends[met:]


class ByteCoder(dict):
    """Texts to ids and back for one file of ranks and one pattern. As a table it remembers the ids of short pieces, within a bound in bytes."""

    def __init__(self, path: str, pattern: str, bound: int = PIECE_BYTES):
        super().__init__()
        with open(path, "rb") as f:
            merges = Merges({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)})
        self.transducer = Transducer(merges)
        self.pieces = regex.compile(unicode_blanks(pattern))
        self.tokens = merges.bytes_of
        self.bound = bound
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = array("I", self.transducer.encode(data))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(data) <= SHORT:
            self.held += 260 + len(data) + len(ids)
            if self.held > self.bound:
                self.clear()
                self.held = 0
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        found = self.pieces.findall(text) if len(text) < RUN else (m.group() for m in self.pieces.finditer(text))
        return b"".join(map(self.__getitem__, found))

    def decode(self, ids: bytes) -> str:
        """Text of ids, decoded run by run; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        stream, out = Utf8Stream(), []
        for at in range(0, len(numbers), RUN):
            out.append(stream.feed(b"".join(map(self.tokens.__getitem__, numbers[at : at + RUN].tolist()))))
        return "".join(out) + stream.finish()


#: UTF-8 machine. A lead byte's range, the range of its first continuation byte, and how many continuation bytes follow.
LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2), (0xED, 0xED, 0x80, 0x9F, 2),
         (0xEE, 0xEF, 0x80, 0xBF, 2), (0xF0, 0xF0, 0x90, 0xBF, 3), (0xF1, 0xF3, 0x80, 0xBF, 3), (0xF4, 0xF4, 0x80, 0x8F, 3)]
#: A state is what the machine waits for: (least next byte, greatest next byte, continuation bytes left). Between characters it waits for nothing.
BETWEEN, BROKEN = (0, 0, 0), (1, 0, 0)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
    least, most, left = state
    if left:
        return ((0x80, 0xBF, left - 1) if left > 1 else BETWEEN) if least <= byte <= most else BROKEN
    return next((t[2:] if t[4] else BETWEEN for t in LEADS if t[0] <= byte <= t[1]), BROKEN)


class Utf8Stream:
    """Gives the characters of a stream of bytes as soon as they are whole. Only the end of a run can be within a character, so the machine reads that."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            state = BETWEEN
            for byte in data[-back:]:
                state = utf8_step(state, byte)
            if state[2]:
                cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode(errors="replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode(errors="replace")


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteCoder:
    return ByteCoder(path, pattern)


def _mapped(docs: DataFrame, source: str, out: str, kind: T.DataType, arrow: pa.DataType, run_one, rows: int = 512) -> DataFrame:
    kept = [c for c in docs.columns if c != out]
    # the source goes last under the name of the result, so that a column named like the result gives way
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(out))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(out, kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = run_one()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = pa.array([None if x is None else one(x) for x in batch.column(len(kept)).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], names=[*kept, out])

    return in_batches(frame, run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns with `out`: ids of the whole text as packed little-endian unsigned 32-bit integers, those of the ranks' own library.

    `ranks` must lie at the same path on every worker. Each match of `pattern` is encoded by itself; special strings are ordinary text. A null
    text gives null ids, an empty one none; repeated rows are encoded alike, a text of any length passes through a state of bounded size, and
    an empty table gives none. A column named like `out` is replaced, unless it is the text itself, which then gives way to its ids.
    """
    return _mapped(docs, text, out, T.BinaryType(), pa.binary(), lambda: coder(ranks, pattern).encode)


def decode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns with `out`, the text of packed ids; null ids give null, no ids the empty text. Ids that are no token raise an error.

    Bytes that form no character become U+FFFD each time they break off; a column named like `out` is replaced.
    """
    return _mapped(docs, ids, out, T.StringType(), pa.string(), lambda: coder(ranks, pattern).decode)
