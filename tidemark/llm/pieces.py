"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi search, and decoding.

The automaton holds all ordinary pieces. As it reads a text it gives, for every position, the pieces that end there, the longest first, by
following its output links; each is relaxed from the place where it starts. The file at hand is a merge-order model: its scores are ranks, whose
sum means nothing, and what the library looks for is the one split that merging in their order leaves. A split is that one exactly if every two
neighbouring pieces would stay apart were they alone, so a link relaxes the best split of its start only if the last piece there and its own
stay apart; then each position has one best split, and it is the library's. A character that is no piece may be passed alone and becomes its
bytes. Where no piece of the vocabulary joins a blank to a character before it, a text falls into stretches that start with blanks, and the
pieces of a stretch are remembered per worker within a bound in bytes.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.byte_bpe import Merges
from tidemark.llm.common import in_batches, with_field

BLANK = "▁"
#: Estimated bytes of stretches whose ids a Python worker remembers, and of pairs known to stay apart or not; the tables start anew beyond.
STRETCH_BYTES = 96 << 20
PAIR_BYTES = 64 << 20
#: Characters of the longest stretch that is remembered.
SHORT = 64


class Characters(dict):
    """Texts of numbered pieces; numbers behind them are the characters that are no pieces."""

    def __init__(self, pieces: list[str]):
        super().__init__(enumerate(pieces))
        self.pieces = len(pieces)

    def __missing__(self, number: int) -> str:
        return chr(number - self.pieces)


class PieceMerges(Merges):
    """Merges of pieces, numbered by falling score; single characters are there from the start, pieces or not."""

    def __init__(self, pieces: list[str]):  # all texts are whole characters, so nothing is asked of single bytes
        self.ranks = {p: rank for rank, p in enumerate(pieces)}
        self.bytes_of = Characters(pieces)
        self.halves = {}
        self.known: dict[int, bool] = {}
        self.merged: dict[int, bool] = {}

    def sound(self, number: int) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        found = self.merged.get(number)
        if found is None:
            try:
                found = len(self.bytes_of[number]) == 1 or bool(self.split(number))
            except ValueError:
                found = False
            self.merged[number] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether piece `right` may come after `left` (-1: at the start)."""
        pair = (left + 1) << 32 | right
        found = self.known.get(pair)
        if found is None:
            if len(self.known) * 140 > PAIR_BYTES:
                self.known.clear()
            found = self.known[pair] = self.sound(right) and (left < 0 or self.apart(left, right))
        return found


class PieceModel(dict):
    """Stretch of text -> its piece ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, bound: int = STRETCH_BYTES):
        super().__init__()
        self.bound = bound
        self.held = 0
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        self.ids = plain
        self.merges = PieceMerges([pieces[i] for i in plain])
        self.automaton = ahocorasick.Automaton()
        for rank, i in enumerate(plain):
            self.automaton.add_word(pieces[i], (len(pieces[i]), rank))
        self.automaton.make_automaton()
        self.single = {pieces[i] for i in plain if len(pieces[i]) == 1}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the vocabulary has no byte pieces, so unknown characters can't be written")
        parts = any(BLANK in pieces[i].lstrip(BLANK) for i in plain)
        self.stretches = re.compile(r"(?s).+" if parts else r" +[^ ]*|[^ ]+")
        written = [b""] * n
        for i in plain:
            written[i] = pieces[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            written[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(written), np.uint8)
        self.sizes = np.fromiter(map(len, written), np.int64, n)
        self.first = np.cumsum(self.sizes) - self.sizes

    def __missing__(self, stretch: str) -> bytes:
        found = array("I", self.viterbi(stretch.replace(" ", BLANK)))
        if sys.byteorder == "big":
            found.byteswap()
        ids = found.tobytes()
        if len(stretch) <= SHORT:
            self.held += 260 + 2 * len(stretch) + len(ids)
            if self.held > self.bound:
                self.clear()
                self.held = 0
            self[stretch] = ids
        return ids

    def viterbi(self, s: str) -> list[int]:
        """Piece ids of the one split of `s` whose neighbours all stay apart."""
        n = len(s)
        last = [-1] * (n + 1)  # number of the last piece of the split of each prefix
        done = 0
        single, follows, unknown = self.single, self.merges.follows, len(self.ids)
        known = self.merges.known.get
        for end, (size, rank) in self.automaton.iter(s):
            while done < end:  # all pieces that end before this one are known
                if last[done + 1] < 0 and s[done] not in single and follows(last[done], unknown + ord(s[done])):
                    last[done + 1] = unknown + ord(s[done])
                done += 1
            if last[end + 1] >= 0:
                continue
            left = last[end + 1 - size]
            if left < 0 and size <= end:
                continue
            fits = known((left + 1) << 32 | rank)
            if follows(left, rank) if fits is None else fits:
                last[end + 1] = rank
        while done < n:
            if last[done + 1] < 0 and s[done] not in single and follows(last[done], unknown + ord(s[done])):
                last[done + 1] = unknown + ord(s[done])
            done += 1
        out: list[int] = []
        while n:
            piece = last[n]
            if piece >= unknown:
                out += [self.byte_ids[b] for b in reversed(s[n - 1].replace(BLANK, " ").encode())]
                n -= 1
            else:
                out.append(self.ids[piece])
                n -= len(self.merges.bytes_of[piece])
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, after the blank that the model puts before it. Null and empty texts have none."""
        return b"".join(map(self.__getitem__, self.stretches.findall(" " + text))) if text else b""

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids that end at `ends`: blanks for the blank sign, bytes joined to characters, the first blank dropped.

        Control and unknown ids give nothing.
        """
        sizes = self.sizes[ids]
        last = np.cumsum(sizes)
        data = self.flat[np.repeat(self.first[ids] - last + sizes, sizes) + np.arange(last[-1] if len(last) else 0)].tobytes()
        at = np.r_[0, last][ends].tolist()
        texts = [data[lo:hi].decode(errors="replace") for lo, hi in zip([0, *at], at)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns with `out`, the piece ids of the whole text (empty for null or empty texts). A column named like `out` is replaced.

    The model file must lie at the same path on every worker. Its normalisation must be the identity, with a blank put before the text.
    """
    kept = [c for c in docs.columns if c != out]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                data = [m.encode(t) for t in batch.column(kept.index(text)).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in data)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*kept, out])

    return in_batches(frame, run, with_field(frame, out, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns with `out`, the text of the piece ids; null ids give null."""
    kept = [c for c in docs.columns if c != out]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(kept.index(ids))
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
                there = lists.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t if v else None for t, v in zip(texts, there)], pa.string())], names=[*kept, out])

    return in_batches(frame, run, with_field(frame, out, T.StringType()))
