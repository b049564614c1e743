"""Packing of documents into token sequences along a space-filling curve.

A document's token counts are hashed to a signed vector, scaled to length one and projected to a few fixed random directions. The cell of
that point on a grid gives its Hilbert key, so documents near each other on the curve use similar tokens. All documents are range-sorted
by the key; their tokens follow each other without a gap and are cut every `length` tokens, so that only the end of the whole table needs
padding, and there the rest is cut in powers of two, which need none.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, spread, staged

LENGTH = 2048
END_ID = 1
DIRECTIONS = 4
GRID_BITS = 12
HASHED = 256
#: Estimated bytes of words and tokens that a Python worker remembers while it reads, and between tasks; the words met most often stay.
READING_BYTES = 140 << 20
RESTING_BYTES = 32 << 20
#: Characters of the longest word that is remembered.
SHORT = 64
#: Signs that end a word without changing the tokens before them, if what is left ends in one of `BODY_ENDS`: no apostrophe, nothing of `<|...|>`.
MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
BODY_ENDS = frozenset(string.ascii_letters + string.digits + "".join(chr(i) for i in range(0xE0, 0x100) if i != 0xF7))
#: Texts encoded at a time; the more, the fewer of their words are looked up again.
TEXTS = 2048
#: Characters of a text split at a time.
_STEP = 1 << 20


class WordTokens(dict):
    """Tokens of whole texts from those of their words, for vocabularies that never join what a space or line feed parts.

    They must not join letters and digits with marks that follow them either, and write in lower case: a new word is put together from what it
    is without its marks, in lower case, and the marks, so that the library is asked once for all forms of a word.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fresh: list[str] = []
        self.fresh_at: list[int] = []
        self.made: list[tuple[int, int, int]] = []
        self.flat, self.first = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)
        self.held = 0

    def thin(self, most: int) -> None:
        """Forget all but the words met most often, and long ones: the words that take `most` bytes."""
        words = list(self)
        sizes = np.diff(self.first)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cost = np.where(lengths > SHORT, most + 1, 270 + 4 * sizes + lengths)
        often = np.argsort(-self.met[: len(words)], kind="stable")
        often = often[cost[often] <= most]
        kept = np.sort(often[np.cumsum(cost[often]) <= most])
        sizes = sizes[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.first[kept] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.first = np.r_[0, ends]
        self.met = self.met[kept]
        # the words are written anew, side by side, so that the memory of the others can go back whole
        copies = [words[i].encode() for i in kept.tolist()]
        self.clear()
        del words
        self.update(zip(map(bytes.decode, copies), range(len(kept))))
        self.held = int(cost[kept].sum())

    def __missing__(self, word: str) -> int:
        body = word.rstrip(MARKS)
        marks = word[len(body):] if body[-1:] in BODY_ENDS else ""
        body = body if marks else word
        if body.isascii() and body.isalnum():
            body = body.lower()
        if body != word:
            made = self[body], self[marks]
            self[word] = at = len(self)
            self.made.append((at, *made))
        else:
            self[word] = at = len(self)
            self.fresh.append(word)
            self.fresh_at.append(at)
        self.held += 270 + 2 * len(word)
        return at

    def learn(self) -> None:
        """Find the tokens of the words met since the last call: the library's, or those of the two words that make one up."""
        old = len(self.first) - 1
        if len(self) == old:
            return
        found = [e.ids for e in self.library.encode_batch_fast(self.fresh, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum())])
        # where the tokens of each word lie in `flat`, in two stretches for what is made up
        start, size = np.zeros((2, len(self)), np.int64), np.zeros((2, len(self)), np.int64)
        start[0, :old], size[0, :old] = self.first[:-1], np.diff(self.first)
        at = np.array(self.fresh_at, np.int64)
        start[0, at], size[0, at] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        at, *parts = np.array(self.made, np.int64).reshape(-1, 3).T
        for k, one in enumerate(parts):
            start[k, at], size[k, at] = start[0, one], size[0, one]
        start, size = start[:, old:].T.ravel(), size[:, old:].T.ravel()
        ends = np.cumsum(size)
        self.flat = np.concatenate([self.flat, flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]])
        self.first = np.concatenate([self.first, self.first[-1] + ends[1::2]])
        for one in (self.fresh, self.fresh_at, self.made):
            one.clear()

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and where each text ends."""
        if self.held > READING_BYTES:
            self.thin(READING_BYTES // 2)
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if (pc.max(pc.binary_length(texts)).as_py() or 0) > _STEP:
            split = [list(parts(t)) for t in texts.to_pylist()]
            counts = np.array([sum(map(len, stretches)) for stretches in split], np.int64)
            words = chain.from_iterable(chain.from_iterable(split))
            at = np.fromiter(map(self.__getitem__, words), np.int64, counts.sum())
        else:  # each different word is looked up once
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            counts = pc.list_value_length(split).to_numpy().astype(np.int64)
            named = split.flatten().dictionary_encode()
            words = named.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))[named.indices.to_numpy()]
        self.learn()
        met = np.bincount(at, minlength=len(self))
        met[: len(self.met)] += self.met
        self.met = met
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, ends[np.cumsum(counts) - 1]  # every text has a word, if only an empty one


def parts(text: str) -> Iterator[list[str]]:
    """Words of a text, a stretch at a time; stretches end at a space."""
    at = 0
    while True:
        end = text.find(" ", at + _STEP) if len(text) - at > _STEP else -1
        yield text[at : end if end >= 0 else len(text)].replace("\n", " ").split(" ")
        if end < 0:
            return
        at = end + 1


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=4)
def projection(hashed: int, directions: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((hashed, directions)) / 2.0


def points(ids: np.ndarray, ends: np.ndarray, directions: int = DIRECTIONS, hashed: int = HASHED) -> np.ndarray:
    """For each run of ids its hashed, signed and scaled counts on the fixed directions, about -1 to 1 each; zero without tokens."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    run = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    cell = run * hashed + ((h >> np.uint64(40)) % np.uint64(hashed)).astype(np.int64)
    vectors = np.bincount(cell, sign, len(ends) * hashed).reshape(len(ends), hashed)
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(size > 0, size, 1) @ projection(hashed, directions)


def hilbert_key(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits (the transpose form of the curve, then interleaved)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def grid(points: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    side = 1 << bits
    return np.clip(((points + 1) / 2 * side).astype(np.int64), 0, side - 1)


def tail_cuts(total: int, length: int) -> list[int]:
    """Where the last, incomplete sequence is cut: its powers of two, the largest first."""
    at = total - total % length
    cuts = []
    for b in range(length.bit_length(), -1, -1):
        if (total % length) >> b & 1:
            at += 1 << b
            cuts.append(at)
    return cuts


def pieces_of(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of a document that lies at `start` of the whole row of tokens."""
    whole = total - total % length
    cuts = list(range(start - start % length + length, min(start + n, whole) + 1, length))
    tail = tail_cuts(total, length)
    cuts += [c for c in tail if start < c <= start + n]
    ends = [c for c in cuts if c < start + n] + [start + n]
    out, at = [], start
    for end in ends:
        if at < whole:
            seq, off = divmod(at, length)
        else:
            k = next(i for i, c in enumerate(tail) if at < c)
            seq, off = whole // length + k, at - (tail[k - 1] if k else whole)
        out.append((at - start, end - at, seq, off))
        at = end
    return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
         release: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every document is its tokens under the file `tokenizer`, without special ones added, and `end_id`; a null or empty text is `end_id`
    alone. Documents lie one after another in order of their Hilbert keys (ties by id, then by place in the input) and may be cut anywhere.
    Repeated rows and null ids are packed like any other; other columns are ignored; an empty table gives no piece.
    The texts are encoded once and written to the shared folder. Only key, id and size are range-sorted; the sums of the ranges, one number
    a shuffle partition, pass the driver. With `release`, for steps of a pipeline, workers keep only the commonest words between tasks and give
    memory back; else they keep their words, which is faster where packing is all they do.
    """
    frame = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokens(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                flat, ends = model.encode(part.column(1))
                keys = hilbert_key(grid(points(flat, ends)))
                n = len(ends)
                flat = np.insert(flat, ends, end_id)
                ends = ends + np.arange(1, n + 1)
                sizes = np.diff(ends, prepend=0)
                # two bytes a token wherever the vocabulary allows
                narrow = flat.max() < 1 << 16
                data = flat.astype("<u2" if narrow else "<u4").tobytes()
                width = 2 if narrow else 4
                cuts = [data[width * (e - k) : width * e] for e, k in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + n), pa.int64()), part.column(0), pa.array(keys, pa.int64()), pa.array(sizes), pa.array(cuts, pa.binary())],
                    names=["row", "doc_id", "key", "n", "data"])
                row += n
        if release:
            model.thin(RESTING_BYTES)

    held = staged(in_batches(frame, encode, "row bigint, doc_id bigint, key bigint, n bigint, data binary", release=release), "pack-tokens")
    order = ["key", "doc_id", "row"]
    parts_ = spread(docs.sparkSession)
    sorted_ = held.select("row", "doc_id", "key", "n").repartitionByRange(parts_, *order).sortWithinPartitions(*order)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(3).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), batch.column(3)],
                                             names=["row", "part", "local", "n"])
            at = int(ends[-1]) if len(n) else at

    placed = staged(sorted_.mapInArrow(place, "row bigint, part bigint, local bigint, n bigint"), "pack-order")
    sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(sums):
        first[part], total = total, total + sums[part]
    spark = docs.sparkSession
    base = F.broadcast(spark.createDataFrame([(p, f) for p, f in first.items()], "part bigint, first bigint"))  # one row a partition
    where = placed.join(base, "part").select("row", (F.col("first") + F.col("local")).alias("at"))
    joined = held.join(where, "row").select("doc_id", "n", "at", "data")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = []
                for id_, n, at, data in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns)):
                    ids = memoryview(data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes())
                    rows += [(id_, s, k, bytes(ids[4 * s : 4 * (s + k)]), n, seq, off) for s, k, seq, off in pieces_of(at, n, total, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return in_batches(joined, cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint", release=release)
