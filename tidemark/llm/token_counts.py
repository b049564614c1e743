"""Token counts of byte-pair encodings by heap and linked list, without building identifiers.

A text is cut at special strings, each of which counts as one token, and then by the vocabulary's own pattern. Every piece starts as one
symbol per byte, chained to its neighbours; a heap gives the adjacent pair of the lowest rank (the leftmost of equals) until none is left.
Each merge removes one symbol, so the count is the number of bytes less the number of merges. Counts of pieces are remembered per worker
in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, with_field

# fixed values: the pattern of byte-level vocabularies, white space named by its Unicode property
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pieces remembered per Python worker; the table starts anew when it is full.
REMEMBERED = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PairMerger(dict):
    """Piece -> number of tokens; missing pieces are counted by merging."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbols = [vocab[s] for s in byte_symbols()]
        self.pieces = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n = self.merged(piece.encode())
        return n

    def merged(self, data: bytes) -> int:
        """Symbols left of `data` once no adjacent pair has a rank."""
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        ids = [self.symbols[b] for b in data]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            found = merges.get(ids[i] << 32 | ids[j])
            if not found or found[0] != rank:  # one of the two has changed since
                continue
            ids[i], ids[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(ids[i] << 32 | ids[k]):
                    heappush(heap, (m[0], i))
            h = before[i]
            if h >= 0 and (m := merges.get(ids[h] << 32 | ids[i])):
                heappush(heap, (m[0], h))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces.findall(p))) for p in parts)


@lru_cache(maxsize=4)
def merger(path: str, pattern: str = PATTERN) -> PairMerger:
    return PairMerger(path, pattern)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", pattern: str = PATTERN) -> DataFrame:
    """All columns but the text, with `out`: tokens of the whole text under the byte-level vocabulary file `vocabulary`.

    The file must lie at the same path on every worker. Null and empty texts have 0 tokens; special strings in a text count as one token
    each; repeated rows are counted alike. A column named like `out` is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, out)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(vocabulary, pattern)
        for batch in batches:
            counts = [model.count(t) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], names=[*kept, out])

    return in_batches(frame, run, with_field(frame, out, T.LongType()))
