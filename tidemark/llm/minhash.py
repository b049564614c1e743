"""One-permutation MinHash with optimal densification and packed low-order bits.

All five-word shingles of a text are hashed once. The top bits of a hash choose one of K bins, which keeps the least of its hashes. An empty
bin takes the value of the first filled bin in its own fixed random order of all bins, whatever the text, so equal sets give equal values
and each filled bin is as likely to be copied as any other. Each value is mixed with its bin's number. Only the `bits` low-order bits of each bin are stored. Two unequal values
agree in them with chance c = 2^-bits, so likeness is (share of agreeing bins - c) / (1 - c), at least 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, mixed, spread, with_field

WIDTH = 5
BINS = 1024
LOW_BITS = 4
#: Word hashes remembered per Python worker; the table starts anew when it is full.
REMEMBERED = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of all shingles of `width` words, A-Z lower-cased; a shorter text is one shingle of all its words, a wordless one has none."""
    parts = text.encode().lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, n)
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _ODD + mixed(each[i : n - k + 1 + i])
    return mixed(total)


@lru_cache(maxsize=2)
def orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a fixed random order of all bins, and the place of each bin in it."""
    with np.errstate(over="ignore"):
        keys = mixed(np.arange(1, bins * bins + 1, dtype=np.uint64) * _ODD).reshape(bins, bins)
    order = keys.argsort(axis=1).astype(np.uint16)
    place = np.empty_like(order)
    np.put_along_axis(place, order.astype(np.int64), np.arange(bins, dtype=np.uint16)[None, :], axis=1)
    return order, place


def densified(filled: np.ndarray, bins: int = BINS) -> np.ndarray:
    """For every bin the bin whose value it takes: itself if filled, else the first filled one in its order."""
    source = np.arange(bins)
    has = np.zeros(bins, bool)
    has[filled] = True
    empty = np.flatnonzero(~has)
    if not len(empty):
        return source
    order, place = orders(bins)
    if len(filled) <= 64:
        source[empty] = filled[place[np.ix_(empty, filled)].argmin(axis=1)]
        return source
    at = 0
    while len(empty):
        tried = order[empty, at : at + 16]
        hit = has[tried]
        found = hit.any(axis=1)
        source[empty[found]] = tried[found, hit[found].argmax(axis=1)]
        empty = empty[~found]
        at += 16
    return source


def packed_bits(values: np.ndarray, bits: int) -> bytes:
    """The `bits` low-order bits of each value, one after another."""
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def sketch(text: str | None, bins: int = BINS, bits: int = LOW_BITS, width: int = WIDTH) -> bytes:
    """Packed fingerprint of a text; a text without words has the empty one."""
    hashes = np.unique(shingle_hashes(text, width))
    if not len(hashes):
        return b""
    shift = np.uint64(64 - (bins - 1).bit_length())
    at = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    values = np.zeros(bins, np.uint64)
    values[at[first]] = hashes[first]
    # mixed with the bin's number, so that bins which copy one value agree by chance each on its own
    return packed_bits(mixed(values[densified(at[first], bins)] + np.arange(bins, dtype=np.uint64) * _ODD), bits)


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = LOW_BITS) -> float:
    """Estimated share of common shingles, 0 to 1; two wordless texts are alike, a wordless and another one are not."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8))[: bins * bits].reshape(bins, bits)
    agree = 1 - x.any(axis=1).mean()
    chance = 2.0**-bits
    return float(max(0.0, (agree - chance) / (1 - chance)))


def written(fp: bytes) -> str:
    return base64.b64encode(fp).decode()


def _checked(bins: int) -> int:
    if bins < 2 or bins & (bins - 1) or bins > 1 << 12:
        raise ValueError("bins must be a power of two from 2 to 4096")
    return bins


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS, bits: int = LOW_BITS) -> DataFrame:
    """All columns of `docs`, with the packed fingerprint in base64. Null texts count as empty; a column named like `out` is replaced."""
    _checked(bins)
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [written(sketch(t, bins, bits)) for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*kept, out])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    return in_batches(frame, run, with_field(frame, out, T.StringType()))


NEIGHBOUR_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")


def neighbour_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = LOW_BITS) -> DataFrame:
    """Fingerprint every text and its edited text, and compare both with the text that follows in order of ids.

    The edited text has its last floor(n/2) code points replaced by as many first ones (or all) of the next document; the first follows
    the last. Ids are cut at percentiles of the whole table into one range per shuffle partition. A range also receives copies of the
    rows at the next range's lower end, so every task sees the neighbour of its last row in one sorted pass; nothing is gathered.
    Null texts count as empty. Null ids come first; rows of equal ids follow each other in order of their texts. An empty table gives none.
    """
    _checked(bins)
    least = -(1 << 63)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(F.col(doc_id).cast("bigint"), F.lit(least)).alias("key"))
    n = spread(docs.sparkSession)
    shares = [i / n for i in range(1, n)] or [0.5]
    row = rows.select("key").agg(F.min("key").alias("least"), F.percentile_approx("key", shares, 10 * n + 1000).alias("cuts")).first()
    lowest = row["least"] if row["least"] is not None else 0
    cuts = np.array(sorted({lowest, *(row["cuts"] or [])}), np.int64)
    last = len(cuts) - 1

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, key.to_numpy(), side="right") - 1
        return pd.Series(2 * at + (cuts[at] == key.to_numpy()), dtype="int32")

    found = rows.withColumn("at", place("key"))
    part = F.floor(F.col("at") / 2).cast("int")
    own = F.struct(part.alias("part"), F.lit(0).alias("wrap"), F.lit(True).alias("own"))
    wraps = (part == 0).cast("int")
    ahead = F.struct(F.when(part == 0, F.lit(last)).otherwise(part - 1).alias("part"), wraps.alias("wrap"), F.lit(False).alias("own"))
    copies = found.select("id", "text", "key", F.explode(F.when(F.col("at") % 2 == 1, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = copies.select("to.part", "to.wrap", "to.own", "key", "id", "text").repartitionById(last + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("wrap", "key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("own", "id", "text")]
            for own_, id_, text_ in zip(*cols):
                fp = sketch(text_, bins, bits) if own_ or held else b""
                if held:
                    id0, text0, fp0 = held
                    half = len(text0) // 2
                    edited = text0[: len(text0) - half] + text_[:half]
                    fp1 = sketch(edited, bins, bits)
                    out.append((id0, len(text0), hashlib.sha256(edited.encode()).hexdigest(), written(fp0), written(fp1),
                                likeness(fp0, fp1, bins, bits), likeness(fp0, fp, bins, bits)))
                held = (id_, text_, fp) if own_ else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=_NEIGHBOUR)

    return in_batches(dealt, run, NEIGHBOUR_SCHEMA)


_NEIGHBOUR = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
