"""Importance resampling towards a target distribution: hashed word n-grams, log-ratio weights, Gumbel top-k.

A 256-byte table lower-cases A-Z and blanks all ASCII but digits and letters, straight in UTF-8, where no byte of a longer character is ASCII;
bytes.split then gives the words. The CRC-32 of an n-gram goes on from that of its first n - 1 words, so no n-gram is ever built. Counters
reduce the buckets of a partition. Texts are read twice, to count and to weigh, and never shuffled; only counts per bucket, of which there is
a fixed number, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, placed_in_groups, staged

WIDTH = 2
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
#: Words whose n-grams are hashed at a time, so that a very long text needs no long lists.
STEP = 1 << 16
#: Bytes that part words are all ASCII but digits and letters; A-Z become a-z, everything else stays.
TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def features(words: list[bytes], width: int = WIDTH, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all runs of one to `width` words, joined by blanks, some at a time."""
    for at in range(0, len(words), STEP):
        own = words[at : at + STEP + width - 1]
        seeds = list(map(crc32, own[:STEP]))
        yield np.array(seeds, np.uint32) % np.uint32(buckets)
        for n in range(1, width):
            seeds = list(map(crc32, [b" " + w for w in own[n:]], seeds))
            yield np.array(seeds, np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: one Counter a partition, then one sum a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for some in features(words_of(data), width, buckets):
                    held.update(some.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["bucket", "n"])

    counted = in_batches(texts.select(F.col(text).cast("binary").alias("text")), run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the buckets' smoothed shares, floored."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", width: int = WIDTH) -> DataFrame:
    """All columns but the text, with n_words, n_features and weight: the floored mean of the features' gains, 0 without features."""
    kept = [c for c in docs.columns if c not in (text, "n_words", "n_features", "weight")]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias("_text"))
    added = T._parse_datatype_string("n_words bigint, n_features bigint, weight bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(len(kept)).to_pylist():
                words = words_of(data)
                n, total = 0, 0
                for some in features(words, width, len(gain)):
                    n += len(some)
                    total += int(gain[some].sum())
                rows.append((len(words), n, total // n if n else 0))
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(numbers[:, k]) for k in range(3))], names=[*kept, *added.names])

    return in_batches(frame, run, T.StructType([*frame.schema.fields[:-1], *added.fields]))


def gumbel(doc_id: str, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel draw from the first 32 bits of the SHA-256 of `seed:doc_id`; a null id counts as the empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, buckets: int = BUCKETS,
              least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; the best `share` percent of those long enough have a rank.

    Weights are those of the hashed n-grams of `docs` against all texts of `target`. Ranks go by descending score, equal ones by ascending
    id (null last), then by n_words and weight; repeated rows take ranks of their own. Null and empty texts have no features and weight 0; texts
    of any length count as a whole; an empty table gives none, an empty target weighs by its smoothing alone. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gain = gains(bucket_counts(rows, "text", width, buckets), bucket_counts(target.select(F.col("text")), "text", width, buckets))
    scored = weighed(rows, gain, "text", width).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = staged(scored, "resampling-scored")
    enough = scored.where(F.col("n_words") >= least_words).withColumn("all", F.lit(0).cast("bigint"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_words", "weight"]
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    placed = placed_in_groups(enough, "all", order, {c: F.col(c) for c in columns}, "resampling-placed")
    drawn = share * enough.count() // 100
    ranked = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    short = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(short)
