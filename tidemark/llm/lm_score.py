"""Scores of documents by the difference of two language models' cross-entropies.

A target and a background model, both bigram models smoothed by their unigrams, share one vocabulary: all words of the corpus and one unknown
word. The loss of a token under either is

    -ln p(w | h),  p(w | h) = (c(h, w) + weight * p(w)) / (c(h) + weight),  p(w) = (c(w) + add) / (n + add * vocabulary)

and a document's score is the mean over its tokens of target loss less background loss: the lower, the closer to the target. What a
document itself adds to the counts of a model is taken off before it is scored (for texts beyond a chunk, what each piece of it adds), so
that neither model has seen what it judges.

Counts are exact and cover every document. Texts are cut into chunks of bounded size, whose tokens are written once. A chunk asks once for each
different word and bigram in it: sorted 64-bit hashes go, packed, to buckets by their leading bits, together with the chunk's own counts. A
bucket adds the counts of all chunks and answers each with totals in the order of its request. The number of buckets grows with the
tokens, so no task holds more than a bucket or a chunk, and a frequent word or bigram weighs one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, spread, staged

#: Tokens in a chunk, and tokens of the corpus per bucket.
CHUNK = 1 << 19
BUCKET = 1 << 20
WEIGHT = 10.0
ADD = 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs, the bytes of equal weight together, so that a codec finds the zeros."""
    size = np.min_scalar_type(int(values.max()) if len(values) else 0).itemsize
    return bytes([size]) + np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) or 1


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _ODD ^ (second + (first << np.uint64(7)) + (first >> np.uint64(3)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Tokens of pieces of documents: one row of word numbers, each piece with the token before it in front."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, target: np.ndarray, vocabulary: np.ndarray):
        ends = np.cumsum(sizes)
        inner = np.ones(len(tokens), bool)
        inner[ends - sizes] = False  # what is in front of a piece
        self.piece = np.repeat(np.arange(len(sizes)), sizes)[inner]
        self.second = tokens[inner]
        self.first = tokens[:-1][inner[1:]] if len(tokens) else tokens
        self.target = np.repeat(target, sizes)[inner]
        self.vocabulary = vocabulary
        pairs = pair_hashes(vocabulary[self.first], vocabulary[self.second])
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)

    def requests(self) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(kind, sorted keys, counts): of words as tokens and as histories, and of pairs, in all documents and in target ones."""
        n = len(self.vocabulary)
        counts = [np.bincount(x, w, n).astype(np.uint64) for x in (self.second, self.first) for w in (None, self.target.astype(float))]
        pairs = [np.bincount(self.pair_at, w, len(self.pairs)).astype(np.uint64) for w in (None, self.target.astype(float))]
        return [(0, self.vocabulary, counts), (1, self.pairs, pairs)]


def own_counts(piece: np.ndarray, x: np.ndarray, different: int) -> np.ndarray:
    """For every token how often its piece holds the same x."""
    _, at, n = np.unique(piece * different + x, return_inverse=True, return_counts=True)
    return n[at]


def _chunks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows chunk, rows (document numbers), ids, sizes, tokens, vocabulary from rows id, text."""
    part = TaskContext.get().partitionId() << 40
    number = {}
    held: dict[str, list] = {"row": [], "id": [], "size": [], "tokens": []}
    total, at, row = 0, part, part

    def full() -> pa.RecordBatch:
        words = np.fromiter(number, object, len(number))
        hashes = np.fromiter((_START if w is None else word_hash(w) for w in words), np.uint64, len(words))
        vocabulary, place = np.unique(hashes, return_inverse=True)
        tokens = place[np.concatenate(held["tokens"])]
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([held["row"]], pa.list_(pa.int64())), pa.array([held["id"]], pa.list_(pa.int64())),
             pa.array([held["size"]], pa.list_(pa.int64())), pa.array([pack(tokens)], pa.binary()), pa.array([pack_sorted(vocabulary)], pa.binary())],
            names=["chunk", "rows", "ids", "sizes", "tokens", "vocabulary"])

    for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
        for id_, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = [None, *(text or b"").split()]
            for lo in range(0, max(len(words) - 1, 1), chunk):
                piece = words[lo : lo + chunk + 1]
                tokens = np.fromiter((number.setdefault(w, len(number)) for w in piece), np.int64, len(piece))
                for k, v in (("row", row), ("id", id_), ("size", len(piece)), ("tokens", tokens)):
                    held[k].append(v)
                total += len(piece)
                if total >= chunk:
                    yield full()
                    number.clear()
                    held, total, at = {k: [] for k in held}, 0, at + 1
            row += 1
    if total:
        yield full()


def _chunk_of(row: dict) -> Chunk:
    target = np.zeros(len(row["sizes"]), bool)
    target[row["marked"] or []] = True
    return Chunk(unpack(row["tokens"]).astype(np.int64), np.array(row["sizes"], np.int64), target, unpack_sorted(row["vocabulary"]))


def entropy_difference(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", weight: float = WEIGHT,
                       add: float = ADD, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row; losses are means over the tokens of the whole text.

    The target is the documents whose ids are in column `doc_id` of `targets` (null matches none, repeated ids once), the background is all
    documents. Words are runs of non-blank bytes, as they are written. Texts without words, null ones included, have 0 tokens, losses and
    score. Repeated rows count and are scored repeatedly; other columns are ignored; an empty table gives none. Without target documents
    the target model is uniform.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    cut = staged(in_batches(frame, lambda b: _chunks(b, chunk), "chunk bigint, rows array<bigint>, ids array<bigint>, sizes array<bigint>, "
                                                               "tokens binary, vocabulary binary"), "lm-chunks")
    # the target's places in each chunk: written first, so that the join is planned by its size
    wanted = targets.select(F.col(doc_id).cast("bigint").alias("id")).distinct()
    places = cut.select("chunk", F.posexplode("ids").alias("place", "id")).join(wanted, "id", "left_semi")
    marked = staged(places.groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias("marked")), "lm-marked")
    held = cut.join(marked, "chunk", "left")
    tokens = cut.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(4 * spread(spark), -(-tokens // bucket))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                rows = []
                for kind, keys, counts in _chunk_of(row).requests():
                    at = bucket_of(keys, buckets)
                    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                        rows.append((int(at[lo]), row["chunk"], kind, pack_sorted(keys[lo:hi]), [pack(c[lo:hi]) for c in counts]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())))],
                                                 names=["bucket", "chunk", "kind", "keys", "counts"])

    asked = in_batches(held.select("chunk", "sizes", "marked", "tokens", "vocabulary"),
                       ask, "bucket bigint, chunk bigint, kind int, keys binary, counts array<binary>")

    def answer(group: pa.Table) -> pa.Table:
        bucket_, rows = group.column("bucket")[0].as_py(), group.drop_columns("bucket").to_pylist()
        out, n = [], [0, 0, 0]
        for kind in (0, 1):
            own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["chunk"])
            if not own:
                continue
            keys = [unpack_sorted(r["keys"]) for r in own]
            all_, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = []
            for k in range(len(own[0]["counts"])):
                each = np.concatenate([unpack(r["counts"][k]) for r in own])
                total = np.zeros(len(all_), np.uint64)
                np.add.at(total, at, each)
                totals.append(total)
            if kind == 0:
                n = [int(totals[0].sum()), int(totals[1].sum()), int((totals[0] > 0).sum())]
            lo = 0
            for r, k in zip(own, keys):
                here = at[lo : lo + len(k)]
                out.append((r["chunk"], bucket_, kind, [pack(t[here]) for t in totals], 0, 0, 0))
                lo += len(k)
        out.append((-1, bucket_, -1, [], *n))  # what the whole corpus adds up to
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWER)], schema=_ANSWER)

    answers = staged(asked.groupBy("bucket").applyInArrow(
        answer, "chunk bigint, bucket bigint, kind int, totals array<binary>, words bigint, target_words bigint, different bigint"), "lm-answers")
    n_all, n_target, different = answers.where("kind = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target_words", "different")]).first()
    vocabulary = different + 1

    def score(chunks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        order = found.drop_columns("chunk").sort_by("bucket").to_pylist()
        for row in chunks.to_pylist():
            c = _chunk_of(row)
            words, pairs = ([np.concatenate([unpack(r["totals"][k]) for r in order if r["kind"] == kind] or [np.empty(0)]).astype(float)
                             for k in range(n)] for kind, n in ((0, 4), (1, 2)))
            own = [own_counts(c.piece, x, max(len(c.vocabulary), len(c.pairs))) for x in (c.second, c.first, c.pair_at)]
            tokens = (np.array(row["sizes"]) - 1)[c.piece]
            losses = []
            for m, total in ((1, n_target), (0, n_all)):
                seen = c.target if m else 1
                single = (words[m][c.second] - own[0] * seen + add) / (total - tokens * seen + add * vocabulary)
                given = (pairs[m][c.pair_at] - own[2] * seen + weight * single) / (words[2 + m][c.first] - own[1] * seen + weight)
                losses.append(np.bincount(c.piece, -np.log(given), len(row["rows"])))
            out.append(pa.table({"row": row["rows"], "id": pa.array(row["ids"], pa.int64()), "n": np.array(row["sizes"], np.int64) - 1,
                                 "target": losses[0], "background": losses[1]}))
        return pa.concat_tables(out) if out else pa.table({k: [] for k in ("row", "id", "n", "target", "background")})

    parts = held.groupBy("chunk").cogroup(answers.where("kind >= 0").select("chunk", "bucket", "kind", "totals").groupBy("chunk")).applyInArrow(
        score, "row bigint, id bigint, n bigint, target double, background double")
    whole = parts.groupBy("row").agg(F.first("id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.col(x) / F.col("n_tokens")).otherwise(F.lit(0.0))
    return whole.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("totals", pa.list_(pa.binary())), ("words", pa.int64()),
                     ("target_words", pa.int64()), ("different", pa.int64())])
