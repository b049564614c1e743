"""Quality classifier learnt from trusted positives and unlabelled text by the non-negative risk of positive-unlabelled learning.

The model is linear in fixed features of a text. With the squared loss l(z) = (1 - z)^2 / 4 the risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

needs only first and second moments of the features over positives P and over unlabelled text U, so one pass sums them over all documents
and the rest is arithmetic on small matrices. Where the second term is negative, a step of its ascent takes the place of descent. The prior
is the least ratio of U to P above any threshold of a first positive-against-unlabelled score. A last logistic scale, fitted to the
labelled rows of the training folds, turns g into a chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, staged, with_field

THRESHOLD = 0.7
#: Labelled rows that the fit may use at most; the first so many in the order of a hash of their ids.
LABELLED_BOUND = 200_000
FOLDS, HELD_OUT = 4, 2
BINS = 512
SHRINK = 32
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "stop": b".,;:?'\"-()",
            "bang": b"!", "bar": b"|", "mark": b"#*$%&<>", "other": b"@[\\]^_`{}~/+="}
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _k] = 1
_TABLE[128:, -1] = 1
_STEPS = (0.01, 0.03, 0.1, 0.3)


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte classes and of repeated words and lines, the mean word, and steps of each share; nothing about where the text is from.

    Shares are taken of `SHRINK` more bytes, so that those of a few words stay small.
    """
    data = text or b""
    n = len(data) + SHRINK
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / n
    words = data.split()
    m = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = [1 - len(set(words)) / m, sum(map(eq, words, words[1:])) / m, sum(map(eq, words, words[2:])) / m,
               1 - len(set(lines)) / max(len(lines), 1)]
    letters = shares[0] + shares[1] + shares[-1]
    ratios = np.r_[shares, repeats, shares[0] / letters if letters else 0.0]
    steps = np.tanh(ratios[:, None] / np.array(_STEPS)).ravel()
    return np.r_[1.0, ratios, min(len(data) / m, 40.0) / 40, steps]


WIDTH = len(features(b""))


def add_features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """All columns but the text, with its features. Null texts count as empty."""
    kept = [c for c in docs.columns if c not in (text, out)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(len(kept)).to_pylist()], np.float32).reshape(-1, WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], names=[*kept, out])

    return in_batches(frame, run, with_field(frame, out, T.ArrayType(T.FloatType())))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def moments(rows: DataFrame, column: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and second moment of the features; every task gives one row of sums and one row per task group reaches the driver."""
    width = WIDTH

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0))
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])

    cells = rows.select(column).mapInArrow(sums, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    second = np.zeros(width * width)
    second[cells["at"].to_numpy()] = cells["x"].to_numpy()
    second = second.reshape(width, width)
    n = second[0, 0]
    second = second / n if n else second
    return n, second[0], second


def histogram(rows: DataFrame, w: np.ndarray, bins: int = BINS, column: str = "features") -> np.ndarray:
    """Rows per bin of the score clipped to -1..1, for all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            z = np.clip(matrix(batch.column(0)) @ w, -1, 1)
            total += np.bincount(np.minimum(((z + 1) / 2 * bins).astype(np.int64), bins - 1), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins)), pa.array(total)], names=["bin", "n"])

    found = rows.select(column).mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(bins)
    out[found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def class_prior(unlabelled: np.ndarray, positive: np.ndarray, doubt: float = 0.1) -> float:
    """Ratio of the two shares above the threshold whose ratio has the least upper bound, at the confidence 1 - `doubt`."""
    n_u, n_p = max(unlabelled.sum(), 1), max(positive.sum(), 1)
    u, p = unlabelled[::-1].cumsum() / n_u, positive[::-1].cumsum() / n_p
    slack = np.sqrt(np.log(4 / doubt) / 2 / n_u) + np.sqrt(np.log(4 / doubt) / 2 / n_p)
    tried = p > 0
    if not tried.any():
        return 0.5
    ratio = u[tried] / p[tried]
    return float(np.clip(ratio[(ratio + slack / p[tried]).argmin()], 0.01, 0.99))


def nn_pu_weights(prior: float, m_p: np.ndarray, s_p: np.ndarray, m_u: np.ndarray, s_u: np.ndarray, ridge: float = 1e-3,
                  rounds: int = 4000) -> np.ndarray:
    """Minimise the non-negative risk by gradient steps, scaled by the curvature of the whole risk."""
    own = np.eye(len(m_p)) * ridge
    own[0, 0] = 0
    scale = np.linalg.pinv(s_u / 2 + own + 1e-9 * np.eye(len(m_p)))
    w = np.zeros(len(m_p))
    for _ in range(rounds):
        negative = ((1 + 2 * w @ m_u + w @ s_u @ w) - prior * (1 + 2 * w @ m_p + w @ s_p @ w)) / 4
        slope = ((m_u + s_u @ w) - prior * (m_p + s_p @ w)) / 2
        if negative < 0:
            w = w + 0.1 * scale @ slope
        else:
            w = w - 0.1 * scale @ (prior * (s_p @ w - m_p) / 2 + slope + own @ w)
    return w


def logistic_scale(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the chance of label 1 given the score, by Newton steps on smoothed labels."""
    if not len(z):
        return 4.0, 0.0
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[z, np.ones(len(z))]
    ab = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p))
        ab = ab + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(ab[0], 0.0)), float(ab[1])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Weights of the features, and slope and shift of the logistic scale."""

    weights: np.ndarray
    slope: float
    shift: float
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights) + self.shift, -30, 30)))


def fit(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", labelled_bound: int = LABELLED_BOUND) -> Model | None:
    """Model of rows with features, all of which are the unlabelled side; None if no row has a positive label.

    Labels are read only of rows outside the held-out fold, at most `labelled_bound` of them; null labels and ids are no labels, and an
    id labelled twice counts as positive only if all its labels are.
    """
    trusted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    trusted = trusted.groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    bounded = trusted.orderBy(F.xxhash64("_id"), "_id").limit(labelled_bound)
    known = staged(rows.select(doc_id, "features").join(bounded, F.col(doc_id) == F.col("_id")).select("features", "_label"), "pu-labelled")
    positives = known.where("_label = 1")
    n_p, m_p, s_p = moments(positives)
    if not n_p:
        return None
    _, m_u, s_u = moments(rows)
    ridge = 1e-3 + 1 / n_p
    first = np.linalg.solve((s_u + s_p) / 2 + ridge * np.eye(WIDTH), (m_p - m_u) / 2)
    first /= max(np.sqrt(first @ s_u @ first) * 3, 1e-9)
    prior = class_prior(histogram(rows, first), histogram(positives, first))
    w = nn_pu_weights(prior, m_p, s_p, m_u, s_u, ridge)
    seen = known.toArrow()  # rows of at most labelled_bound ids
    return Model(w, *logistic_scale(matrix(seen.column("features").combine_chunks()) @ w, seen.column("_label").to_numpy()), prior)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """All columns of `docs` but the text, with held_out, score and predicted.

    The model is fitted to `docs` and the labels that `fit` may use. Null and empty texts are scored as empty ones, repeated rows alike.
    Without any positive label every score is 0.5; an empty table gives none. Added columns replace those of their names.
    """
    fresh = docs.drop("features", "held_out", "score", "predicted")
    rows = staged(add_features(fresh, text), "pu-features")
    model = fit(rows, labels, doc_id, label, labelled_bound)
    kept = [c for c in rows.columns if c != "features"]
    frame = rows.select(*[F.col(f"`{c}`") for c in kept], "features")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model(matrix(batch.column(len(kept)))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score)], names=[*kept, "score"])

    out = frame.mapInArrow(run, T.StructType([*frame.drop("features").schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumns({"held_out": held_out(doc_id), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """The rows of `docs` that the model predicts to be good, with all their columns. Without any positive label all rows stay."""
    rows = staged(add_features(docs.select(doc_id, text), text), "pu-features")
    model = fit(rows, labels, doc_id, label, labelled_bound)
    if model is None:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([features(t.encode() if t else None) for t in batch.column(at).to_pylist()], np.float32).astype(np.float64)
                yield batch.filter(pa.array(model(x) >= THRESHOLD))

    return in_batches(docs, run, docs.schema, release=True)
