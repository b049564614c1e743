from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_cases import LONG, messy, nothing  # noqa: F401
from tidemark.llm import queries, resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, share=25, least=20):
    def buckets(text):
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        runs = [b" ".join(words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r) % 10_000 for r in runs]

    made = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, bs in made for b in bs), Counter(b for x in target for b in buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(big_s + 10_000) / (float(s[b] + 1) * float(big_t + 10_000)))) for b in s}
    rows = []
    for i, words, bs in made:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    for k, r in enumerate(enough[: share * len(enough) // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in rows), key=str)


def test_query_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    found = queries.op13_importance_resampling(spark, d)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(((r[0], *r[2:]) for r in brute(docs, target)), key=str)


@pytest.mark.parametrize("share", [0, 50, 100])
def test_ties_repeats_and_messy_rows(spark, messy, nothing, share):
    """Equal scores, null ids, repeated rows and texts without words; sorted shards far smaller than the groups of equal rows."""
    docs = [(r.doc_id, r.text) for r in messy.collect()] + [(8, "same words " * 20)] * 40 + [(8, "other words " * 20), (None, "a b " * 30), (-3, "é ü " * 11 + "..")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, score int, rank int").repartition(3)
    target = spark.createDataFrame([("same words of a benchmark",), (None,), ("",)], "text string")
    found = resampling.resampled(df, target, share=share).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(docs, [r.text for r in target.collect()], share)
    assert resampling.resampled(nothing, target).count() == 0


def test_empty_target(spark):
    docs = [(i, f"w{i} " * 25) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = resampling.resampled(df, df.where("false").select("text")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(docs, [])


def test_long_texts_in_steps(monkeypatch):
    whole = np.sort(np.concatenate(list(resampling.features(resampling.words_of(LONG.encode()), 3))))
    monkeypatch.setattr(resampling, "STEP", 7)
    assert (np.sort(np.concatenate(list(resampling.features(resampling.words_of(LONG.encode()), 3)))) == whole).all()


def test_words_are_cut_in_bytes():
    text = "Ünï cO-de é\x00x\x7fy_z [A]{B}`9:;é漢字\U0001f600 ÀB\x1fc"
    assert resampling.words_of(text.encode()) == WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    assert list(resampling.features([])) == []
