from __future__ import annotations

import base64
import gzip
import hashlib
import math
from collections import Counter

import pytest

from llm_cases import MESSY, documents, messy, nothing  # noqa: F401
from tidemark.llm import lm_score, queries, warc
from tidemark.llm.common import new_folder


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (7, None, "<p>one</p>"), (3, "http://c/ü\r\nX: y", ""), (4, "http://d", None),
         (5, "u", "é" * 50_000), (6, "v", "W\r\n\r\nWARC/1.1\r\n"), (None, "w", "<p>one</p>"), (7, "again", "<p>one</p>"), (8, "u", "é" * 50_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "s") for p in PAGES], "page_id bigint, url string, html string, size int, sum string").repartition(3)


@pytest.mark.parametrize("least", [0, 1])
def test_archives_round_trip(pages, least):
    manifest = warc.write_archives(pages, roll_bytes=300, least_bytes=least)
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        refers = top[h or ""] if len(data) >= least and (i is None or i < top[h or ""]) else None
        want.append((str(i), "response" if refers is None else "revisit", len(data), b32(data), str(refers), None if refers is not None else data))
    got = [(str(r.page_id), r.record_type, r.payload_bytes, r.payload_digest, str(r.refers_to), None if r.payload is None else bytes(r.payload))
           for r in warc.read_archives(manifest).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert manifest.count() > 4 and manifest.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_archives_are_equal_for_equal_input_and_plain_gzip(spark, pages):
    one, two = (warc.write_archives(pages, roll_bytes=2000).select("shard", "roll", "sha256", "path").collect() for _ in range(2))
    assert sorted(r[:3] for r in one) == sorted(r[:3] for r in two)
    _, path = warc.store(one[0].path)
    with gzip.open(path) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_only_what_the_manifest_lists_is_read(spark, pages):
    folder = new_folder(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    files, root = warc.store(folder)
    with files.open_output_stream(f"{root}/tmp/000000-000009.warc.gz.77", compression=None) as f:
        f.write(b"left by a lost attempt")
    assert warc.read_archives(manifest).count() == len(PAGES)
    with files.open_output_stream(warc.store(manifest.first().path)[1], compression=None) as f:
        f.write(b"damaged")
    with pytest.raises(Exception, match="differs from its manifest|archive ends|incorrect header"):
        warc.read_archives(manifest).collect()


def test_no_pages(pages):
    manifest = warc.write_archives(pages.where("false"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_page_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    top = {}
    for r in rows:
        top[r.html] = max(top.get(r.html, -1), r.page_id)
    want = {(r.page_id, len(r.html.encode()), b32(r.html.encode()), "response" if top[r.html] == r.page_id else "revisit",
             None if top[r.html] == r.page_id else top[r.html]) for r in rows}
    assert {tuple(r) for r in queries.op6_warc_round_trip(spark, sf).collect()} == want


def brute_scores(rows, weight=lm_score.WEIGHT, add=lm_score.ADD):
    """(id, tokens, target loss, background loss) with each text's own counts taken off."""
    texts = [(i, bool(t), [None, *(x or "").encode().split()]) for i, t, x in rows]
    models = []
    for only in (True, False):
        word, first, pair = Counter(), Counter(), Counter()
        for _, t, w in texts:
            if t or not only:
                word.update(w[1:])
                first.update(w[:-1])
                pair.update(zip(w, w[1:]))
        models.append((only, word, first, pair, sum(word.values())))
    vocabulary = len({x for _, _, w in texts for x in w[1:]}) + 1
    for i, t, w in texts:
        own = Counter(w[1:]), Counter(w[:-1]), Counter(zip(w, w[1:]))
        losses = []
        for only, word, first, pair, n in models:
            k = 1 if t or not only else 0
            loss = 0.0
            for h, x in zip(w, w[1:]):
                single = (word[x] - k * own[0][x] + add) / (n - k * (len(w) - 1) + add * vocabulary)
                loss -= math.log((pair[h, x] - k * own[2][h, x] + weight * single) / (first[h] - k * own[1][h] + weight))
            losses.append(loss / max(len(w) - 1, 1))
        yield i, len(w) - 1, *losses


def check_scores(found, rows):
    got = sorted(found, key=lambda r: (str(r.doc_id), r.n_tokens, r.target_loss))
    want = sorted(brute_scores(rows), key=lambda r: (str(r[0]), r[1], r[2]))
    assert [(r.doc_id, r.n_tokens) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want):
        assert (r.target_loss, r.background_loss, r.score) == pytest.approx((w[2], w[3], w[2] - w[3]), abs=1e-9)


def test_scores_against_brute_force(spark, documents):
    sf = "/root/testdata/sf0.001"
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = [(r.doc_id, r.doc_id in good, r.text) for r in documents.collect()]
    check_scores(queries.op7_entropy_difference(spark, sf).collect(), rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, target boolean, text string").repartition(3)
    check_scores(lm_score.entropy_difference(frame, frame.where("target"), chunk=50_000, bucket=10_000).collect(), rows)


def test_scores_of_messy_rows(spark, messy, nothing):
    rows = [(i, i is not None and i % 2 == 0, t) for i, t in MESSY]
    targets = spark.createDataFrame([(i,) for i in (2, 2, 4, 6, 8, None)], "doc_id bigint")
    check_scores(lm_score.entropy_difference(messy, targets, chunk=60_000).collect(), rows)
    check_scores(lm_score.entropy_difference(messy, targets.where("false"), chunk=60_000).collect(), [(i, False, t) for i, _, t in rows])
    assert lm_score.entropy_difference(nothing, targets).count() == 0
    split = lm_score.entropy_difference(messy, targets, chunk=1000).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in split) == sorted((str(i), len((t or "").encode().split())) for i, t in MESSY)


def test_packed_integers():
    import numpy as np

    for values in ([], [0], [255, 256], [1 << 40, 3], [(1 << 64) - 1, 0]):
        x = np.array(values, np.uint64)
        assert (lm_score.unpack(lm_score.pack(x)) == x).all()
        y = np.sort(x)
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(y)) == y).all()
