from __future__ import annotations

import hashlib

import check_oracles
import numpy as np
import pytest

from llm_cases import MESSY, documents, messy, nothing  # noqa: F401
from tidemark.llm import chat, host_rules, minhash, pu_quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    text, _, _, fine = check_oracles.compare(spark, check_oracles.connect(SF), name, SF)
    assert fine, text


def repeated(text, width=8):
    words = text.split()
    places = {}
    for i in range(len(words) - width + 1):
        places.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(width)})


def test_host_rules_on_messy_rows(spark, messy, nothing):
    found = host_rules.judged_by_host(messy).collect()
    ascii_words = lambda t: [w for w in (t or "").encode().split()]
    want = sorted((str(i), len(ascii_words(t)), repeated(" ".join(w.decode("latin1") for w in ascii_words(t)))) for i, t in MESSY)
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in found) == want
    assert host_rules.judged_by_host(nothing).count() == 0
    rows = [(1, "a\nb\na\n \n ", None), (2, "w " * 40, None), (3, None, "x")]
    out = {r.doc_id: r for r in host_rules.judged_by_host(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[1].n_dup_lines == 1 and out[2].n_repeat_words == 40 and out[3].n_words == 0 and not any(r.kept for r in out.values())


def rates(spark, hosts):
    """Shrunk rates of hosts given as (documents, failed ones)."""
    rows = [(f"h{i}", k < failed) for i, (n, failed) in enumerate(hosts) for k in range(n)]
    found = host_rules.host_rates(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()
    return np.array([r.host_rate for r in sorted(found, key=lambda r: int(r.host[1:]))])


def test_hosts_of_one_document_are_shrunk(spark):
    assert (np.abs(rates(spark, [(1, i % 4 == 0) for i in range(400)]) - 0.25) < 1e-3).all()


def test_chance_between_small_hosts_is_no_difference(spark):
    """3,000 hosts of three documents that share the true rate 0.3: none is rejected."""
    failed = np.random.default_rng(3).binomial(3, 0.3, 3000)
    assert rates(spark, [(3, int(x)) for x in failed]).max() < 0.5


def test_hosts_that_differ_keep_their_rates(spark):
    true = np.random.default_rng(4).beta(1.5, 4.5, 200)
    failed = np.random.default_rng(5).binomial(40, true)
    found = rates(spark, [(40, int(x)) for x in failed])
    assert np.abs(found - (failed + 1.5) / 46).max() < 0.03  # the prior of which the rates were drawn
    assert rates(spark, [(5, 0), (7, 0)]).tolist() == [0.0, 0.0]


def test_bad_host_is_rejected_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"v{i}" for i in range(50)), "short"
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, bad if i < 50 else good, "awful") for i in range(60)] + [(300, good, "tiny"), (301, bad, "tiny")]
    rows += [(400 + i, good, f"h{i}") for i in range(30)]
    out = {r.doc_id: r for r in host_rules.judged_by_host(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[0].kept and not out[159].kept and out[159].host_rate > 0.7 and out[300].kept and out[300].host_rate < 0.5 and out[405].kept


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def neighbours(rows):
    rows = sorted(((-1 if i is None else i, t or "", i) for i, t in rows), key=lambda r: r[:2])
    for k, (_, text, i) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + nxt[:half], nxt


def check_neighbours(found, rows, bound=0.12):
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in neighbours(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == want
    by = {(str(i), hashlib.sha256(e.encode()).hexdigest()): (t, e, n) for i, t, e, n in neighbours(rows)}
    errors = []
    for r in found:
        t, e, n = by[str(r.doc_id), r.edited_sha256]
        assert r.fingerprint == minhash.written(minhash.sketch(t)) and r.edited_fingerprint == minhash.written(minhash.sketch(e))
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, n)]
    assert max(map(abs, errors)) < bound and abs(np.mean(errors)) < 0.01


def test_fingerprints_of_neighbours(spark, documents):
    check_neighbours(queries.op10_minhash_neighbours(spark, SF).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_fingerprints_of_messy_rows(messy, nothing, spark):
    check_neighbours(minhash.neighbour_likeness(messy).collect(), MESSY)
    assert minhash.neighbour_likeness(nothing).count() == 0 and minhash.fingerprints(nothing).count() == 0
    one = minhash.neighbour_likeness(spark.createDataFrame([(5, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert one[0].near_next == 1.0 and len(one) == 1
    assert minhash.fingerprints(messy).columns == [*messy.columns, "fingerprint"]


def test_densification_takes_the_first_filled_bin_of_each_order():
    order, _ = minhash.orders(64)
    for filled in (np.array([3]), np.array([1, 9, 40]), np.arange(0, 64, 2), np.arange(64)):
        source = minhash.densified(filled, 64)
        assert all(source[i] == i if i in filled else source[i] == next(j for j in order[i] if j in filled) for i in range(64))


def test_low_bits_are_packed_in_order():
    assert minhash.packed_bits(np.array([1, 2, 15, 16 + 4], np.uint64), 4) == bytes([0b10000100, 0b11110010])


def test_quality_on_the_held_out_fold(spark):
    rows = queries.op3_pu_quality(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.94
    pairs = [(a.score > b.score) for a in rows if a.quality for b in rows if not b.quality]
    assert np.mean(pairs) > 0.97


def test_quality_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(4, 1), (7, 1), (5, 0), (6, None), (None, 1), (9, 1), (9, 0)], "doc_id bigint, quality int")
    found = pu_quality.scored(messy, labels).collect()
    assert len(found) == len(MESSY) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert pu_quality.scored(nothing, labels).count() == 0 and pu_quality.accepted(nothing, labels).count() == 0
    assert all(r.score == 0.5 for r in pu_quality.scored(messy, labels.where("false")).collect())
    assert pu_quality.accepted(messy, labels.where("false")).count() == len(MESSY)
    assert pu_quality.accepted(messy, labels).columns == messy.columns


def test_labels_of_the_held_out_fold_are_never_used(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    score = lambda ls: {r.doc_id: round(r.score, 9) for r in pu_quality.scored(documents, ls).collect()}
    assert score(labels) == score(flipped)


def test_prior_and_risk():
    rng = np.random.default_rng(5)
    p, n = rng.normal(1, 0.5, 4000), rng.normal(-1, 0.5, 1000)
    bins = lambda z: np.histogram(np.clip(z / 3, -1, 1), 64, (-1, 1))[0]
    assert abs(pu_quality.class_prior(bins(np.r_[p, n]), bins(p)) - 0.8) < 0.06
    x = lambda z: np.c_[np.ones(len(z)), z]
    u = x(np.r_[p, n])
    w = pu_quality.nn_pu_weights(0.8, x(p).mean(0), x(p).T @ x(p) / len(p), u.mean(0), u.T @ u / len(u))
    assert (x(p) @ w > 0).mean() > 0.95 and (x(n) @ w < 0).mean() > 0.9


def test_rotation_joins_to_whole_dialogues(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, None, None, "x"),
            (None, 0, "bob", "y"), (3, 0, "system", "alone"), (4, 5, "a b|", "z")] + [(5, i, f"p{i % 3}", f"t{i}") for i in range(40)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn int, role string, text string, start int, block int")
    out = chat.rotated(turns, block=4).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r.start)):
        key = (r.conv_id, r.assistant)
        assert len(whole.get(key, "")) == r.start
        whole[key] = whole.get(key, "") + r.segment
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "bob"), (4, "a_b_"), (5, "p0"), (5, "p1"), (5, "p2")}
    assert whole[1, "bob"] == ("<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi <\\|end|><|end|>\n<|assistant|>\n<|end|>\n"
                               "<|user name=ann|>\nbye<|end|>\n<|user name=ann|>\nbye<|end|>\n")
    masks = {(r.conv_id, r.assistant): [] for r in out}
    for r in out:
        if r.mask_start is not None:
            masks[r.conv_id, r.assistant].append(whole[r.conv_id, r.assistant][r.mask_start : r.mask_end])
    assert sorted(masks[1, "ann"]) == ["bye<|end|>", "bye<|end|>", "hi <\\|end|><|end|>"]
    assert sorted(masks[5, "p1"]) == sorted(f"t{i}<|end|>" for i in range(40) if i % 3 == 1)
    assert chat.rotated(turns.where("false")).count() == 0


def test_participants_are_told_apart_by_their_raw_names(spark):
    """Names that look alike once cleaned stay two participants; a context role keeps its name."""
    rows = [(1, 0, "a b", "x"), (1, 1, "a_b", "y"), (1, 2, "a#b", "z"), (1, 3, "a b", "again"), (2, 0, "system", "rule"), (2, 1, "sys tem", "u"), (3, 0, None, "n"), (3, 1, "unknown", "m")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = chat.rotated(turns).collect()
    shown = {(r.conv_id, r.turn): r.speaker for r in out}
    assert {r.assistant for r in out if r.conv_id == 1} == {"a_b", "a_b#2", "a_b#3"} == {shown[1, 0], shown[1, 1], shown[1, 2]}
    assert shown[1, 0] == shown[1, 3] == "a_b" and all((r.mask_start is not None) == (r.assistant == r.speaker) for r in out)
    assert shown[2, 0] == "system" and {r.assistant for r in out if r.conv_id == 2} == {"sys_tem"}
    assert {r.assistant for r in out if r.conv_id == 3} == {"unknown"} and len(out) == 12 + 2 + 2
