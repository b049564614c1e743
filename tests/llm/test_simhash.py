from __future__ import annotations

import sys

import numpy as np
import pytest
import xxhash

from llm_cases import MESSY, documents, messy, nothing  # noqa: F401
from tidemark.llm import queries, simhash
from tidemark.llm.components import components


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs):
    """(place, least id) of the groups of pairs (id, fingerprint) with links of at most four bits."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(pairs))]
    return [min((p[0] for p, q in zip(pairs, roots) if q == r and p[0] is not None), default=None) for r in roots]


def test_query_against_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    want = {(d, f"{f:016x}", g) for (d, f), g in zip(prints, brute_groups(prints))}
    assert {tuple(r) for r in queries.op1_simhash_groups(spark, "/root/testdata/sf0.001").collect()} == want


def test_messy_rows(messy, nothing):
    prints = [(i, brute_print(t) if t != MESSY[7][1] else int(simhash.fingerprint(t.encode())[0])) for i, t in MESSY]
    want = sorted(((str(i), f, str(g)) for (i, f), g in zip(prints, brute_groups(prints))))
    found = simhash.near_groups(messy)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found.collect()) == want
    assert "kept" in found.columns
    assert simhash.near_groups(nothing).count() == 0


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a ^ (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) & rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    low = np.uint64(0x5555555555555555)
    emb = lambda x: x - ((x >> np.uint64(1)) & low)
    assert (simhash.manhattan(emb(a), emb(b)) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("block", [8, 2048])
def test_links_join_what_brute_force_joins(spark, block):
    rng = np.random.default_rng(2)
    prints = set()
    for base in rng.integers(0, 1 << 63, 30).tolist():
        for _ in range(20):  # chains and stars around a base
            prints.add(base)
            for b in rng.integers(0, 63, rng.integers(1, 5)).tolist():
                base ^= 1 << b
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p, p) for p in prints], "id bigint, fp bigint")
    found = simhash.near_links(nodes, ["fp"], block=block)
    groups = {r.node: r.root for r in components(found).collect()}
    assert [groups.get(p, p) for p in prints] == brute_groups([(p, p) for p in prints])
    assert all((r.a ^ r.b).bit_count() <= 4 for r in found.collect())


def test_components_of_chain_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rounds_over_few_edges_write_few_files(spark, monkeypatch):
    module, written = sys.modules["tidemark.llm.components"], []
    real = module.durable
    monkeypatch.setattr(module, "durable", lambda df: written.append(real(df)) or written[-1])
    monkeypatch.setattr(module, "EDGES", 1000)
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        found = {r.node: r.root for r in components(spark.range(2500).selectExpr("id as a", "id + 1 as b")).collect()}
        assert found == dict.fromkeys(range(2501), 0)
        assert len(written) > 2 and all(w.rdd.getNumPartitions() <= 3 for w in written[1:])
    finally:
        spark.conf.unset(off)


def test_survivors(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows, groups = [], {}
    for g in range(12):
        text = [word() for _ in range(150)]
        for c in range(5):
            own = list(text)
            for at in rng.integers(0, 150, 2 if c > 1 else 0):
                own[at] = word()
            rows.append((g * 10 + c, " ".join(own), g, 1))
        groups[g] = g * 10
    rows += [(300, rows[0][1], 0, 1), (0, rows[0][1], 0, 1), (None, None, 99, 1), (None, "", 99, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, g int, _fp int")
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.g), str(r.doc_id)) for r in kept.collect()) == sorted([(str(g), str(d)) for g, d in groups.items()] + [("99", "None")])
    assert simhash.survivors(docs.where("false")).count() == 0


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def with_changes(text, places):
    own = text.split()
    for at in places:
        own[at] = f"changed{abs(hash((text, at))) % 10**9}"
    return " ".join(own)


def template(rng, n, of, own):
    """`n` texts of `of` common words and `own` words of their own, which come last."""
    common = " ".join(f"c{x}" for x in rng.integers(0, 1 << 40, of))
    return [common + " " + " ".join(f"o{x}" for x in rng.integers(0, 1 << 40, own)) for _ in range(n)]


def test_texts_below_the_likeness_stay(spark):
    rng = np.random.default_rng(5)
    texts = template(rng, 60, 300, 45) + template(rng, 60, 300, 60)
    assert all(0.65 < jaccard(texts[i], texts[i + 1]) < 0.8 for i in (0, 20, 60, 90))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.survivors(docs).collect()} == set(range(120))


@pytest.mark.parametrize("block", [700, 1 << 19])
def test_verified_links_join_what_brute_force_joins(spark, block):
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
        for _ in range(12):
            base = base.copy()
            base[rng.integers(0, 100, rng.integers(1, 16))] = rng.integers(0, 1 << 60, dtype=np.uint64)
            sets.append(np.unique(base))
    want = components(spark.createDataFrame([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
                                             if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))], "a bigint, b bigint"))
    found = simhash.alike(sets, 0.8)
    assert sorted(map(tuple, components(spark.createDataFrame(found, "a bigint, b bigint")).collect())) == sorted(map(tuple, want.collect()))
    texts = [" ".join(map(str, x)) for x in sets]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row bigint, text string")
    nodes = rows.select(rows._row.alias("id"), rows._row.alias("row")).selectExpr("id", "row", "96L as size")
    chain = spark.createDataFrame([(i, i + 1) for i in range(len(sets) - 1)], "a bigint, b bigint")
    links = simhash.verified(rows, "text", nodes, chain, 0.8, 1, 42, block)
    assert sorted(map(tuple, components(links).collect())) == sorted(map(tuple, want.collect()))


def test_isolated_pairs_at_the_likeness_are_found(spark):
    rng = np.random.default_rng(7)
    rows, at = [], []
    for g in range(300):  # two texts of 200 words each, alike by 0.78 to 0.85
        text = " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 200))
        other = with_changes(text, range(0, 4 - g % 2))
        own = other.split()
        own[-(12 + g % 9):] = [f"v{x}" for x in rng.integers(0, 1 << 40, 12 + g % 9)]
        other = " ".join(own)
        rows += [(2 * g, text), (2 * g + 1, other)]
        at.append(jaccard(text, other))
    close = {2 * g + 1 for g in range(300) if at[g] >= 0.8}
    assert sum(0.8 <= x <= 0.85 for x in at) >= 150 and min(at) < 0.8
    kept = {r.doc_id for r in simhash.survivors(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {d for d, _ in rows} - close


@pytest.mark.parametrize("common", [16, 80, 400])
def test_sets_at_the_likeness_share_a_cell(common):
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(1500):  # likeness 0.8 exactly
        x = rng.integers(0, 1 << 64, common * 5 // 4, dtype=np.uint64)
        own = common // 8
        a, b = simhash.cells_of(np.sort(x[: common + own])), simhash.cells_of(np.sort(np.r_[x[:common], x[common + own:]]))
        missed += not (a == b).any()
    assert missed == 0


def near_copies(rng):
    """(id, text) of five families of texts that differ in a word or two; then texts of their own."""
    rows = []
    for g in range(5):
        text = " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 400))
        rows += [(10 * g + c, with_changes(text, rng.integers(0, 400, c).tolist()) if c else text) for c in range(4)]
    return rows + [(100 + i, " ".join(f"v{x}" for x in rng.integers(0, 1 << 40, 60))) for i in range(10)]


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    """Without the cells of MinHash values all links of four bits or fewer still hold, each counted on the shingles."""
    rows = near_copies(np.random.default_rng(9))
    monkeypatch.setattr(simhash, "sharing", lambda rows: spark.createDataFrame([], "a bigint, b bigint"))
    prints = {d: int(simhash.fingerprint(t.encode(), 5, repeats=False)[0]) for d, t in rows}
    text = dict(rows)
    gone = {d for d, _ in rows if any(e < d and (prints[d] ^ prints[e]).bit_count() <= 4 and jaccard(text[d], text[e]) >= 0.8 for e, _ in rows)}
    kept = {r.doc_id for r in simhash.survivors(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(gone) >= 5 and kept == set(text) - gone


def test_links_of_equal_and_near_fingerprints(spark):
    prints = [5, 5, 5, 7, 0, (1 << 60) - 1, (1 << 60) - 1, 0b110000 << 30]
    nodes = spark.createDataFrame([(100 + i, p) for i, p in enumerate(prints)], "id bigint, fp bigint")
    groups = {r.node: r.root for r in components(simhash.print_links(nodes)).collect()}
    assert [groups.get(100 + i, 100 + i) for i in range(8)] == [100, 100, 100, 100, 100, 105, 105, 100]


def test_links_between_known_groups(spark):
    """Groups that a proposal joins meet with all their nodes, whichever of them it names; others are not counted again."""
    base = [f"x{i}" for i in range(100)]
    drift = [base[k:] + [f"y{i}" for i in range(k)] for k in (0, 6, 12, 18)]  # likeness 0.89 to the next, 0.79 or less beyond
    texts = [" ".join(t) for t in [*drift, base[:50], base[:49]]]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row bigint, text string")
    nodes = rows.selectExpr("_row as id", "_row as row", "100L as size")
    joined = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)], "node bigint, root bigint")
    links = spark.createDataFrame([(3, 0), (4, 5)], "a bigint, b bigint")
    found = simhash.verified(rows, "text", nodes, links, 0.8, 1, 42, joined=joined).collect()
    assert {r.node: r.root for r in components(spark.createDataFrame(found, "a bigint, b bigint")).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
