from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs int, depth string"


def brute(rows):
    """Nodes by walking every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        base, h = c - c % 20, zlib.crc32(str(c).encode()) % 4
        made[c] = turns[c] if base == c else turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    own_value = {k: (k not in children, (len(v) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)) for k, v in members.items()}
    sums = defaultdict(lambda: [0, 0])
    for k, (leaf, saved) in own_value.items():
        for d in range(len(k) + 1):
            sums[k[:d]][0] += leaf
            sums[k[:d]][1] += saved
    out = []
    for k, v in members.items():
        ends = ",".join(map(str, sorted(c for c in v if len(made[c]) == len(k))))
        out.append((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(children[k]) if k in children else 0, *sums[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **kw).collect()), key=str)


def mixed_rows():
    """Shared openings, copies, short and absent bases, turnless ends, nulls, repeated rows, and dialogues over several bands."""
    rows = []
    for c in list(range(0, 45)) + [61, 62, 63, 79]:
        for t in range(c % 7):
            rows.append((c, t, ("user", "assistant")[t % 2], f"shared {t}" if t < c % 4 else f"own {c % 5} {t}  words"))
    for c in (100, 101, 102, 103, 104):
        rows += [(c, t, "user", f"long {t}" if t < 20 + c % 3 else f"turn {t} of {c % 2}") for t in range(35 + c % 2)]
    rows += [(200, None, None, None), (200, None, "user", None), (200, 1, None, "x"), (201, 5, "b", "y"), (201, 5, "a", "y"), (201, 5, "a", "y"),
             (None, 0, "user", "of no conversation"), (203, -1, "user", "z " * 5000)]
    return rows


def test_nodes_by_brute_force(spark):
    assert run(spark, mixed_rows()) == brute(mixed_rows())


def test_small_shards_and_bands(spark, monkeypatch):
    """Shards of four rows and bands of two turns: nearly every node is recombined; long runs are summed by blocks."""
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    monkeypatch.setattr(prefix_trie, "SALT_ROWS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert run(spark, mixed_rows(), band=2) == brute(mixed_rows())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_conversation_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SALT_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = [(5, t, "user", f"t{t}") for t in range(400)] + [(7, t, "user", f"t{t}") for t in range(390)] + [(c, 0, "user", "same") for c in range(300, 420)]
        assert run(spark, rows, 6) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    rows = [(c, 0, "user", "gone") for c in range(61, 70)]  # their base is absent, so most lose their only turn
    assert run(spark, rows) == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in brute(rows))


@pytest.mark.parametrize("size", ["sf0.001"])
def test_given_conversations(spark, size):
    from tidemark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_prefix_trie(spark, f"/root/testdata/{size}").collect()), key=str) == brute(rows)
