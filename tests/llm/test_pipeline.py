"""Each stage of the pipeline against plain Python."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from test_documents import repeated
from test_tokens import WORD, holds, library
from tidemark.llm.common import staged

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), name))
    return docs


def test_rules(stages):
    rows = stages[0].collect()
    failed = {r.doc_id for r in rows if len(r.text.encode().split()) < 20 or 100 * repeated(r.text) > 30 * len(r.text.encode().split())}
    rates = {}
    for r in rows:
        rates.setdefault(r.source, []).append(r.doc_id in failed)
    n, m = np.array([len(x) for x in rates.values()]), len(failed) / len(rows)
    p = np.array([np.mean(x) for x in rates.values()])
    noise = m * (1 - m) * (len(n) - 1)
    over, room = (n * (p - m) ** 2).sum() - noise, m * (1 - m) * (n.sum() - (n * n).sum() / n.sum()) - noise
    k = min(max(room / over - 1, 1), 1000) if over > 0 and room > 0 else 1000
    bad = {s for s, x in rates.items() if (sum(x) + m * k) / (len(x) + k) > 0.5}
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in rows if r.doc_id not in failed and r.source not in bad}
    assert stages[1].columns == stages[0].columns


def test_classifier_keeps_good_and_drops_bad(spark, stages):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, there = ({r.doc_id for r in s.collect()} for s in (stages[2], stages[1]))
    assert kept <= there and stages[2].columns == stages[0].columns
    good = [d in kept for d in there if label.get(d) == 1]
    bad = [d not in kept for d in there if label.get(d) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_one_of_each_group_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    kept = {r.doc_id for r in stages[3].collect()}
    assert kept <= {d for d, _ in rows} and stages[3].columns == stages[0].columns
    sets = {}
    for d, text in rows:
        w = text.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    best = dict.fromkeys(sets, 0.0)
    for a in sets:
        for b in sets:
            if a < b and (common := len(sets[a] & sets[b])):
                alike = common / (len(sets[a]) + len(sets[b]) - common)
                best[a], best[b] = max(best[a], alike), max(best[b], alike)
                assert alike < 0.8 or not (a in kept and b in kept)
    assert all(best[d] >= 0.8 for d in sets if d not in kept) and len(kept) < len(sets)


def test_packing(stages):
    lib = library(WORD)
    ids = {r.doc_id: [lib.encode(r.text, add_special_tokens=False).ids + [1]] for r in stages[3].collect()}
    rows = stages[4].collect()
    holds(rows, ids, 2048)
    assert {r.doc_id for r in rows} == set(ids)


def test_run_is_the_last_stage(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, stages[4].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_on_odd_rows(spark):
    rows: list = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "w " * 30, None, None, 60), (2, "w " * 30, None, None, 60)]
    rows += [(10 + i, " ".join(f"Good word{i}{k} here," for k in range(30)), "en", "s", 1) for i in range(5)] * 2
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0
            docs = out if out.columns == docs.columns else docs


def test_clashing_columns_keep_their_values(spark):
    """Columns named like the stages' own measures come out of each stage as they went in."""
    names = ["n_words", "kept", "_row", "_part", "_set", "_cells", "base_failed", "host_rate", "features", "score", "_doc", "_text", "_id"]
    rows = [(i, " ".join(f"Good word{i % 9}{k} here," for k in range(30)), "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(12)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        found = docs.collect()
        assert docs.columns == schema.replace(" bigint", "").replace(" string", "").split(", ") and found
        assert all(tuple(r) in rows for r in found)
    assert len(found) == 9
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= 9
