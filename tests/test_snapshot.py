from __future__ import annotations

import json

from tidemark.sources import snapshot as N


def test_documents_are_bounded_and_read_back(spark):
    rows = [("a", i, float(i), "x") for i in range(10)] + [("b", 1, float("nan"), None), (None, 2, float("inf"), "y")]
    df = spark.createDataFrame(rows, "k string, at int, v double, t string").repartition(3)
    documents = N.snapshot({"d": df, "e": df}, {"d": N.Domain("k", ("at",), 3), "e": N.Domain("at"), "absent": N.Domain("k")})
    held = {(r.domain, r.key): json.loads(r.document) for r in documents.collect()}
    assert held["d", "a"] == {"n": 10, "rows": [{"k": "a", "at": i, "v": float(i), "t": "x"} for i in (9, 8, 7)]}
    assert held["d", "b"]["rows"] == [{"k": "b", "at": 1, "v": None, "t": None}]  # not a number is null, and nulls stay visible
    assert held["d", "null"]["rows"] == [{"k": None, "at": 2, "v": None, "t": "y"}] and len(held) == 3 + 10
    back = N.read_blocks(documents, "d", df.schema)
    assert back.columns == ["_key", "_n", "k", "at", "v", "t"] and back.count() == 5 and back.where("k = 'a'").first()._n == 10
    assert N.snapshot({"d": df.where("false")}, {"d": N.Domain("k")}).count() == 0
