from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import make_bars, stamp
from pyspark.sql import functions as F

from tidemark.operators import structure as X
from tidemark.plans import structure
from tidemark.sources import documents as D
from tidemark.sources import journal as J
from tidemark.sources import market as M


def test_history_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Time (EET),Open,High,Low,Close,Volume \n2020.01.02 00:15:00,1,2,0.5,1.5,9.0\n2020.01.02 00:30:00,1,2,0.5,1.25,9.0\n")
    got = M.read_history_csv(spark, str(tmp_path / "h.csv"), "XAUUSD", "M15").orderBy("bar_time").collect()
    assert [r.close for r in got] == [1.5, 1.25] and got[0].bar_time.strftime("%H:%M") == "00:15"
    plan = M.read_history_csv(spark, str(tmp_path / "h.csv"), "XAUUSD", "M15").select("close")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<close:double>" in plan


def test_bar_table_prunes(spark, tmp_path):
    path = str(tmp_path / "bars")
    M.write_bars(make_bars(spark, range(100)), path)
    lo, hi = (F.lit(t).cast("timestamp") for t in ("2026-01-02 00:00:00", "2026-01-02 05:00:00"))
    rows = M.bars_in_days(M.read_bars(spark, path).where("tf = 'H1'"), lo, hi)
    assert rows.count() == 6
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tf" in plan.replace("isnotnull(day", "isnotnull(day") or "PartitionFilters: [" in plan
    assert "PushedFilters: [IsNotNull(bar_time), GreaterThanOrEqual(bar_time" in plan


def test_journal_round_trip(spark, tmp_path):
    path = str(tmp_path / "j")
    e = spark.createDataFrame([(1, "Srv A", 7), (3, "Srv A", 8), (2, "Srv/B", 9)], "ts bigint, server string, ticket bigint")
    J.append_journal(e, path)
    part = next((tmp_path / "j" / "server_slug=Srv_A").glob("*.json"))
    (tmp_path / "j" / "server_slug=Srv_A" / "hand.json").write_text('\n{"ts": 9, "ticket": 10}\n{broken\n')
    assert part.exists()
    rows = J.recent_journal(J.read_journal(spark, path).where("server_slug = 'Srv_A'"), 2).collect()
    assert [r.ticket for r in rows] == [10, 8]
    lines = spark.createDataFrame([(1, '{"ts": 1, "ticket": 5, "ctx": {"M15": {"ae": true, "adx": 28.0}}}'), (2, ""), (3, "{bad"), (4, "[]")], "i int, line string")
    got = J.parse_journal_lines(lines).collect()
    assert [r.i for r in got] == [1] and got[0].ctx["M15"].ae and got[0].ctx["M15"].adx == 28.0


def test_bands_document_round_trip(spark, tmp_path):
    rows = [("M15", p, s, 0.1 * p, 0.2 * p, 0.3 * p, 0.4 * p, 5) for p in (20, 80) for s in ("pos", "neg")]
    bands = spark.createDataFrame(rows, "mode string, period int, side string, p90 double, p95 double, p99 double, max double, n bigint")
    path = str(tmp_path / "bands")
    D.write_bands(bands, path)
    assert sorted(map(tuple, D.read_bands(spark, path, "M15").collect())) == sorted(rows)
    assert D.read_bands(spark, path, "H9").count() == 0
    text = D.bands_document(bands, F.lit("now")).first().value
    doc = json.loads(text)
    assert doc["modes"]["M15"]["bands"]["ema20"]["pos"]["p90"] == pytest.approx(2.0) and doc["modes"]["M15"]["periods"] == [20, 80]
    assert D.parse_bands(spark.createDataFrame([("not json",)], "body string")).count() == 0


LINES = {"symbol": "XAUUSD", "updated_at": "2026-01-03T00:00:00Z", "lines": {
    "horizontal": [{"name": "R1_D1", "price": 101.0, "color": "red"}],
    "trendlines": [{"name": "TL_up", "point1": ["2026-01-01T00:00:00Z", 100.0], "point2": ["2026-01-01T10:00:00Z", 110.0], "ray_right": True}],
    "rectangles": [{"name": "zone_supply", "time1": "2026-01-01T02:00:00Z", "time2": "2026-01-01T04:00:00Z", "price_low": 99.0, "price_high": 103.0}],
    "channels": [{"name": "ch", "main_point1": ["2026-01-01T00:00:00Z", 100.0], "main_point2": ["2026-01-01T10:00:00Z", 110.0],
                  "parallel_anchor": ["2026-01-01T05:00:00Z", 108.0], "ray_right": False}],
    "fibonacci": [{"name": "fib", "point1": ["2026-01-01T00:00:00Z", 100.0], "point2": ["2026-01-01T10:00:00Z", 110.0], "levels": [{"ratio": 0.5, "label": "50"}]}],
    "texts": []}}


def test_line_documents_against_bars(spark, tmp_path):
    (tmp_path / "XAUUSD.json").write_text(json.dumps(LINES, indent=1))
    lines = D.read_lines(spark, str(tmp_path))
    assert {r.kind for r in lines.collect()} == {"horizontal", "trendline", "rectangle", "channel", "fibonacci"}
    bars = make_bars(spark, [100.0] * 30)
    got = {}
    for r in X.lines_at_bars(bars, lines).collect():
        got[r.kind, int(r.bar_time.timestamp() - stamp("2026-01-01 00:00:00").timestamp()) // 3600] = r
    assert got["trendline", 20].value == pytest.approx(120) and got["trendline", 29].slope_per_day == pytest.approx(24)
    assert ("channel", 11) not in got and got["channel", 10].other_value == pytest.approx(113)
    assert {h for k, h in got if k == "rectangle"} == {2, 3, 4} and got["rectangle", 2].other_value == 103
    assert {h for k, h in got if k == "horizontal"} == set(range(30)) and got["fibonacci", 1].level_prices == [pytest.approx(105)]


def test_lines_round_what_they_show_only(spark, tmp_path):
    """Rounded once a line or once a row, the values are those of the unrounded columns."""
    third = json.loads(json.dumps(LINES).replace("100.0", "100.123456789").replace("99.0", "99.987654321"))
    (tmp_path / "XAUUSD.json").write_text(json.dumps(third))
    lines = D.read_lines(spark, str(tmp_path))
    bars = make_bars(spark, [100.0] * 30)
    key = ("kind", "bar_time")
    whole, short = ({tuple(r[k] for k in key): r for r in X.lines_at_bars(bars, lines, **more).collect()} for more in ({}, {"digits": 2}))
    assert whole.keys() == short.keys() and len(whole) > 50
    near = lambda x: None if x is None else pytest.approx(x, abs=0.0051)
    for k, r in whole.items():
        s = short[k]
        assert (s.value, s.other_value, s.slope_per_day) == tuple(map(near, (r.value, r.other_value, r.slope_per_day)))
        for x in (s.value, s.other_value, s.slope_per_day, *(s.level_prices or [])):
            assert x is None or x == round(x, 2)


def test_line_documents_are_dealt_to_all_tasks(spark):
    """One small file of drawings becomes many rows: it must not stay one task."""
    assert structure.documents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_snapshots_and_change_guard(spark, tmp_path):
    d = spark.createDataFrame([("a", 3, (1.5,), (None,))], "k string, version bigint, price struct<last: double>, account struct<level: double>")
    full = json.loads(D.snapshot_documents(d, "k", ["price", "account"]).first().document)
    light = json.loads(D.snapshot_documents(d, "k", ["price", "account"], ["price"], partial=True).first().document)
    assert full == {"version": 3, "price": {"last": 1.5}, "account": {"level": None}} and light == {"partial": True, "version": 3, "price": {"last": 1.5}}
    held = spark.createDataFrame([("a", 1, "keep"), ("b", 1, "keep")], "k string, price int, analysis string")
    fresh = spark.createDataFrame([("a", None)], "k string, price int")
    assert {r.k: (r.price, r.analysis) for r in D.merge_partial(held, fresh, "k", ["price"]).collect()} == {"a": (None, "keep"), "b": (1, "keep")}
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "symbol string, payload string")
    prev = p.where("symbol = 'a'").select("symbol", F.xxhash64("payload").alias("content_hash"))
    assert [r.symbol for r in D.changed_only(p, prev).collect()] == ["b"]
    D.save_last_good(held, str(tmp_path / "lg"))
    assert D.load_last_good(spark, str(tmp_path / "lg")).where("stale").count() == 2


def test_structure_levels(spark):
    highs = [1, 2, 5, 2, 1, 3, 1]
    swings = X.swing_points(make_bars(spark, [0.0] * 7, highs=highs, lows=[0, 0, -1, 0, 0, 0, 0]))
    got = swings.collect()
    assert len(got) == 1 and got[0].swing_high and got[0].swing_low and got[0].high == 5
    lv = spark.createDataFrame([("S", 100.0), ("S", 100.1), ("S", 100.2), ("S", 100.4), ("S", 105.0), ("S", 105.0), ("S", 105.0), ("S", 110.0)], "symbol string, price double")
    z = X.confluence(lv, spark.createDataFrame([("S", 1.0)], "symbol string, atr double")).orderBy("zone_low").collect()
    assert [(r.zone_low, r.zone_high, r.stars) for r in z] == [(100.0, 100.2, 3), (105.0, 105.0, 3)]
    close = spark.createDataFrame([("S", float(i)) for i in range(100)], "symbol string, price double")
    wide = X.confluence(close, spark.createDataFrame([("S", 8.0)], "symbol string, atr double")).collect()
    assert wide and all(r.zone_high - r.zone_low <= 8.0 * 0.3 and r.n_levels == 3 for r in wide)
    assert X.confluence(close, spark.createDataFrame([("S", 4.0)], "symbol string, atr double")).count() == 0


def test_swings_and_patterns_across_stretches(spark, monkeypatch):
    from tidemark.operators import scan
    rng = np.random.default_rng(8)
    closes = 100 + rng.normal(size=300).round(1).cumsum()
    bars = make_bars(spark, closes, highs=list(closes + rng.random(300)), lows=list(closes - rng.random(300)), skip=range(40, 45))
    rows = bars.withColumn("rsi", F.pmod(F.col("close") * 7, F.lit(100.0)))
    whole = [sorted(map(str, f(rows).collect())) for f in (X.swing_points, X.bar_patterns, X.rsi_divergence)]
    cut = []
    for f in (X.swing_points, X.bar_patterns, X.rsi_divergence):
        with monkeypatch.context() as m:
            m.setattr(scan.with_neighbours, "__kwdefaults__", {**scan.with_neighbours.__kwdefaults__, "span": 7})
            cut.append(sorted(map(str, f(rows).collect())))
    assert cut == whole and all(whole)
