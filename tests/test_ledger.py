"""Sinks that account for every row, last-good publishing, and inside-bar breaks."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from conftest import START, make_bars
from pyspark.sql import functions as F

from tidemark.operators import structure as G
from tidemark.sources import documents as D
from tidemark.streaming import jobs, ledger

TICK = "symbol string, ts timestamp, seq bigint, price double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def bars_of(rows, closed_by=None):
    """Hourly bars of ticks by hand: (symbol, hour) -> open, high, low, close, count."""
    out = {}
    for s, ts, seq, p in sorted(rows, key=lambda r: (r[1], r[2])):
        key = s, (ts - START) // dt.timedelta(hours=1)
        o, h, lo, _, n = out.get(key, (p, p, p, p, 0))
        out[key] = o, max(h, p), min(lo, p), p, n + 1
    return out


def test_bars_and_late_ticks_add_up(spark, tmp_path):
    r = random.Random(3)
    batches = [[(r.choice("AB"), at(r.uniform(0, 150) + 60 * k * (i % 9 > 1)), 1000 * k + i, float(r.randint(90, 110))) for i in range(80)] for k in range(4)]
    batches[2].append((None, at(130), 9001, 5.0))
    batches[3].append(("A", None, 9002, 5.0))
    path = str(tmp_path / "out")
    sink = ledger.bars_and_late_ticks(path, "H1")
    on_time, late, newest = [], [], None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, TICK)
        sink(df, k)
        if k == 2:  # the batch is replayed after a failure
            sink(df, k)
        mark = newest - dt.timedelta(minutes=10) if newest else None
        for row in rows:
            gone = row[1] is None or (mark is not None and START + ((row[1] - START) // dt.timedelta(hours=1) + 1) * dt.timedelta(hours=1) <= mark)
            (late if gone else on_time).append(row)
        newest = max(t for t in [newest, *(row[1] for row in rows)] if t is not None)
    assert late and on_time
    assert sorted(map(str, (r.seq for r in ledger.read_epochs(spark, f"{path}/late").collect()))) == sorted(str(x[2]) for x in late)
    closed = {k: v for k, v in bars_of(on_time).items() if START + (k[1] + 1) * dt.timedelta(hours=1) <= newest - dt.timedelta(minutes=10)}
    hour = lambda t: (t.replace(tzinfo=dt.timezone.utc) - START) // dt.timedelta(hours=1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = {(b.symbol, b.h): (b.open, b.high, b.low, b.close, b.tick_volume) for b in ledger.read_epochs(spark, f"{path}/bars").withColumn(
        "h", F.floor((F.unix_seconds("bar_time") - F.lit(int(START.timestamp()))) / 3600)).collect()}
    assert found == closed and hour(START) == 0
    rows = {c.batch: c for c in ledger.read_epochs(spark, f"{path}/counts").collect()}
    assert [rows[k].n for k in range(4)] == [len(b) for b in batches]
    assert sum(c.late for c in rows.values()) == len(late) and all(c.n == c.on_time + c.late for c in rows.values())
    assert len([p for p in os.listdir(f"{path}/open") if p.startswith("version=")]) == jobs.KEPT_VERSIONS


def test_progress_and_counts_agree(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("A", at(m), m, 1.0) for m in range(200)], TICK).repartition(3).write.parquet(src)
    read = ledger.drained(jobs.tick_stream(spark, src, TICK), ledger.bars_and_late_ticks(out, "H1"), str(tmp_path / "ck"))
    assert read == 200 == ledger.read_epochs(spark, f"{out}/counts").agg(F.sum("n")).first()[0]


def test_broken_json_is_kept_as_text_and_the_schema_grows(spark, tmp_path):
    src, out, ck, done = (str(tmp_path / x) for x in ("in", "out", "ck", "done"))
    deliveries = ['{"a": 1}\n{"a": \n\n[3]\n{"a": 2, "b": "early"}', '{"b": "x", "a": 5}\nno json']
    for k, text in enumerate(deliveries):
        os.makedirs(src, exist_ok=True)
        with open(f"{src}/{k}.json", "w") as f:
            f.write(text)
        schema = "a bigint" + (", b string" if k else "")
        ledger.drained(ledger.json_stream(spark, src, schema, clean="archive", archive=done), ledger.good_and_quarantined(out), ck)
    good = {(r.a, r.b) for r in ledger.read_epochs(spark, f"{out}/good", "a bigint, b string").collect()}
    bad = {r.text for r in ledger.read_epochs(spark, f"{out}/quarantine").collect()}
    assert {(1, None), (2, None), (5, "x")} <= good and {'{"a": ', "no json"} <= bad


def test_counters_rise_on_changes_only(spark, tmp_path):
    schema = "domain string, key string, payload string, seq bigint"
    sink = ledger.change_counters(str(tmp_path), ("analysis",))
    batches = [[("analysis", "X", "p", 1), ("price", "X", "1", 2), ("price", "X", "1", 3), ("price", "X", "2", 4)],
               [("analysis", "X", "p", 5), ("price", "X", "2", 6)],
               [("analysis", "X", "q", 7), ("analysis", "X", "p", 8), ("analysis", None, None, 9)], [("analysis", None, None, 10)]]
    seen = []
    for epoch, rows in enumerate(batches):
        for _ in range(2):  # every batch is replayed
            sink(spark.createDataFrame(rows, schema), epoch)
        held = jobs.latest_version(spark, str(tmp_path))
        seen.append(tuple(ledger.counters(held).first()))
    assert seen == [(3, 1), (3, 1), (6, 4), (6, 4)]
    last = {(r.domain, r.key): r.version for r in jobs.latest_version(spark, str(tmp_path)).collect()}
    assert last == {("analysis", "X"): 3, ("price", "X"): 2, ("analysis", None): 1}


def test_a_failing_write_leaves_the_last_good_answer(spark, tmp_path):
    path = str(tmp_path / "good")
    with pytest.raises(FileNotFoundError):
        D.load_last_good(spark, path)
    D.save_last_good(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    broken = spark.createDataFrame([("b", 2)], "k string, v int").select("k", F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        D.save_last_good(broken, path)
    assert [tuple(r) for r in D.load_last_good(spark, path).collect()] == [("a", 1, True)]
    began = D.load_last_good(spark, path)
    for v in (3, 4, 5):
        D.save_last_good(spark.createDataFrame([("c", v)], "k string, v int"), path)
        if v == 3:
            assert began.collect()  # the version before stays for readers that have begun
    assert [r.v for r in D.load_last_good(spark, path).collect()] == [5]
    assert len([p for p in os.listdir(path) if os.path.exists(f"{path}/{p}/_PUBLISHED")]) == D.KEPT_GOOD
    # last good rows may be read and saved again
    D.save_last_good(D.load_last_good(spark, path).drop("stale"), path)
    assert [r.v for r in D.load_last_good(spark, path).collect()] == [5]


@pytest.mark.parametrize("n", [1, 3, 6])
def test_inside_bar_breaks_within_n_bars(spark, n):
    r = random.Random(n)
    closes = [100 + r.choice([0, 0, 0.5, -0.5, 3, -3]) + 0.1 * r.random() for _ in range(150)]
    highs, lows = [c + r.choice([0.2, 1, 2]) for c in closes], [c - r.choice([0.2, 1, 2]) for c in closes]
    want = set()
    for i in range(1, 150):
        if highs[i] <= highs[i - 1] and lows[i] >= lows[i - 1]:
            for j in range(i + 1, min(150, i + n + 1)):
                if closes[j] > highs[i - 1] or closes[j] < lows[i - 1]:
                    want.add((j, "inside_break_up" if closes[j] > highs[i - 1] else "inside_break_down"))
                    break
    bars = make_bars(spark, closes, tf="M15", highs=highs, lows=lows)
    found = G.bar_patterns(bars, break_bars=n).where("pattern LIKE 'inside_break%'").select(
        ((F.unix_seconds("bar_time") - F.lit(int(START.timestamp()))) / 900).cast("int").alias("i"), "pattern").collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want) and want
