from __future__ import annotations

import datetime as dt

import numpy as np
from conftest import START, make_bars
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.streaming import jobs

TICK = "symbol string, ts timestamp, seq bigint, price double"


def ticks(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.uniform(0, 6 * 3600, n))
    return [(["A", "B"][i % 2], START + dt.timedelta(seconds=float(s)), i, float(100 + rng.normal())) for i, s in enumerate(at)]


def test_bars_equal_batch_with_late_rows_dropped(spark, tmp_path):
    rows = ticks(spark, 400)
    src = tmp_path / "in"
    for part in (rows[:250], rows[250:]):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(src))
        stream = jobs.tick_stream(spark, str(src), TICK)
        jobs.run_available(jobs.closed_bar_stream(stream, "H1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = B.ticks_to_bars(spark.createDataFrame(rows, TICK), "H1")
    newest = rows[-1][1] - dt.timedelta(minutes=10)
    closed = batch.where(F.col("bar_time") + F.expr("INTERVAL 1 HOUR") <= F.lit(newest))
    assert got == sorted(map(tuple, closed.collect())) and got
    # a very late row cannot change a bar already emitted
    spark.createDataFrame([("A", START, 999, 1e6)], TICK).coalesce(1).write.mode("append").parquet(str(src))
    jobs.run_available(jobs.closed_bar_stream(jobs.tick_stream(spark, str(src), TICK), "H1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == got


def test_indicators_extend_like_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    closes = 100 + np.cumsum(rng.normal(0, 1, 120))
    bars = make_bars(spark, closes)
    src = str(tmp_path / "bars")
    for lo, hi in ((0, 33), (33, 34), (34, 120)):
        t0, t1 = (F.lit(START + dt.timedelta(hours=h)) for h in (lo, hi))
        bars.where((F.col("bar_time") >= t0) & (F.col("bar_time") < t1)).coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(jobs.indicator_stream(jobs.tick_stream(spark, src, bars.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("bar_time").toPandas()
    want = I.indicator_history(bars).orderBy("bar_time").toPandas()
    assert len(got) == 120
    for name in ("ema", "atr", "rsi", "di_plus", "di_minus", "adx"):
        assert np.allclose(got[name].to_numpy(float), want[name].to_numpy(float), rtol=1e-10, equal_nan=True), name


def test_latest_quotes_upsert(spark, tmp_path):
    rows = ticks(spark, 60)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(src)
        jobs.run_upsert(jobs.latest_quotes(jobs.tick_stream(spark, src, TICK)), out, ck, "symbol", "ts")
    got = {r.symbol: r.seq for r in jobs.latest_version(spark, out).collect()}
    assert got == {"A": 58, "B": 59} and jobs.latest_version(spark, out, before=0) is None


def test_alerts_fire_on_change_only(spark, tmp_path):
    schema = "symbol string, cls string, score double, at timestamp"
    steps = [("buy", 6.0), ("buy", 6.5), ("neutral", 0.0), ("buy", 7.0), ("strong-buy", 8.0), ("sell", -4.0)]
    src = str(tmp_path / "in")
    for i, (cls, score) in enumerate(steps):
        spark.createDataFrame([("A", cls, score, START + dt.timedelta(hours=i))], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(jobs.setup_alerts(jobs.tick_stream(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [r.cls for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == ["buy", "strong-buy"]          # the first sighting only seeds


def test_late_rows_are_kept_apart(spark):
    df = spark.createDataFrame(ticks(spark, 20), TICK)
    mark = F.lit(START + dt.timedelta(hours=3))
    on_time, late = jobs.split_late(df, mark)
    assert on_time.count() + late.count() == 20 and late.count() > 0


def test_upsert_keeps_the_newest_versions(spark, tmp_path):
    sink = jobs.upsert_latest(str(tmp_path), "symbol", "seq")
    for epoch in range(5):
        sink(spark.createDataFrame([("A", START, epoch, float(epoch)), (f"S{epoch}", START, epoch, 1.0)], TICK), epoch)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("version=")) == ["version=3", "version=4"]
    got = {r.symbol: r.price for r in jobs.latest_version(spark, str(tmp_path)).collect()}
    assert got == {"A": 4.0, **{f"S{i}": 1.0 for i in range(5)}}


def test_a_domain_runs_at_its_own_cadence(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame(ticks(spark, 20), TICK).coalesce(1).write.parquet(src)
    quotes = jobs.latest_quotes(jobs.tick_stream(spark, src, TICK))
    query = jobs.start_domain(quotes, "price", out, ck, "symbol", "ts")
    try:
        query.processAllAvailable()
        assert query.name == "price" and query.isActive and {r.symbol for r in jobs.latest_version(spark, out).collect()} == {"A", "B"}
        spark.createDataFrame([("C", START, 99, 1.0)], TICK).coalesce(1).write.mode("append").parquet(src)
        query.processAllAvailable()
        assert {r.symbol for r in jobs.latest_version(spark, out).collect()} == {"A", "B", "C"}
    finally:
        query.stop()
