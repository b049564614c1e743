from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from tidemark.operators import oscillator as O
from tidemark.operators import setups as U
from tidemark.dims import OSC_MODES


def ewm(v, p):
    return pd.Series(v).ewm(span=p, adjust=False).mean().to_numpy()


@pytest.mark.parametrize("n", [100, 500, 1501])
def test_ramp(spark, n):
    closes = 2000 + 0.2 * np.arange(n)
    rows = O.oscillator(make_bars(spark, closes, "M15", spread=1.0), "M15").orderBy("bar_time").toPandas()
    if n == 100:
        assert rows.empty
        return
    c = closes[-1500:][:-1]
    center = ewm(c, 320)
    assert len(rows) == min(480, len(c))
    assert np.allclose(rows["dev_price"], ((c - center) / center * 100)[-480:], rtol=1e-9)
    assert np.allclose(rows["ema_fast"], ewm(c, 20)[-480:], rtol=1e-12)
    assert rows["price"].iloc[-1] == pytest.approx(c[-1])


def test_placeholder_rows(spark):
    expected = spark.createDataFrame([("XAUUSD",), ("GONE",)], "symbol string")
    snap = O.oscillator_snapshot(O.oscillator(make_bars(spark, 2000 + 0.2 * np.arange(600), "M15"), "M15"))
    got = {r.symbol: r for r in O.with_placeholders(expected, snap, ["symbol"]).collect()}
    assert got["GONE"].stale and got["GONE"].price is None and not got["XAUUSD"].stale


def test_bands_match_numpy_and_are_ordered(spark):
    rng = np.random.default_rng(5)
    closes = 2000 + np.cumsum(rng.normal(0, 1, 1400))
    periods = OSC_MODES["M15"][1]
    got = O.disparity_bands(make_bars(spark, closes, "M15"), "M15", periods).collect()
    assert len(got) == 6
    for r in got:
        d = ((closes - ewm(closes, r.period)) / ewm(closes, r.period) * 100)[max(periods):]
        a = np.abs(d[d > 0] if r.side == "pos" else d[d < 0])
        assert r.n == a.size
        assert [r.p90, r.p95, r.p99, r.max] == pytest.approx([*np.percentile(a, (90, 95, 99)), a.max()], rel=1e-9)
        assert r.p90 <= r.p95 <= r.p99 <= r.max


def test_bands_of_an_empty_side_are_zero(spark):
    got = O.disparity_bands(make_bars(spark, np.linspace(100, 200, 200)), "X", (5, 10)).where("side = 'neg'").collect()
    assert all(r.p90 == r.p99 == r.max == 0.0 and r.n == 0 for r in got) and len(got) == 2


def test_index_card_hides_the_forming_bar(spark):
    card = O.index_card(make_bars(spark, [99.0, 99.5, 99.2, 99.8, 999.0])).first()
    assert card.price == 99.8 and card.prev_close == 99.2 and card.closes == [99.0, 99.5, 99.2, 99.8]
    assert card.change == pytest.approx(0.6) and card.change_pct == pytest.approx(0.6 / 99.2 * 100)
    assert card.ema == pytest.approx(ewm([99.0, 99.5, 99.2, 99.8], 20)[-1]) and card.above_ema


def test_composite_and_setups(spark):
    rows = [("A", tf, 100.0, 90.0, True, 60.0, 30.0, 30.0, 10.0) for tf in ("D1", "H4", "H1", "M15")]
    rows += [("B", "D1", 100.0, 110.0, False, 40.0, 30.0, 10.0, 30.0), ("B", "H1", 1.0, 1.0, None, None, 20.0, 1.0, 1.0)]
    rows += [("C", "D1", 100.0, 90.0, True, 60.0, 15.0, 30.0, 10.0), ("D", "D1", 1.0, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "symbol string, tf string, last_close double, ema double, above_ema boolean, rsi double, "
                                        "adx double, di_plus double, di_minus double")
    scores = U.composite_scores(table)
    got = {r.symbol: r for r in scores.collect()}
    assert got["A"].score == pytest.approx(10) and got["A"].cls == "strong-buy" and got["A"].activity == "touch"
    assert got["B"].score == pytest.approx(-10) and got["B"].label == "STRONG SELL"      # the unusable timeframe counts nowhere
    assert got["C"].score == 0 and got["C"].cls == "neutral"                              # ranging market is gated out
    assert got["D"].label == "NO DATA" and got["D"].cls == "na"
    strong = U.high_conviction(scores)
    assert [r.symbol for r in U.top_setups(strong).collect()] == ["A", "B"]
    before = spark.createDataFrame([("A", "strong-buy"), ("B", "buy")], "symbol string, cls string")
    assert [r.symbol for r in U.new_setups(strong, before).collect()] == ["B"]
    sig = {(r.symbol, r.tf): r for r in U.signal_table(table).collect()}
    assert sig["A", "D1"].label == "STRONG BUY" and sig["B", "H1"].label == "n/a" and sig["B", "H1"].code == 0


def test_tiers(spark):
    bars = make_bars(spark, 2000 + np.sin(np.arange(700)) * 5, "M15")
    periods = OSC_MODES["M15"][1]
    rows = O.oscillator(bars, "M15")
    tiers = O.with_extension_tiers(rows, O.disparity_bands(bars, "M15", periods), periods)
    assert {r.tier0 for r in tiers.select("tier0").distinct().collect()} <= {"", "warn", "x"}
    assert tiers.where("tier0 = 'x'").count() > 0
    none = spark.createDataFrame([], "mode string, period int, side string, p90 double, p95 double, p99 double, max double, n bigint")
    assert O.with_extension_tiers(rows, none, periods).where(F.col("tier0") != "").count() == 0
