"""Hand-computed vectors, a sequential reference for long gappy series, and causality."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.scan import CELL, affine_scan, chain, first_value_ema, sma_seeded_ema, with_cell


def smooth(v, period, alpha):
    out = np.full(len(v), np.nan)
    if len(v) < period:
        return out
    y = float(np.mean(v[:period]))
    out[period - 1] = y
    for i in range(period, len(v)):
        y = alpha * v[i] + (1 - alpha) * y
        out[i] = y
    return out


def sequential(h, lo, c, adx_period=14):
    pc = c[:-1]
    tr = np.r_[h[0] - lo[0], np.maximum.reduce([h[1:] - lo[1:], abs(h[1:] - pc), abs(lo[1:] - pc)])]
    d = np.diff(c)
    ag, al = smooth(np.where(d > 0, d, 0), 14, 1 / 14), smooth(np.where(d < 0, -d, 0), 14, 1 / 14)
    up, dn = h[1:] - h[:-1], lo[:-1] - lo[1:]
    sp = smooth(np.where((up > dn) & (up > 0), up, 0), adx_period, 1 / adx_period)
    sm = smooth(np.where((dn > up) & (dn > 0), dn, 0), adx_period, 1 / adx_period)
    st = smooth(tr[1:], adx_period, 1 / adx_period)
    with np.errstate(all="ignore"):
        rsi = np.r_[np.nan, np.where(al == 0, 100.0, 100 - 100 / (1 + ag / al))]
        dp, dm = 100 * sp / st, 100 * sm / st
        dx = np.where(dp + dm > 0, 100 * abs(dp - dm) / (dp + dm), 0.0)
    rsi[np.isnan(np.r_[np.nan, ag])] = np.nan
    return {"ema": smooth(c, 20, 2 / 21), "atr": smooth(tr, 14, 1 / 14), "rsi": rsi, "di_plus": np.r_[np.nan, dp],
            "di_minus": np.r_[np.nan, dm], "adx": np.r_[np.nan, smooth(dx, adx_period, 1 / adx_period)]}


def column(df, name):
    return [r[name] for r in df.orderBy("bar_time").select(name).collect()]


def ema_of(spark, closes, period, cell="cell"):
    bars = make_bars(spark, closes)
    chained = chain(with_cell(bars)) if cell else chain(bars, cell=None)
    return column(affine_scan(chained, [sma_seeded_ema("y", F.col("close"), period)], cell=cell), "y")


def test_ema_seed_and_steps(spark):
    got = ema_of(spark, range(1, 11), 5)
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(3.0)
    assert ema_of(spark, range(10, 18), 3) == [None, None] + [pytest.approx(v) for v in (11, 12, 13, 14, 15, 16)]


def test_ema_bad_or_short(spark):
    with pytest.raises(ValueError):
        sma_seeded_ema("y", F.col("close"), 0)
    assert ema_of(spark, [1, 2], 5) == [None, None]


def test_true_range_and_atr(spark):
    bars = make_bars(spark, [9.5, 10.5, 11.5, 12.5, 13.5], highs=[10, 11, 12, 13, 14], lows=[9, 10, 11, 12, 13])
    chained = chain(bars, ("close",), cell=None)
    assert column(chained.withColumn("tr", I.true_range()), "tr")[:3] == [1.0, 1.5, 1.5]
    out = column(I.indicator_history(bars, atr_period=3), "atr")
    assert out[2] == pytest.approx(4 / 3) and out[3] == pytest.approx((8 / 3 + 1.5) / 3)


def test_rsi_extremes(spark):
    assert column(I.indicator_history(make_bars(spark, range(1, 30))), "rsi")[-1] == 100.0
    assert column(I.indicator_history(make_bars(spark, range(30, 1, -1))), "rsi")[-1] == pytest.approx(0.0)
    flat = column(I.indicator_history(make_bars(spark, [5.0] * 30)), "rsi")
    assert flat[13] is None and flat[14] == 100.0


def test_adx_flat_and_trending(spark):
    assert column(I.indicator_history(make_bars(spark, [100.0] * 50, spread=0.0)), "adx")[-1] == 0.0
    last = I.indicator_history(make_bars(spark, np.linspace(100, 150, 80), spread=0.1)).orderBy(F.desc("bar_time")).first()
    assert last.adx > 80 and last.di_plus > last.di_minus


def test_adx_warm_up_seed(spark):
    rng = np.random.default_rng(7)
    bars = make_bars(spark, 100 + np.cumsum(rng.normal(0, 1, 60)))
    quirk = column(I.indicator_history(bars), "adx")
    strict = column(I.indicator_history(bars, adx_seed="wilder"), "adx")
    assert quirk[13] is None and quirk[14] is not None
    assert strict[26] is None and strict[27] is not None
    short = column(I.indicator_history(make_bars(spark, range(28))), "adx")
    assert short == [None] * 28


def test_long_gappy_series_matches_sequential(spark):
    rng = np.random.default_rng(3)
    n = CELL * 5 + 37
    closes = 100 + np.cumsum(rng.normal(0, 0.5, n))
    closes[600:1100] = closes[600]          # a long flat stretch keeps its ratios
    skip = set(range(300, 290 + CELL)) | {5, 6, 1200}
    bars = make_bars(spark, closes, spread=0.0, skip=skip).orderBy(F.rand(1))
    keep = np.array([i for i in range(n) if i not in skip])
    c = closes[keep]
    want = sequential(c, c, c)
    rows = I.indicator_history(bars).orderBy("bar_time").toPandas()
    for name, w in want.items():
        got = rows[name].to_numpy(float)
        live = ~np.isnan(w)
        assert (np.isnan(got) == ~live).all(), name
        assert np.allclose(got[live], w[live], rtol=1e-9, atol=1e-10), name


def test_no_repaint(spark):
    rng = np.random.default_rng(11)
    closes = 100 + np.cumsum(rng.normal(0, 1, 400))
    early = I.indicator_history(make_bars(spark, closes[:300])).orderBy("bar_time").toPandas()
    late = I.indicator_history(make_bars(spark, closes)).orderBy("bar_time").toPandas().iloc[:300]
    for name in ("ema", "atr", "rsi", "adx", "di_plus", "di_minus"):
        assert np.allclose(early[name].to_numpy(float), late[name].to_numpy(float), rtol=1e-12, equal_nan=True)


def test_first_value_ema_is_ewm(spark):
    import pandas as pd
    closes = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = affine_scan(chain(with_cell(make_bars(spark, closes))), [first_value_ema("y", F.col("close"), 3)])
    assert column(rows, "y") == pytest.approx(pd.Series(closes).ewm(span=3, adjust=False).mean().tolist())


def test_period_one_is_identity(spark):
    assert ema_of(spark, [3, 1, 4, 1, 5], 1) == pytest.approx([3, 1, 4, 1, 5])
    assert ema_of(spark, [3, 1, 4, 1, 5], 1, cell=None) == pytest.approx([3, 1, 4, 1, 5])


def test_table_reads_last_closed_bar(spark):
    rng = np.random.default_rng(42)
    closes = 100 + np.cumsum(rng.normal(0, 0.05, 400))
    bars = make_bars(spark, closes).unionByName(make_bars(spark, [1.0], symbol="LONELY")).unionByName(
        make_bars(spark, [1.0, 2.0, 3.0], symbol="SHORT"))
    got = {r.symbol: r for r in I.indicator_table(bars).collect()}
    assert set(got) == {"XAUUSD", "SHORT"}          # fewer than two bars: omitted
    c = closes[-240:]                                # the hourly look-back
    want = sequential(c + 0.2, c - 0.2, c)
    assert got["XAUUSD"].last_close == pytest.approx(c[-2])
    for name, w in want.items():
        assert got["XAUUSD"][name] == pytest.approx(w[:-1][-1], rel=1e-9), name
    assert got["SHORT"].last_close == 2.0 and got["SHORT"].ema is None and got["SHORT"].above_ema is None
