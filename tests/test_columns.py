from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import guards as G
from tidemark.functions import lines as L
from tidemark.functions import price as P
from tidemark.functions import risk as R
from tidemark.functions.bins import bin_label, bin_labels
from tidemark.dims import R_MULTIPLE_BINS


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_lot_ladder(spark):
    cases = {1e5: 0.01, 199999.0: 0.01, 2e5: 0.02, 250000.0: 0.02, 1e6: 0.10, 5e6: 0.50, 5e4: 0.01, 0.0: 0.01, 1e9: 10.0, 1e30: 10.0,
             None: 0.01, float("nan"): 0.01, float("inf"): 0.01, -5.0: 0.01}
    got = values(spark, [(k,) for k in cases], "e double", R.recommended_lot(F.col("e")))
    assert [g[0] for g in got] == pytest.approx(list(cases.values()))


def test_pip_sizes(spark):
    rows = [("XAUUSD", 2, 0.01), ("XAUUSD", 3, 0.001), ("EURUSD", 5, 0.00001), ("USDJPY", 3, 0.001), ("EURUSD", 4, 0.0001)]
    got = values(spark, rows, "b string, d int, p double", P.pip_size(F.col("b"), F.col("d"), F.col("p")))
    assert [g[0] for g in got] == pytest.approx([0.10, 0.10, 0.0001, 0.01, 0.0001])


def test_bins(spark):
    assert bin_labels((0.25, 0.5)) == ["<0.25", "0.25~0.5", ">=0.5"]
    got = values(spark, [(-3.5,), (-3.0,), (0.0,), (3.99,), (4.0,), (None,)], "v double", bin_label(F.col("v"), R_MULTIPLE_BINS))
    assert [g[0] for g in got] == ["<-3", "-3~-2", "0~1", "3~4", ">=4", None]


def test_money_formulas(spark):
    w, rr, u = F.lit(0.5), F.lit(2.0), F.lit(20)
    got = values(spark, [(1,)], "x int", R.expectancy(w, rr), R.breakeven_win_rate(rr), R.kelly(w, rr), R.risk_of_ruin(w, rr, u), R.risk_of_ruin(w, F.lit(0.5), u),
                 R.kelly(w, F.lit(0.0)), R.lots_for_risk(F.lit(100.0), F.lit(0), F.lit(10.0)), R.reward_risk(F.lit(1.0), F.lit(1.0), F.lit(2.0)),
                 R.edge_lot(w, rr, F.lit(10000.0), F.lit(50)), R.liquidation_pips(F.lit(1000.0), F.lit(200.0), F.lit(0.1)))[0]
    assert got[:5] == pytest.approx((0.5, 1 / 3, 0.25, (0.5 / 1.5) ** 20, 1.0)) and got[5] is got[6] is got[7] is None
    assert got[8] == pytest.approx(0.25 / 4 * 10000 / 500) and got[9] == pytest.approx(800)


def test_gates_and_budget(spark):
    rows = [(1000.0, -30.0, 0.0), (1000.0, -29.0, 9.9), (1000.0, 5.0, 10.0), (0.0, -5.0, None), (1000.0, None, None)]
    b, t, d = F.col("b"), F.col("t"), F.col("d")
    got = values(spark, rows, "b double, t double, d double", R.risk_gated(b, t, d), R.daily_budget_left(b, t))
    assert [g[0] for g in got] == [True, False, True, False, False]
    assert [g[1] for g in got] == pytest.approx([0.0, 1 / 30, 1.0, 1.0, 1.0])


def test_snapped_lots(spark):
    rows = [(0.005, 0.01, 100.0, 0.01), (0.017, 0.01, 100.0, 0.01), (50.0, 0.01, 100.0, 0.01), (0.1234, 0.001, 5.0, 0.001), (3.4, 1.0, 9.0, 1.0)]
    got = values(spark, rows, "l double, a double, b double, s double", R.snapped_lot(*[F.col(c) for c in "labs"]))
    assert got[0][0] is None and [g[0] for g in got[1:]] == pytest.approx([0.02, 10.0, 0.123, 3.0])


def test_guards(spark):
    rows = [(" 12.9 ",), ("-3.2",), ("x",), (None,), ("NaN",), ("1e3",)]
    got = values(spark, rows, "v string", G.to_long(F.col("v")), G.one_decimal(F.col("v")))
    assert [g[0] for g in got] == [12, -3, None, None, None, 1000] and got[0][1] == 12.9 and got[2][1] is None
    slug = values(spark, [("A b/c..d",), (None,), ("",), ("..",)], "v string", G.path_slug(F.col("v")))
    assert [s[0] for s in slug] == ["A_b_c_d", "unknown", "unknown", "_"]
    assert values(spark, [("u?api_key=abc&x=1 api_key=q",)], "v string", G.redact(F.col("v")))[0][0] == "u?api_key=***&x=1 api_key=***"
    fin = values(spark, [(1.0,), (math.inf,), (math.nan,), (None,)], "v double", G.finite_or_null(F.col("v")))
    assert [f[0] for f in fin] == [1.0, None, None, None]


def test_spread_r_and_disparity(spark):
    got = values(spark, [(1,)], "x int", P.spread_pips(F.lit(1.0), F.lit(1.0002), F.lit(10000.0)), P.spread_pips(F.lit(2.0), F.lit(1.0), F.lit(1.0)),
                 P.spread_pips(F.lit(1.0), F.lit(math.inf), F.lit(1.0)), P.position_r(F.lit("SELL"), F.lit(10.0), F.lit(8.0), F.lit(11.0)),
                 P.position_r(F.lit("BUY"), F.lit(10.0), F.lit(8.0), F.lit(0.0)), P.disparity(F.lit(110.0), F.lit(100.0)), P.disparity(F.lit(1.0), F.lit(0.0)),
                 P.disparity_from_deviations(F.lit(10.0), F.lit(-100.0)), P.min_max_scaled(F.lit(5.0), F.lit(5.0), F.lit(5.0)))[0]
    assert got[:4] == pytest.approx((2.0, 0.0, 0.0, 2.0)) and got[4] is None and got[5] == pytest.approx(10) and got[6] is None and got[7] == 0 and got[8] == 0


def test_line_geometry(spark):
    t = [F.lit(f"2026-01-0{d} 00:00:00").cast("timestamp") for d in (1, 2, 3)]
    got = values(spark, [(1,)], "x int", L.line_value(t[0], F.lit(10.0), t[1], F.lit(12.0), t[2]), L.line_value(t[0], F.lit(10.0), t[0], F.lit(12.0), t[2]),
                 L.slope_per_day(t[0], F.lit(10.0), t[2], F.lit(12.0)), L.slope_per_day(t[0], F.lit(1.0), t[0], F.lit(2.0)),
                 L.channel_offset(t[0], F.lit(10.0), t[1], F.lit(12.0), t[2], F.lit(15.0)), L.fibonacci_price(F.lit(10.0), F.lit(20.0), F.lit(0.618)),
                 L.name_category(F.lit("R1_strong_D1")), L.name_weight(F.lit("R1_strong_D1")), L.name_timeframe(F.lit("R1_strong_D1")))[0]
    assert got[:6] == pytest.approx((14.0, 10.0, 1.0, 0.0, 1.0, 16.18)) and got[6:] == ("resistance", "strong", "D1")


def test_range_days_and_timeframe_order(spark):
    from tidemark.operators.indicators import by_timeframe
    from tidemark.operators.performance import range_days
    got = values(spark, [("24h",), ("1Y",), ("all",), ("zzz",)], "v string", range_days(F.col("v")))
    assert [g[0] for g in got] == [1, 365, 90, 90]
    rows = spark.createDataFrame([("A", t) for t in ("M15", "W1", "D1", "H1", "H4")], "symbol string, tf string")
    assert [r.tf for r in by_timeframe(rows).collect()] == ["D1", "H4", "H1", "M15", "W1"]


def test_long_legs_keep_their_whole_text(spark):
    from tidemark.functions.price import split_pair
    long = "EUR" + "X" * 300
    row = spark.createDataFrame([(long,)], "pair string").select(*split_pair(F.col("pair"))).first()
    assert tuple(row) == ("EUR", "X" * 300)
