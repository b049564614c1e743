from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from conftest import make_bars, stamp
from pyspark.sql import functions as F

from tidemark.operators import performance as PF
from tidemark.operators import trades as T

DEAL = ("ticket bigint, position_id bigint, symbol string, type int, entry int, volume double, price double, profit double, "
        "time double, swap double, commission double")


def deals(spark, rows):
    full = [(i, pos, "XAUUSD", typ, ent, 0.1, float(px), float(pr), float(t), 0.0, 0.0) for i, (pos, typ, ent, px, pr, t) in enumerate(rows)]
    return spark.createDataFrame(full, DEAL)


def pnl_trades(spark, pnls, times=None):
    rows = [(i, i, "XAUUSD", "BUY", 0.1, float(t) - 600, float(t), 1.0, 2.0, float(p), 0.0, 0.0, float(p))
            for i, (p, t) in enumerate(zip(pnls, times or range(1000, 1000 + len(pnls))))]
    return spark.createDataFrame(rows, "position_id bigint, ticket bigint, symbol string, type string, volume double, entry_time double, "
                                       "exit_time double, entry_price double, exit_price double, profit double, swap double, commission double, pnl double"
                                 ).withColumn("range_label", F.lit("all"))


def test_pair_orphan_balance(spark):
    got = T.pair_deals(deals(spark, [(1, 0, 0, 4500, 0, 10), (1, 1, 1, 4520, 200, 20), (2, 0, 1, 10, -50, 30), (3, 2, 0, 0, 1e5, 5)])).orderBy("position_id").collect()
    assert [(r.type, r.profit, r.is_orphan) for r in got] == [("BUY", 200.0, False), ("SELL", -50.0, True)]
    assert got[0].entry_price == 4500 and got[0].exit_price == 4520 and got[1].entry_time == got[1].exit_time == 30


def test_second_partial_close_is_orphan_and_reversal_only_closes(spark):
    got = T.pair_deals(deals(spark, [(1, 0, 0, 10, 0, 1), (1, 1, 1, 11, 1, 2), (1, 1, 2, 12, 1, 3), (1, 1, 1, 13, 1, 4)])).orderBy("exit_time").collect()
    assert [(r.is_orphan, r.type) for r in got] == [(False, "BUY"), (True, "BUY"), (True, "BUY")]


def test_fifo_equals_a_queue(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 40), rng.choice([0, 1, 2]), rng.choice([0, 0, 1, 1, 2, 3]), i, 1, i // 3) for i in range(6000)]
    queues, want = defaultdict(deque), {}
    for i, (pos, typ, ent, *_ ) in enumerate(rows):
        if typ == 2 or ent == 3:
            continue
        if ent == 0:
            queues[pos].append(i)
        else:
            want[i] = queues[pos].popleft() if queues[pos] else None
    got = {r.ticket: (None if r.is_orphan else int(r.entry_price)) for r in T.pair_deals(deals(spark, rows)).collect()}
    assert got == want


def test_summary_vector(spark):
    r = PF.range_summary(pnl_trades(spark, [200, -50, 100])).where("range_label = 'all'").first()
    assert r.win_rate == pytest.approx(2 / 3) and r.profit_factor == 6 and r.risk_reward == 3 and r.net_profit == 250
    empty = PF.range_summary(pnl_trades(spark, [1])).where("range_label = '7d'").first()
    assert empty.trade_count == 0 and empty.win_rate == 0 and empty.profit_factor is None and empty.risk_reward is None


def test_drawdown_vector_and_both_peaks(spark):
    curve = PF.equity_curve(pnl_trades(spark, [100, 200, -150, -50]))
    d = PF.range_drawdown(curve).first()
    assert d.max_drawdown_abs == 200 and d.max_drawdown_pct == pytest.approx(66.6666667)
    opening = PF.equity_curve(pnl_trades(spark, [-30, 10]))
    assert PF.range_drawdown(opening).first().max_drawdown_abs == 30          # peak floored at zero
    assert PF.risk_ratios(opening).first().max_drawdown_abs == 0              # peak starts at the first equity


def test_hour_and_slices(spark):
    r = PF.range_slices(pnl_trades(spark, [5], [1767236400])).where("slice = 'hour_jst'").first()
    assert r.hour_jst == 12 and r.net_profit == 5


def test_streak_vector(spark):
    t = pnl_trades(spark, [100, 50, -30, -20, 40])
    s = PF.streaks(t).first()
    assert (s.max_win_streak, s.max_loss_streak, s.current_streak) == (2, 2, 1)
    curve = PF.equity_curve(t).orderBy("exit_time").collect()
    assert curve[-1].equity == 140 and PF.risk_ratios(PF.equity_curve(t)).first().max_drawdown_abs == 50
    z = PF.streaks(pnl_trades(spark, [1, 1, 0, -1, -1, -1, 0])).first()
    assert (z.max_win_streak, z.max_loss_streak, z.current_streak) == (2, 3, 0)


def test_single_trade_has_no_ratios(spark):
    r = PF.risk_ratios(PF.equity_curve(pnl_trades(spark, [5]))).first()
    assert r.sharpe is None and r.sortino is None and r.calmar is None
    v = PF.value_at_risk(pnl_trades(spark, [5])).first()
    assert v.var_95 == v.cvar_95 == 5


JOURNAL = ("ts bigint, seq bigint, ticket bigint, sl double, tp double, "
           "ctx map<string, struct<ae: boolean, adx: double, dip: double, dim: double, rsi: double>>, env map<string, double>")


def test_enrich_and_excursion_vector(spark):
    trades = T.pair_deals(deals(spark, [(1, 0, 0, 4500, 0, 1767225600), (1, 1, 1, 4520, 200, 1767225600 + 120), (2, 0, 1, 5, 1, 1)]))
    journal = spark.createDataFrame([(1, 0, 1, 1.0, None, None, None), (2, 1, 1, 4490.0, None, None, {"cot_pctile": 5.0}), (2, 0, 1, 7.0, None, None, None)], JOURNAL)
    e = {r.position_id: r for r in T.enrich(trades, journal).collect()}
    assert e[1].pips == pytest.approx(200) and e[1].r_multiple == pytest.approx(2) and e[1].env == {"cot_pctile": 5.0}
    assert e[2].sl is None and e[2].r_multiple is None and e[2].ctx == {} and e[2].env == {}
    bars = make_bars(spark, [4510, 4510, 4510], "M1", highs=[4512, 4525, 4510], lows=[4498, 4505, 4510], start=stamp("2026-01-01 00:00:00"))
    x = {r.ticket: r for r in T.excursions(trades, bars).collect()}
    assert x[1].mfe_pips == pytest.approx(250) and x[1].mae_pips == pytest.approx(-20)
    assert x[2].mae_pips is None and x[2].mfe_pips is None


def test_excursions_equal_brute_force(spark):
    rng = random.Random(8)
    n = 3000
    hi = [100 + rng.random() * 50 for _ in range(n)]
    lo = [100 - rng.random() * 50 for _ in range(n)]
    bars = make_bars(spark, [100] * n, "M1", highs=hi, lows=lo, skip=set(rng.sample(range(n), 300)), start=stamp("2026-01-01 00:00:00"))
    have = {int((r.bar_time.timestamp() - 1767225600) // 60) for r in bars.select("bar_time").collect()}
    rows, want = [], {}
    for k in range(200):
        a = rng.uniform(-50, n + 50) * 60
        b = a + rng.choice([0, 30, 61, 3600, 86400, 200000]) * rng.random()
        rows.append((k, 0, "XAUUSD", "BUY" if k % 2 else "SELL", 1767225600 + a, 1767225600 + b, 100.0))
        inside = [i for i in have if a <= i * 60 <= b]
        h, w = (max((hi[i] for i in inside), default=None), min((lo[i] for i in inside), default=None))
        want[k] = None if h is None else ((w - 100) / 0.1, (h - 100) / 0.1) if k % 2 else ((100 - h) / 0.1, (100 - w) / 0.1)
    t = spark.createDataFrame(rows, "ticket bigint, position_id bigint, symbol string, type string, entry_time double, exit_time double, entry_price double")
    for levels in (12, 2):
        got = {r.ticket: None if r.mae_pips is None else (r.mae_pips, r.mfe_pips) for r in T.excursions(t, bars, levels=levels).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k] == (None if w is None else pytest.approx(w)), k


def test_edge_vector(spark):
    ctx = lambda ae, adx: {"M15": (ae, adx, None, None, None)}
    rows = [(100.0, 0.0, 600.0, ctx(True, 28.0), {"cot_pctile": 5.0}), (-50.0, 0.0, 600.0, ctx(True, 28.0), {}), (10.0, 600.0, 0.0, ctx(None, None), {"flip_norm": -0.3})]
    t = spark.createDataFrame(rows, "pnl double, entry_time double, exit_time double, "
                                    "ctx map<string, struct<ae: boolean, adx: double, dip: double, dim: double, rsi: double>>, env map<string, double>")
    e = {(r.dimension, r.bucket): r for r in PF.edge_stats(t).collect()}
    assert e["alignment", "M15_above"].n == 2 and e["alignment", "M15_above"].win_rate == 0.5 and e["alignment", "M15_above"].pf == 2
    assert e["adx", "25~30"].n == 2 and e["alignment", "M15_below"].n == 1 and e["cot_extreme", "low"].n == 1
    assert e["hold_min", "<15"].n == 3 and e["flip", "0.25~0.5"].n == 1 and e["weekday_jst", "木"].n == 3
    assert ("rsi", "<30") not in e


def test_ranges_use_exact_seconds(spark):
    t = pnl_trades(spark, [1, 1, 1], [86400.0 * 10, 86400.0 * 9, 86400.0 * 9 - 1]).drop("range_label")
    got = {(r.range_label, r.ticket) for r in PF.in_ranges(t, F.lit(86400.0 * 10)).collect()}
    assert ("24h", 1) in got and ("24h", 2) not in got and ("all", 2) in got
