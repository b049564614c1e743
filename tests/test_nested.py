"""Nested ranges against a walk per range, percentiles in rounds, aligned runs."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.dims import HISTORY_RANGES
from tidemark.operators import intervals as I
from tidemark.operators import nested as N
from tidemark.operators.quantiles import exact_percentiles

DAY = 86400.0
NOW = 400 * DAY


def drawn(seed, n=400, span=400.0):
    """Trades with equal times, zero and repeated results, and long runs; a share lies far back."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = NOW - r.choice([r.uniform(0, span), r.uniform(0, 8), 7, 30]) * DAY
        out.append((i, "X", float(at), float(r.choice([0, 5, 5, -4, -4, r.randint(-30, 30)]) if i % 50 > 20 else r.choice([3, 3, -1]))))
    return out


def per_range(rows, ranges=HISTORY_RANGES):
    for label, days in ranges:
        own = sorted((t, k, p) for k, _, t, p in rows if days is None or (t is not None and t >= NOW - days * DAY))
        if own:
            yield label, own


def walked(own):
    equity, peak, floor, best, curve = 0.0, -np.inf, 0.0, (-1.0, 0.0), []
    run = {1: 0, -1: 0}
    longest = {1: 0, -1: 0}
    for _, ticket, pnl in own:
        equity += pnl
        peak, floor = max(peak, equity), max(floor, equity)
        if floor - equity > best[0]:
            best = (floor - equity, (floor - equity) / floor * 100 if floor > 0 else 0.0)
        for s in (1, -1):
            run[s] = run[s] + 1 if s * pnl > 0 else 0
            longest[s] = max(longest[s], run[s])
        curve.append((ticket, equity, peak, max(0.0, peak)))
    return curve, best, (longest[1], longest[-1], run[1] - run[-1])


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark):
    rows = drawn(request.param) if request.param < 3 else [(0, "X", NOW, -5.0)]
    return rows, spark.createDataFrame(rows, "ticket bigint, symbol string, exit_time double, pnl double").repartition(3)


def test_curve(case):
    rows, trades = case
    found = {(r.range_label, r.ticket): (r.equity, r.peak, r.floor_peak) for r in N.nested_curve(trades, F.lit(NOW)).collect()}
    want = {(label, c[0]): c[1:] for label, own in per_range(rows) for c in walked(own)[0]}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_drawdown_and_streaks(case):
    rows, trades = case
    down = {r.range_label: (r.max_drawdown_abs, r.max_drawdown_pct) for r in N.nested_drawdown(trades, F.lit(NOW)).collect()}
    runs = {r.range_label: (r.max_win_streak, r.max_loss_streak, r.current_streak) for r in N.nested_streaks(trades, F.lit(NOW)).collect()}
    for label, own in per_range(rows):
        _, best, streak = walked(own)
        assert down.pop(label) == pytest.approx(best) and runs.pop(label) == streak
    assert not down and not runs


def test_ratios_and_tail(case):
    rows, trades = case
    ratio = {r.range_label: r for r in N.nested_ratios(trades, F.lit(NOW)).collect()}
    tail = {r.range_label: r for r in N.nested_value_at_risk(trades, F.lit(NOW)).collect()}
    for label, own in per_range(rows):
        pnl = np.array([p for _, _, p in own])
        low = np.percentile(pnl, 5)
        assert tail[label].var_95 == pytest.approx(low) and tail[label].cvar_95 == pytest.approx(pnl[pnl <= low].mean() if (pnl <= low).any() else low)
        if len(pnl) > 1 and pnl.std() > 0:
            assert ratio[label].sharpe == pytest.approx(pnl.mean() / statistics.stdev(pnl.tolist()) * len(pnl) ** 0.5)
    assert len(tail) == len(list(per_range(rows)))


def test_null_times_count_in_the_unbounded_range_only(spark):
    rows = [(1, "X", None, 7.0), (2, "X", NOW - DAY, -3.0)]
    trades = spark.createDataFrame(rows, "ticket bigint, symbol string, exit_time double, pnl double")
    found = {(r.range_label, r.ticket): r.equity for r in N.nested_curve(trades, F.lit(NOW)).collect()}
    assert found["all", 1] == 7.0 and found["all", 2] == 4.0 and found["7d", 2] == -3.0 and ("7d", 1) not in found
    assert N.nested_streaks(trades.where("false"), F.lit(NOW)).count() == 0


def test_trades_are_shuffled_once(case, capsys):
    """Between the written trades and the result no row is multiplied by its ranges before an exchange."""
    _, trades = case
    N.nested_streaks(trades, F.lit(NOW)).explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate explode") < plan.rindex("Exchange hashpartitioning(_segment")


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_in_rounds(spark, seed):
    """A few bins and a low bound on distinct values force many rounds; hot groups, ties, infinities and nulls."""
    r = np.random.default_rng(seed)
    values = [("a", float(x)) for x in r.normal(size=900)] + [("b", float(x)) for x in r.integers(0, 5, 200)] + [("c", 1.0)] * 50
    values += [("d", float("inf")), ("d", float("-inf")), ("d", 2.0), ("e", None), ("f", float("nan")), (None, 4.0), (None, 8.0)]
    names = {"p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(values, "g string, v double").repartition(3)
    found = {row.g: row for row in exact_percentiles(df, ["g"], "v", names, distinct=20, bins=7).collect()}
    groups = {}
    for g, v in values:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert found.keys() == groups.keys()
    for g, vs in groups.items():
        if g != "d":
            assert [found[g][n] for n in names] == pytest.approx(np.percentile(vs, [100 * p for p in names.values()]).tolist())
    assert found["d"].p50 == 2.0
    whole = exact_percentiles(df.where("g = 'a'"), [], "v", names, distinct=20, bins=7).first()
    assert [whole[n] for n in names] == [found["a"][n] for n in names]


def test_percentiles_never_join_rows(spark, capsys):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).cast("double").alias("v"))
    exact_percentiles(df, ["g"], "v", {"m": 0.5}, distinct=100, bins=64).explain()
    assert "Join" not in capsys.readouterr().out


def test_cover_is_the_interval(spark):
    r = random.Random(9)
    rows = [(i, a := r.randint(-500, 500), a + r.randint(-2, 700)) for i in range(60)] + [(99, 0, 4**5 + 3)]
    df = spark.createDataFrame(rows, "i bigint, lo bigint, hi bigint")
    for levels in (0, 2, 5):
        got = {}
        for row in I.covered(df, "lo", "hi", levels).collect():
            got.setdefault(row.i, []).extend(range(row._node << 2 * row._level, row._node + 1 << 2 * row._level))
        assert {k: sorted(v) for k, v in got.items()} == {i: list(range(a, b)) for i, a, b in rows if a < b}


def test_levels_of_runs_come_from_each_other(spark):
    slots = spark.createDataFrame([("X", s, float(s % 17)) for s in range(3, 300)], "symbol string, s bigint, v double")
    tree = I.extremes_by_run(slots, ["symbol"], F.col("s"), {"top": F.col("v")}, {"top": F.max("top")}, 5).collect()
    assert len(tree) < 1.5 * 297
    for r in tree:
        held = [s % 17 for s in range(3, 300) if s >> 2 * r._level == r._node]
        assert held and r.top == max(held)
    assert [I.levels_for(n, 9) for n in (None, 0, 1, 2, 4, 5, 16, 17)] == [0, 0, 0, 1, 1, 2, 2, 3]
