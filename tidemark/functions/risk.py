"""Position sizing, expectancy and limit gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import (
    DAILY_LOSS_LIMIT_PCT, LOT_EQUITY_STEP, LOT_MAX, LOT_MIN, MAX_DRAWDOWN_LIMIT_PCT, MIN_EDGE_SAMPLE, PIP_VALUE_PER_LOT)
from tidemark.functions.guards import is_finite


def recommended_lot(equity: Column) -> Column:
    """One hundredth of a lot per full equity step, clamped; missing, non-finite or non-positive equity -> minimum."""
    steps = F.floor(F.least(equity, F.lit(LOT_MAX * 100 * LOT_EQUITY_STEP)) / F.lit(LOT_EQUITY_STEP))
    lot = steps.cast("double") / F.lit(100.0)
    return F.when(is_finite(equity) & (equity > 0), F.greatest(F.lit(LOT_MIN), F.least(F.lit(LOT_MAX), lot))).otherwise(
        F.lit(LOT_MIN))


def pip_value(lots: Column) -> Column:
    return lots * F.lit(PIP_VALUE_PER_LOT)


def lots_for_risk(risk_amount: Column, stop_pips: Column, pip_value_per_lot: Column) -> Column:
    return F.when((stop_pips > 0) & (pip_value_per_lot > 0), F.try_divide(risk_amount, stop_pips * pip_value_per_lot))


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.try_divide(F.abs(target - entry), risk))


def expectancy(win_rate: Column, rr: Column) -> Column:
    return win_rate * rr - (F.lit(1.0) - win_rate)


def breakeven_win_rate(rr: Column) -> Column:
    return F.when(rr > 0, F.try_divide(F.lit(1.0), F.lit(1.0) + rr))


def kelly(win_rate: Column, rr: Column) -> Column:
    return F.when(rr > 0, win_rate - F.try_divide(F.lit(1.0) - win_rate, rr))


def risk_of_ruin(win_rate: Column, rr: Column, units: Column) -> Column:
    edge = expectancy(win_rate, rr)
    ratio = F.try_divide(F.lit(1.0) - edge, F.lit(1.0) + edge)
    return F.when(edge <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(ratio, units))))


def liquidation_pips(equity: Column, margin: Column, lots: Column) -> Column:
    per_pip = pip_value(lots)
    return F.when(per_pip > 0, F.try_divide(equity - margin, per_pip))


def liquidation_price(entry: Column, pips: Column) -> Column:
    return entry - pips * 0.10


def edge_lot(win_rate: Column, rr: Column, balance: Column, stop_pips: Column) -> Column:
    """Quarter-Kelly lot from realised results; null when nothing may be risked."""
    risk = F.greatest(F.lit(0.0), kelly(win_rate, rr)) / 4.0 * balance
    return F.when((balance > 0) & (risk > 0), lots_for_risk(risk, stop_pips, F.lit(PIP_VALUE_PER_LOT)))


def few_trades(n: Column) -> Column:
    return n < MIN_EDGE_SAMPLE


def daily_budget_left(balance: Column, today: Column) -> Column:
    """Share of the daily loss allowance still unused."""
    limit = balance * (DAILY_LOSS_LIMIT_PCT / 100.0)
    used = F.when(today < 0, -today).otherwise(F.lit(0.0))
    return F.when(limit > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(used, limit))).otherwise(F.lit(1.0))


def risk_gated(balance: Column, today: Column, drawdown_pct: Column) -> Column:
    daily = (balance > 0) & (today <= balance * (-DAILY_LOSS_LIMIT_PCT / 100.0))
    return F.coalesce(daily, F.lit(False)) | F.coalesce(drawdown_pct >= MAX_DRAWDOWN_LIMIT_PCT, F.lit(False))


def snapped_lot(lots: Column, vmin: Column, vmax: Column, step: Column, cap: float = LOT_MAX) -> Column:
    """Requested lots on the broker's volume grid, never above the cap; below the minimum -> null (rejected)."""
    ceiling = F.least(vmax, F.lit(cap))
    clamped = F.greatest(vmin, F.least(ceiling, lots))
    snapped = vmin + F.rint((clamped - vmin) / step) * step
    bounded = F.greatest(vmin, F.least(ceiling, snapped))
    digits = F.when(step >= 1, 0).otherwise(F.greatest(F.lit(2), F.rint(-F.log10(step)).cast("int")))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(lots >= vmin, F.rint(bounded * scale) / scale)
