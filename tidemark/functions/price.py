"""Pips, spreads, R multiples, symbol names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import DEFAULT_PIP_PRICE, FUTURES_MONTH_CODES, FUTURES_NAME, PIP_PRICE


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))[key]


def pip_size(base: Column, digits: Column, point: Column) -> Column:
    """Gold 0.10 whatever the quote precision; odd digits ten points; even digits one point."""
    return (
        F.when(F.upper(base).startswith("XAU"), F.lit(0.10))
        .when(digits % 2 == 1, point * 10.0)
        .otherwise(point)
    )


def pip_price(symbol: Column) -> Column:
    return F.coalesce(_lookup(PIP_PRICE, symbol), F.lit(DEFAULT_PIP_PRICE))


def trade_move(side: Column, entry: Column, exit_: Column) -> Column:
    return F.when(side == "BUY", exit_ - entry).otherwise(entry - exit_)


def trade_pips(symbol: Column, side: Column, entry: Column, exit_: Column) -> Column:
    return trade_move(side, entry, exit_) / pip_price(symbol)


def r_multiple(symbol: Column, side: Column, entry: Column, exit_: Column, stop: Column) -> Column:
    """Realised pips over risked pips; null without a usable stop."""
    risk = F.abs(entry - stop) / pip_price(symbol)
    return F.when(risk > 0, F.try_divide(trade_pips(symbol, side, entry, exit_), risk))


def position_r(side: Column, opened: Column, current: Column, stop: Column) -> Column:
    """R of an open position; a stop of 0 means none."""
    risk = F.abs(opened - stop)
    return F.when((stop != 0) & (risk > 0), F.try_divide(trade_move(side, opened, current), risk))


def net_pnl(profit: Column, swap: Column, commission: Column) -> Column:
    return profit + swap + commission


def price_digits(price: Column, broker_digits: Column) -> Column:
    size = F.abs(price)
    guess = F.when(price.isNull() | F.isnan(price) | (size == F.lit(float("inf"))), 2).when(size >= 1000, 2).when(
        size >= 50, 3).otherwise(5)
    return F.coalesce(broker_digits, guess)


def pip_multiplier(symbol: Column, broker_pip: Column) -> Column:
    """Price units -> pips, from the broker's pip size or by currency convention."""
    return (
        F.when(symbol.isNull() | (symbol == ""), F.lit(10000.0))
        .when(broker_pip > 0, F.try_divide(F.lit(1.0), broker_pip))
        .when(symbol.endswith("JPY"), F.lit(100.0))
        .when(symbol.startswith("XAU") | symbol.startswith("XAG"), F.lit(10.0))
        .otherwise(F.lit(10000.0))
    )


def spread_pips(bid: Column, ask: Column, multiplier: Column) -> Column:
    """0 when crossed or not finite."""
    inf = F.lit(float("inf"))
    fine = ~F.isnan(bid) & ~F.isnan(ask) & (F.abs(bid) != inf) & (F.abs(ask) != inf) & (ask >= bid)
    return F.when(fine, (ask - bid) * multiplier).otherwise(F.lit(0.0))


def split_pair(pair: Column) -> tuple[Column, Column]:
    return F.substring(pair, 1, 3), F.substr(pair, F.lit(4))


def contract_month(name: Column, now: Column) -> Column:
    """Expiry of a futures name ``..._<month code><1-2 year digits>`` as ``year*100 + month``; null if it has none."""
    code = F.regexp_extract(F.upper(name), FUTURES_NAME, 1)
    digits = F.regexp_extract(F.upper(name), FUTURES_NAME, 2)
    year_now = F.year(now)
    single = F.floor(year_now / 10) * 10 + digits.try_cast("int")
    year = F.when(F.length(digits) == 1, F.when(single < year_now - 1, single + 10).otherwise(single)).otherwise(
        F.lit(2000) + digits.try_cast("int"))
    return F.when(code != "", year * 100 + _lookup(FUTURES_MONTH_CODES, code)).cast("long")


def disparity(price: Column, mean: Column) -> Column:
    """Percent distance of price from a mean; null when the mean is null or 0."""
    return F.try_divide(price - mean, mean) * 100.0


def disparity_from_deviations(dev_price: Column, dev_mean: Column) -> Column:
    """Percent distance of price from a mean when both are given as percent deviations from a third line."""
    base = F.lit(1.0) + dev_mean / 100.0
    return F.when(base == 0, F.lit(0.0)).otherwise(
        (F.try_divide(F.lit(1.0) + dev_price / 100.0, base) - 1.0) * 100.0)


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    """Position between low and high; a zero span counts as 1."""
    span = high - low
    return (value - low) / F.when(span == 0, F.lit(1.0)).otherwise(span)
