"""Timeframe signals, composite labels and read-out zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timeframe_code(above: Column, adx: Column, di_plus: Column, di_minus: Column, rsi: Column) -> Column:
    """-2..+2; null where RSI or ADX is missing."""
    up = F.coalesce(above, F.lit(False))
    bull = F.coalesce(di_plus > di_minus, F.lit(False))
    bear = F.coalesce(di_minus > di_plus, F.lit(False))
    return (
        F.when(rsi.isNull() | adx.isNull(), F.lit(None).cast("int"))
        .when(up & (adx >= 25) & bull & (rsi >= 55), 2)
        .when(~up & (adx >= 25) & bear & (rsi <= 45), -2)
        .when(up & (rsi >= 50), 1)
        .when(~up & (rsi <= 50), -1)
        .otherwise(0)
    )


def timeframe_label(code: Column) -> Column:
    return (
        F.when(code == 2, "STRONG BUY").when(code == 1, "BUY").when(code == 0, "NEUTRAL")
        .when(code == -1, "SELL").when(code == -2, "STRONG SELL").otherwise("n/a")
    )


def trend_factor(adx: Column) -> Column:
    """0 in a range (ADX <= 15) to 1 in a trend (ADX >= 25)."""
    return F.when(adx.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (adx - 15.0) / 10.0)))


def composite_class(score: Column) -> Column:
    return (
        F.when(score.isNull(), "na").when(score >= 7, "strong-buy").when(score >= 3, "buy")
        .when(score > -3, "neutral").when(score > -7, "sell").otherwise("strong-sell")
    )


def composite_label(cls: Column) -> Column:
    return F.when(cls == "na", "NO DATA").otherwise(F.upper(F.replace(cls, F.lit("-"), F.lit(" "))))


def ema_zone(distance: Column) -> Column:
    return F.when(distance > 0, "pos").when(distance.isNotNull(), "neg").otherwise("na")


def adx_zone(adx: Column) -> Column:
    return F.when(adx.isNull(), "na").when(adx >= 25, "strong").otherwise("")


def di_zone(di_plus: Column, di_minus: Column) -> Column:
    spread = di_plus - di_minus
    return (
        F.when(spread.isNull(), "na").when(spread >= 5, "pos").when(spread <= -5, "neg").otherwise("")
    )


def rsi_zone(rsi: Column) -> Column:
    return F.when(rsi.isNull(), "na").when(rsi >= 70, "warn-high").when(rsi <= 30, "warn-low").otherwise("")


def activity_tier(cls: Column) -> Column:
    return F.when(cls.isin("strong-buy", "strong-sell"), "touch").when(cls.isin("buy", "sell"), "active").otherwise("quiet")


def extension_tier(value: Column, p95: Column, p99: Column) -> Column:
    """'x' at or beyond p99, 'warn' at or beyond p95; a missing or zero threshold never triggers."""
    size = F.abs(value)
    return (
        F.when((p99 > 0) & (size >= p99), "x").when((p95 > 0) & (size >= p95), "warn").otherwise("")
    )


def gold_impact(change: Column) -> Column:
    """Dollar or yield up is a headwind for gold: -1, 0, +1."""
    return F.when(change > 0, -1).when(change < 0, 1).otherwise(0)
