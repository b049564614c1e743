"""Chart-line geometry and naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sec(ts: Column) -> Column:
    return F.unix_seconds(ts).cast("double")


def line_value(t1: Column, p1: Column, t2: Column, p2: Column, at: Column) -> Column:
    """Price of the line through two points at a time; a vertical pair gives its first price."""
    run = _sec(t2) - _sec(t1)
    return F.when(run == 0, p1).otherwise(p1 + F.try_divide(p2 - p1, run) * (_sec(at) - _sec(t1)))


def slope_per_second(t1: Column, p1: Column, t2: Column, p2: Column) -> Column:
    """Slope of `line_value`; zero for a vertical pair."""
    run = _sec(t2) - _sec(t1)
    return F.when(run == 0, 0.0).otherwise(F.try_divide(p2 - p1, run))


def slope_per_day(t1: Column, p1: Column, t2: Column, p2: Column) -> Column:
    days = (_sec(t2) - _sec(t1)) / 86400.0
    return F.coalesce(F.try_divide(p2 - p1, days), F.lit(0.0))


def channel_offset(t1: Column, p1: Column, t2: Column, p2: Column, t3: Column, p3: Column) -> Column:
    return p3 - line_value(t1, p1, t2, p2, t3)


def fibonacci_price(p1: Column, p2: Column, ratio: Column) -> Column:
    return p1 + (p2 - p1) * ratio


def name_category(name: Column) -> Column:
    """Category by the drawing name's prefix."""
    return (
        F.when(name.rlike("^R\\d*_"), "resistance").when(name.rlike("^S\\d*_"), "support")
        .when(name.rlike("^TL_up"), "trend_up").when(name.rlike("^TL_dn"), "trend_down")
        .when(name.rlike("^zone_supply"), "supply").when(name.rlike("^zone_demand"), "demand").otherwise("other")
    )


def name_weight(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "_(strong|major|weak)(?:_|$)", 1), F.lit(""))


def name_timeframe(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "_(D1|H4|H1)(?:_|$)", 1), F.lit(""))
