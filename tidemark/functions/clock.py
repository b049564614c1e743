"""Zone shifts, feed clock parsing and reporting-zone formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import JST_SECONDS, UNTIMED


def jst(ts: Column) -> Column:
    """UTC timestamp -> the same instant's UTC+9 wall clock."""
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(JST_SECONDS * 1_000_000))


def jst_hour(ts: Column) -> Column:
    return F.hour(jst(ts))


def jst_weekday(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(jst(ts))


def jst_clock(ts: Column) -> Column:
    return F.coalesce(F.date_format(jst(ts), "HH:mm:ss"), F.lit("--:--:--"))


def jst_clock_short(ts: Column) -> Column:
    return F.coalesce(F.date_format(jst(ts), "HH:mm"), F.lit("--:--"))


def jst_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(jst(ts), "M/d"), F.lit("--"))


def jst_date_year(ts: Column) -> Column:
    return F.coalesce(F.date_format(jst(ts), "yyyy/M/d"), F.lit("--"))


def day_tag(ts: Column, now: Column) -> Column:
    """'today', 'tomorrow' or '' by JST calendar day."""
    gap = F.datediff(F.to_date(jst(ts)), F.to_date(jst(now)))
    return F.when(gap == 0, F.lit("today")).when(gap == 1, F.lit("tomorrow")).otherwise(F.lit(""))


def wall_to_utc(day: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """Local clock time on a date in an IANA zone -> UTC timestamp."""
    local = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + hour * 3600 + minute * 60)
    return F.to_utc_timestamp(local, zone)


def feed_time(day: Column, clock: Column) -> Column:
    """``MM-dd-yyyy`` and ``h:mma`` / ``ha`` (UTC, any case) -> timestamp; untimed entries are null."""
    text = F.upper(F.trim(clock))
    joined = F.concat_ws(" ", F.trim(day), text)
    parsed = F.coalesce(
        F.try_to_timestamp(joined, F.lit("MM-dd-yyyy h:mma")),
        F.try_to_timestamp(joined, F.lit("MM-dd-yyyy ha")),
    )
    return F.when(~F.lower(text).isin(*UNTIMED) & (F.trim(day) != ""), parsed)


def quote_age(seconds: Column) -> Column:
    """Age of a quote: tenths of seconds, then whole minutes, then whole hours."""
    return (
        F.when(seconds.isNull(), F.lit(""))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60)))
        .otherwise(F.format_string("%dh", F.floor(seconds / 3600)))
    )


def holding_age(seconds: Column) -> Column:
    """Age of an open position: ``1h05m`` or ``12m``; negative counts as zero."""
    s = F.greatest(F.lit(0), F.floor(seconds))
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm", m))
