"""Economic calendar: filters, scheduled decisions, merging and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import clock
from tidemark.functions import events as E

EVENT_COLUMNS = ("release_ts", "currency", "title", "impact", "forecast", "previous", "actual", "source", "source_url")


def filter_feed(raw: DataFrame, keywords=dims.EVENT_KEYWORDS, impacts=dims.IMPACT_ALLOWED,
                currencies=dims.FIAT_CURRENCIES) -> DataFrame:
    """Feed rows -> events: impact, currency and title filters, then the clock; untimed entries are dropped."""
    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    kept = raw.where(E.impact_allowed(F.col("impact"), impacts) & E.currency_allowed(F.col("country"), currencies)
                     & E.title_allowed(text("title"), keywords))
    out = kept.select(
        clock.feed_time(F.col("date"), F.col("time")).alias("release_ts"),
        F.upper(text("country")).alias("currency"), text("title").alias("title"), text("impact").alias("impact"),
        text("forecast").alias("forecast"), text("previous").alias("previous"), text("actual").alias("actual"),
        F.lit("primary").alias("source"), text("url").alias("source_url"))
    return out.where(F.col("release_ts").isNotNull())


def secondary_calendar(values: DataFrame, events: DataFrame, countries: DataFrame, keywords=dims.EVENT_KEYWORDS,
                       impacts=dims.IMPACT_ALLOWED, currencies=dims.FIAT_CURRENCIES, now: Column | None = None,
                       window_days: int = dims.SECONDARY_WINDOW_DAYS) -> DataFrame:
    """Values with their event and country (misses dropped), then the same filters; non-positive times are dropped.

    With ``now`` only releases from an hour before it to ``window_days`` after it are kept, at the value scan.

    The two lookups are dimension tables; the optimiser broadcasts them while they are under its size limit.
    """
    if now is not None:
        at = F.unix_seconds(now)
        values = values.where(F.col("time").between(at - 3600, at + window_days * 86400))
    joined = values.join(events, "event_id").join(countries, "country_id")
    impact = E.importance_label(F.col("importance"))
    kept = joined.where(E.currency_allowed(F.col("currency"), currencies) & E.impact_allowed(impact, impacts)
                        & E.title_allowed(F.col("name"), keywords) & (F.col("time") > 0))
    return kept.select(
        F.timestamp_seconds("time").alias("release_ts"), F.upper("currency").alias("currency"), F.col("name").alias("title"),
        impact.alias("impact"), E.value_text(F.col("forecast_value")).alias("forecast"),
        E.value_text(F.col("prev_value")).alias("previous"), E.value_text(F.col("actual_value")).alias("actual"),
        F.lit("secondary").alias("source"), F.lit("").alias("source_url"))


def bank_schedule(spark: SparkSession) -> DataFrame:
    """Published decision dates as events in UTC."""
    banks = F.array(*[
        F.struct(F.lit(c).alias("currency"), F.lit(t).alias("title"), F.lit(z).alias("zone"), F.lit(h).alias("h"),
                 F.lit(m).alias("m"), F.lit(u).alias("source_url"), F.array(*[F.lit(d) for d in days]).alias("days"))
        for c, t, z, h, m, u, days in dims.BANK_SCHEDULES])
    rows = spark.range(1).select(F.explode(banks).alias("b")).select("b.*", F.explode("b.days").alias("day"))
    return scheduled_events(rows.select("currency", "title", "zone", "h", "m", "source_url", "day"))


def payroll_schedule(dates: DataFrame, day: str = "day") -> DataFrame:
    """Distinct non-empty release dates as payroll events."""
    zone, hour, minute = dims.PAYROLL_CLOCK
    rows = dates.where(F.col(day).isNotNull() & (F.col(day) != "")).select(F.col(day).alias("day")).distinct()
    return scheduled_events(rows.select(
        F.lit("USD").alias("currency"), F.lit(dims.PAYROLL_TITLE).alias("title"), F.lit(zone).alias("zone"),
        F.lit(hour).alias("h"), F.lit(minute).alias("m"), F.lit(dims.PAYROLL_LINK).alias("source_url"), "day"))


def scheduled_events(rows: DataFrame) -> DataFrame:
    at = clock.wall_to_utc(F.to_date("day"), F.col("h"), F.col("m"), F.col("zone"))
    empty = F.lit("")
    return rows.select(
        at.alias("release_ts"), "currency", "title", F.lit("High").alias("impact"), empty.alias("forecast"),
        empty.alias("previous"), empty.alias("actual"), F.lit("scheduled").alias("source"), "source_url")


def live_days(events: DataFrame) -> DataFrame:
    return events.select("currency", F.to_date("release_ts").alias("_day")).distinct()


def upcoming(scheduled: DataFrame, live: DataFrame, now: Column, count: int = dims.UPCOMING_COUNT,
             currencies: DataFrame | None = None) -> DataFrame:
    """First ``count`` future events per schedule, skipping UTC days on which the currency already has a live event."""
    future = scheduled.where(F.col("release_ts") >= now).withColumn("_day", F.to_date("release_ts"))
    open_days = future.join(live_days(live), ["currency", "_day"], "left_anti")
    if currencies is not None:
        open_days = open_days.join(currencies, "currency", "left_semi")
    w = Window.partitionBy("currency", "title").orderBy("release_ts")
    return open_days.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).select(*EVENT_COLUMNS)


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """Union; one event per (release, currency, title), earlier feeds winning. An aggregate, so it combines map-side."""
    ranked = None
    for i, feed in enumerate(feeds):
        part = feed.select(*EVENT_COLUMNS).withColumn("_p", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    rest = [c for c in EVENT_COLUMNS if c not in ("release_ts", "currency", "title")]
    # ties inside one feed fall to the smallest remaining fields
    first = F.min(F.struct("_p", *rest)).alias("_e")
    return ranked.groupBy("release_ts", "currency", "title").agg(first).select(
        "release_ts", "currency", "title", *[F.col(f"_e.{c}") for c in rest])


def by_release(events: DataFrame) -> DataFrame:
    return events.orderBy("release_ts", "currency", "title")


def display_rows(events: DataFrame, symbols: DataFrame, now: Column, count: int = dims.DISPLAY_COUNT,
                 window_sec: int = dims.WARNING_WINDOW_SEC) -> DataFrame:
    """First ``count`` events from half an hour ago on, for the currencies of the shown symbols."""
    shown = symbols.select(F.explode(E.displayed_currencies(F.col("symbol"))).alias("currency")).distinct()
    cutoff = F.timestamp_seconds(F.unix_seconds(now) - F.lit(window_sec))
    kept = events.where(F.col("release_ts") >= cutoff).withColumn("currency", F.upper("currency"))
    kept = by_release(kept.join(shown, "currency", "left_semi")).limit(count)
    return kept.select(
        "release_ts", clock.jst_date(F.col("release_ts")).alias("date_jst"),
        clock.jst_clock_short(F.col("release_ts")).alias("time_jst"),
        clock.day_tag(F.col("release_ts"), now).alias("day_tag"), "currency",
        E.category(F.col("title")).alias("category"),
        E.localised_title(F.col("title"), F.col("currency")).alias("title"),
        E.source_link(F.col("source_url")).alias("source_url"))
