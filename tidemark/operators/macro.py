"""Rate observations, yields, payrolls, pair bias and last-good fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.dims import FALLBACK_AFTER_FAILURES, REAL_YIELD_DEAD_BAND, REAL_YIELD_POINTS
from tidemark.functions.price import split_pair
from tidemark.operators.ordering import asof_join


def latest_observation(observations: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Newest dated value per key. ``observations``: keys, obs_date, value."""
    return observations.groupBy(*keys).agg(
        F.max("obs_date").alias("obs_date"), F.max_by("value", "obs_date").alias("value"))


def daily_fill(observations: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """One row per key and calendar day from its first to the overall last day, last value carried forward.

    Each observation covers the days up to the next one, so days come from exploding short intervals and no task
    walks a whole history. ``observations`` has one row per (key, day).
    """
    w = Window.partitionBy(key).orderBy(day)
    end = observations.agg(F.max(day).alias("_end"))
    # one row
    spans = observations.withColumn("_next", F.date_sub(F.lead(day).over(w), 1)).crossJoin(F.broadcast(end))
    return spans.select(key, value, F.explode(F.sequence(F.col(day), F.coalesce("_next", "_end"))).alias(day))


def daily_wide(observations: DataFrame, key: str, day: str, value: str, names: Sequence[str]) -> DataFrame:
    """Daily wide table; leading days on which any column is still missing are dropped."""
    filled = daily_fill(observations, key, day, value)
    wide = filled.groupBy(day).pivot(key, list(names)).agg(F.first(value))
    return wide.dropna("any", subset=list(names))


def write_daily_csv(wide: DataFrame, path: str) -> None:
    """Daily wide table as CSV with a header, in date order within each file."""
    wide.sortWithinPartitions(wide.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def policy_rates(observations: DataFrame, key: str = "currency", day: str = "obs_date", value: str = "rate") -> DataFrame:
    """Latest rate per currency and the last rate that differed from it."""
    w = Window.partitionBy(key).orderBy(day)
    changes = observations.withColumn("_before", F.lag(value).over(w)).where(
        F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    newest = observations.groupBy(key).agg(F.max_by(value, day).alias("rate"), F.max(day).alias("as_of"))
    prev = changes.groupBy(key).agg(F.max_by("_before", day).alias("prev_rate"))
    return newest.join(prev, key, "left")


def rate_changes(observations: DataFrame, key: str = "currency", day: str = "obs_date", value: str = "rate") -> DataFrame:
    """Every change point with the rate before it."""
    w = Window.partitionBy(key).orderBy(day)
    return observations.withColumn("prev_rate", F.lag(value).over(w)).where(
        F.col("prev_rate").isNull() | (F.col("prev_rate") != F.col(value))).select(key, day, value, "prev_rate")


def pair_bias(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate differential and direction per pair; gold follows the change of the US rate. Stale or missing legs give 0.

    ``rates`` has one row per currency (currency, rate, prev_rate, stale), so it is a small lookup on both legs.
    """
    base, quote = split_pair(F.col("pair"))
    usable = rates.where(~F.coalesce("stale", F.lit(False)))
    b = usable.select(F.col("currency").alias("base_ccy"), F.col("rate").alias("_b"))
    q = usable.select(F.col("currency").alias("quote_ccy"), F.col("rate").alias("_q"))
    usd = usable.where("currency = 'USD'").select(
        F.lit("XAU").alias("base_ccy"), (F.col("rate") - F.col("prev_rate")).alias("_usd"))
    legs = pairs.withColumn("base_ccy", base).withColumn("quote_ccy", quote)
    joined = legs.join(b, "base_ccy", "left").join(q, "quote_ccy", "left").join(usd, "base_ccy", "left")
    gold = F.col("base_ccy") == "XAU"
    diff = F.coalesce(F.when(gold, F.col("_usd")).otherwise(F.col("_b") - F.col("_q")), F.lit(0.0))
    known = F.when(gold, F.col("_usd").isNotNull()).otherwise(F.col("_b").isNotNull() & F.col("_q").isNotNull())
    direction = F.when(gold, -F.signum(diff)).otherwise(F.signum(diff)).cast("int")
    label = (
        F.when(~known, dims.NO_DIRECTION)
        .when(gold & (diff > 0), dims.GOLD_RATES_UP).when(gold & (diff < 0), dims.GOLD_RATES_DOWN).when(gold, dims.NO_DIRECTION)
        .when(diff > 0, F.concat("base_ccy", F.lit(dims.RATE_ADVANTAGE))).when(diff < 0, F.concat("quote_ccy", F.lit(dims.RATE_ADVANTAGE)))
        .otherwise(dims.NO_RATE_GAP)
    )
    return joined.select("pair", "base_ccy", "quote_ccy", diff.alias("differential"), direction.alias("macro_dir"),
                         label.alias("label"))


def real_yield(observations: DataFrame, key: str = "series", points: int = REAL_YIELD_POINTS) -> DataFrame:
    """Latest value, previous value, one-day change, five-row trend, gold direction and the trailing values.

    Reads the newest ``points`` rows per series, so the windows see a bounded number of rows.
    """
    newest = Window.partitionBy(key).orderBy(F.col("obs_date").desc())
    recent = observations.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= points)
    picked = recent.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("value"))).alias("value"),
        F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("prev_value"),
        F.max(F.when(F.col("_rn") == 6, F.col("value"))).alias("_sixth"),
        F.min_by("value", "obs_date").alias("_first"),
        F.max("obs_date").alias("as_of"),
        F.array_sort(F.collect_list(F.struct("obs_date", "value"))).alias("_s"))
    trend = F.col("value") - F.coalesce("_sixth", "_first")
    return picked.select(
        key, "value", "prev_value", (F.col("value") - F.col("prev_value")).alias("change_1d"), trend.alias("trend_5d"),
        F.when(F.abs(trend) <= REAL_YIELD_DEAD_BAND, 0).when(trend > 0, -1).otherwise(1).alias("gold_dir"),
        "as_of", F.transform("_s", lambda e: e["value"]).alias("series_values"))


def live_overlay(anchors: DataFrame, nominal: DataFrame, keys: Sequence[str], anchor_time: str, quote_time: str) -> DataFrame:
    """Daily anchor plus the intraday move of a nominal yield known at that time; without one the anchor stands.

    Anchors are the left side: each takes the newest nominal quote at or before ``anchor_time``.
    """
    joined = asof_join(anchors, nominal, keys, anchor_time, quote_time, ["live", "prev"])
    moved = F.col("value") + (F.col("live") - F.col("prev"))
    return joined.select(
        *anchors.columns, F.col("live").alias("nominal_10y"), F.col("prev").alias("nominal_prev"),
        F.coalesce(F.bround(moved, 3), F.col("value")).alias("live_value"), F.col("live").isNotNull().alias("is_live"))


def level_changes(levels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest and previous month-over-month change of a level series; fewer than two rows give null.

    Only the newest three rows per key are read.
    """
    newest = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("obs_date").desc())
    top = levels.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 3)

    def nth(i: int) -> Column:
        return F.max(F.when(F.col("_rn") == i, F.col("value")))

    return top.groupBy(*keys).agg(
        F.max("obs_date").alias("as_of"),
        (nth(1) - nth(2)).alias("change"), (nth(2) - nth(3)).alias("prev_change"))


def employment(payrolls: DataFrame, unemployment: DataFrame) -> DataFrame:
    """Payroll change beside the latest unemployment rate (two one-row frames)."""
    rate = unemployment.agg(F.max_by("value", "obs_date").alias("unemployment_rate"))
    return level_changes(payrolls).select(
        "as_of", F.col("change").alias("nonfarm_change"), F.col("prev_change").alias("prev_nonfarm_change")).crossJoin(rate)


def with_last_good(fresh: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows win; a key missing now comes from the cache, flagged stale."""
    values = [c for c in fresh.columns if c not in keys]
    f = fresh.select(*keys, F.struct(*values).alias("_f"))
    c = cached.select(*keys, F.struct(*values).alias("_c"))
    return f.join(c, list(keys), "full_outer").select(
        *keys, F.coalesce("_f", "_c").alias("_v"), F.col("_f").isNull().alias("stale")).select(*keys, "_v.*", "stale")


def failure_streaks(attempts: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Attempts since the last success and the newest error.

    ``attempts``: keys, attempt_ts, sources_ok, error. An attempt fails only when no source delivered; a partial
    failure is a success that may carry an error. Everything is an aggregate: no ordered walk is needed.
    """
    ok = F.col("sources_ok") > 0
    last_ok = attempts.groupBy(*keys).agg(
        F.max(F.when(ok, F.col("attempt_ts"))).alias("_ok"),
        F.max("attempt_ts").alias("last_attempt"),
        F.max_by(F.struct("error"), "attempt_ts").alias("_e"))
    joined = attempts.join(last_ok, list(keys))
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("_ok").isNull() | (F.col("attempt_ts") > F.col("_ok"))).alias("consecutive_failures"),
        F.first("_ok").alias("last_success"), F.first("_e.error").alias("last_error"))


def choose_feed(primary: DataFrame, secondary: DataFrame, failures: DataFrame, keys: Sequence[str] = ("source",),
                after: int = FALLBACK_AFTER_FAILURES) -> DataFrame:
    """The last primary events, or the secondary feed's where the primary failed ``after`` or more times in a row.

    A secondary feed without events leaves the primary's last events in place.
    """
    down = failures.where(F.col("consecutive_failures") >= after).select(*keys)
    supplied = secondary.join(down, list(keys), "left_semi")
    replaced = supplied.select(*keys).distinct()
    return primary.join(replaced, list(keys), "left_anti").unionByName(supplied, allowMissingColumns=True)
