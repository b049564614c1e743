"""Ticks to bars, bar scans and chart tails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dims import JST_SECONDS, SERVER_ZONES, TF_DEPTH, TF_SECONDS
from tidemark.operators.scan import SERIES

OHLC = ("open", "high", "low", "close")


def grid_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(seconds)) * F.lit(seconds))


def arrival_key(time: Column, seq: Column) -> Column:
    """(time, seq) as one fixed-width number: a struct here would force a sort of all ticks before they combine."""
    return F.unix_micros(time).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + seq


def ticks_to_bars(ticks: DataFrame, tf: str = "M15", *, price: str = "price", time: str = "ts",
                  seq: str = "seq") -> DataFrame:
    """Tumbling OHLC bars. All five aggregates combine map-side, so a hot symbol is reduced before it is shuffled."""
    at = F.col("_at")
    return (
        ticks.select("symbol", grid_start(F.col(time), TF_SECONDS[tf]).alias("bar_time"), price,
                     arrival_key(F.col(time), F.col(seq)).alias("_at"))
        .groupBy("symbol", "bar_time")
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.count(F.lit(1)).alias("tick_volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), "bar_time", *OHLC, "tick_volume")
    )


def roll_up(bars: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Coarser bars from finer ones whose grid divides theirs; ticks are read once for every timeframe."""
    wanted = F.explode(F.array(*[
        F.struct(F.lit(t).alias("to_tf"), F.lit(TF_SECONDS[t]).alias("sec")) for t in targets]))
    wide = bars.select("*", wanted.alias("_t"))
    start = F.timestamp_seconds(F.floor(F.unix_seconds("bar_time") / F.col("_t.sec")) * F.col("_t.sec"))
    return (
        wide.select("symbol", F.col("_t.to_tf").alias("tf"), start.alias("_start"), "bar_time", *OHLC, "tick_volume")
        .groupBy("symbol", "tf", "_start")
        .agg(
            F.min_by("open", "bar_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_time").alias("close"),
            F.sum("tick_volume").alias("tick_volume"),
        )
        .select("symbol", "tf", F.col("_start").alias("bar_time"), *OHLC, "tick_volume")
    )


def server_bars_to_utc(bars: DataFrame, server: str = "server", wall: str = "server_secs",
                       flat_offset: Column | None = None) -> DataFrame:
    """Bar times stamped in a server's wall clock -> UTC, per bar, with that server's summer time.

    Servers without a listed zone use the flat offset (seconds east of UTC).
    """
    naive = F.timestamp_seconds(F.col(wall))
    utc = F.timestamp_seconds(F.col(wall) - (flat_offset if flat_offset is not None else F.lit(0)))
    for name, zone in SERVER_ZONES.items():
        utc = F.when(F.col(server) == name, F.to_utc_timestamp(naive, zone)).otherwise(utc)
    return bars.withColumn("bar_time", utc)


def bars_between(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Range scan of stored bars, both bounds inclusive. Bars derived from ticks need their ticks bounded as well."""
    return bars.where(F.col("bar_time").between(start, end))


def last_bars(bars: DataFrame, count: int | Column) -> DataFrame:
    """The newest ``count`` bars per series. Spark keeps only ``count`` rows per series and task before the shuffle."""
    w = Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def depth_scan(bars: DataFrame, depth: Mapping[str, int] = TF_DEPTH) -> DataFrame:
    """Every (symbol, timeframe) with each timeframe's own depth; timeframes not listed are left out."""
    largest = max(depth.values())
    limit = F.coalesce(*[F.when(F.col("tf") == t, F.lit(n)) for t, n in depth.items()])
    w = Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())
    ranked = bars.where(F.col("tf").isin(*depth)).withColumn("_rn", F.row_number().over(w))
    # the literal bound is what lets the group limit act before the shuffle
    return ranked.where((F.col("_rn") <= largest) & (F.col("_rn") <= limit)).drop("_rn")


def closed_bars(bars: DataFrame) -> DataFrame:
    """Drop the newest (still forming) bar of each series."""
    newest = bars.groupBy(*SERIES).agg(F.max("bar_time").alias("_newest"))
    return bars.join(newest, list(SERIES)).where(F.col("bar_time") < F.col("_newest")).drop("_newest")


def latest_ticks(ticks: DataFrame, offset_sec: Column | None = None, seq: str = "seq") -> DataFrame:
    """Newest quote per symbol; ``time_msc`` is shifted from server clock to UTC."""
    shift = (offset_sec if offset_sec is not None else F.lit(0)) * F.lit(1000)
    # one aggregate per field keeps the buffers fixed-width, hence hash aggregation
    at = arrival_key(F.timestamp_millis("time_msc"), F.col(seq))
    newest = ticks.withColumn("_at", at).groupBy("symbol").agg(
        *[F.max_by(c, "_at").alias(c) for c in ("bid", "ask", "last")], F.max("time_msc").alias("time_msc"))
    return newest.withColumn("time_msc", F.col("time_msc") - shift)


def chart_tails(bars: DataFrame, ema_h4: DataFrame, candles: int = 40, closes: int = 30) -> DataFrame:
    """Last 40 H4 candles, last 30 M15 closes (forming bar included) and the H4 EMA; no row when both are empty."""
    ohlc = F.struct(*OHLC)
    kept = last_bars(bars.where(F.col("tf").isin("H4", "M15")), max(candles, closes))
    w = Window.partitionBy(*SERIES).orderBy(F.col("bar_time").desc())
    kept = kept.withColumn("_rn", F.row_number().over(w))
    h4 = (F.col("tf") == "H4") & (F.col("_rn") <= candles)
    m15 = (F.col("tf") == "M15") & (F.col("_rn") <= closes)
    packed = kept.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(h4, F.struct("bar_time", ohlc.alias("v"))))).alias("_h4"),
        F.array_sort(F.collect_list(F.when(m15, F.struct("bar_time", "close")))).alias("_m15"),
    )
    return packed.select(
        "symbol",
        F.transform("_h4", lambda e: e["v"]).alias("ohlc_h4"),
        F.transform("_m15", lambda e: e["close"]).alias("closes_m15"),
    ).where((F.size("ohlc_h4") > 0) | (F.size("closes_m15") > 0)).join(ema_h4, "symbol", "left")


def jst_day(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(F.unix_seconds(ts) + F.lit(JST_SECONDS)))


def day_boundaries(bars: DataFrame, prev_time: str = "prev_bar_time") -> DataFrame:
    """Bars that open a new JST calendar day; the first bar of a series is not a boundary."""
    return bars.where(jst_day(F.col("bar_time")) != jst_day(F.col(prev_time))).withColumn(
        "day", jst_day(F.col("bar_time")))
