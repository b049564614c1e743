"""Moving-average stack oscillator, its historical percentile bands, and the index card."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import BAND_PERCENTILES, INDEX_BARS, INDEX_EMA_PERIOD, OSC_MODES, SPARKLINE_CLOSES
from tidemark.functions.guards import is_finite
from tidemark.functions.price import disparity, disparity_from_deviations
from tidemark.functions.signal import extension_tier
from tidemark.operators.bars import depth_scan, last_bars
from tidemark.operators.quantiles import exact_percentiles
from tidemark.operators.scan import SERIES, affine_scan, chain, first_value_ema, with_cell
from tidemark.session import durable


def _deviation(value: Column, center: Column) -> Column:
    return F.when(center == 0, F.lit(0.0)).otherwise(F.try_divide(value - center, center) * 100.0)


def oscillator(bars: DataFrame, mode: str = "M15", *, deep: bool = False,
               spec: Mapping[str, tuple] = OSC_MODES) -> DataFrame:
    """Closed bars of the trailing display window with the three averages and percent deviations from the slowest.

    A series with fewer closed bars than the slowest period yields no rows (see :func:`with_placeholders`).
    """
    tf, (fast, mid, center), live_fetch, live_show, deep_fetch, deep_show = spec[mode]
    fetch, show = (deep_fetch, deep_show) if deep else (live_fetch, live_show)
    recent = last_bars(bars.where(F.col("tf") == tf), fetch)
    chained = chain(with_cell(recent.select(*SERIES, "bar_time", "close")))
    rows = affine_scan(chained, [
        first_value_ema("ema_fast", F.col("close"), fast),
        first_value_ema("ema_mid", F.col("close"), mid),
        first_value_ema("ema_center", F.col("close"), center)])
    closed = F.col("n") - 1
    rows = rows.where((F.col("idx") < closed) & (closed >= center) & (F.col("idx") >= closed - show))
    c = F.col("ema_center")
    return rows.select(
        "symbol", F.lit(mode).alias("mode"), "bar_time", F.col("close").alias("price"),
        "ema_fast", "ema_mid", "ema_center",
        _deviation(F.col("close"), c).alias("dev_price"),
        _deviation(F.col("ema_fast"), c).alias("dev_fast"),
        _deviation(F.col("ema_mid"), c).alias("dev_mid"))


def oscillator_snapshot(rows: DataFrame) -> DataFrame:
    """Latest absolute values per (symbol, mode)."""
    latest = F.struct("price", "ema_fast", "ema_mid", "ema_center")
    return rows.groupBy("symbol", "mode").agg(
        F.max_by(latest, "bar_time").alias("_v"), F.max("bar_time").alias("bar_time"),
        F.count(F.lit(1)).alias("n_display")).select("symbol", "mode", "_v.*", "bar_time", "n_display")


def with_placeholders(expected: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a usable result stay visible as all-null rows flagged stale."""
    found = results.withColumn("_found", F.lit(True))
    return expected.join(found, list(keys), "left").withColumn("stale", F.col("_found").isNull()).drop("_found")


def disparity_bands(bars: DataFrame, mode: str, periods: Sequence[int], *, stored: bool = False) -> DataFrame:
    """Percentiles of the absolute percent distance to each average, by sign, over a whole close history.

    The first ``max(periods)`` bars of a series are warm-up. Zeros belong to neither side; a side without any bar is a
    row of zeros.
    """
    warm = max(periods)
    rows = affine_scan(chain(with_cell(bars.select(*SERIES, "bar_time", "close")), stored=stored),
                       [first_value_ema(f"e{p}", F.col("close"), p) for p in periods])
    wide = rows.where(F.col("idx") >= warm).select("close", F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), disparity(F.col("close"), F.col(f"e{p}")).alias("d")) for p in periods
    ])).alias("_p"))
    d = F.col("_p.d")
    sided = wide.where(is_finite(d) & (d != 0)).select(
        F.col("_p.period").alias("period"), F.when(d > 0, "pos").otherwise("neg").alias("side"), F.abs(d).alias("size"))
    # three passes follow: sketch, ranks, totals
    sided = durable(sided)
    names = {f"p{int(p * 100)}": p for p in BAND_PERCENTILES}
    ranks = exact_percentiles(sided, ["period", "side"], "size", names)
    whole = sided.groupBy("period", "side").agg(F.max("size").alias("max"), F.count(F.lit(1)).alias("n"))
    every = bars.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in periods])).alias("period")).select(
        "period", F.explode(F.array(F.lit("pos"), F.lit("neg"))).alias("side"))
    joined = every.join(ranks.join(whole, ["period", "side"]), ["period", "side"], "left")
    return joined.select(F.lit(mode).alias("mode"), "period", "side",
                         *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*names, "max")],
                         F.coalesce("n", F.lit(0)).alias("n"))


def with_extension_tiers(rows: DataFrame, bands: DataFrame, periods: tuple[int, int, int]) -> DataFrame:
    """Distance of price to each of the three averages per bar, with its overextension tier from the bands.

    ``bands`` has six rows per mode: it is folded to one row per mode and joined on the mode.
    """
    pick = {}
    for p in periods:
        for side in ("pos", "neg"):
            here = (F.col("period") == p) & (F.col("side") == side)
            pick[f"_{p}{side}95"] = F.max(F.when(here, F.col("p95")))
            pick[f"_{p}{side}99"] = F.max(F.when(here, F.col("p99")))
    folded = bands.groupBy("mode").agg(*[c.alias(n) for n, c in pick.items()])
    # one row per mode
    joined = rows.join(F.broadcast(folded), "mode", "left")
    dist = {
        periods[0]: disparity_from_deviations(F.col("dev_price"), F.col("dev_fast")),
        periods[1]: disparity_from_deviations(F.col("dev_price"), F.col("dev_mid")),
        periods[2]: F.col("dev_price"),
    }
    out = joined.select(*rows.columns, *[c.alias(f"dist{i}") for i, c in enumerate(dist.values())],
                        *[c for c in folded.columns if c != "mode"])
    tiers = []
    for i, p in enumerate(periods):
        v = F.col(f"dist{i}")
        p95 = F.when(v >= 0, F.col(f"_{p}pos95")).otherwise(F.col(f"_{p}neg95"))
        p99 = F.when(v >= 0, F.col(f"_{p}pos99")).otherwise(F.col(f"_{p}neg99"))
        tiers.append(extension_tier(v, p95, p99).alias(f"tier{i}"))
    return out.select(*rows.columns, *[f"dist{i}" for i in range(3)], *tiers)


def index_card(bars: DataFrame, tf: str = "H1") -> DataFrame:
    """Price, previous close, change, trend average and sparkline closes of the last 120 bars, forming bar dropped."""
    recent = depth_scan(bars, {tf: INDEX_BARS}).where(is_finite(F.col("close")))
    chained = chain(recent.select(*SERIES, "bar_time", "close"), ("close",), cell=None).where(F.col("idx") < F.col("n") - 1)
    rows = affine_scan(chained, [first_value_ema("ema", F.col("close"), INDEX_EMA_PERIOD)], cell=None)
    last = rows.groupBy("symbol").agg(
        F.max_by(F.struct(F.col("close").alias("price"), F.col("prev_close"), "ema"), "bar_time").alias("_v"),
        F.array_sort(F.collect_list(F.when(F.col("idx") >= F.col("n") - 1 - SPARKLINE_CLOSES,
                                           F.struct("bar_time", "close")))).alias("_c"))
    change = F.col("_v.price") - F.col("_v.prev_close")
    return last.select(
        "symbol", "_v.price", "_v.prev_close", change.alias("change"),
        (F.try_divide(change, F.col("_v.prev_close")) * 100.0).alias("change_pct"),
        "_v.ema", (F.col("_v.price") > F.col("_v.ema")).alias("above_ema"),
        F.transform("_c", lambda e: e["close"]).alias("closes"))
