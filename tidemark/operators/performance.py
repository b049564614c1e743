"""Range summaries, equity curves, tail risk, streaks and per-condition edges over closed trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import (
    ADX_BINS, DEFAULT_RANGE_DAYS, HISTORY_RANGES, HOLD_MINUTE_BINS, R_MULTIPLE_BINS, RSI_BINS, WEEKDAYS_JA)
from tidemark.functions import clock
from tidemark.functions.bins import bin_label
from tidemark.operators.ordering import BLOCK, order_blocks, running_totals
from tidemark.operators.quantiles import exact_percentiles


def range_days(label: Column) -> Column:
    """Days of a range label; unknown or unbounded labels count as the default."""
    known = F.coalesce(*[F.when(label == lbl, F.lit(d)) for lbl, d in HISTORY_RANGES if d is not None])
    return F.coalesce(known, F.lit(DEFAULT_RANGE_DAYS))


def in_ranges(trades: DataFrame, now_sec: Column, ranges: Sequence[tuple[str, int | None]] = HISTORY_RANGES) -> DataFrame:
    """One row per (trade, rolling range it belongs to): a fixed fan-out of at most seven, without a join."""
    labels = F.array(*[
        F.when(F.lit(True) if days is None else F.col("exit_time") >= now_sec - F.lit(days * 86400.0), F.lit(label))
        for label, days in ranges])
    return trades.withColumn("range_label", F.explode(F.array_compact(labels)))


def _sums(pnl: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.count(F.lit(1)).alias("trade_count"),
        F.count_if(pnl > 0).alias("win_count"),
        F.count_if(pnl < 0).alias("loss_count"),
        F.sum(F.when(pnl > 0, pnl).otherwise(zero)).alias("gross_profit"),
        F.sum(F.when(pnl < 0, pnl).otherwise(zero)).alias("gross_loss"),
    ]


def _ratios() -> list[Column]:
    n, wins, losses = F.col("trade_count"), F.col("win_count"), F.col("loss_count")
    gp, gl = F.col("gross_profit"), F.col("gross_loss")
    zero = F.lit(0.0)
    avg_win = F.coalesce(F.try_divide(gp, wins), zero)
    avg_loss = F.coalesce(F.try_divide(gl, losses), zero)
    return [
        F.coalesce(F.try_divide(wins, n), zero).alias("win_rate"),
        F.when(gl < 0, F.try_divide(gp, F.abs(gl))).alias("profit_factor"),
        avg_win.alias("avg_win"),
        avg_loss.alias("avg_loss"),
        F.when(losses > 0, F.try_divide(avg_win, F.abs(avg_loss))).alias("risk_reward"),
        (gp + gl).alias("net_profit"),
    ]


def range_summary(ranged: DataFrame) -> DataFrame:
    """Every listed range, with zeros where no trade falls in it."""
    totals = ranged.groupBy("range_label").agg(*_sums(F.col("pnl")))
    labels = ranged.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(lbl) for lbl, _ in HISTORY_RANGES])).alias("range_label"))
    filled = F.broadcast(labels).join(totals, "range_label", "left").fillna(
        0, ["trade_count", "win_count", "loss_count"]).fillna(0.0, ["gross_profit", "gross_loss"])
    return filled.select("range_label", "trade_count", "win_count", "loss_count", "gross_profit", "gross_loss", *_ratios())


def range_slices(ranged: DataFrame) -> DataFrame:
    """Range, range x symbol and range x JST close hour in one pass over the trades (grouping sets)."""
    keyed = ranged.withColumn("hour_jst", clock.jst_hour(F.timestamp_micros((F.col("exit_time") * 1e6).cast("long"))))
    sets = [[F.col("range_label")], [F.col("range_label"), F.col("symbol")], [F.col("range_label"), F.col("hour_jst")]]
    grouped = keyed.groupingSets(sets, F.col("range_label"), F.col("symbol"), F.col("hour_jst")).agg(
        *_sums(F.col("pnl")), F.grouping_id().alias("_gid"))
    kind = F.when(F.col("_gid") == 3, "range").when(F.col("_gid") == 1, "symbol").otherwise("hour_jst")
    return grouped.select(
        "range_label", kind.alias("slice"), "symbol", "hour_jst", "trade_count", "win_count",
        (F.col("gross_profit") + F.col("gross_loss")).alias("net_profit"),
        F.coalesce(F.try_divide("win_count", "trade_count"), F.lit(0.0)).alias("win_rate"))


def _blocked(trades: DataFrame) -> DataFrame:
    """Paired trades keep the blocks of their closing fills, which follow exit_time; others are cut here."""
    return trades if BLOCK in trades.columns else order_blocks(trades, "exit_time", "ticket")


def equity_curve(trades: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    """Running equity, running peak and underwater amount per trade in (exit_time, ticket) order.

    ``floor_peak`` is the peak that starts at zero; ``peak`` starts at the first equity value.
    """
    blocked = _blocked(trades)
    out = running_totals(blocked, keys, ["exit_time", "ticket"],
                         totals={"equity": F.col("pnl")}, peaks={"peak": ("equity", F.lit(True))})
    return out.select(
        *trades.columns, "equity", "peak",
        F.greatest(F.lit(0.0), F.col("peak")).alias("floor_peak"),
        (F.col("equity") - F.col("peak")).alias("underwater"))


def range_drawdown(curve: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    """Largest drop from the zero-floored peak, and its percentage at the earliest row where it occurs."""
    dd = F.col("floor_peak") - F.col("equity")
    pct = F.when(F.col("floor_peak") > 0, dd / F.col("floor_peak") * 100.0).otherwise(F.lit(0.0))
    return curve.groupBy(*keys).agg(
        F.max(dd).alias("max_drawdown_abs"),
        F.max_by(pct, F.struct(dd, -F.col("exit_time"), -F.col("ticket"))).alias("max_drawdown_pct"))


def streaks(trades: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    """Longest winning and losing runs and the signed current run; a zero result ends both."""
    blocked = _blocked(trades)
    pnl = F.col("pnl")
    marked = running_totals(blocked, keys, ["exit_time", "ticket"], totals={
        "_w": F.when(pnl > 0, F.lit(0)).otherwise(F.lit(1)),
        "_l": F.when(pnl < 0, F.lit(0)).otherwise(F.lit(1)),
    })
    # both kinds of run are counted in one pass over the marked trades
    runs = marked.select(*keys, F.explode(F.array(
        F.struct(F.lit("w").alias("kind"), F.col("_w").alias("run"), (pnl > 0).alias("hit")),
        F.struct(F.lit("l").alias("kind"), F.col("_l").alias("run"), (pnl < 0).alias("hit")))).alias("r"))
    sized = runs.groupBy(*keys, "r.kind", "r.run").agg(F.count_if("r.hit").alias("len"))
    win, loss = F.col("kind") == "w", F.col("kind") == "l"

    def last(kind: Column) -> Column:
        return F.max_by(F.col("len"), F.when(kind, F.col("run")))

    return sized.groupBy(*keys).agg(
        F.max(F.when(win, F.col("len"))).alias("max_win_streak"), F.max(F.when(loss, F.col("len"))).alias("max_loss_streak"),
        (last(win) - last(loss)).alias("current_streak"))


def risk_ratios(curve: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    """Sharpe, Sortino, Calmar, recovery, ulcer, underwater share and drawdown from an equity curve."""
    pnl = F.col("pnl")
    dd_pct = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak") * 100.0).otherwise(F.lit(0.0))
    agg = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(pnl).alias("_mean"),
        F.stddev_samp(pnl).alias("_std"),
        F.stddev_samp(F.when(pnl < 0, pnl)).alias("_dstd"),
        F.sum(pnl).alias("_net"),
        F.max(-F.col("underwater")).alias("max_drawdown_abs"),
        F.avg(F.when(F.col("underwater") < 0, 1.0).otherwise(0.0)).alias("underwater_pct"),
        F.sqrt(F.avg(dd_pct * dd_pct)).alias("ulcer_index"),
    )
    root = F.sqrt(F.col("_n").cast("double"))
    calmar = F.when(F.col("max_drawdown_abs") > 0, F.try_divide("_net", "max_drawdown_abs"))
    return agg.select(
        *keys,
        F.when(F.col("_std") > 0, F.try_divide("_mean", "_std") * root).alias("sharpe"),
        F.when(F.col("_dstd") > 0, F.try_divide("_mean", "_dstd") * root).alias("sortino"),
        calmar.alias("calmar"), calmar.alias("recovery_factor"),
        "ulcer_index", "max_drawdown_abs", "underwater_pct")


def value_at_risk(trades: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    """5th percentile of P&L and the mean of everything at or below it."""
    var = exact_percentiles(trades, keys, "pnl", {"var_95": 0.05})
    tail = trades.join(var, list(keys)).groupBy(*keys).agg(
        F.first("var_95").alias("var_95"),
        F.avg(F.when(F.col("pnl") <= F.col("var_95"), F.col("pnl"))).alias("cvar_95"))
    return tail.select(*keys, "var_95", F.coalesce("cvar_95", "var_95").alias("cvar_95"))


def r_distribution(trades: DataFrame, keys: Sequence[str] = ("range_label",)) -> DataFrame:
    return trades.where(F.col("r_multiple").isNotNull()).groupBy(
        *keys, bin_label(F.col("r_multiple"), R_MULTIPLE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def edge_stats(trades: DataFrame) -> DataFrame:
    """(dimension, bucket) -> n, win rate, profit factor. Timeframe dimensions count a trade once per timeframe."""
    pnl = F.col("pnl")
    entry = F.timestamp_micros((F.col("entry_time") * 1e6).cast("long"))
    weekday = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS_JA]), clock.jst_weekday(entry) + 1)
    hold = F.greatest(F.lit(0.0), (F.col("exit_time") - F.col("entry_time")) / 60.0)

    def env(name: str) -> Column:
        return F.try_element_at("env", F.lit(name))

    def entry_of(dimension: str, bucket: Column) -> Column:
        return F.when(bucket.isNotNull(), F.struct(F.lit(dimension).alias("dimension"), bucket.alias("bucket")))

    def up_down(v: Column) -> Column:
        return F.when(v >= 0, "up").when(v < 0, "down")

    flip = F.abs(env("flip_norm"))
    cot = env("cot_pctile")
    fixed = F.array(
        entry_of("weekday_jst", weekday),
        entry_of("hold_min", bin_label(hold, HOLD_MINUTE_BINS)),
        entry_of("dxy", up_down(env("dxy_change"))),
        entry_of("cot_extreme", F.when(cot < 10, "low").when(cot > 90, "high").when(cot.isNotNull(), "mid")),
        entry_of("real_yield", up_down(env("real_yield_change"))),
        entry_of("flip", F.when(flip < 0.25, "<0.25").when(flip < 0.5, "0.25~0.5").when(flip.isNotNull(), ">=0.5")),
    )
    per_tf = F.flatten(F.transform(F.map_entries("ctx"), lambda e: F.array(
        entry_of("alignment", F.concat(e["key"], F.when(F.coalesce(e["value"]["ae"], F.lit(False)), "_above").otherwise("_below"))),
        entry_of("adx", bin_label(e["value"]["adx"], ADX_BINS)),
        entry_of("rsi", bin_label(e["value"]["rsi"], RSI_BINS)),
    )))
    long = trades.select(pnl.alias("pnl"), F.explode(F.array_compact(F.concat(fixed, per_tf))).alias("_e"))
    grouped = long.groupBy("_e.dimension", "_e.bucket").agg(*_sums(F.col("pnl")))
    return grouped.select(
        "dimension", "bucket", F.col("trade_count").alias("n"),
        F.try_divide("win_count", "trade_count").alias("win_rate"),
        F.when(F.col("gross_loss") < 0, F.try_divide("gross_profit", F.abs("gross_loss"))).alias("pf"))


def today_pnl(trades: DataFrame, positions: DataFrame, now: Column) -> DataFrame:
    """Realised since UTC midnight plus floating on open positions, and the open count."""
    midnight = F.unix_seconds(F.date_trunc("day", now)).cast("double")
    realised = trades.agg(F.coalesce(
        F.sum(F.when(F.col("exit_time") >= midnight, F.col("pnl"))), F.lit(0.0)).alias("today_realised_pnl"))
    floating = positions.agg(
        F.coalesce(F.sum(F.col("profit") + F.col("swap")), F.lit(0.0)).alias("today_floating_pnl"),
        F.count(F.lit(1)).alias("open_trade_count"))
    # two one-row frames
    return realised.crossJoin(floating).withColumn(
        "today_total_pnl", F.col("today_realised_pnl") + F.col("today_floating_pnl"))
