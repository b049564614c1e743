"""Equity, drawdown, streaks, ratios and tail risk of nested ranges in one pass over the trades.

All ranges end now, so along the closing time each range is everything from its start on, and a wider one holds the narrower ones. The trades
are cut once, at the order blocks and at the starts of ranges, into segments that lie in a range as a whole or not at all. A segment is summed
up by values that combine in order: its sum and highest prefix, its lowest prefix and deepest drop with the places where they occur, its size
and the runs at both ends and within. Every range folds the summaries of its segments; only summaries are multiplied by the ranges, and a trade
is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dims import HISTORY_RANGES
from tidemark.operators.ordering import BLOCK, order_blocks
from tidemark.operators.performance import risk_ratios
from tidemark.operators.quantiles import exact_percentiles

Ranges = Sequence[tuple[str, int | None]]
ZONE = "_zone"
ORDER = ("exit_time", "ticket")


def _starts(ranges: Ranges) -> list[int]:
    """Days of the bounded ranges, the widest first."""
    return sorted({d for _, d in ranges if d is not None}, reverse=True)


def zone(now_sec: Column, ranges: Ranges = HISTORY_RANGES, time: str = "exit_time") -> Column:
    """How many range starts a trade is at or behind; null times are behind none. Never decreases along the time."""
    inside = [F.coalesce((F.col(time) >= now_sec - F.lit(d * 86400.0)).cast("int"), F.lit(0)) for d in _starts(ranges)]
    return sum(inside, F.lit(0))


def labels_of(zone_: Column, ranges: Ranges = HISTORY_RANGES) -> Column:
    """Labels of the ranges that hold a zone."""
    starts = _starts(ranges)
    return F.array_compact(F.array(*[
        F.when(F.lit(True) if d is None else zone_ > starts.index(d), F.lit(label)) for label, d in ranges]))


def segments(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """Trades with ``_segment``: order block and zone, both rising along (exit_time, ticket)."""
    blocked = trades if BLOCK in trades.columns else order_blocks(trades, *ORDER)
    return blocked.withColumn("_segment", F.struct(F.col(BLOCK), zone(now_sec, ranges).alias(ZONE)))


def _ordered() -> Window:
    return Window.partitionBy("_segment").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)


def _in_ranges(summary: DataFrame, ranges: Ranges) -> tuple[DataFrame, Window]:
    """A row per (segment, range that holds it), and the window of the range's earlier segments."""
    laid = summary.withColumn("range_label", F.explode(labels_of(F.col("_segment")[ZONE], ranges)))
    return laid, Window.partitionBy("range_label").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)


def _prefixes(marked: DataFrame) -> DataFrame:
    """Sum and highest sum of each trade's segment up to the trade."""
    w = _ordered()
    return marked.withColumn("_sum", F.sum("pnl").over(w)).withColumn("_top", F.max("_sum").over(w))


def _carried(summary: DataFrame, ranges: Ranges) -> DataFrame:
    """(segment, range) with ``_before`` and ``_peak``: the range's equity and peak before the segment, the peak null before the first trade."""
    laid, before = _in_ranges(summary, ranges)
    laid = laid.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    return laid.withColumn("_peak", F.max(F.col("_before") + F.col("_high")).over(before))


def nested_curve(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """A row per trade and range that holds it: running equity of the range, its peak, floored peak and underwater amount.

    Trades are windowed once, by segment; each range's equity and peak before the segment are added where rows come out.
    """
    local = _prefixes(segments(trades, now_sec, ranges))
    summary = local.groupBy("_segment").agg(F.sum("pnl").alias("_total"), F.max("_sum").alias("_high"))
    carried = _carried(summary, ranges).groupBy("_segment").agg(F.collect_list(F.struct("range_label", "_before", "_peak")).alias("_ranges"))
    rows = local.join(carried, "_segment").withColumn("_r", F.explode("_ranges"))
    rows = rows.withColumn("equity", F.col("_r._before") + F.col("_sum"))
    rows = rows.withColumn("peak", F.greatest(F.col("_r._peak"), F.col("_r._before") + F.col("_top")))
    return rows.select(*[c for c in trades.columns if c != "range_label"], "_r.range_label", "equity", "peak",
                       F.greatest(F.lit(0.0), F.col("peak")).alias("floor_peak"), (F.col("equity") - F.col("peak")).alias("underwater"))


def nested_drawdown(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """Largest drop from the zero-floored peak per range, and its percentage at the earliest trade where it occurs.

    A drop within a segment starts either at a peak of the segment, which the segment knows by itself, or at the peak before it, and is then
    deepest at the segment's lowest sum.
    """
    local = _prefixes(segments(trades, now_sec, ranges))
    earlier = [(-F.col(c)).alias(f"-{c}") for c in ORDER]
    summary = local.groupBy("_segment").agg(
        F.sum("pnl").alias("_total"), F.max("_sum").alias("_high"),
        F.max(F.struct((-F.col("_sum")).alias("deep"), *earlier)).alias("_low"),
        F.max(F.struct((F.col("_top") - F.col("_sum")).alias("drop"), *earlier, F.col("_top").alias("top"))).alias("_drop"))
    carried = _carried(summary, ranges).withColumn("_floor", F.greatest(F.lit(0.0), F.col("_peak")))

    def candidate(drop: Column, at: str, peak: Column) -> Column:
        return F.struct(drop.alias("drop"), *[F.col(at)[f"-{c}"].alias(f"-{c}") for c in ORDER], peak.alias("peak"))

    from_before = candidate(F.col("_floor") - F.col("_before") + F.col("_low.deep"), "_low", F.col("_floor"))
    # before the first trade the peak is the floor, so a drop from a negative top of the segment is no drop from it
    within = F.when(F.col("_before") + F.col("_drop.top") >= F.col("_floor"), candidate(F.col("_drop.drop"), "_drop", F.col("_before") + F.col("_drop.top")))
    worst = carried.groupBy("range_label").agg(F.max(F.greatest(from_before, within)).alias("w"))
    return worst.select("range_label", F.col("w.drop").alias("max_drawdown_abs"),
                        F.when(F.col("w.peak") > 0, F.col("w.drop") / F.col("w.peak") * 100.0).otherwise(F.lit(0.0)).alias("max_drawdown_pct"))


def nested_streaks(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """Longest winning and losing runs and the signed current run per range; a zero result ends both."""
    w = Window.partitionBy("_segment").orderBy(*ORDER)
    marked = segments(trades, now_sec, ranges).withColumn("_n", F.row_number().over(w))
    kinds = {"win": F.col("pnl") > 0, "loss": F.col("pnl") < 0}
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = {k: F.when(~F.coalesce(hit, F.lit(False)), F.col("_n")) for k, hit in kinds.items()}
    marked = marked.select("*", *[(F.col("_n") - F.coalesce(F.max(b).over(upto), F.lit(0))).alias(f"_run_{k}") for k, b in broken.items()],
                           *[b.alias(f"_break_{k}") for k, b in broken.items()])
    n = F.max("_n")
    summary = marked.groupBy("_segment").agg(
        n.alias("_size"), *[c for k in kinds for c in (
            F.max(f"_run_{k}").alias(f"_longest_{k}"), (F.coalesce(F.min(f"_break_{k}") - 1, n)).alias(f"_first_{k}"),
            (n - F.coalesce(F.max(f"_break_{k}"), F.lit(0))).alias(f"_last_{k}"), (F.count(f"_break_{k}") > 0).alias(f"_broken_{k}"))])
    laid, before = _in_ranges(summary, ranges)
    through = before.rowsBetween(Window.unboundedPreceding, 0)
    for k in kinds:
        # the run that reaches the end of a segment: its last one and, as long as nothing breaks, what came before
        laid = laid.withColumn(f"_part_{k}", F.count_if(f"_broken_{k}").over(through))
        own = Window.partitionBy("range_label", f"_part_{k}").orderBy("_segment").rowsBetween(Window.unboundedPreceding, 0)
        laid = laid.withColumn(f"_end_{k}", F.sum(f"_last_{k}").over(own))
    in_order = Window.partitionBy("range_label").orderBy("_segment")
    laid = laid.select("range_label", "_segment", *[c for k in kinds for c in (
        F.greatest(F.col(f"_longest_{k}"), F.coalesce(F.lag(f"_end_{k}").over(in_order), F.lit(0)) + F.col(f"_first_{k}")).alias(f"_longest_{k}"),
        F.col(f"_end_{k}"))])
    return laid.groupBy("range_label").agg(
        F.max("_longest_win").cast("bigint").alias("max_win_streak"), F.max("_longest_loss").cast("bigint").alias("max_loss_streak"),
        F.max_by(F.col("_end_win") - F.col("_end_loss"), "_segment").cast("bigint").alias("current_streak"))


def nested_ratios(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """Sharpe, Sortino, Calmar, recovery, ulcer and underwater share per range; a range's rows exist only between its join and its partial sums."""
    return risk_ratios(nested_curve(trades, now_sec, ranges))


def nested_value_at_risk(trades: DataFrame, now_sec: Column, ranges: Ranges = HISTORY_RANGES) -> DataFrame:
    """5th percentile of P&L per range and the mean of everything at or below it; values are counted by zone, not by range."""
    zoned = trades.select(zone(now_sec, ranges).alias(ZONE), "pnl")
    labels = labels_of(F.col(ZONE), ranges)
    var = exact_percentiles(zoned, [ZONE], "pnl", {"var_95": 0.05}, groups=("range_label", labels))
    # at most one entry a range, in one row
    bounds = var.agg(F.map_from_entries(F.collect_list(F.struct("range_label", "var_95"))).alias("_var"))
    tail = zoned.crossJoin(F.broadcast(bounds)).withColumn("range_label", F.explode(labels)).withColumn("_limit", F.col("_var")[F.col("range_label")])
    mean = tail.groupBy("range_label").agg(F.first("_limit").alias("var_95"), F.avg(F.when(F.col("pnl") <= F.col("_limit"), F.col("pnl"))).alias("cvar_95"))
    return mean.select("range_label", "var_95", F.coalesce("cvar_95", "var_95").alias("cvar_95"))
