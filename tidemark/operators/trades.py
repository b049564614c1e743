"""Deals to round-trip trades, journal enrichment and excursions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dims import DEAL_BUY, DEAL_SELL, ENTRY_IN, ENTRY_INOUT, ENTRY_OUT
from tidemark.functions import price as P
from tidemark.operators import intervals as I
from tidemark.operators.ordering import BLOCK, order_blocks, running_totals


def trade_fills(deals: DataFrame) -> DataFrame:
    """Buy/sell fills that open or close; balance rows and other entry kinds are dropped."""
    return deals.where(F.col("type").isin(DEAL_BUY, DEAL_SELL) & F.col("entry").isin(ENTRY_IN, ENTRY_OUT, ENTRY_INOUT))


def pair_deals(deals: DataFrame, *, keep_blocks: bool = False) -> DataFrame:
    """First-in-first-out pairing: every closing fill becomes one trade.

    Closed form of the queue, per position in (time, ticket) order. With O and I the running counts of closes and opens,
    a close finds the queue empty exactly when O - I exceeds every earlier O - I and 0; the excess so far is the number
    of orphans, and any other close takes open number O - orphans. Opens and closes meet by (position, number), so one
    position may hold any share of the deals. ``keep_blocks`` leaves the order blocks on the trades for the
    running statistics that follow.
    """
    fills = order_blocks(trade_fills(deals), "time", "ticket")
    is_out = F.col("entry") != ENTRY_IN
    one, zero = F.lit(1), F.lit(0)
    numbered = running_totals(
        fills, ["position_id"], ["time", "ticket"],
        totals={
            "_i": F.when(is_out, zero).otherwise(one),
            "_o": F.when(is_out, one).otherwise(zero),
            "_d": F.when(is_out, one).otherwise(F.lit(-1)),
        },
        peaks={"_peak": ("_d", is_out)},
        inclusive_peaks=False,
    )
    earlier = F.greatest(F.coalesce(F.col("_peak"), zero), zero)
    orphans = F.greatest(earlier, F.col("_d"))
    # an open and the close that takes it share a number, so one aggregate over two rows replaces a self-join
    number = F.when(~is_out, F.col("_i")).when(F.col("_d") > earlier, -F.col("ticket") - 1).otherwise(F.col("_o") - orphans)
    kept = ("ticket", "symbol", "type", "volume", "time", "price", "profit", "swap", "commission", BLOCK)
    matched = numbered.select("position_id", number.alias("_number"), is_out.alias("_out"), *kept).groupBy(
        "position_id", "_number").agg(
        *[F.max(F.when(F.col("_out"), F.col(c))).alias(c) for c in kept],
        *[F.max(F.when(~F.col("_out"), F.col(c))).alias(f"_o{c}") for c in ("type", "time", "price")],
    ).where(F.col("ticket").isNotNull())
    side = (
        F.when(F.col("_otype") == DEAL_BUY, F.lit("BUY"))
        .when(F.col("_otype").isNotNull(), F.lit("SELL"))
        .when(F.col("type") == DEAL_BUY, F.lit("SELL"))
        .otherwise(F.lit("BUY"))
    )
    return matched.select(
        "position_id", "ticket", "symbol", side.alias("type"), "volume",
        F.coalesce("_otime", "time").alias("entry_time"), F.col("time").alias("exit_time"),
        F.coalesce("_oprice", "price").alias("entry_price"), F.col("price").alias("exit_price"),
        "profit", "swap", "commission", F.col("_otype").isNull().alias("is_orphan"),
        P.net_pnl(F.col("profit"), F.col("swap"), F.col("commission")).alias("pnl"),
        *([BLOCK] if keep_blocks else []),
    )


def latest_journal(journal: DataFrame, seq: str = "seq") -> DataFrame:
    """Newest entry per ticket; equal times go to the later entry. Combines map-side."""
    rest = [c for c in journal.columns if c != "ticket"]
    newest = journal.where(F.col("ticket").isNotNull()).groupBy("ticket").agg(
        F.max_by(F.struct(*rest), F.struct(F.coalesce("ts", F.lit(0)), F.col(seq))).alias("_j"))
    return newest.select("ticket", "_j.*")


def enrich(trades: DataFrame, journal: DataFrame) -> DataFrame:
    """Add pips, R, and the journal's stop, target, context and environment; unmatched trades get nulls and empty maps."""
    entry = latest_journal(journal).select(
        F.col("ticket").alias("position_id"), "sl", "tp", F.col("ctx").alias("_ctx"), F.col("env").alias("_env"))
    out = trades.join(entry, "position_id", "left")
    args = (F.col("symbol"), F.col("type"), F.col("entry_price"), F.col("exit_price"))
    return out.select(
        *trades.columns, "sl", "tp",
        P.trade_pips(*args).alias("pips"),
        P.r_multiple(*args, F.col("sl")).alias("r_multiple"),
        F.coalesce(F.col("_ctx"), F.from_json(F.lit("{}"), out.schema["_ctx"].dataType)).alias("ctx"),
        F.coalesce(F.col("_env"), F.from_json(F.lit("{}"), out.schema["_env"].dataType)).alias("env"),
    )


def excursions(trades: DataFrame, bars: DataFrame, seconds: int = 60, levels: int = 12) -> DataFrame:
    """Worst and best move in pips over the bars opened while a trade was held (both ends inclusive).

    A long hold on fine bars would join millions of rows. Instead the hold is cut into aligned runs of 4^level slots,
    at most six per level, and joined by equality to the highs and lows of such runs, each level of which is made from the one
    below: a trade costs about 3*log2(bars held) rows whatever its length, and one hot symbol is spread over (level, run).
    Only the top level (31 years of minutes) lists runs one by one, and no more levels are made than the longest hold uses.
    """
    # times are whole or fractional epoch seconds
    first = F.ceil(F.col("entry_time") / F.lit(float(seconds)))
    stop = F.floor(F.col("exit_time") / F.lit(float(seconds))) + 1
    cut = trades.select("ticket", "symbol", first.alias("_first"), stop.alias("_stop"))
    needed = I.levels_for(cut.agg(F.max(F.col("_stop") - F.col("_first"))).first()[0], levels)
    tree = I.extremes_by_run(bars, ["symbol"], F.floor(F.unix_seconds("bar_time") / F.lit(seconds)), {"_hi": F.col("high"), "_lo": F.col("low")},
                             {"_hi": F.max("_hi"), "_lo": F.min("_lo")}, needed)
    held = I.covered(cut, "_first", "_stop", needed).join(tree, ["symbol", "_level", "_node"]).groupBy("ticket").agg(
        F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    out = trades.join(held, "ticket", "left")
    buy = F.col("type") == "BUY"
    pip = P.pip_price(F.col("symbol"))
    entry = F.col("entry_price")
    return out.select(
        *trades.columns,
        (F.when(buy, F.col("_lo") - entry).otherwise(entry - F.col("_hi")) / pip).alias("mae_pips"),
        (F.when(buy, F.col("_hi") - entry).otherwise(entry - F.col("_lo")) / pip).alias("mfe_pips"),
    )


def trades_newest_first(trades: DataFrame) -> DataFrame:
    return trades.orderBy(F.col("exit_time").desc(), F.col("ticket").desc())

