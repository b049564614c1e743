"""Moving averages, true range, RSI, ADX and the multi-timeframe table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dims import ADX_PERIOD, ATR_PERIOD, RSI_PERIOD, TF_RANK, TREND_EMA_PERIOD
from tidemark.operators.bars import depth_scan
from tidemark.operators.scan import SERIES, affine_scan, chain, sma_seeded_ema, wilder, with_cell
from tidemark.session import durable


def true_range() -> Column:
    """First bar of a series: high - low."""
    span = F.col("high") - F.col("low")
    return F.when(F.col("prev_close").isNull(), span).otherwise(F.greatest(
        span, F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))))


def _moves() -> dict[str, Column]:
    diff = F.coalesce(F.col("close") - F.col("prev_close"), F.lit(0.0))
    up = F.coalesce(F.col("high") - F.col("prev_high"), F.lit(0.0))
    down = F.coalesce(F.col("prev_low") - F.col("low"), F.lit(0.0))
    zero = F.lit(0.0)
    return {
        "tr": true_range(),
        "gain": F.when(diff > 0, diff).otherwise(zero),
        "loss": F.when(diff < 0, -diff).otherwise(zero),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(zero),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(zero),
    }


def indicator_columns(
    chained: DataFrame,
    *,
    ema_period: int = TREND_EMA_PERIOD,
    rsi_period: int = RSI_PERIOD,
    atr_period: int = ATR_PERIOD,
    adx_period: int = ADX_PERIOD,
    adx_seed: str = "zero",
    cell: str | None = "cell",
) -> DataFrame:
    """Add ema, atr, rsi, di_plus, di_minus and adx to every bar (null while warming up).

    ``adx_seed='zero'`` reads the undefined DX of the warm-up as 0 and is non-null from bar ``adx_period``;
    ``'wilder'`` starts the smoothing at the first defined DX. Series shorter than ``2 * adx_period + 1`` have no ADX.
    """
    keep = chained.columns
    moves = chained.select("*", *[c.alias(n) for n, c in _moves().items()])
    first = affine_scan(moves, [
        sma_seeded_ema("ema", F.col("close"), ema_period),
        wilder("atr", F.col("tr"), atr_period),
        wilder("_ag", F.col("gain"), rsi_period, first=1),
        wilder("_al", F.col("loss"), rsi_period, first=1),
        wilder("_sp", F.col("plus_dm"), adx_period, first=1),
        wilder("_sm", F.col("minus_dm"), adx_period, first=1),
        wilder("_st", F.col("tr"), adx_period, first=1),
    ], cell=cell)
    rs = F.try_divide(F.col("_ag"), F.col("_al"))
    rsi = F.when(F.col("_al") == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs))
    enough = F.col("n") >= 2 * adx_period + 1
    dip = F.lit(100.0) * F.try_divide(F.col("_sp"), F.col("_st"))
    dim = F.lit(100.0) * F.try_divide(F.col("_sm"), F.col("_st"))
    second = first.select(
        *keep, "ema", "atr",
        F.when(F.col("n") > rsi_period, rsi).alias("rsi"),
        F.when(enough, dip).alias("di_plus"),
        F.when(enough, dim).alias("di_minus"),
    )
    if cell is not None:
        # the second scan reads its input twice; written, the cost stays linear in the number of scans
        second = durable(second)
    total = F.col("di_plus") + F.col("di_minus")
    dx = F.when(total > 0, F.lit(100.0) * F.abs(F.col("di_plus") - F.col("di_minus")) / total).otherwise(F.lit(0.0))
    start = 1 if adx_seed == "zero" else adx_period
    third = affine_scan(second.withColumn("_dx", dx),
                        [wilder("adx", F.col("_dx"), adx_period, first=start)], cell=cell)
    return third.select(*keep, "ema", "atr", "rsi", "di_plus", "di_minus",
                        F.when(enough, F.col("adx")).alias("adx"))


def indicator_history(bars: DataFrame, *, stored: bool = False, **options) -> DataFrame:
    """Indicators on every bar of series of any length. ``stored``: the bars are a table scan, not a derivation."""
    return indicator_columns(chain(with_cell(bars), ("high", "low", "close"), stored=stored), **options)


def indicator_table(bars: DataFrame, **options) -> DataFrame:
    """One row per (symbol, timeframe): indicators read at the last closed bar of the bounded look-back scan.

    The scan keeps at most 400 bars per series, so plain windows suffice and one shuffle serves everything.
    Series with fewer than two bars are omitted.
    """
    chained = chain(depth_scan(bars), ("high", "low", "close"), cell=None)
    rows = indicator_columns(chained, cell=None, **options).where(F.col("idx") < F.col("n") - 1)
    finite = ("ema", "rsi", "atr", "adx", "di_plus", "di_minus")
    last = rows.groupBy(*SERIES).agg(
        F.max_by("close", "bar_time").alias("last_close"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("bar_time"))).alias(c) for c in finite],
        F.max("bar_time").alias("bar_time"),
    )
    period = options.get("ema_period", TREND_EMA_PERIOD)
    return last.select(
        *SERIES, "last_close", "ema", F.lit(period).alias("ema_period"),
        (F.col("last_close") > F.col("ema")).alias("above_ema"),
        "rsi", "atr", "adx", "di_plus", "di_minus", "bar_time",
    )


def last_finite(rows: DataFrame, columns: list[str], keys=SERIES, order: str = "bar_time") -> DataFrame:
    """Last non-null, finite value of each column per key."""
    def usable(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))

    return rows.groupBy(*keys).agg(*[
        F.max_by(F.col(c), F.when(usable(c), F.col(order))).alias(c) for c in columns])


def by_timeframe(rows: DataFrame) -> DataFrame:
    """Display order: symbol, then D1, H4, H1, M15; other timeframes last."""
    rank = F.coalesce(*[F.when(F.col("tf") == t, F.lit(r)) for t, r in TF_RANK.items()], F.lit(len(TF_RANK)))
    return rows.orderBy("symbol", rank)


def indicator_map(table: DataFrame) -> DataFrame:
    """The table folded to one row per symbol: timeframe -> indicators (at most one entry per timeframe)."""
    fields = F.struct(*[c for c in table.columns if c != "symbol"])
    return table.groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("tf"), fields))).alias("by_tf"))


def with_broker_names(snapshot: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols with the broker's own name, or the base name where the broker lists none."""
    return snapshot.join(names.select("symbol", F.col("broker_name").alias("_b")), "symbol", "left").withColumn(
        "broker_name", F.coalesce("_b", "symbol")).drop("_b")
