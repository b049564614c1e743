"""Composite scores, high-conviction setups and what is new among them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dims import TF_WEIGHT
from tidemark.functions import signal as SG
from tidemark.functions.price import disparity


def signal_table(table: DataFrame) -> DataFrame:
    """Indicator rows with the five-tier signal, regime factor and read-out zones."""
    code = SG.timeframe_code(*[F.col(c) for c in ("above_ema", "adx", "di_plus", "di_minus", "rsi")])
    dist = disparity(F.col("last_close"), F.col("ema"))
    return table.select(
        "*", F.coalesce(code, F.lit(0)).alias("code"), SG.timeframe_label(code).alias("label"),
        SG.trend_factor(F.col("adx")).alias("trend_factor"), dist.alias("ema_dist_pct"),
        SG.ema_zone(dist).alias("ema_zone"), SG.adx_zone(F.col("adx")).alias("adx_zone"),
        SG.di_zone(F.col("di_plus"), F.col("di_minus")).alias("di_zone"), SG.rsi_zone(F.col("rsi")).alias("rsi_zone"))


def composite_scores(table: DataFrame) -> DataFrame:
    """-10..+10 per symbol; timeframes without RSI or ADX count in neither numerator nor denominator."""
    weights = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TF_WEIGHT.items()))
    code = SG.timeframe_code(*[F.col(c) for c in ("above_ema", "adx", "di_plus", "di_minus", "rsi")])
    weight = F.when(code.isNotNull(), weights[F.col("tf")])
    summed = table.groupBy("symbol").agg(
        F.sum(code * weight * SG.trend_factor(F.col("adx"))).alias("raw"), F.sum(weight).alias("_w"))
    score = F.try_divide(F.col("raw"), F.col("_w") * 2.0) * 10.0
    cls = SG.composite_class(score)
    return summed.select("symbol", F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("raw", F.lit(0.0)).alias("raw"),
                         SG.composite_label(cls).alias("label"), cls.alias("cls"), SG.activity_tier(cls).alias("activity"))


def high_conviction(scores: DataFrame, least: float = 5.0) -> DataFrame:
    return scores.where(~F.col("cls").isin("na", "neutral") & (F.abs("score") >= least))


def top_setups(scores: DataFrame, count: int = 8) -> DataFrame:
    return scores.orderBy(F.abs("score").desc(), "symbol").limit(count)


def new_setups(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(symbol, class) pairs not present in the previous pass."""
    return current.join(previous.select("symbol", "cls"), ["symbol", "cls"], "left_anti")
