"""Weekly positioning of large speculators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dims import COT_EXTREME_HIGH, COT_EXTREME_LOW, COT_WEEKS
from tidemark.functions.guards import to_long


def usable_rows(raw: DataFrame) -> DataFrame:
    """Delivered text fields to integers; rows without a date or without both speculator sides are dropped."""
    typed = raw.select(
        "market", F.substring(F.coalesce("report_date", F.lit("")), 1, 10).alias("report_date"),
        *[to_long(F.col(c)).alias(c) for c in
          ("noncomm_long", "noncomm_short", "comm_long", "comm_short", "open_interest")])
    return typed.where((F.col("report_date") != "") & F.col("noncomm_long").isNotNull() & F.col("noncomm_short").isNotNull())


def newest_weeks(rows: DataFrame, weeks: int = COT_WEEKS) -> DataFrame:
    """The newest reports per market; the group limit acts before the shuffle."""
    w = Window.partitionBy("market").orderBy(F.col("report_date").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= weeks).drop("_rn")


def weekly_metrics(rows: DataFrame) -> DataFrame:
    """Net, change, shares, percentile and flags for each of the newest weeks (at most 52 rows per market)."""
    net = F.col("noncomm_long") - F.col("noncomm_short")
    recent = newest_weeks(rows).withColumn("net", net)
    by_date = Window.partitionBy("market").orderBy("report_date")
    rank = F.cume_dist().over(Window.partitionBy("market").orderBy("net")) * 100.0
    total = F.col("noncomm_long") + F.col("noncomm_short")
    return recent.select(
        "market", "report_date", "noncomm_long", "noncomm_short", "net",
        F.lag("net").over(by_date).alias("net_prev"),
        (F.col("net") - F.lag("net").over(by_date)).alias("net_change"),
        (F.col("comm_long") - F.col("comm_short")).alias("comm_net"),
        "open_interest",
        (F.try_divide("net", "open_interest") * 100.0).alias("net_pct_oi"),
        (F.try_divide(F.col("noncomm_long"), total) * 100.0).alias("long_share"),
        rank.alias("pctile_1y"),
        F.signum("net").cast("int").alias("direction"),
        F.when(rank >= COT_EXTREME_HIGH, 1).when(rank <= COT_EXTREME_LOW, -1).otherwise(0).alias("extreme"))


def positioning_snapshot(rows: DataFrame) -> DataFrame:
    """Latest week per market with the net history behind it, oldest first."""
    weekly = weekly_metrics(rows)
    values = [c for c in weekly.columns if c not in ("market", "report_date")]
    return weekly.groupBy("market").agg(
        F.max("report_date").alias("report_date"), F.max_by(F.struct(*values), "report_date").alias("_v"),
        F.array_sort(F.collect_list(F.struct("report_date", "net"))).alias("_h"),
    ).select("market", "report_date", "_v.*",
             F.transform("_h", lambda e: e["net"]).alias("net_history"),
             F.transform("_h", lambda e: e["report_date"]).alias("history_dates"))
