"""Queries that write what they derive from the driver tables to landed files and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.bars import arrival_key
from tidemark.plans import standins as S
from tidemark.plans.market import BARS, TICKS, R, rounded
from tidemark.session import work_dir
from tidemark.sources import documents as D
from tidemark.sources import journal as J
from tidemark.sources import market as K

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("history_csv_bars", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, {R("open", "open")}, {R("high", "high")}, {R("low", "low")}, {R('"close"', "close")}
FROM bars WHERE tf = 'H1'""")
def history_csv_bars(spark, sf_dir):
    """Hourly bars written as history files, one folder per symbol, and read with the positional schema."""
    path = _folder(spark, "history")
    bars = S.bars(spark, sf_dir, "H1").select(
        "symbol", F.date_format("bar_time", K.HISTORY_CLOCK).alias("Time (EET)"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("tick_volume").alias("Volume "))
    bars.write.partitionBy("symbol").csv(path, header=True)
    symbol = F.regexp_extract("_metadata.file_path", "symbol=([^/]+)/", 1)
    return rounded(K.read_history_csv(spark, path, symbol, "H1").select("symbol", "tf", "bar_time", "open", "high", "low", "close"))


@query("journal_append_and_read", f"""SELECT epoch_us(ts) // 1000 AS ts, event_type AS symbol, user_id AS ticket, {R("value", "price")},
  'Srv_' || event_type AS server_slug FROM events""")
def journal_append_and_read(spark, sf_dir):
    """Order log appended in two deliveries, one folder per server, and read back as one table."""
    path = _folder(spark, "journal")
    e = S.table(spark, sf_dir, "events")
    rows = e.select(F.unix_millis("ts").alias("ts"), F.col("event_type").alias("symbol"), F.col("user_id").alias("ticket"),
                    F.col("value").alias("price"), F.concat(F.lit("Srv/"), "event_type").alias("server"))
    J.append_journal(rows.where("symbol <> 'view'"), path)
    J.append_journal(rows.where("symbol = 'view'"), path)
    return rounded(J.read_journal(spark, path).select("ts", "symbol", "ticket", "price", "server_slug"))


@query("last_good_store", f"""WITH {TICKS} SELECT symbol, {R("last(price ORDER BY ts, seq)", "last")}, count(*) AS n, true AS stale FROM ticks GROUP BY symbol""")
def last_good_store(spark, sf_dir):
    """The newest quotes kept as the last good answer and served as stale ones."""
    path = _folder(spark, "last-good")
    quotes = S.ticks(spark, sf_dir).groupBy("symbol").agg(
        F.max_by("price", arrival_key(F.col("ts"), F.col("seq"))).alias("last"), F.count(F.lit(1)).alias("n"))
    D.save_last_good(quotes, path)
    return rounded(D.load_last_good(spark, path))


@query("series_in_display_order", f"""WITH {BARS} SELECT symbol, tf, row_number() OVER (ORDER BY symbol, rk) AS place
FROM (SELECT DISTINCT symbol, tf, rk FROM bars JOIN tfs USING (tf))""")
def series_in_display_order(spark, sf_dir):
    """Place of every series in the display; there are symbols x timeframes rows."""
    shown = I.by_timeframe(S.bars(spark, sf_dir).select("symbol", "tf").distinct()).withColumn("_at", F.monotonically_increasing_id())
    return shown.select("symbol", "tf", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"))
