"""The driver tables read as market tables: which column plays which role."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import arrival_key, roll_up, ticks_to_bars
from tidemark.schemas import DRIVER
from tidemark.session import durable, use_utc

SYMBOLS = ("click", "error", "purchase", "signup", "view")
NOW = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    ddl = DRIVER[name]
    df = spark.read.schema(ddl).parquet(f"{sf_dir}/{name}.parquet")
    # zone-free columns hold UTC wall clock
    zoned = [c.split()[0] for c in ddl.split(", ") if c.endswith("timestamp_ntz")]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoned}) if zoned else df


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf_dir: str, *tfs: str, ticks_where: Column | None = None) -> DataFrame:
    """M15 bars of every symbol, rolled up to the wanted timeframes; a condition on ticks reaches the file scan."""
    tfs = tfs or ("D1", "H4", "H1", "M15")
    source = ticks(spark, sf_dir)
    fine = ticks_to_bars(source if ticks_where is None else source.where(ticks_where), "M15")
    coarse = [t for t in tfs if t != "M15"]
    if not coarse:
        return fine
    return roll_up(fine, tfs)


def stored_bars(spark: SparkSession, sf_dir: str, *tfs: str) -> DataFrame:
    """The same bars written once, for queries that read them more than once."""
    return durable(bars(spark, sf_dir, *tfs))


def deals(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fills: position = user, opens = click/view, closes = purchase/error, balance rows = signup.

    Bounds of the time, lower inclusive and upper exclusive, are compared with the stored column, so they reach the file scan.
    """
    e = table(spark, sf_dir, "events")
    for bound, compare in ((start, "ge"), (end, "lt")):
        if bound:
            e = e.where(getattr(operator, compare)(F.col("ts"), F.lit(bound).cast("timestamp")))
    kind = F.col("event_type")
    closing = kind.isin("purchase", "error")
    return e.select(
        F.col("event_id").alias("ticket"),
        F.col("user_id").alias("position_id"),
        F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("user_id") % 5 + 1).cast("int")).alias("symbol"),
        F.when(kind == "signup", 2).otherwise((F.col("event_id") % 2).cast("int")).alias("type"),
        F.when(kind == "purchase", 1).when(kind == "error", 2).otherwise(0).alias("entry"),
        ((F.col("event_id") % 5 + 1) / F.lit(100.0)).alias("volume"),
        F.col("value").alias("price"),
        F.when(closing, F.col("value") - 50.0).otherwise(0.0).alias("profit"),
        (F.unix_micros("ts") / F.lit(1e6)).alias("time"),
        ((F.col("event_id") % 3) * F.lit(-0.01)).alias("swap"),
        F.lit(-0.1).alias("commission"),
    )


CTX = ("struct<ae:boolean,adx:double,dip:double,dim:double,rsi:double>")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order log: ticket = user; stop, target, context and environment derive from the event's ``k``."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    k = F.get_json_object("props", "$.k").cast("bigint")

    def context(ae: Column, adx: Column, rsi: Column) -> Column:
        return F.struct(ae.alias("ae"), adx.cast("double").alias("adx"), F.lit(20.5).alias("dip"),
                        F.lit(18.5).alias("dim"), rsi.cast("double").alias("rsi")).cast(CTX)

    m15 = context(k % 2 == 0, k % 30 + F.lit(10.5), (k * 7) % 60 + F.lit(20.25))
    h1 = context(k % 3 == 0, F.when(k % 4 != 0, (k * 3) % 30 + F.lit(12.5)), (k * 11) % 60 + F.lit(20.75))
    env = F.create_map(
        F.lit("dxy_change"), (k % 21 - 10) / F.lit(10.0),
        F.lit("cot_pctile"), k % 100 + F.lit(0.5),
        F.lit("real_yield_change"), (k % 11 - 5) / F.lit(100.0))
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_millis("ts").alias("ts"),
        F.col("user_id").alias("ticket"),
        (F.col("value") - (k % 7 + 5)).alias("sl"),
        (F.col("value") + k % 11).alias("tp"),
        F.create_map(F.lit("M15"), m15, F.lit("H1"), h1).alias("ctx"),
        F.when(k % 5 != 0, env).alias("env"),
    )


def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tickets: opening fills at the newest price of their symbol."""
    opened = deals(spark, sf_dir).where("entry = 0 AND type IN (0, 1)")
    quote = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("price", arrival_key(F.col("ts"), F.col("seq"))).alias("price_current"))
    return opened.join(quote, "symbol").select(
        "ticket", "symbol", F.when(F.col("type") == 0, "BUY").otherwise("SELL").alias("type"), "volume",
        F.col("price").alias("price_open"), "price_current",
        F.when(F.col("ticket") % 3 == 0, F.lit(0.0)).otherwise(F.col("price") - 4.0).alias("sl"),
        (F.col("price_current") - F.col("price")).alias("profit"), "swap", "time")


CURRENCIES = ("USD", "EUR", "GBP", "JPY", "AUD")


def order_currency() -> Column:
    """Priority 1..5 of an order as a currency."""
    return F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), F.substring("o_orderpriority", 1, 1).cast("int"))


def rate_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate per currency and order day: mean order price in integer cents, and the same in quarter-point steps."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    daily = o.groupBy(order_currency().alias("currency"), F.to_date("o_orderdate").alias("obs_date")).agg(
        cents.alias("_c"), F.count(F.lit(1)).alias("_n"))
    mean = F.expr("_c div _n")
    return daily.select("currency", "obs_date", (F.floor(mean / F.lit(10)) / F.lit(1e6)).alias("value"),
                        (F.floor(mean / F.lit(2500000)) * F.lit(0.25)).alias("rate"))


def positioning_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed JSON body per (market, week) of shipments, numbers as text the way they are delivered."""
    weekly = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.date_trunc("week", "l_shipdate").alias("w")).agg(
        *[F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0)).alias(f"q{s}") for s in "OF"],
        *[F.sum(F.when(F.col("l_linestatus") == s, F.round(F.col("l_extendedprice") * 100).cast("bigint")).otherwise(0)).alias(f"c{s}")
          for s in "OF"],
        F.count(F.lit(1)).alias("n"))
    row = F.struct(
        F.col("l_returnflag").alias("market_and_exchange_names"),
        F.concat(F.date_format("w", "yyyy-MM-dd"), F.lit("T00:00:00.000")).alias("report_date_as_yyyy_mm_dd"),
        F.col("qO").cast("bigint").cast("string").alias("noncomm_positions_long_all"),
        F.col("qF").cast("bigint").cast("string").alias("noncomm_positions_short_all"),
        F.expr("(cO div 100)").cast("string").alias("comm_positions_long_all"),
        F.expr("(cF div 100)").cast("string").alias("comm_positions_short_all"),
        (F.col("n") * 100).cast("string").alias("open_interest_all"))
    return weekly.select(F.to_json(F.array(row)).alias("body"))


PHRASES = ("FOMC Statement", "ADP Non-Farm Employment Change", "Unemployment Claims", "Official Bank Rate", "CPI m/m",
           "ECB Press Conference", "Retail Sales m/m", "JOLTS Job Openings", "Cash Rate", "Monetary Policy Statement",
           "Flash Manufacturing PMI", "Average Hourly Earnings m/m")
FEED_COUNTRIES = ("USD", "EUR", "GBP", "JPY", "AUD", "CHF", "NZD", "CAD", "usd")
FEED_IMPACTS = ("High", "high", "Medium", "Low")
FEED_TIMES = ("8:30am", "12:15PM", "All Day", "2pm", "Tentative", "11:05am")
FEED_HOSTS = ("www.forexfactory.com", "www.bls.gov", "evil.example.com", "www.ecb.europa.eu")
EVENT_NOW = "2026-03-01 00:00:00"


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def feed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed feed bodies: one event document per document row, and the raw web pages as throttle answers."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")

    def nth(k: int) -> Column:
        return F.floor(i / k)

    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (i % 330).cast("int")), "MM-dd-yyyy")
    escaped = F.col("text")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    title = F.concat_ws(" ", pick(PHRASES, i), escaped)
    fields = {
        "title": title, "country": pick(FEED_COUNTRIES, nth(5)), "date": day, "time": pick(FEED_TIMES, nth(7)),
        "impact": pick(FEED_IMPACTS, nth(3)), "forecast": F.concat((i % 50).cast("string"), F.lit("K")),
        "previous": F.lit(""), "url": F.concat(F.lit("https://"), pick(FEED_HOSTS, i), F.lit("/e/"), i.cast("string")),
    }
    tags = [part for k, v in fields.items() for part in (F.lit(f"<{k}>"), v, F.lit(f"</{k}>"))]
    body = F.concat(F.lit("<?xml version=\"1.0\"?><weeklyevents><event>"), *tags, F.lit("</event></weeklyevents>"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("body"))
    return d.select(F.concat(F.lit("d"), i.cast("string")).alias("key"), body.alias("body")).unionByName(pages)


def observation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed payload per order in each delivery format; every fifth order's payload has no usable value."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    bad = F.col("o_orderkey") % 5 == 0
    v = F.col("o_totalprice")
    text = F.when(bad, F.lit(".")).otherwise(F.format_string("%.2f", v))
    iso = day.cast("string")
    base = dict(series=order_currency(), key=F.col("o_orderkey"))
    json = F.to_json(F.struct(F.array(
        F.struct(iso.alias("date"), text.alias("value")),
        F.struct(F.date_add(day, 1).cast("string").alias("date"), F.lit(".").alias("value"))).alias("observations")))
    sdmx = F.concat(F.lit("KEY,FREQ,TIME_PERIOD,TITLE,OBS_VALUE,UNIT\nK,D,"), iso, F.lit(",\"Level, raw\","),
                    F.when(bad, F.lit("")).otherwise(text), F.lit(",PC\n"))
    csv = F.concat(F.lit("DATE,RATE\r\n"), F.date_format(day, "dd MMM yyyy"), F.lit(","), F.when(bad, F.lit("n/a")).otherwise(text), F.lit("\r\n"))
    html = F.concat(F.lit("<html><table><tr><th scope=\"row\">"), F.date_format(day, "yyyy/MM/dd"), F.lit("</th><td class=\"v\"> "),
                    F.when(bad, F.lit("NA")).otherwise(text), F.lit("</td></tr><tr><th>"), F.date_format(F.date_add(day, 1), "yyyy/MM/dd"),
                    F.lit("</th>\n<td>NA</td></tr></table></html>"))
    return o.select(*[c.alias(n) for n, c in base.items()], json.alias("json"), sdmx.alias("sdmx"), csv.alias("csv"), html.alias("html"))
