"""Streaming jobs drained over the event table and compared with their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans import standins as S
from tidemark.plans.market import TICKS, R, rounded
from tidemark.schemas import DRIVER
from tidemark.plans.structure import SQL as DRAWN_SQL
from tidemark.plans.structure import line_objects, documents
from tidemark.session import use_utc, work_dir
from tidemark.sources import documents as D
from tidemark.streaming import jobs, ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _ticks(spark, sf_dir):
    use_utc(spark)
    raw = jobs.tick_stream(spark, sf_dir, DRIVER["events"], pathGlobFilter="events.parquet")
    return raw.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


def _fresh(spark) -> tuple[str, str]:
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


CLOSED = """mx AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS wm FROM events),
b AS (SELECT symbol, epoch_us(ts) // 1000000 // 3600 * 3600 AS t, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, seq) AS "close", count(*) AS tick_volume FROM ticks GROUP BY ALL),
cb AS (SELECT b.* FROM b, mx WHERE (t + 3600) * 1000 <= wm)"""


@query("stream_latest_quotes", f"WITH {TICKS} SELECT symbol, last(price ORDER BY ts, seq) AS price, max(seq) AS seq FROM ticks GROUP BY symbol")
def stream_latest_quotes(spark, sf_dir):
    out, ckpt = _fresh(spark)
    jobs.run_upsert(jobs.latest_quotes(_ticks(spark, sf_dir)), out, ckpt, "symbol", "ts")
    return jobs.latest_version(spark, out).select("symbol", "price", "seq")


@query("stream_closed_bars", f"""WITH {TICKS}, {CLOSED} SELECT symbol, 'H1' AS tf, t AS bar_time, open, high, low, "close", tick_volume FROM cb""")
def stream_closed_bars(spark, sf_dir):
    out, ckpt = _fresh(spark)
    jobs.run_available(jobs.closed_bar_stream(_ticks(spark, sf_dir), "H1"), out, ckpt)
    return rounded(spark.read.parquet(out))


@query("stream_indicators", f"""WITH RECURSIVE {TICKS}, {CLOSED},
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM cb),
e AS (SELECT symbol, t, i, "close" / 20 AS y FROM s WHERE i = 0
  UNION ALL SELECT s.symbol, s.t, s.i, CASE WHEN s.i < 20 THEN e.y + s."close" / 20 ELSE e.y + (2::DOUBLE / 21) * (s."close" - e.y) END
  FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)
SELECT symbol, t AS bar_time, {R("CASE WHEN i >= 19 THEN y END", "ema")} FROM e""")
def stream_indicators(spark, sf_dir):
    """Closed bars land as files; a second query extends the indicators from them."""
    bars_out, bars_ckpt = _fresh(spark)
    jobs.run_available(jobs.closed_bar_stream(_ticks(spark, sf_dir), "H1"), bars_out, bars_ckpt)
    out, ckpt = _fresh(spark)
    landed = jobs.tick_stream(spark, bars_out, spark.read.parquet(bars_out).schema)
    jobs.run_available(jobs.indicator_stream(landed), out, ckpt)
    return rounded(spark.read.parquet(out).select("symbol", "bar_time", "ema"))


def _deliveries(rows, number, land):
    """Land rows of one delivery after another; yields after each."""
    for k in range(3):
        land(rows.where(number == k))
        yield k


DELIVERED = """d AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, event_id % 3 AS d, epoch_us(ts) // 1000000 // 3600 * 3600 AS t FROM events),
dm AS (SELECT d, max(epoch_us(max(ts))) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM d GROUP BY d),
marked AS (SELECT d.*, coalesce((t + 3600) * 1000000 <= newest - 600000000, false) AS late FROM d JOIN dm USING (d))"""


@query("stream_late_ticks", f"""WITH {DELIVERED}
SELECT symbol, t AS bar_time, first(price ORDER BY ts, seq) FILTER (WHERE NOT late) AS open, max(price) FILTER (WHERE NOT late) AS high,
  min(price) FILTER (WHERE NOT late) AS low, last(price ORDER BY ts, seq) FILTER (WHERE NOT late) AS "close",
  count(*) FILTER (WHERE NOT late) AS tick_volume, count(*) FILTER (WHERE late) AS late_ticks,
  (t + 3600) * 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000 AS closed,
  (SELECT count(*) FROM events) AS ticks_read FROM marked GROUP BY symbol, t""")
def stream_late_ticks(spark, sf_dir):
    """Three deliveries that each span the whole time: hourly bars of the ticks in time, late ticks kept beside them, closed or not yet."""
    use_utc(spark)
    base = f"{work_dir(spark)}/late-{uuid.uuid4().hex}"
    events = S.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                                                     F.col("event_id").alias("seq"), F.col("value").alias("price"))
    sink, read = ledger.bars_and_late_ticks(f"{base}/out", "H1"), 0
    for _ in _deliveries(events, F.col("seq") % 3, lambda part: part.write.mode("append").parquet(f"{base}/in")):
        read += ledger.drained(jobs.tick_stream(spark, f"{base}/in", events.schema), sink, f"{base}/checkpoint")
    bars = ledger.read_epochs(spark, f"{base}/out/bars").drop("tf").withColumn("closed", F.lit(True))
    unfinished = jobs.latest_version(spark, f"{base}/out/open").drop("first", "last").withColumn("closed", F.lit(False))
    late = ledger.read_epochs(spark, f"{base}/out/late").groupBy(
        F.col("symbol"), F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("bar_time")).agg(F.count(F.lit(1)).alias("late_ticks"))
    both = bars.unionByName(unfinished).join(late, ["symbol", "bar_time"], "full")
    return rounded(both.select("symbol", "bar_time", "open", "high", "low", "close", *[
        F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("tick_volume", "late_ticks")], F.coalesce("closed", F.lit(True)).alias("closed"),
        F.lit(read).cast("bigint").alias("ticks_read")))


JOURNAL_DROP = "ts bigint, ticket bigint, symbol string, price double"


@query("stream_journal_drops", """SELECT CASE WHEN event_type = 'error' THEN 'quarantined' ELSE 'entry' END AS kind,
  CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS ts, CASE WHEN event_type <> 'error' THEN event_id END AS ticket,
  CASE WHEN event_type <> 'error' THEN event_type END AS symbol, CASE WHEN event_type <> 'error' THEN value END AS price,
  CASE WHEN event_type <> 'error' AND event_id % 3 = 2 THEN 'n' || user_id END AS note,
  CASE WHEN event_type = 'error' THEN '{"ts": ' || epoch_us(ts) // 1000 || ', "ticket": ' || event_id END AS text FROM events""")
def stream_journal_drops(spark, sf_dir):
    """Journal lines that land in three deliveries, the last with a new field; lines that break off are quarantined as text."""
    use_utc(spark)
    base = f"{work_dir(spark)}/journal-{uuid.uuid4().hex}"
    e = S.table(spark, sf_dir, "events")
    seq = F.col("event_id")
    note = F.when(seq % 3 == 2, F.concat(F.lit("n"), F.col("user_id")))
    whole = F.to_json(F.struct(F.unix_millis("ts").alias("ts"), seq.alias("ticket"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), note.alias("note")))
    broken = F.concat(F.lit('{"ts": '), F.unix_millis("ts"), F.lit(', "ticket": '), seq)
    lines = e.select(seq.alias("seq"), F.when(F.col("event_type") == "error", broken).otherwise(whole).alias("value"))
    sink = ledger.good_and_quarantined(f"{base}/out")
    for k in _deliveries(lines, F.col("seq") % 3, lambda part: part.select("value").write.mode("append").text(f"{base}/in")):
        schema = JOURNAL_DROP + (", note string" if k == 2 else "")  # the schema grows before the delivery that needs it
        ledger.drained(ledger.json_stream(spark, f"{base}/in", schema), sink, f"{base}/checkpoint")
    good = ledger.read_epochs(spark, f"{base}/out/good", JOURNAL_DROP + ", note string")
    bad = ledger.read_epochs(spark, f"{base}/out/quarantine")
    none = {c: F.lit(None) for c in ("ts", "ticket", "symbol", "price", "note")}
    entries = good.select(F.lit("entry").alias("kind"), *none.keys(), F.lit(None).cast("string").alias("text"))
    return entries.unionByName(bad.select(F.lit("quarantined").alias("kind"), *[
        v.cast(good.schema[c].dataType).alias(c) for c, v in none.items()], "text"))


@query("stream_line_documents", DRAWN_SQL["chart_line_objects"])
def stream_line_documents(spark, sf_dir):
    """Line documents that land as JSON beside broken ones, read as a stream and taken apart into chart objects."""
    use_utc(spark)
    base = f"{work_dir(spark)}/lines-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    docs.write.json(f"{base}/in")
    docs.select(F.concat(F.lit('{"symbol": "'), "symbol").alias("value")).distinct().write.mode("append").text(f"{base}/in")
    ledger.drained(ledger.json_stream(spark, f"{base}/in", D.LINES_DOCUMENT), ledger.good_and_quarantined(f"{base}/out"), f"{base}/checkpoint")
    return line_objects(ledger.read_epochs(spark, f"{base}/out/good"))


@query("stream_change_counters", """WITH p AS (
  SELECT event_type AS domain, (user_id % 7)::VARCHAR AS key, floor(value / 100) AS payload, ts >= TIMESTAMP '2024-01-16' AS d, event_id FROM events),
c AS (SELECT *, payload IS DISTINCT FROM lag(payload) OVER w AS changed FROM p WINDOW w AS (PARTITION BY domain, key ORDER BY d, event_id))
SELECT domain, key, sum(changed::INT)::BIGINT AS version, CASE WHEN domain IN ('purchase', 'view') THEN sum(changed::INT)::BIGINT ELSE 0 END AS heavy_version
FROM c GROUP BY domain, key""")
def stream_change_counters(spark, sf_dir):
    """Payloads of two deliveries; counters rise only where the content of a key changes."""
    use_utc(spark)
    base = f"{work_dir(spark)}/counters-{uuid.uuid4().hex}"
    e = S.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("domain"), (F.col("user_id") % 7).cast("string").alias("key"), F.floor(F.col("value") / 100).cast("string").alias("payload"),
        F.col("event_id").alias("seq"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int").alias("delivery"))
    for k in range(2):
        e.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(e.drop("delivery").schema).parquet(f"{base}/in")
        ledger.drained(stream, ledger.change_counters(f"{base}/out", ("purchase", "view")), f"{base}/checkpoint")
    return jobs.latest_version(spark, f"{base}/out").select("domain", "key", "version", "heavy_version")


@query("stream_setup_alerts", """WITH hours AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS h, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT symbol, h, CASE WHEN n % 3 = 0 THEN 'neutral' WHEN v > 250 THEN 'buy' ELSE 'sell' END AS cls, (v - 250) / 10 AS score FROM hours),
a AS (SELECT *, CASE WHEN cls <> 'neutral' AND abs(score) >= 5 THEN cls END AS active FROM c),
p AS (SELECT *, lag(active) OVER w AS previous, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY symbol ORDER BY h))
SELECT symbol, cls, epoch_us(h) // 1000000 AS "at" FROM p WHERE rn > 1 AND active IS NOT NULL AND active IS DISTINCT FROM previous""")
def stream_setup_alerts(spark, sf_dir):
    """A class per symbol and hour; an alert wherever a class newly becomes one of high conviction."""
    use_utc(spark)
    base = f"{work_dir(spark)}/alerts-{uuid.uuid4().hex}"
    e = S.table(spark, sf_dir, "events")
    hours = e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(
        F.round(F.avg("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))
    cls = F.when(F.col("n") % 3 == 0, "neutral").when(F.col("v") > 250, "buy").otherwise("sell")
    scores = hours.select("symbol", cls.alias("cls"), ((F.col("v") - 250) / 10).alias("score"), "at")
    scores.write.parquet(f"{base}/in")
    jobs.run_available(jobs.setup_alerts(jobs.tick_stream(spark, f"{base}/in", scores.schema)), f"{base}/out", f"{base}/checkpoint")
    return rounded(spark.read.parquet(f"{base}/out").select("symbol", "cls", "at"))
