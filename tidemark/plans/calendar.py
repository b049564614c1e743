"""Economic calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import events as E
from tidemark.operators import events as C
from tidemark.plans import standins as S
from tidemark.plans.market import rounded
from tidemark.sources import feeds, macro_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _list(values):
    return "list_value(" + ", ".join(f"'{v}'" for v in values) + ")"


def _likes(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


MINUTES = "list_value(510, 735, NULL, 840, NULL, 665)"
RAW = f"""raw AS (
  SELECT doc_id, rtrim({_list(S.PHRASES)}[doc_id % 12 + 1] || ' ' || text, ' ' || chr(9) || chr(10) || chr(13)) AS title,
    {_list(S.FEED_COUNTRIES)}[(doc_id // 5) % 9 + 1] AS country, {_list(S.FEED_IMPACTS)}[(doc_id // 3) % 4 + 1] AS impact,
    epoch_us(CAST(DATE '2026-01-01' + CAST(doc_id % 330 AS INTEGER) AS TIMESTAMP)) // 1000000 + {MINUTES}[(doc_id // 7) % 6 + 1] * 60 AS release_ts,
    (doc_id % 50) || 'K' AS forecast, 'https://' || {_list(S.FEED_HOSTS)}[doc_id % 4 + 1] || '/e/' || doc_id AS url
  FROM documents),
feed AS (SELECT doc_id, release_ts, upper(country) AS currency, title, impact, forecast, '' AS previous, '' AS actual, 'primary' AS source, url AS source_url
  FROM raw WHERE lower(impact) = 'high' AND upper(country) IN ({", ".join(f"'{c}'" for c in dims.FIAT_CURRENCIES)})
    AND {_likes("title", dims.EVENT_KEYWORDS)} AND release_ts IS NOT NULL)"""
COLS = "release_ts, currency, title, impact, forecast, previous, actual, source, source_url"
NOW = f"(epoch_us(TIMESTAMP '{S.EVENT_NOW}') // 1000000)"


def _feed(spark, sf_dir):
    good, _ = feeds.split_feed(S.feed_bodies(spark, sf_dir))
    return C.filter_feed(feeds.parse_events(good))


def _now():
    return F.lit(S.EVENT_NOW).cast("timestamp")


@query("calendar_feed_events", f"WITH {RAW} SELECT {COLS} FROM feed")
def calendar_feed_events(spark, sf_dir):
    return rounded(_feed(spark, sf_dir))


@query("quarantined_feed_bodies", "SELECT 'p' || page_id AS key FROM pages WHERE NOT contains(lower(html), '<weeklyevents')")
def quarantined_feed_bodies(spark, sf_dir):
    return feeds.split_feed(S.feed_bodies(spark, sf_dir))[1].select("key")


SECONDARY = f"""sv AS (
  SELECT l_partkey AS event_id, (l_orderkey - 20) * 3600 + l_linenumber AS time, l_quantity AS f, l_discount AS p, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS a FROM lineitem),
se AS (SELECT p_partkey AS event_id, p_size % 30 AS country_id, p_partkey % 4 AS importance, {_list(S.PHRASES)}[p_partkey % 12 + 1] || ' ' || p_name AS name FROM part),
sc AS (SELECT n_nationkey AS country_id, {_list(S.FEED_COUNTRIES)}[n_nationkey % 9 + 1] AS currency FROM nation),
sec AS (SELECT time AS release_ts, upper(currency) AS currency, name AS title, 'High' AS impact, CAST(CAST(f AS BIGINT) AS VARCHAR) AS forecast,
   rtrim(rtrim(printf('%.2f', p), '0'), '.') AS previous, CASE WHEN a IS NULL THEN '' ELSE rtrim(rtrim(printf('%.2f', a), '0'), '.') END AS actual, 'secondary' AS source, '' AS source_url
  FROM sv JOIN se USING (event_id) JOIN sc USING (country_id)
  WHERE importance = 3 AND upper(currency) IN ({", ".join(f"'{c}'" for c in dims.FIAT_CURRENCIES)}) AND {_likes("name", dims.EVENT_KEYWORDS)} AND time > 0)"""


#: An instant inside the stand-in's release times.
SECONDARY_NOW = "1970-02-10 00:00:00"


def _secondary(spark, sf_dir, now=None):
    li = S.table(spark, sf_dir, "lineitem")
    values = li.select(
        F.col("l_partkey").alias("event_id"), ((F.col("l_orderkey") - 20) * 3600 + F.col("l_linenumber")).alias("time"),
        F.col("l_quantity").alias("forecast_value"), F.col("l_discount").alias("prev_value"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("actual_value"))
    events = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("event_id"), (F.col("p_size") % 30).alias("country_id"), (F.col("p_partkey") % 4).alias("importance"),
        F.concat_ws(" ", S.pick(S.PHRASES, F.col("p_partkey")), F.col("p_name")).alias("name"))
    countries = S.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("country_id"), S.pick(S.FEED_COUNTRIES, F.col("n_nationkey")).alias("currency"))
    return C.secondary_calendar(values, events, countries, now=now)


@query("secondary_calendar_events", f"WITH {SECONDARY} SELECT {COLS} FROM sec")
def secondary_calendar_events(spark, sf_dir):
    return rounded(_secondary(spark, sf_dir))


@query("secondary_calendar_window", f"""WITH {SECONDARY} SELECT {COLS} FROM sec
WHERE release_ts BETWEEN epoch_us(TIMESTAMP '{SECONDARY_NOW}') // 1000000 - 3600 AND epoch_us(TIMESTAMP '{SECONDARY_NOW}') // 1000000 + 7 * 86400""")
def secondary_calendar_window(spark, sf_dir):
    """Releases of the secondary feed from an hour back to seven days ahead."""
    return rounded(_secondary(spark, sf_dir, F.lit(SECONDARY_NOW).cast("timestamp")))


@query("merged_calendar", f"""WITH {RAW}, {SECONDARY}, u AS (SELECT 0 AS p, {COLS} FROM feed UNION ALL SELECT 1, {COLS} FROM sec)
SELECT {COLS} FROM u QUALIFY row_number() OVER (PARTITION BY release_ts, currency, title ORDER BY p, impact, forecast, previous, actual, source, source_url) = 1""")
def merged_calendar(spark, sf_dir):
    return rounded(C.merge_feeds(_feed(spark, sf_dir), _secondary(spark, sf_dir)))


_BANKS = ", ".join(
    f"('{c}', '{t}', '{z}', {h * 60 + m}, '{u}', '{d}')" for c, t, z, h, m, u, days in dims.BANK_SCHEDULES for d in days)
SCHEDULE = f"""bank(currency, title, zone, mins, url, d) AS (VALUES {_BANKS}),
sch AS (SELECT epoch_us(timezone(zone, CAST(d AS TIMESTAMP) + to_minutes(mins))) // 1000000 AS release_ts, currency, title, 'High' AS impact,
   '' AS forecast, '' AS previous, '' AS actual, 'scheduled' AS source, url AS source_url FROM bank),
live AS (SELECT DISTINCT currency, release_ts // 86400 AS day FROM feed),
shown AS (SELECT DISTINCT {_list(S.FEED_COUNTRIES)}[r_regionkey + 1] AS currency FROM region WHERE r_name <> 'EUROPE'),
upc AS (SELECT {COLS} FROM sch WHERE release_ts >= {NOW} AND NOT EXISTS (SELECT 1 FROM live WHERE live.currency = sch.currency AND live.day = sch.release_ts // 86400)
   AND currency IN (SELECT currency FROM shown)
   QUALIFY row_number() OVER (PARTITION BY currency, title ORDER BY release_ts) <= 3)"""


def _upcoming(spark, sf_dir, feed):
    shown = S.table(spark, sf_dir, "region").where("r_name <> 'EUROPE'").select(
        S.pick(S.FEED_COUNTRIES, F.col("r_regionkey")).alias("currency")).distinct()
    return C.upcoming(C.bank_schedule(spark), feed, _now(), currencies=shown)


@query("upcoming_decisions", f"WITH {RAW}, {SCHEDULE} SELECT {COLS} FROM upc")
def upcoming_decisions(spark, sf_dir):
    return rounded(_upcoming(spark, sf_dir, _feed(spark, sf_dir)))


@query("upcoming_payrolls", f"""WITH {RAW},
pd AS (SELECT DISTINCT CAST(DATE '2026-01-02' + CAST(7 * (o_custkey % 60) AS INTEGER) AS VARCHAR) AS d FROM orders WHERE o_orderkey % 11 <> 0),
ps AS (SELECT epoch_us(timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 510 MINUTE)) // 1000000 AS release_ts FROM pd)
SELECT release_ts, 'USD' AS currency, '{dims.PAYROLL_TITLE}' AS title FROM ps WHERE release_ts >= {NOW}
  AND release_ts // 86400 NOT IN (SELECT release_ts // 86400 FROM feed WHERE currency = 'USD') ORDER BY release_ts LIMIT 3""")
def upcoming_payrolls(spark, sf_dir):
    """Release dates arrive as landed documents, one per order here, with blanks and repeats."""
    o = S.table(spark, sf_dir, "orders")
    day = F.date_add(F.lit("2026-01-02").cast("date"), (F.col("o_custkey") % 60 * 7).cast("int")).cast("string")
    body = F.to_json(F.struct(F.array(F.struct(F.when(F.col("o_orderkey") % 11 != 0, day).otherwise("").alias("date"))).alias("release_dates")))
    dates = macro_files.parse_release_dates(o.select(body.alias("body")))
    picked = C.upcoming(C.payroll_schedule(dates), _feed(spark, sf_dir), _now())
    return rounded(picked.select("release_ts", "currency", "title"))


CAT = f"""CASE WHEN {_likes("title", dims.CATEGORY_EMPLOYMENT)} THEN 'emp' WHEN {_likes("title", dims.CATEGORY_RATE)} THEN 'rate' ELSE 'oth' END"""
BYCCY = "CASE currency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.TITLE_RATE_BY_CURRENCY.items()) + f" ELSE '{dims.TITLE_RATE_DEFAULT}' END"
LOCAL = f"""CASE WHEN contains(lower(title), 'adp') THEN '{dims.TITLE_ADP}' WHEN {_likes("title", ("non-farm", "nonfarm", "payroll"))} THEN '{dims.TITLE_PAYROLL}'
  WHEN {_likes("title", ("unemployment", "jobless", "claimant"))} THEN '{dims.TITLE_UNEMPLOYMENT}' WHEN contains(lower(title), 'press conference') THEN '{dims.TITLE_PRESS}'
  WHEN {_likes("title", dims.TITLE_RATE_KEYWORDS)} THEN {BYCCY} ELSE title END"""
LINK = f"""CASE WHEN starts_with(lower(source_url), 'https://') AND lower(split_part(split_part(source_url, '://', 2), '/', 1)) IN ({", ".join(f"'{h}'" for h in dims.SOURCE_HOSTS)}) THEN source_url ELSE '' END"""


@query("event_titles_and_categories", f"""WITH {RAW} SELECT doc_id, {CAT} AS category, {LOCAL.replace("currency", "country")} AS local_title FROM raw""")
def event_titles_and_categories(spark, sf_dir):
    """Category and localised title of every document-derived title, filtered or not."""
    good, _ = feeds.split_feed(S.feed_bodies(spark, sf_dir))
    rows = feeds.parse_events(good, keep=("key",))
    title = F.trim("title")
    return rows.where("key LIKE 'd%'").select(
        F.substr("key", F.lit(2)).cast("bigint").alias("doc_id"), E.category(title).alias("category"),
        E.localised_title(title, F.col("country")).alias("local_title"))


@query("calendar_display", f"""WITH {RAW}, {SCHEDULE},
al AS (SELECT {COLS} FROM feed UNION ALL SELECT {COLS} FROM upc),
kept AS (SELECT * FROM al WHERE release_ts >= {NOW} - 1800 AND currency IN ('USD', 'EUR', 'JPY') ORDER BY release_ts, currency, title LIMIT 12),
j AS (SELECT *, make_timestamp((release_ts + 32400) * 1000000) AS jt FROM kept)
SELECT release_ts, month(jt) || '/' || day(jt) AS date_jst, strftime(jt, '%H:%M') AS time_jst,
  CASE CAST(jt AS DATE) - CAST(TIMESTAMP '{S.EVENT_NOW}' + INTERVAL 9 HOUR AS DATE) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE '' END AS day_tag,
  currency, {CAT} AS category, {LOCAL} AS title, {LINK} AS source_url FROM j""")
def calendar_display(spark, sf_dir):
    feed = _feed(spark, sf_dir)
    merged = C.merge_feeds(feed, _upcoming(spark, sf_dir, feed))
    symbols = spark.range(1).select(F.explode(F.array(F.lit("XAUUSD"), F.lit("EURJPY"))).alias("symbol"))
    return rounded(C.display_rows(merged, symbols, _now()))


@query("page_link_check", f"""SELECT page_id, CASE WHEN starts_with(lower(url), 'https://')
   AND lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) IN ('m.ththth.example.net', 'www.ththth.example.net') THEN url ELSE '' END AS link FROM pages""")
def page_link_check(spark, sf_dir):
    hosts = ("m.ththth.example.net", "www.ththth.example.net")
    return S.table(spark, sf_dir, "pages").select("page_id", E.source_link(F.col("url"), hosts).alias("link"))
