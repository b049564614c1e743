"""Rates, yields, payload parsing, positioning and fallback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import macro as M
from tidemark.operators import positioning as W
from tidemark.plans import standins as S
from tidemark.plans.market import R, rounded
from tidemark.sources import macro_files as MF

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


CCY = "list_value('USD', 'EUR', 'GBP', 'JPY', 'AUD')[CAST(left(o_orderpriority, 1) AS INTEGER)]"
OBS = f"""od AS (SELECT {CCY} AS currency, CAST(o_orderdate AS DATE) AS d, sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS m
  FROM orders GROUP BY ALL),
obs AS (SELECT currency, d, CAST(m // 10 AS DOUBLE) / 1e6 AS value, floor(CAST(m AS DOUBLE) / 2500000) * 0.25::DOUBLE AS rate FROM od),
chg AS (SELECT *, lag(rate) OVER (PARTITION BY currency ORDER BY d) AS before FROM obs),
lat AS (SELECT currency, arg_max(rate, d) AS rate, max(d) AS as_of,
  (SELECT arg_max(before, d) FROM chg WHERE chg.currency = obs.currency AND before <> rate) AS prev_rate FROM obs GROUP BY currency)"""


def _dates(df):
    return rounded(df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "date" else F.col(f.name)
                               for f in df.schema.fields]))


@query("policy_rates", f"""WITH {OBS} SELECT currency, {R("rate", "rate")}, CAST(as_of AS VARCHAR) AS as_of, {R("prev_rate", "prev_rate")} FROM lat""")
def policy_rates(spark, sf_dir):
    return _dates(M.policy_rates(S.rate_observations(spark, sf_dir)))


@query("rate_change_points", f"""WITH {OBS} SELECT currency, CAST(d AS VARCHAR) AS obs_date, {R("rate", "rate")}, {R("before", "prev_rate")}
FROM chg WHERE before IS NULL OR before <> rate""")
def rate_change_points(spark, sf_dir):
    return _dates(M.rate_changes(S.rate_observations(spark, sf_dir)))


@query("daily_rates_filled", f"""WITH {OBS},
days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM obs),
g AS (SELECT days.d, c.currency, last_value(o.value IGNORE NULLS) OVER (PARTITION BY c.currency ORDER BY days.d) AS value
  FROM days CROSS JOIN (SELECT DISTINCT currency FROM obs) c LEFT JOIN obs o ON o.d = days.d AND o.currency = c.currency),
p AS (SELECT d, {", ".join(f"max(value) FILTER (WHERE currency = '{c}') AS {c.lower()}" for c in S.CURRENCIES)} FROM g GROUP BY d)
SELECT CAST(d AS VARCHAR) AS obs_date, {", ".join(R(c.lower(), c) for c in S.CURRENCIES)} FROM p
WHERE {" AND ".join(f"{c.lower()} IS NOT NULL" for c in S.CURRENCIES)}""")
def daily_rates_filled(spark, sf_dir):
    return _dates(M.daily_wide(S.rate_observations(spark, sf_dir), "currency", "obs_date", "value", S.CURRENCIES))


PAIRS = ("USDJPY", "EURUSD", "GBPJPY", "AUDUSD", "XAUUSD", "EURGBP", "CHFJPY")


@query("pair_macro_bias", f"""WITH {OBS},
u AS (SELECT *, currency = 'AUD' AS stale FROM lat),
p(pair) AS (VALUES {", ".join(f"('{p}')" for p in PAIRS)}),
j AS (SELECT pair, left(pair, 3) AS base_ccy, substr(pair, 4) AS quote_ccy, b.rate AS b, q.rate AS q,
    (SELECT rate - prev_rate FROM u WHERE currency = 'USD') AS us
  FROM p LEFT JOIN u b ON b.currency = left(pair, 3) AND NOT b.stale LEFT JOIN u q ON q.currency = substr(pair, 4) AND NOT q.stale),
k AS (SELECT *, coalesce(CASE WHEN base_ccy = 'XAU' THEN us ELSE b - q END, 0) AS diff FROM j)
SELECT pair, base_ccy, quote_ccy, {R("diff", "differential")}, CAST(CASE WHEN base_ccy = 'XAU' THEN -sign(diff) ELSE sign(diff) END AS INTEGER) AS macro_dir,
  CASE WHEN base_ccy = 'XAU' THEN CASE WHEN diff > 0 THEN '米金利上昇=金に逆風' WHEN diff < 0 THEN '米金利低下=金に追風' ELSE '—' END
    WHEN b IS NULL OR q IS NULL THEN '—' WHEN diff > 0 THEN base_ccy || '金利優位' WHEN diff < 0 THEN quote_ccy || '金利優位' ELSE '金利差なし' END AS label FROM k""")
def pair_macro_bias(spark, sf_dir):
    rates = M.policy_rates(S.rate_observations(spark, sf_dir)).withColumn("stale", F.col("currency") == "AUD")
    pairs = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in PAIRS])).alias("pair"))
    return rounded(M.pair_bias(pairs, rates))


@query("real_yield_trend", f"""WITH {OBS},
r AS (SELECT currency, d, value, row_number() OVER (PARTITION BY currency ORDER BY d DESC) AS rn FROM obs QUALIFY rn <= 60),
a AS (SELECT currency, max(value) FILTER (WHERE rn = 1) AS v, max(value) FILTER (WHERE rn = 2) AS pv,
   coalesce(max(value) FILTER (WHERE rn = 6), arg_min(value, d)) AS r5, max(d) AS as_of, count(*) AS n FROM r GROUP BY currency)
SELECT currency, {R("v", "value")}, {R("pv", "prev_value")}, {R("v - pv", "change_1d")}, {R("v - r5", "trend_5d")},
  CASE WHEN abs(v - r5) <= 0.02 THEN 0 WHEN v > r5 THEN -1 ELSE 1 END AS gold_dir, CAST(as_of AS VARCHAR) AS as_of, n AS n_series FROM a""")
def real_yield_trend(spark, sf_dir):
    y = M.real_yield(S.rate_observations(spark, sf_dir), "currency")
    return _dates(y.withColumn("n_series", F.size("series_values").cast("bigint")).drop("series_values"))


MONTHLY = f"""mo AS (SELECT {CCY} AS currency, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY d DESC) AS rn FROM mo),
al AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(count(*) AS DOUBLE) AS v,
   100 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS u FROM orders GROUP BY ALL),
ar AS (SELECT *, row_number() OVER (ORDER BY d DESC) AS rn FROM al)"""


@query("level_changes_by_series", f"""WITH {MONTHLY} SELECT currency, CAST(max(d) AS VARCHAR) AS as_of,
  max(v) FILTER (WHERE rn = 1) - max(v) FILTER (WHERE rn = 2) AS change, max(v) FILTER (WHERE rn = 2) - max(v) FILTER (WHERE rn = 3) AS prev_change
FROM mr GROUP BY currency""")
def level_changes_by_series(spark, sf_dir):
    monthly = S.table(spark, sf_dir, "orders").groupBy(
        S.order_currency().alias("currency"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("obs_date")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return _dates(M.level_changes(monthly, ["currency"]))


@query("employment_snapshot", f"""WITH {MONTHLY} SELECT CAST(max(d) AS VARCHAR) AS as_of,
  max(v) FILTER (WHERE rn = 1) - max(v) FILTER (WHERE rn = 2) AS nonfarm_change, max(v) FILTER (WHERE rn = 2) - max(v) FILTER (WHERE rn = 3) AS prev_nonfarm_change,
  {R("max(u) FILTER (WHERE rn = 1)", "unemployment_rate")} FROM ar""")
def employment_snapshot(spark, sf_dir):
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("obs_date")
    monthly = S.table(spark, sf_dir, "orders").groupBy(month).agg(
        F.count(F.lit(1)).cast("double").alias("value"),
        (F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("u"))
    return _dates(M.employment(monthly.select("obs_date", "value"), monthly.select("obs_date", F.col("u").alias("value"))))


@query("last_good_fallback", f"""WITH {OBS},
f AS (SELECT currency, arg_max(value, d) AS value, max(d) AS d FROM obs WHERE d >= DATE '2001-01-01' AND currency NOT IN ('JPY', 'AUD') GROUP BY currency),
c AS (SELECT currency, arg_max(value, d) AS value, max(d) AS d FROM obs WHERE d < DATE '2001-01-01' GROUP BY currency)
SELECT coalesce(f.currency, c.currency) AS currency, {R("coalesce(f.value, c.value)", "value")}, CAST(coalesce(f.d, c.d) AS VARCHAR) AS obs_date,
  f.currency IS NULL AS stale FROM f FULL JOIN c ON f.currency = c.currency""")
def last_good_fallback(spark, sf_dir):
    obs = S.rate_observations(spark, sf_dir)
    cut = F.lit("2001-01-01").cast("date")
    fresh = M.latest_observation(obs.where((F.col("obs_date") >= cut) & ~F.col("currency").isin("JPY", "AUD")), ["currency"])
    cached = M.latest_observation(obs.where(F.col("obs_date") < cut), ["currency"])
    return _dates(M.with_last_good(fresh, cached, ["currency"]))


ATTEMPTS = """att AS (SELECT 's' || (o_custkey % 97) AS source, o_orderkey AS attempt_ts, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS sources_ok,
  CASE WHEN o_orderkey % 2 = 0 THEN 'timeout ' || o_orderkey END AS error FROM orders),
ok AS (SELECT source, max(attempt_ts) FILTER (WHERE sources_ok > 0) AS last_ok FROM att GROUP BY source),
fs AS (SELECT a.source, count(*) FILTER (WHERE last_ok IS NULL OR attempt_ts > last_ok) AS consecutive_failures, max(last_ok) AS last_success,
   first(error ORDER BY attempt_ts DESC) AS last_error FROM att a JOIN ok USING (source) GROUP BY a.source)"""


def _attempts(spark, sf_dir):
    k = F.col("o_orderkey")
    return S.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 97).cast("string")).alias("source"), k.alias("attempt_ts"),
        F.when(k % 3 == 0, 2).otherwise(0).alias("sources_ok"),
        F.when(k % 2 == 0, F.concat(F.lit("timeout "), k.cast("string"))).alias("error"))


@query("fetch_failure_streaks", f"WITH {ATTEMPTS} SELECT * FROM fs")
def fetch_failure_streaks(spark, sf_dir):
    return M.failure_streaks(_attempts(spark, sf_dir))


@query("feed_fallback_choice", f"""WITH {ATTEMPTS},
pri AS (SELECT 's' || (s_suppkey % 97) AS source, 'primary' AS feed, s_name AS item FROM supplier),
sec AS (SELECT 's' || (p_partkey % 60) AS source, 'secondary' AS feed, p_name || '-' || p_partkey AS item FROM part),
down AS (SELECT source FROM fs WHERE consecutive_failures >= 2)
SELECT * FROM sec WHERE source IN (SELECT source FROM down)
UNION ALL SELECT * FROM pri WHERE source NOT IN (SELECT source FROM sec WHERE source IN (SELECT source FROM down))""")
def feed_fallback_choice(spark, sf_dir):
    primary = S.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), (F.col("s_suppkey") % 97).cast("string")).alias("source"), F.lit("primary").alias("feed"), F.col("s_name").alias("item"))
    secondary = S.table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), (F.col("p_partkey") % 60).cast("string")).alias("source"), F.lit("secondary").alias("feed"),
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("item"))
    return M.choose_feed(primary, secondary, M.failure_streaks(_attempts(spark, sf_dir)))


# ------------------------------------------------------------------------------------------------ payloads

LATEST_SQL = f"""WITH o AS (SELECT {CCY} AS series, o_orderkey AS key, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0),
x AS (SELECT series, d, max(v) AS v FROM o GROUP BY ALL)
SELECT series, CAST(max(d) AS VARCHAR) AS obs_date, {R("arg_max(v, d)", "value", 2)} FROM x GROUP BY series"""


def _payload(name, column, parser):
    @query(name, LATEST_SQL)
    def run(spark, sf_dir):
        bodies = S.observation_bodies(spark, sf_dir).select("series", "key", F.col(column).alias("body"))
        rows = parser(bodies, ["series", "key"])
        # several payloads may carry the same day: the largest value stands for it
        daily = rows.groupBy("series", "obs_date").agg(F.max("value").alias("value"))
        return _dates(M.latest_observation(daily).withColumn("value", F.round("value", 2)))
    return run


_payload("latest_from_observation_json", "json", MF.parse_observation_json)
_payload("latest_from_sdmx_csv", "sdmx", MF.parse_sdmx_csv)
_payload("latest_from_rate_csv", "csv", MF.parse_rate_csv)
_payload("latest_from_rate_html", "html", MF.parse_rate_html)


@query("rejected_payloads", f"SELECT {CCY} AS series, o_orderkey AS key FROM orders WHERE o_orderkey % 5 = 0")
def rejected_payloads(spark, sf_dir):
    bodies = S.observation_bodies(spark, sf_dir).select("series", "key", F.col("html").alias("body"))
    return MF.rejected_bodies(bodies, MF.parse_rate_html(bodies, ["series", "key"]), ["series", "key"]).select("series", "key")


@query("quote_documents", f"""SELECT l_orderkey AS key, l_linenumber AS line, {R("l_extendedprice / 1000", "live")},
  {R("CASE l_linenumber % 3 WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_extendedprice / 1000 END", "prev")} FROM lineitem WHERE l_linenumber % 7 <> 6""")
def quote_documents(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    meta = F.struct(
        F.when(n % 7 != 6, F.col("l_extendedprice") / 1000).alias("regularMarketPrice"),
        F.when(n % 3 == 0, F.col("l_discount")).alias("chartPreviousClose"),
        F.when(n % 3 == 1, F.col("l_tax")).alias("previousClose"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(meta.alias("meta"))).alias("result")).alias("chart")))
    bodies = li.select(F.col("l_orderkey").alias("key"), n.alias("line"), body.alias("body"))
    return rounded(MF.parse_quotes(bodies, ["key", "line"]))


@query("weekly_positioning_metrics")
def weekly_positioning_metrics(spark, sf_dir):
    rows = W.usable_rows(MF.parse_positioning(S.positioning_bodies(spark, sf_dir)))
    return rounded(W.weekly_metrics(rows))


POSITIONING = """wk AS (SELECT l_returnflag AS market, date_trunc('week', l_shipdate) AS w,
   CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS nl, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS ns,
   CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) // 100 AS cl,
   CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) // 100 AS cs, count(*) * 100 AS oi
  FROM lineitem GROUP BY ALL),
rec52 AS (SELECT *, nl - ns AS net FROM wk QUALIFY row_number() OVER (PARTITION BY market ORDER BY w DESC) <= 52),
m AS (SELECT *, lag(net) OVER (PARTITION BY market ORDER BY w) AS pn,
   100::DOUBLE * count(*) OVER (PARTITION BY market ORDER BY net RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY market) AS pct FROM rec52)"""
POS_OUT = f"""nl AS noncomm_long, ns AS noncomm_short, net, pn AS net_prev, net - pn AS net_change, cl - cs AS comm_net, oi AS open_interest,
  {R("100 * net / oi", "net_pct_oi")}, {R("CASE WHEN nl + ns <> 0 THEN 100 * nl / (nl + ns) END", "long_share")}, {R("pct", "pctile_1y")}, CAST(sign(net) AS INTEGER) AS direction,
  CASE WHEN pct >= 90 THEN 1 WHEN pct <= 10 THEN -1 ELSE 0 END AS extreme"""
SQL["weekly_positioning_metrics"] = f"WITH {POSITIONING} SELECT market, strftime(w, '%Y-%m-%d') AS report_date, {POS_OUT} FROM m"


@query("positioning_snapshot", f"""WITH {POSITIONING} SELECT market, strftime(w, '%Y-%m-%d') AS report_date, {POS_OUT},
  (SELECT string_agg(CAST(net AS VARCHAR), ' ' ORDER BY w) FROM m h WHERE h.market = m.market) AS history FROM m
QUALIFY row_number() OVER (PARTITION BY market ORDER BY w DESC) = 1""")
def positioning_snapshot(spark, sf_dir):
    snap = W.positioning_snapshot(W.usable_rows(MF.parse_positioning(S.positioning_bodies(spark, sf_dir))))
    return rounded(snap.withColumn("history", F.array_join(F.transform("net_history", lambda v: v.cast("string")), " ")).drop(
        "net_history", "history_dates"))


@query("positioning_one_market", f"WITH {POSITIONING} SELECT market, strftime(w, '%Y-%m-%d') AS report_date, net FROM m WHERE market = 'R'")
def positioning_one_market(spark, sf_dir):
    rows = MF.parse_positioning(S.positioning_bodies(spark, sf_dir), "R")
    return W.weekly_metrics(W.usable_rows(rows)).select("market", "report_date", "net")
