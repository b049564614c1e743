"""Symbol, account, sizing, journal and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clock, guards, price, risk
from tidemark.operators import performance as PF
from tidemark.operators import symbols as Y
from tidemark.operators import trades as T
from tidemark.operators.bars import arrival_key

from tidemark.plans import standins as S
from tidemark.plans.market import TICKS, R, rounded
from tidemark.plans.trading import CURVE, DEALS, OPEN, RANGED
from tidemark.session import durable
from tidemark.sources import documents as D
from tidemark.sources import journal as J

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


# ------------------------------------------------------------------------------------------------ symbols

@query("broker_symbol_resolution", """WITH b AS (SELECT DISTINCT n_name AS base FROM nation),
l AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN '.a' WHEN 3 THEN '.pro' ELSE 'micro' END AS suf, c_custkey % 37 AS k FROM customer),
n AS (SELECT CASE WHEN k % 2 = 0 THEN 'Nation_' ELSE 'NATION_' END || k || CASE WHEN k % 3 = 0 AND suf = '' THEN 'x' ELSE suf END AS name FROM l),
m AS (SELECT base, name, upper(name) AS up, split_part(upper(name), '.', 1) AS stem FROM b, n
  WHERE upper(name) = base OR starts_with(split_part(upper(name), '.', 1), base))
SELECT base, first(name ORDER BY NOT (up = base OR stem = base), up <> base, length(name), name) AS broker_name FROM m GROUP BY base""")
def broker_symbol_resolution(spark, sf_dir):
    k = F.col("c_custkey") % 37
    suffix = S.pick(("", "m", ".a", ".pro", "micro"), F.col("c_custkey"))
    listed = S.table(spark, sf_dir, "customer").select(k.alias("k"), suffix.alias("suf")).distinct().select(
        F.concat(F.when(F.col("k") % 2 == 0, "Nation_").otherwise("NATION_"), F.col("k").cast("string"),
                 F.when((F.col("k") % 3 == 0) & (F.col("suf") == ""), "x").otherwise(F.col("suf"))).alias("name"))
    bases = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("base")).distinct()
    return Y.resolve_symbols(bases, listed)


QUOTES = """qt AS (SELECT p_brand AS broker, CASE p_partkey % 23 WHEN 0 THEN 'USDX' WHEN 1 THEN 'usdollar' WHEN 2 THEN 'EURUSD' WHEN 3 THEN 'DXY_spot' ELSE
    'DXY_' || list_value('F','G','H','J','K','M','N','Q','U','V','X','Z')[p_partkey % 12 + 1] || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 10 AS VARCHAR) ELSE lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') END END AS name,
  CASE WHEN p_partkey % 4 = 0 OR (p_partkey % 23 < 2 AND p_partkey % 46 > 1) THEN 0 ELSE p_retailprice END AS bid, p_partkey AS tick_time FROM part)"""


@query("front_contract_choice", f"""WITH {QUOTES},
k AS (SELECT *, list_position(list_value('USDX', 'DXY', 'USDIDX', 'USDOLLAR'), upper(name)) AS pr, regexp_extract(upper(name), '_([FGHJKMNQUVXZ])(\\d{{1,2}})$', 1) AS mc,
   regexp_extract(upper(name), '_([FGHJKMNQUVXZ])(\\d{{1,2}})$', 2) AS yd FROM qt WHERE bid > 0),
y AS (SELECT *, CASE WHEN mc = '' THEN NULL ELSE 100 * (CASE WHEN length(yd) = 2 THEN 2000 + CAST(yd AS INT) WHEN 2020 + CAST(yd AS INT) < 2023 THEN 2030 + CAST(yd AS INT) ELSE 2020 + CAST(yd AS INT) END)
   + list_position(list_value('F','G','H','J','K','M','N','Q','U','V','X','Z'), mc) END AS ym FROM k),
t AS (SELECT *, CASE WHEN pr > 0 THEN 0 WHEN NOT starts_with(upper(name), 'DXY') THEN NULL WHEN ym >= 202401 THEN 1 WHEN ym IS NOT NULL THEN 2 ELSE 3 END AS tier FROM y),
o AS (SELECT *, CASE tier WHEN 0 THEN pr WHEN 3 THEN -tick_time ELSE ym END AS place FROM t WHERE tier IS NOT NULL)
SELECT broker, first(name ORDER BY tier, place, name) AS name, min(tier) AS tier FROM o GROUP BY broker""")
def front_contract_choice(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    month = S.pick(("F", "G", "H", "J", "K", "M", "N", "Q", "U", "V", "X", "Z"), k)
    year = F.when(k % 2 == 0, (size % 10).cast("string")).otherwise(F.lpad((size % 30).cast("string"), 2, "0"))
    name = F.when(k % 23 == 0, "USDX").when(k % 23 == 1, "usdollar").when(k % 23 == 2, "EURUSD").when(k % 23 == 3, "DXY_spot").otherwise(
        F.concat(F.lit("DXY_"), month, year))
    bid = F.when((k % 4 == 0) | ((k % 23 < 2) & (k % 46 > 1)), 0.0).otherwise(F.col("p_retailprice"))
    quotes = p.select(F.col("p_brand").alias("broker"), name.alias("name"), bid.alias("bid"), k.alias("tick_time"))
    return Y.front_contract(quotes, S.now())


@query("symbol_metadata", f"""SELECT p_partkey AS key, base, digits, {R("point", "point", 8)},
  {R("CASE WHEN starts_with(upper(base), 'XAU') THEN 0.1::DOUBLE WHEN digits % 2 = 1 THEN point * 10 ELSE point END", "pip_size", 8)},
  {R("CASE WHEN tsz <> 0 THEN tsz ELSE point END", "trade_tick_size", 8)}, {R("coalesce(tv, 0)", "trade_tick_value", 8)}, {R("coalesce(cs, 0)", "trade_contract_size", 8)}
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'XAUUSD' WHEN 1 THEN 'EURUSD' ELSE 'xauEUR' END AS base, p_size % 4 + 2 AS digits,
  list_value(0.01, 0.001, 0.0001, 0.00001)[p_size % 4 + 1]::DOUBLE AS point, CASE WHEN p_partkey % 5 = 0 THEN 0::DOUBLE WHEN p_partkey % 5 = 1 THEN NULL ELSE 0.25::DOUBLE END AS tsz,
  CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS tv, CASE WHEN p_partkey % 7 = 0 THEN 0::DOUBLE ELSE 100::DOUBLE END AS cs FROM part)""")
def symbol_metadata(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = p.select(
        S.pick(("XAUUSD", "EURUSD", "xauEUR"), k).alias("base"), (F.col("p_size") % 4 + 2).alias("digits"),
        S.pick((0.01, 0.001, 0.0001, 0.00001), F.col("p_size")).alias("point"),
        F.when(k % 5 == 0, 0.0).when(k % 5 > 1, 0.25).alias("trade_tick_size"),
        F.when(k % 2 == 0, F.col("p_retailprice")).alias("trade_tick_value"),
        F.when(k % 7 == 0, 0.0).otherwise(100.0).alias("trade_contract_size"), k.alias("key"))
    meta = Y.symbol_metadata(raw.withColumn("base", F.concat_ws("|", "base", F.col("key").cast("string"))))
    out = meta.withColumn("key", F.split_part("base", F.lit("|"), F.lit(2)).cast("bigint")).withColumn(
        "base", F.split_part("base", F.lit("|"), F.lit(1)))
    return rounded(out, 8)


@query("server_clock_offsets", """WITH s AS (SELECT 'srv' || (o_custkey % 13) AS server, o_orderkey AS ingest,
   o_orderkey + CASE o_orderkey % 6 WHEN 0 THEN 10800 WHEN 1 THEN 7200 WHEN 2 THEN 7200 WHEN 3 THEN 12000 WHEN 4 THEN 60 * 3600 ELSE 10800 END + o_orderkey % 400 - 200 AS tick FROM orders),
d AS (SELECT server, ingest, tick - ingest AS delta, round_even((tick - ingest) / 3600, 0) * 3600 AS h FROM s WHERE tick > 0),
a AS (SELECT server, ingest, CAST(h AS BIGINT) AS h, row_number() OVER w AS n, lag(h) OVER w AS ph FROM d WHERE abs(delta - h) <= 180 AND h BETWEEN -43200 AND 50400 WINDOW w AS (PARTITION BY server ORDER BY ingest)),
c AS (SELECT *, CASE WHEN n = 1 OR h = ph THEN h END AS conf FROM a)
SELECT server, ingest AS ingest_time, h AS sample_offset, last_value(conf IGNORE NULLS) OVER (PARTITION BY server ORDER BY ingest) AS offset_sec FROM c""")
def server_clock_offsets(spark, sf_dir):
    k = F.col("o_orderkey")
    drift = F.when(k % 6 == 0, 10800).when(k % 6 == 1, 7200).when(k % 6 == 2, 7200).when(k % 6 == 3, 12000).when(k % 6 == 4, 216000).otherwise(10800)
    samples = S.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("srv"), (F.col("o_custkey") % 13).cast("string")).alias("server"), k.alias("ingest_time"),
        (k + drift + k % 400 - 200).alias("tick_time"))
    return Y.server_offsets(samples)


@query("server_bars_to_utc", f"""WITH {TICKS}, w AS (SELECT seq, CASE seq % 3 WHEN 0 THEN 'ICMarketsSC-MT5-3' WHEN 1 THEN 'TitanFX-MT5-01' ELSE 'Flat' END AS server,
   epoch_us(ts) // 1000000 + (seq % 12) * 30 * 86400 AS wall FROM ticks),
z AS (SELECT *, make_timestamp(wall * 1000000) AS lw, CASE server WHEN 'TitanFX-MT5-01' THEN 'Europe/Athens' ELSE 'Europe/Bucharest' END AS zone FROM w),
-- a wall time that occurs twice means its first occurrence
u AS (SELECT *, timezone(zone, lw) AS ut FROM z)
SELECT seq, server, CASE WHEN server = 'Flat' THEN wall - 7200
  ELSE epoch_us(CASE WHEN timezone(zone, ut - INTERVAL 1 HOUR) = lw THEN ut - INTERVAL 1 HOUR ELSE ut END) // 1000000 END AS bar_time FROM u""")
def server_bars_to_utc(spark, sf_dir):
    from tidemark.operators.bars import server_bars_to_utc as convert
    t = S.ticks(spark, sf_dir).select(
        "seq", S.pick(("ICMarketsSC-MT5-3", "TitanFX-MT5-01", "Flat"), F.col("seq")).alias("server"),
        (F.unix_seconds("ts") + F.col("seq") % 12 * 30 * 86400).alias("server_secs"))
    return rounded(convert(t, flat_offset=F.lit(7200)).select("seq", "server", "bar_time"))


# ------------------------------------------------------------------------------------------------ scalar columns on quotes

@query("quote_columns", f"""WITH {TICKS}, q AS (SELECT seq, symbol, CASE WHEN seq % 11 = 0 THEN price + 1 ELSE price END AS bid, price + (seq % 4) / 10::DOUBLE AS ask, price,
   list_value('XAUUSD', 'USDJPY', 'EURUSD', 'XAGUSD', '')[seq % 5 + 1] AS pair, seq % 5000 AS age FROM ticks)
SELECT seq, {R("CASE WHEN ask >= bid THEN (ask - bid) * CASE WHEN pair LIKE '%JPY' THEN 100 WHEN pair LIKE 'XA%' THEN 10 ELSE 10000 END ELSE 0 END", "spread")},
  CASE WHEN abs(price * 10) >= 1000 THEN 2 WHEN abs(price * 10) >= 50 THEN 3 ELSE 5 END AS digits,
  CASE WHEN age < 60 THEN printf('%.1fs', age::DOUBLE) WHEN age < 3600 THEN (age // 60) || 'm' ELSE (age // 3600) || 'h' END AS age_text,
  CASE WHEN age >= 3600 THEN printf('%dh%02dm', age // 3600, age % 3600 // 60) ELSE (age // 60) || 'm' END AS hold_text,
  left(pair, 3) AS base_ccy, substr(pair, 4) AS quote_ccy FROM q""")
def quote_columns(spark, sf_dir):
    seq = F.col("seq")
    q = S.ticks(spark, sf_dir).select(
        "seq", F.when(seq % 11 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("bid"),
        (F.col("price") + seq % 4 / F.lit(10.0)).alias("ask"), "price",
        S.pick(("XAUUSD", "USDJPY", "EURUSD", "XAGUSD", ""), seq).alias("pair"), (seq % 5000).alias("age"))
    base, quote = price.split_pair(F.col("pair"))
    return rounded(q.select(
        "seq", price.spread_pips(F.col("bid"), F.col("ask"), price.pip_multiplier(F.col("pair"), F.lit(None).cast("double"))).alias("spread"),
        price.price_digits(F.col("price") * 10, F.lit(None).cast("int")).alias("digits"),
        clock.quote_age(F.col("age")).alias("age_text"), clock.holding_age(F.col("age")).alias("hold_text"),
        base.alias("base_ccy"), quote.alias("quote_ccy")))


@query("jst_clock_columns", f"""WITH {TICKS}, j AS (SELECT seq, ts, ts + INTERVAL 9 HOUR AS jt FROM ticks)
SELECT seq, strftime(jt, '%H:%M:%S') AS clock, strftime(jt, '%H:%M') AS clock_short, month(jt) || '/' || day(jt) AS date_jst, year(jt) || '/' || month(jt) || '/' || day(jt) AS date_year,
  CASE CAST(jt AS DATE) - CAST(TIMESTAMP '2024-01-15 20:00:00' + INTERVAL 9 HOUR AS DATE) WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE '' END AS day_tag FROM j""")
def jst_clock_columns(spark, sf_dir):
    ts = F.col("ts")
    return S.ticks(spark, sf_dir).select(
        "seq", clock.jst_clock(ts).alias("clock"), clock.jst_clock_short(ts).alias("clock_short"), clock.jst_date(ts).alias("date_jst"),
        clock.jst_date_year(ts).alias("date_year"), clock.day_tag(ts, F.lit("2024-01-15 20:00:00").cast("timestamp")).alias("day_tag"))


@query("tolerant_text_columns", """SELECT doc_id, regexp_replace('GET /x?api_key=' || doc_id || 'ab&f=' || source || ' ' || text, '(api_key=)[^&\\s"'']+', '\\1***', 'g') AS redacted,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN n_chars WHEN doc_id % 4 = 2 THEN n_chars ELSE NULL END AS n_long,
  CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE replace(regexp_replace(trim(lang || ' ' || source || '..' || doc_id), '[^A-Za-z0-9._-]+', '_', 'g'), '..', '_') END AS slug FROM documents""")
def tolerant_text_columns(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    n = F.col("n_chars").cast("string")
    text = F.concat(F.lit("GET /x?api_key="), i.cast("string"), F.lit("ab&f="), "source", F.lit(" "), "text")
    number = F.when(i % 4 == 0, "n/a").when(i % 4 == 1, F.concat(F.lit(" "), n, F.lit(".75 "))).when(i % 4 == 2, n).otherwise("NaN")
    name = F.when(i % 7 != 0, F.concat("lang", F.lit(" "), "source", F.lit(".."), i.cast("string")))
    return d.select("doc_id", guards.redact(text).alias("redacted"), guards.to_long(number).alias("n_long"), guards.path_slug(name).alias("slug"))


# ------------------------------------------------------------------------------------------------ accounts and sizing

@query("recommended_lots", f"""SELECT c_custkey, {R("CASE WHEN e > 0 THEN greatest(0.01::DOUBLE, least(10::DOUBLE, floor(e / 100000) / 100)) ELSE 0.01::DOUBLE END", "lot")}
FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal * 500 END AS e FROM customer)""")
def recommended_lots(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    equity = F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal") * 500)
    return rounded(c.select("c_custkey", risk.recommended_lot(equity).alias("lot")))


@query("sizing_requests", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS entry, l_extendedprice / 100 - l_linenumber AS stop, l_extendedprice / 100 + l_quantity / 5 AS target,
   l_extendedprice AS risk_amount, l_linenumber * 10 - 20 AS stop_pips, l_quantity / 7 AS lots, l_extendedprice * 2 AS equity, l_quantity * 10 / 3 AS margin FROM lineitem)
SELECT l_orderkey, l_linenumber, {R("CASE WHEN stop_pips > 0 THEN risk_amount / (stop_pips * 10) END", "lots_for_risk")},
  {R("CASE WHEN abs(entry - stop) > 0 THEN abs(target - entry) / abs(entry - stop) END", "reward_risk")}, {R("lots * 10", "pip_value")},
  {R("(equity - margin) / (lots * 10)", "liq_pips")}, {R("(entry - (equity - margin) / (lots * 10) * 0.1::DOUBLE) / entry", "liq_price_share")},
  {R("CASE WHEN lots >= 0.5 THEN round_even(least(5, greatest(0.5::DOUBLE, 0.5::DOUBLE + round_even((least(5, lots) - 0.5) / 0.25::DOUBLE, 0) * 0.25)) * 100, 0) / 100 END", "snapped")} FROM r""")
def sizing_requests(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    entry = F.col("l_extendedprice") / 100
    lots = F.col("l_quantity") / 7
    liq = risk.liquidation_pips(F.col("l_extendedprice") * 2, F.col("l_quantity") * 10 / 3, lots)
    return rounded(li.select(
        "l_orderkey", "l_linenumber",
        risk.lots_for_risk(F.col("l_extendedprice"), F.col("l_linenumber") * 10 - 20, F.lit(10.0)).alias("lots_for_risk"),
        risk.reward_risk(entry, entry - F.col("l_linenumber"), entry + F.col("l_quantity") / 5).alias("reward_risk"),
        risk.pip_value(lots).alias("pip_value"), liq.alias("liq_pips"), (risk.liquidation_price(entry, liq) / entry).alias("liq_price_share"),
        risk.snapped_lot(lots, F.lit(0.5), F.lit(5.0), F.lit(0.25)).alias("snapped")))


@query("account_snapshots", f"""WITH p AS (SELECT o_custkey AS login, count(*) AS n, sum(o_totalprice - 250000 + -0.25::DOUBLE) AS fl FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS login, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS margin_level, coalesce(n, 0) AS open_count, {R("coalesce(fl, 0)", "floating", 3)},
  c_custkey % 2 = 0 AND (c_mktsegment = 'MACHINERY' OR c_custkey % 3 = 0) AS trade_allowed FROM customer LEFT JOIN p ON login = c_custkey""")
def account_snapshots(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    level = F.when(k % 9 == 0, F.lit(float("inf"))).otherwise(F.round("c_acctbal", 2))
    accounts = c.select(k.alias("login"), guards.finite_or_null(level).alias("margin_level"), (k % 2 == 0).alias("account_allowed"))
    positions = S.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("login"), (F.col("o_totalprice") - 250000.0).alias("profit"), F.lit(-0.25).alias("swap"))
    # accounts of one segment report no terminal, which does not block trading
    terminals = c.where("c_mktsegment <> 'MACHINERY'").select(k.alias("login"), (k % 3 == 0).alias("terminal_allowed"))
    return rounded(Y.account_snapshot(accounts, positions, terminals), 3)


@query("open_position_rows", f"""WITH {OPEN} SELECT ticket, type, {R("CASE WHEN type = 'BUY' THEN price_current - price_open ELSE price_open - price_current END / 0.1::DOUBLE", "pips")},
  {R("CASE WHEN sl <> 0 AND abs(price_open - sl) > 0 THEN CASE WHEN type = 'BUY' THEN price_current - price_open ELSE price_open - price_current END / abs(price_open - sl) END", "r_open")} FROM opn""")
def open_position_rows(spark, sf_dir):
    p = S.open_positions(spark, sf_dir).withColumn("side", F.when(F.col("type") == "BUY", 0).otherwise(1)).drop("type")
    return rounded(Y.open_position_rows(p).select("ticket", "type", "pips", "r_open"))


SUMMARY = RANGED + """,
s AS (SELECT range_label, count(pnl) AS n, count(*) FILTER (WHERE pnl > 0) AS w, count(*) FILTER (WHERE pnl < 0) AS l,
        coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gp, coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl
      FROM rng LEFT JOIN ranged USING (range_label) GROUP BY range_label),
sr AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE w / n END AS wr, CASE WHEN l > 0 THEN (CASE WHEN w = 0 THEN 0 ELSE gp / w END) / abs(gl / l) END AS rr FROM s)"""


def _stored_trades(spark, sf_dir):
    # closed trades feed several passes: written once
    return durable(T.pair_deals(S.deals(spark, sf_dir), keep_blocks=True))


def _ranged(spark, sf_dir):
    return PF.in_ranges(_stored_trades(spark, sf_dir), F.unix_seconds(S.now()).cast("double"))


@query("expectancy_by_range", f"""WITH RECURSIVE {SUMMARY}, e AS (SELECT *, wr * rr - (1 - wr) AS edge FROM sr)
SELECT range_label, {R("edge", "expectancy")}, {R("CASE WHEN rr > 0 THEN 1 / (1 + rr) END", "breakeven")}, {R("CASE WHEN rr > 0 THEN wr - (1 - wr) / rr END", "kelly")},
  {R("CASE WHEN edge <= 0 THEN 1 ELSE greatest(0, least(1, power((1 - edge) / (1 + edge), 20))) END", "risk_of_ruin")}, n < 20 AS few_trades, n < 5 AS low_sample FROM e""")
def expectancy_by_range(spark, sf_dir):
    s = PF.range_summary(_ranged(spark, sf_dir))
    wr, rr = F.col("win_rate"), F.col("risk_reward")
    return rounded(s.select(
        "range_label", risk.expectancy(wr, rr).alias("expectancy"), risk.breakeven_win_rate(rr).alias("breakeven"), risk.kelly(wr, rr).alias("kelly"),
        risk.risk_of_ruin(wr, rr, F.lit(20)).alias("risk_of_ruin"), risk.few_trades(F.col("trade_count")).alias("few_trades"),
        (F.col("trade_count") < 5).alias("low_sample")))


ACCOUNT_ROW = f"""WITH RECURSIVE {CURVE}, {OPEN.replace(DEALS + ",", "")}, {SUMMARY[len(RANGED) + 2:]},
dd AS (SELECT *, greatest(0, peak) - equity AS ddv FROM curve WHERE range_label = '90d'),
so AS (SELECT sign(pnl) AS s, row_number() OVER (ORDER BY exit_time, ticket) AS rn, row_number() OVER (PARTITION BY sign(pnl) ORDER BY exit_time, ticket) AS rs
  FROM ranged WHERE range_label = '90d'),
sl AS (SELECT s, count(*) AS len FROM so GROUP BY s, rn - rs),
perf AS (SELECT (SELECT coalesce(max(len) FILTER (WHERE s > 0), 0) FROM sl) AS max_win_streak, (SELECT coalesce(max(len) FILTER (WHERE s < 0), 0) FROM sl) AS max_loss_streak,
  (SELECT coalesce(sum(pnl), 0) FROM trades WHERE exit_time >= epoch_us(date_trunc('day', TIMESTAMP '{S.NOW}')) // 1000000) + (SELECT coalesce(sum(profit + swap), 0) FROM opn) AS today,
  (SELECT gp + gl FROM sr WHERE range_label = '7d') AS net7, (SELECT gp + gl FROM sr WHERE range_label = '30d') AS net30,
  (SELECT wr FROM sr WHERE range_label = '90d') AS wr, (SELECT rr FROM sr WHERE range_label = '90d') AS rr,
  (SELECT first(CASE WHEN peak > 0 THEN ddv / peak * 100 ELSE 0 END ORDER BY ddv DESC, exit_time, ticket) FROM dd) AS ddp)"""


@query("account_kpi_rows", f"""{ACCOUNT_ROW}
SELECT c_custkey AS login, {R("c_acctbal", "balance", 4)}, {R("today", "today", 4)}, {R("net7", "net_7d", 4)}, {R("net30", "net_30d", 4)}, {R("ddp", "max_drawdown_pct", 4)},
  {R("CASE WHEN c_acctbal * 0.03::DOUBLE > 0 THEN greatest(0, 1 - (CASE WHEN today < 0 THEN -today ELSE 0 END) / (c_acctbal * 0.03::DOUBLE)) ELSE 1 END", "budget_left", 4)},
  (c_acctbal > 0 AND today <= c_acctbal * -0.03::DOUBLE) OR ddp >= 10 AS gated,
  {R("CASE WHEN c_acctbal > 0 AND greatest(0, CASE WHEN rr > 0 THEN wr - (1 - wr) / rr END) / 4 * c_acctbal > 0 THEN greatest(0, CASE WHEN rr > 0 THEN wr - (1 - wr) / rr END) / 4 * c_acctbal / 500 END", "edge_lot", 4)},
  max_win_streak, max_loss_streak
FROM customer CROSS JOIN perf""")
def account_kpi_rows(spark, sf_dir):
    trades = _stored_trades(spark, sf_dir)
    ranged = PF.in_ranges(trades, F.unix_seconds(S.now()).cast("double"))
    summary = PF.range_summary(ranged)
    draw = PF.range_drawdown(PF.equity_curve(ranged.where("range_label = '90d'"))).select("max_drawdown_pct")

    def of(label, c):
        return F.max(F.when(F.col("range_label") == label, F.col(c)))

    row = summary.agg(of("7d", "net_profit").alias("net_7d"), of("30d", "net_profit").alias("net_30d"),
                      of("90d", "win_rate").alias("wr"), of("90d", "risk_reward").alias("rr"))
    today = PF.today_pnl(trades, S.open_positions(spark, sf_dir), S.now()).select(
        F.col("today_total_pnl").alias("today"))
    runs = PF.streaks(ranged.where("range_label = '90d'")).select("max_win_streak", "max_loss_streak")
    # four one-row frames beside every account
    perf = row.crossJoin(draw).crossJoin(today).crossJoin(runs)
    accounts = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("login"), F.col("c_acctbal").alias("balance"))
    b, t = F.col("balance"), F.col("today")
    out = accounts.crossJoin(F.broadcast(perf)).select(
        "login", "balance", "today", "net_7d", "net_30d", "max_drawdown_pct", risk.daily_budget_left(b, t).alias("budget_left"),
        risk.risk_gated(b, t, F.col("max_drawdown_pct")).alias("gated"), risk.edge_lot(F.col("wr"), F.col("rr"), b, F.lit(50)).alias("edge_lot"), "max_win_streak", "max_loss_streak")
    return rounded(out, 4)


# ------------------------------------------------------------------------------------------------ journal and snapshots

@query("journal_lines", """SELECT event_id, epoch_us(ts) // 1000 AS ts, event_type AS symbol, user_id AS ticket, value AS price FROM events
WHERE event_id % 13 NOT IN (0, 1) ORDER BY ts DESC, event_id DESC""")
def journal_lines(spark, sf_dir):
    """Journal text held in a table: blank and truncated lines are dropped, the rest parsed."""
    e = S.table(spark, sf_dir, "events")
    k = F.col("event_id") % 13
    doc = F.to_json(F.struct(F.unix_millis("ts").alias("ts"), F.col("event_type").alias("symbol"), F.col("user_id").alias("ticket"), F.col("value").alias("price")))
    line = F.when(k == 0, F.lit(" ")).when(k == 1, F.substring(doc, 1, 20)).otherwise(doc)
    rows = J.parse_journal_lines(e.select("event_id", line.alias("line")))
    return rows.select("event_id", "ts", "symbol", "ticket", "price")


@query("recent_journal_entries", "SELECT event_id, epoch_us(ts) // 1000 AS ts, event_type AS symbol FROM events ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC LIMIT 200")
def recent_journal_entries(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", F.unix_millis("ts").alias("ts"), F.col("event_type").alias("symbol"))
    return J.recent_journal(e, 200, "event_id")


@query("snapshot_documents_full", f"""WITH {TICKS}, t AS (SELECT symbol, max(seq) AS version, last(price ORDER BY ts, seq) AS last, count(*) AS n FROM ticks GROUP BY symbol)
SELECT symbol, '{{"version":' || version || ',"price":{{"last":' || last || ',"n":' || n || '}},"account":{{"margin_level":null}}}}' AS document FROM t""")
def snapshot_documents_full(spark, sf_dir):
    return D.snapshot_documents(_domains(spark, sf_dir), "symbol", ["price", "account"])


@query("snapshot_documents_light", f"""WITH {TICKS}, t AS (SELECT symbol, max(seq) AS version, last(price ORDER BY ts, seq) AS last, count(*) AS n FROM ticks GROUP BY symbol)
SELECT symbol, '{{"partial":true,"version":' || version || ',"price":{{"last":' || last || ',"n":' || n || '}}}}' AS document FROM t""")
def snapshot_documents_light(spark, sf_dir):
    return D.snapshot_documents(_domains(spark, sf_dir), "symbol", ["price", "account"], ["price"], partial=True)


def _domains(spark, sf_dir):
    t = S.ticks(spark, sf_dir).groupBy("symbol").agg(
        F.max("seq").alias("version"), F.max_by("price", arrival_key(F.col("ts"), F.col("seq"))).alias("last"), F.count(F.lit(1)).alias("n"))
    return t.select("symbol", "version", F.struct("last", "n").alias("price"),
                    F.struct(guards.finite_or_null(F.lit(float("inf"))).alias("margin_level")).alias("account"))


@query("merged_partial_snapshots", """WITH h AS (SELECT c_custkey AS k, c_acctbal AS price, c_mktsegment AS analysis FROM customer),
n AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1)
SELECT h.k, coalesce(n.price, h.price) AS price, analysis FROM h LEFT JOIN n USING (k)""")
def merged_partial_snapshots(spark, sf_dir):
    held = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.col("c_mktsegment").alias("analysis"))
    fresh = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    return D.merge_partial(held, fresh, "k", ["price"])


@query("changed_payloads", "SELECT page_id AS symbol FROM pages WHERE page_id % 3 = 0")
def changed_payloads(spark, sf_dir):
    """Pages whose content differs from the previous write; every third page's content changed."""
    now = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("symbol"), F.col("html").alias("payload"))
    before = now.select("symbol", F.xxhash64(F.when(F.col("symbol") % 3 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).alias("content_hash"))
    return D.changed_only(now, before).select("symbol")


