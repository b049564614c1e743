"""Trade, performance, excursion and sizing-on-results queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.dims import DEFAULT_RANGE_DAYS, HISTORY_RANGES
from tidemark.operators import nested as N
from tidemark.operators import performance as PF
from tidemark.operators import trades as T
from tidemark.operators.bars import ticks_to_bars
from tidemark.plans import standins as S
from tidemark.plans.market import TICKS, R, rounded
from tidemark.operators.ordering import BLOCK
from tidemark.session import durable, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


NOW_SEC = f"(epoch_us(TIMESTAMP '{S.NOW}') // 1000000)"
SYMBOL_OF_USER = "list_value('click', 'error', 'purchase', 'signup', 'view')[user_id % 5 + 1]"
DEALS = f"""deals AS (
  SELECT event_id AS ticket, user_id AS position_id, {SYMBOL_OF_USER} AS symbol,
    CASE WHEN event_type = 'signup' THEN 2 ELSE event_id % 2 END AS type,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS entry,
    (event_id % 5 + 1) / 100::DOUBLE AS volume, value AS price,
    CASE WHEN event_type IN ('purchase', 'error') THEN value - 50::DOUBLE ELSE 0::DOUBLE END AS profit,
    epoch_us(ts) / 1e6::DOUBLE AS time, (event_id % 3) * -0.01::DOUBLE AS swap, -0.1::DOUBLE AS commission
  FROM events)"""
# a real queue per position, one deal at a time
TRADES = DEALS + """,
f AS (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY time, ticket) AS rn FROM deals WHERE type IN (0, 1)),
q AS (
  SELECT position_id, rn, CASE WHEN entry = 0 THEN [ticket] ELSE CAST([] AS BIGINT[]) END AS queue, CAST(NULL AS BIGINT) AS matched
  FROM f WHERE rn = 1
  UNION ALL
  SELECT f.position_id, f.rn, CASE WHEN f.entry = 0 THEN list_append(q.queue, f.ticket) ELSE q.queue[2:] END,
    CASE WHEN f.entry <> 0 AND len(q.queue) > 0 THEN q.queue[1] END
  FROM q JOIN f ON f.position_id = q.position_id AND f.rn = q.rn + 1),
trades AS (
  SELECT o.position_id, o.ticket, o.symbol,
    CASE WHEN i.ticket IS NOT NULL THEN CASE WHEN i.type = 0 THEN 'BUY' ELSE 'SELL' END
         WHEN o.type = 0 THEN 'SELL' ELSE 'BUY' END AS type,
    o.volume, coalesce(i.time, o.time) AS entry_time, o.time AS exit_time, coalesce(i.price, o.price) AS entry_price,
    o.price AS exit_price, o.profit, o.swap, o.commission, i.ticket IS NULL AS is_orphan,
    o.profit + o.swap + o.commission AS pnl
  FROM f o JOIN q USING (position_id, rn) LEFT JOIN deals i ON i.ticket = q.matched WHERE o.entry <> 0)"""
RANGED = TRADES + f""",
rng(range_label, days) AS (VALUES {", ".join(f"('{lbl}', {'NULL' if d is None else d})" for lbl, d in HISTORY_RANGES)}),
ranged AS (SELECT t.*, range_label FROM trades t JOIN rng ON days IS NULL OR exit_time >= {NOW_SEC} - days * 86400)"""
CURVE = RANGED + """,
eq AS (SELECT *, sum(pnl) OVER (PARTITION BY range_label ORDER BY exit_time, ticket) AS equity FROM ranged),
curve AS (SELECT *, max(equity) OVER (PARTITION BY range_label ORDER BY exit_time, ticket) AS peak FROM eq)"""
JOURNAL = f"""jl AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, user_id AS ticket, value,
    CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k
  FROM events WHERE event_type IN ('click', 'view')),
jn AS (
  SELECT *, value - (5 + k % 7) AS sl, value + k % 11 AS tp FROM jl
  QUALIFY row_number() OVER (PARTITION BY ticket ORDER BY ts DESC, seq DESC) = 1)"""
ENRICHED = TRADES + "," + JOURNAL + f""",
enr AS (
  SELECT t.*, sl, tp, k, k IS NOT NULL AND k % 5 <> 0 AS has_env,
    (CASE WHEN type = 'BUY' THEN exit_price - entry_price ELSE entry_price - exit_price END) / 0.1::DOUBLE AS pips,
    abs(entry_price - sl) / 0.1::DOUBLE AS risk
  FROM trades t LEFT JOIN jn j ON j.ticket = t.position_id),
enriched AS (SELECT *, CASE WHEN risk > 0 THEN pips / risk END AS r_multiple FROM enr)"""


def _trades(spark, sf_dir):
    return T.pair_deals(S.deals(spark, sf_dir))


def _blocked(spark, sf_dir):
    """Closed trades with their order blocks, of the columns that range statistics need; they feed several passes and are written once."""
    trades = T.pair_deals(S.deals(spark, sf_dir), keep_blocks=True)
    return written(trades.select("ticket", "symbol", "exit_time", "pnl", BLOCK), "trades"), F.unix_seconds(S.now()).cast("double")


def _ranged(spark, sf_dir):
    return PF.in_ranges(*_blocked(spark, sf_dir))


@query("deals_in_window", f"""WITH {DEALS} SELECT ticket, position_id, {R("time", "time", 3)} FROM deals
WHERE time >= {NOW_SEC} - 10 * 86400 AND time < {NOW_SEC}""")
def deals_in_window(spark, sf_dir):
    """Deal history scan: lower bound inclusive, upper exclusive."""
    d = S.deals(spark, sf_dir, "2024-01-20 12:00:00", S.NOW)
    return rounded(d.select("ticket", "position_id", "time"), 3)


@query("closed_trades_fifo", f"""WITH RECURSIVE {TRADES} SELECT position_id, ticket, symbol, type, {R("volume", "volume")},
  {R("entry_time", "entry_time", 3)}, {R("exit_time", "exit_time", 3)}, {R("entry_price", "entry_price")}, {R("exit_price", "exit_price")},
  {R("profit", "profit")}, {R("swap", "swap")}, {R("commission", "commission")}, is_orphan, {R("pnl", "pnl")} FROM trades""")
def closed_trades_fifo(spark, sf_dir):
    t = _trades(spark, sf_dir)
    return rounded(t.withColumn("entry_time", F.round("entry_time", 3)).withColumn("exit_time", F.round("exit_time", 3)))


@query("trade_range_summary", f"""WITH RECURSIVE {RANGED},
s AS (SELECT range_label, count(pnl) AS trade_count, count(*) FILTER (WHERE pnl > 0) AS win_count,
        count(*) FILTER (WHERE pnl < 0) AS loss_count, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gp,
        coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl
      FROM rng LEFT JOIN ranged USING (range_label) GROUP BY range_label)
SELECT range_label, trade_count, win_count, loss_count, {R("gp", "gross_profit")}, {R("gl", "gross_loss")},
  {R("CASE WHEN trade_count = 0 THEN 0 ELSE win_count / trade_count END", "win_rate")},
  {R("CASE WHEN gl < 0 THEN gp / abs(gl) END", "profit_factor")},
  {R("CASE WHEN win_count = 0 THEN 0 ELSE gp / win_count END", "avg_win")},
  {R("CASE WHEN loss_count = 0 THEN 0 ELSE gl / loss_count END", "avg_loss")},
  {R("CASE WHEN loss_count > 0 THEN (CASE WHEN win_count = 0 THEN 0 ELSE gp / win_count END) / abs(gl / loss_count) END", "risk_reward")},
  {R("gp + gl", "net_profit")} FROM s""")
def trade_range_summary(spark, sf_dir):
    return rounded(PF.range_summary(_ranged(spark, sf_dir)))


@query("range_label_days", f"""SELECT ticket, label, coalesce(days, {DEFAULT_RANGE_DAYS}) AS days FROM (
  SELECT event_id AS ticket, list_value({", ".join(f"'{x}'" for x in (*[lbl for lbl, _ in HISTORY_RANGES], "2d", ""))}, NULL)[event_id % {len(HISTORY_RANGES) + 3} + 1] AS label FROM events)
LEFT JOIN (VALUES {", ".join(f"('{lbl}', {'NULL' if d is None else d})" for lbl, d in HISTORY_RANGES)}) r(label, days) USING (label)""")
def range_label_days(spark, sf_dir):
    """Days of known, unknown, empty and missing range labels."""
    labels = F.array(*[F.lit(x) for x in (*[lbl for lbl, _ in HISTORY_RANGES], "2d", "", None)])
    e = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("ticket"), F.get(labels, (F.col("event_id") % (len(HISTORY_RANGES) + 3)).cast("int")).alias("label"))
    return e.select("ticket", "label", PF.range_days(F.col("label")).alias("days"))


@query("trade_range_slices", f"""WITH RECURSIVE {RANGED},
h AS (SELECT *, (CAST(floor(exit_time) AS BIGINT) // 3600 + 9) % 24 AS hj FROM ranged)
SELECT range_label, CASE WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(hj) = 0 THEN 'hour_jst' ELSE 'range' END AS slice,
  symbol, CAST(hj AS INTEGER) AS hour_jst, count(*) AS trade_count, count(*) FILTER (WHERE pnl > 0) AS win_count,
  {R("coalesce(sum(pnl), 0)", "net_profit")}, {R("count(*) FILTER (WHERE pnl > 0) / count(*)", "win_rate")}
FROM h GROUP BY GROUPING SETS ((range_label), (range_label, symbol), (range_label, hj))""")
def trade_range_slices(spark, sf_dir):
    return rounded(PF.range_slices(_ranged(spark, sf_dir)))


@query("equity_curve_by_range", f"""WITH RECURSIVE {CURVE} SELECT range_label, ticket, {R("equity", "equity")}, {R("peak", "peak")},
  {R("greatest(0, peak)", "floor_peak")}, {R("equity - peak", "underwater")} FROM curve""")
def equity_curve_by_range(spark, sf_dir):
    c = N.nested_curve(*_blocked(spark, sf_dir))
    return rounded(c.select("range_label", "ticket", "equity", "peak", "floor_peak", "underwater"))


@query("range_drawdown", f"""WITH RECURSIVE {CURVE},
dd AS (SELECT *, greatest(0, peak) - equity AS dd FROM curve)
SELECT range_label, {R("max(dd)", "max_drawdown_abs")},
  {R("first(CASE WHEN peak > 0 THEN dd / peak * 100 ELSE 0 END ORDER BY dd DESC, exit_time, ticket)", "max_drawdown_pct")}
FROM dd GROUP BY range_label""")
def range_drawdown(spark, sf_dir):
    return rounded(N.nested_drawdown(*_blocked(spark, sf_dir)))


@query("win_loss_streaks", f"""WITH RECURSIVE {RANGED},
o AS (SELECT range_label, sign(pnl) AS s, row_number() OVER (PARTITION BY range_label ORDER BY exit_time, ticket) AS rn,
        row_number() OVER (PARTITION BY range_label, sign(pnl) ORDER BY exit_time, ticket) AS rs FROM ranged),
isl AS (SELECT range_label, s, rn - rs AS grp, count(*) AS len, max(rn) AS last_rn FROM o GROUP BY ALL)
SELECT range_label, coalesce(max(len) FILTER (WHERE s > 0), 0) AS max_win_streak,
  coalesce(max(len) FILTER (WHERE s < 0), 0) AS max_loss_streak,
  CAST(arg_max(len * s, last_rn) AS BIGINT) AS current_streak FROM isl GROUP BY range_label""")
def win_loss_streaks(spark, sf_dir):
    return N.nested_streaks(*_blocked(spark, sf_dir))


@query("risk_adjusted_ratios", f"""WITH RECURSIVE {CURVE},
a AS (SELECT range_label, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS sd, stddev_samp(pnl) FILTER (WHERE pnl < 0) AS ds,
        sum(pnl) AS net, max(peak - equity) AS mdd, avg(CASE WHEN equity < peak THEN 1 ELSE 0 END) AS uw,
        sqrt(avg(power(CASE WHEN peak > 0 THEN (peak - equity) / peak * 100 ELSE 0 END, 2))) AS ulcer
      FROM curve GROUP BY range_label)
SELECT range_label, {R("CASE WHEN sd > 0 THEN m / sd * sqrt(n) END", "sharpe")}, {R("CASE WHEN ds > 0 THEN m / ds * sqrt(n) END", "sortino")},
  {R("CASE WHEN mdd > 0 THEN net / mdd END", "calmar")}, {R("CASE WHEN mdd > 0 THEN net / mdd END", "recovery_factor")},
  {R("ulcer", "ulcer_index", 4)}, {R("mdd", "max_drawdown_abs")}, {R("uw", "underwater_pct")} FROM a""")
def risk_adjusted_ratios(spark, sf_dir):
    r = N.nested_ratios(*_blocked(spark, sf_dir))
    return rounded(r.withColumn("ulcer_index", F.round("ulcer_index", 4)))


@query("value_at_risk", f"""WITH RECURSIVE {RANGED},
v AS (SELECT range_label, quantile_cont(pnl, 0.05) AS var FROM ranged GROUP BY range_label)
SELECT range_label, {R("first(var)", "var_95")}, {R("avg(pnl) FILTER (WHERE pnl <= var)", "cvar_95")}
FROM ranged JOIN v USING (range_label) GROUP BY range_label""")
def value_at_risk(spark, sf_dir):
    return rounded(N.nested_value_at_risk(*_blocked(spark, sf_dir)))


@query("latest_journal_per_ticket", f"""WITH {JOURNAL} SELECT ticket, seq, ts, {R("sl", "sl")}, {R("tp", "tp")} FROM jn""")
def latest_journal_per_ticket(spark, sf_dir):
    return rounded(T.latest_journal(S.journal(spark, sf_dir)).select("ticket", "seq", "ts", "sl", "tp"))


@query("trades_with_journal", f"""WITH RECURSIVE {ENRICHED} SELECT position_id, ticket, {R("sl", "sl")}, {R("tp", "tp")}, {R("pips", "pips")},
  {R("r_multiple", "r_multiple")}, CASE WHEN k IS NULL THEN 0 ELSE 2 END AS n_ctx, CASE WHEN has_env THEN 3 ELSE 0 END AS n_env,
  {R("CASE WHEN k IS NOT NULL THEN 20.25::DOUBLE + (k * 7) % 60 END", "m15_rsi")} FROM enriched""")
def trades_with_journal(spark, sf_dir):
    e = T.enrich(_trades(spark, sf_dir), S.journal(spark, sf_dir))
    return rounded(e.select("position_id", "ticket", "sl", "tp", "pips", "r_multiple", F.size("ctx").alias("n_ctx"),
                            F.size("env").alias("n_env"), F.try_element_at("ctx", F.lit("M15"))["rsi"].alias("m15_rsi")))


@query("trade_excursions", f"""WITH RECURSIVE {TRADES}, {TICKS},
m1 AS (SELECT symbol, (epoch_us(ts) // 1000000) // 60 * 60 AS t, max(price) AS high, min(price) AS low FROM ticks GROUP BY ALL),
x AS (SELECT tr.ticket, tr.type, tr.entry_price, max(high) AS hi, min(low) AS lo FROM trades tr
  LEFT JOIN m1 ON m1.symbol = tr.symbol AND m1.t BETWEEN tr.entry_time AND tr.exit_time GROUP BY ALL)
SELECT ticket, {R("CASE WHEN type = 'BUY' THEN lo - entry_price ELSE entry_price - hi END / 0.1::DOUBLE", "mae_pips")},
  {R("CASE WHEN type = 'BUY' THEN hi - entry_price ELSE entry_price - lo END / 0.1::DOUBLE", "mfe_pips")} FROM x""")
def trade_excursions(spark, sf_dir):
    minute = ticks_to_bars(S.ticks(spark, sf_dir), "M1")
    # read twice: for the runs they were held and for the result
    return rounded(T.excursions(durable(_trades(spark, sf_dir)), minute).select("ticket", "mae_pips", "mfe_pips"))


@query("r_multiple_distribution", f"""WITH RECURSIVE {ENRICHED}
SELECT CASE WHEN r_multiple < -3 THEN '<-3' WHEN r_multiple < -2 THEN '-3~-2' WHEN r_multiple < -1 THEN '-2~-1' WHEN r_multiple < 0 THEN '-1~0'
  WHEN r_multiple < 1 THEN '0~1' WHEN r_multiple < 2 THEN '1~2' WHEN r_multiple < 3 THEN '2~3' WHEN r_multiple < 4 THEN '3~4' ELSE '>=4' END AS bin,
  count(*) AS n FROM enriched WHERE r_multiple IS NOT NULL GROUP BY 1""")
def r_multiple_distribution(spark, sf_dir):
    return PF.r_distribution(T.enrich(_trades(spark, sf_dir), S.journal(spark, sf_dir)), keys=())


@query("edge_breakdown", f"""WITH RECURSIVE {ENRICHED},
tfx AS (
  SELECT pnl, 'M15' AS tf, k % 2 = 0 AS ae, (k % 30 + 10.5)::DOUBLE AS adx, ((k * 7) % 60 + 20.25)::DOUBLE AS rsi FROM enriched WHERE k IS NOT NULL
  UNION ALL
  SELECT pnl, 'H1', k % 3 = 0, CASE WHEN k % 4 <> 0 THEN ((k * 3) % 30 + 12.5)::DOUBLE END, ((k * 11) % 60 + 20.75)::DOUBLE FROM enriched WHERE k IS NOT NULL),
lng AS (
  SELECT 'alignment' AS dimension, tf || CASE WHEN ae THEN '_above' ELSE '_below' END AS bucket, pnl FROM tfx
  UNION ALL SELECT 'adx', CASE WHEN adx < 20 THEN '<20' WHEN adx < 25 THEN '20~25' WHEN adx < 30 THEN '25~30' ELSE '>=30' END, pnl FROM tfx WHERE adx IS NOT NULL
  UNION ALL SELECT 'rsi', CASE WHEN rsi < 30 THEN '<30' WHEN rsi < 50 THEN '30~50' WHEN rsi < 70 THEN '50~70' ELSE '>=70' END, pnl FROM tfx
  UNION ALL SELECT 'weekday_jst', list_value('月', '火', '水', '木', '金', '土', '日')[isodow(make_timestamp(CAST(floor((entry_time + 32400) * 1e6) AS BIGINT)))], pnl FROM enriched
  UNION ALL SELECT 'hold_min', CASE WHEN h < 15 THEN '<15' WHEN h < 60 THEN '15~60' WHEN h < 240 THEN '60~240' ELSE '>=240' END, pnl
    FROM (SELECT pnl, greatest(0, (exit_time - entry_time) / 60) AS h FROM enriched)
  UNION ALL SELECT 'dxy', CASE WHEN k % 21 - 10 >= 0 THEN 'up' ELSE 'down' END, pnl FROM enriched WHERE has_env
  UNION ALL SELECT 'cot_extreme', CASE WHEN k % 100 + 0.5 < 10 THEN 'low' WHEN k % 100 + 0.5 > 90 THEN 'high' ELSE 'mid' END, pnl FROM enriched WHERE has_env
  UNION ALL SELECT 'real_yield', CASE WHEN k % 11 - 5 >= 0 THEN 'up' ELSE 'down' END, pnl FROM enriched WHERE has_env)
SELECT dimension, bucket, count(*) AS n, {R("count(*) FILTER (WHERE pnl > 0) / count(*)", "win_rate")},
  {R("CASE WHEN count(*) FILTER (WHERE pnl < 0) > 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)) END", "pf")}
FROM lng GROUP BY ALL""")
def edge_breakdown(spark, sf_dir):
    return rounded(PF.edge_stats(T.enrich(_trades(spark, sf_dir), S.journal(spark, sf_dir))))


OPEN = DEALS + "," + TICKS + """,
quote AS (SELECT symbol, last(price ORDER BY ts, seq) AS px FROM ticks GROUP BY symbol),
opn AS (SELECT ticket, d.symbol, CASE WHEN type = 0 THEN 'BUY' ELSE 'SELL' END AS type, volume, d.price AS price_open, px AS price_current,
  CASE WHEN ticket % 3 = 0 THEN 0::DOUBLE ELSE d.price - 4 END AS sl, px - d.price AS profit, swap, time
  FROM deals d JOIN quote USING (symbol) WHERE entry = 0 AND type IN (0, 1))"""


@query("today_profit_and_loss", f"""WITH RECURSIVE {TRADES}, {OPEN.replace(DEALS + ",", "")}
SELECT {R("a", "today_realised_pnl", 4)}, {R("b", "today_floating_pnl", 4)}, c AS open_trade_count, {R("a + b", "today_total_pnl", 4)} FROM
 (SELECT coalesce(sum(pnl), 0) AS a FROM trades WHERE exit_time >= epoch_us(date_trunc('day', TIMESTAMP '{S.NOW}')) // 1000000),
 (SELECT coalesce(sum(profit + swap), 0) AS b, count(*) AS c FROM opn)""")
def today_profit_and_loss(spark, sf_dir):
    return rounded(PF.today_pnl(_trades(spark, sf_dir), S.open_positions(spark, sf_dir), S.now()), 4)


@query("trades_newest_first", f"""WITH RECURSIVE {TRADES} SELECT ticket, {R("exit_time", "exit_time", 3)}, {R("pnl", "pnl")} FROM trades""")
def trades_newest_first(spark, sf_dir):
    return rounded(T.trades_newest_first(_trades(spark, sf_dir)).select("ticket", F.round("exit_time", 3).alias("exit_time"), "pnl"))
