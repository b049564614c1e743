"""Oscillator, band, signal and as-of context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.dims import OSC_MODES, TF_SECONDS
from tidemark.functions.guards import one_decimal
from tidemark.operators import indicators as I
from tidemark.operators import oscillator as O
from tidemark.operators import setups as U
from tidemark.operators.ordering import asof_join
from tidemark.plans import standins as S
from tidemark.plans.market import BARS, SERIES, TABLE, R, recursive_indicators, rounded
from tidemark.session import durable
from tidemark.sources import documents as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _stack(source: str, periods, name: str = "st") -> str:
    f, m, c = (f"(2::DOUBLE / {p + 1})" for p in periods)
    return f"""{name} AS (
  SELECT symbol, tf, t, i, n, "close", "close" AS ef, "close" AS em, "close" AS ec FROM {source} WHERE i = 0
  UNION ALL
  SELECT s.symbol, s.tf, s.t, s.i, s.n, s."close", r.ef + {f} * (s."close" - r.ef), r.em + {m} * (s."close" - r.em), r.ec + {c} * (s."close" - r.ec)
  FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.tf = r.tf AND s.i = r.i + 1)"""


def _osc(mode: str, deep: bool = False) -> str:
    tf, periods, fetch, show, dfetch, dshow = OSC_MODES[mode]
    fetch, show = (dfetch, dshow) if deep else (fetch, show)
    return f"""{BARS},
rec0 AS (SELECT * FROM bars WHERE tf = '{tf}' QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY t DESC) <= {fetch}),
os AS (SELECT symbol, tf, t, "close", row_number() OVER (PARTITION BY symbol, tf ORDER BY t) - 1 AS i,
         count(*) OVER (PARTITION BY symbol, tf) AS n FROM rec0),
{_stack("os", periods)},
osc AS (SELECT symbol, '{mode}' AS mode, t, "close" AS price, ef, em, ec, ("close" - ec) / ec * 100 AS dp, (ef - ec) / ec * 100 AS df,
          (em - ec) / ec * 100 AS dm
        FROM st WHERE i < n - 1 AND n - 1 >= {periods[2]} AND i >= n - 1 - {show})"""


def _bands(mode: str) -> str:
    tf, periods, *_ = OSC_MODES[mode]
    p = periods
    return f"""bs AS (SELECT symbol, tf, t, "close", row_number() OVER (PARTITION BY symbol, tf ORDER BY t) - 1 AS i, 0 AS n FROM bars WHERE tf = '{tf}'),
{_stack("bs", periods, "bst")},
dis AS (
  SELECT {p[0]} AS period, ("close" - ef) / ef * 100 AS d FROM bst WHERE i >= {max(p)}
  UNION ALL SELECT {p[1]}, ("close" - em) / em * 100 FROM bst WHERE i >= {max(p)}
  UNION ALL SELECT {p[2]}, ("close" - ec) / ec * 100 FROM bst WHERE i >= {max(p)}),
sided AS (SELECT period, CASE WHEN d > 0 THEN 'pos' ELSE 'neg' END AS side, abs(d) AS a FROM dis WHERE d <> 0),
bnd AS (SELECT '{mode}' AS mode, e.period, e.side, coalesce(quantile_cont(a, 0.9), 0) AS p90, coalesce(quantile_cont(a, 0.95), 0) AS p95,
          coalesce(quantile_cont(a, 0.99), 0) AS p99, coalesce(max(a), 0) AS mx, count(a) AS n
        FROM (SELECT * FROM (VALUES ({p[0]}), ({p[1]}), ({p[2]})) v(period), (VALUES ('pos'), ('neg')) w(side)) e
        LEFT JOIN sided USING (period, side) GROUP BY ALL)"""


OSC_OUT = ", ".join(R(a, b) for a, b in (("price", "price"), ("ef", "ema_fast"), ("em", "ema_mid"), ("ec", "ema_center"),
                                        ("dp", "dev_price"), ("df", "dev_fast"), ("dm", "dev_mid")))


@query("oscillator_m15", f"WITH RECURSIVE {_osc('M15')} SELECT symbol, mode, t AS bar_time, {OSC_OUT} FROM osc")
def oscillator_m15(spark, sf_dir):
    return rounded(O.oscillator(S.bars(spark, sf_dir, "M15"), "M15"))


@query("oscillator_h1_deep", f"WITH RECURSIVE {_osc('H1', True)} SELECT symbol, mode, t AS bar_time, {OSC_OUT} FROM osc")
def oscillator_h1_deep(spark, sf_dir):
    return rounded(O.oscillator(S.bars(spark, sf_dir, "H1"), "H1", deep=True))


@query("oscillator_snapshot_with_placeholders", f"""WITH RECURSIVE {_osc('H1')},
snap AS (SELECT symbol, max(t) AS t, count(*) AS nd, arg_max(price, t) AS price, arg_max(ef, t) AS ef, arg_max(em, t) AS em, arg_max(ec, t) AS ec FROM osc GROUP BY symbol)
SELECT e.symbol, {R("price", "price")}, {R("ef", "ema_fast")}, {R("em", "ema_mid")}, {R("ec", "ema_center")}, t AS bar_time, nd AS n_display, t IS NULL AS stale
FROM (SELECT DISTINCT symbol FROM bars UNION ALL SELECT upper(r_name) FROM region) e LEFT JOIN snap USING (symbol)""")
def oscillator_snapshot_with_placeholders(spark, sf_dir):
    """Expected symbols include names that never trade, which stay visible as stale rows."""
    bars = S.stored_bars(spark, sf_dir, "H1")
    snap = O.oscillator_snapshot(O.oscillator(bars, "H1")).drop("mode")
    expected = bars.select("symbol").distinct().unionByName(
        S.table(spark, sf_dir, "region").select(F.upper("r_name").alias("symbol")))
    return rounded(O.with_placeholders(expected, snap, ["symbol"]))


def _band_query(mode):
    tf, periods, *_ = OSC_MODES[mode]

    @query(f"disparity_bands_{mode.lower()}", f"""WITH RECURSIVE {BARS}, {_bands(mode)}
SELECT mode, period, side, {R("p90", "p90")}, {R("p95", "p95")}, {R("p99", "p99")}, {R("mx", "max")}, n FROM bnd""")
    def run(spark, sf_dir):
        return rounded(O.disparity_bands(S.bars(spark, sf_dir, tf), mode, periods))
    return run


for _m in OSC_MODES:
    _band_query(_m)

_P = OSC_MODES["M15"][1]


def _tier(v: str, period: int) -> str:
    def edge(p):
        return (f"(SELECT {p} FROM bnd WHERE period = {period} AND side = CASE WHEN {v} >= 0 THEN 'pos' ELSE 'neg' END)")
    return (f"CASE WHEN {edge('p99')} > 0 AND abs({v}) >= {edge('p99')} THEN 'x' "
            f"WHEN {edge('p95')} > 0 AND abs({v}) >= {edge('p95')} THEN 'warn' ELSE '' END")


@query("overextension_tiers", f"""WITH RECURSIVE {_osc('M15')}, {_bands('M15')},
k AS (SELECT symbol, t, ((1 + dp / 100) / (1 + df / 100) - 1) * 100 AS d0, ((1 + dp / 100) / (1 + dm / 100) - 1) * 100 AS d1, dp AS d2 FROM osc)
SELECT symbol, t AS bar_time, {R("d0", "dist0")}, {R("d1", "dist1")}, {R("d2", "dist2")},
  {_tier("d0", _P[0])} AS tier0, {_tier("d1", _P[1])} AS tier1, {_tier("d2", _P[2])} AS tier2 FROM k""")
def overextension_tiers(spark, sf_dir):
    bars = S.stored_bars(spark, sf_dir, "M15")
    rows = O.oscillator(bars, "M15").select("symbol", "mode", "bar_time", "dev_price", "dev_fast", "dev_mid")
    tiers = O.with_extension_tiers(rows, O.disparity_bands(bars, "M15", _P, stored=True), _P)
    return rounded(tiers.drop("mode", "dev_price", "dev_fast", "dev_mid"))


@query("index_card", f"""WITH RECURSIVE {BARS},
rec0 AS (SELECT * FROM bars WHERE tf = 'H1' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 120),
os AS (SELECT symbol, tf, t, "close", row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rec0),
{_stack("os", (20, 20, 20))},
c AS (SELECT *, lag("close") OVER (PARTITION BY symbol ORDER BY t) AS pc FROM st WHERE i < n - 1)
SELECT symbol, {R('arg_max("close", t)', "price")}, {R('arg_max(pc, t)', "prev_close")}, {R('arg_max("close" - pc, t)', "change")},
  {R('arg_max(("close" - pc) / pc * 100, t)', "change_pct")}, {R("arg_max(ef, t)", "ema")}, arg_max("close" > ef, t) AS above_ema,
  count(*) FILTER (WHERE i >= n - 1 - 60) AS n_closes, {R('min("close") FILTER (WHERE i >= n - 1 - 60)', "low")},
  CASE WHEN arg_max("close" - pc, t) > 0 THEN -1 WHEN arg_max("close" - pc, t) < 0 THEN 1 ELSE 0 END AS gold_impact
FROM c GROUP BY symbol""")
def index_card(spark, sf_dir):
    from tidemark.functions.signal import gold_impact
    card = O.index_card(S.bars(spark, sf_dir, "H1"))
    return rounded(card.select("symbol", "price", "prev_close", "change", "change_pct", "ema", "above_ema",
                               F.size("closes").cast("bigint").alias("n_closes"), F.array_min("closes").alias("low"),
                               gold_impact(F.col("change")).alias("gold_impact")))


@query("sparkline_scaling", f"""WITH {BARS},
x AS (SELECT symbol, t, "close" FROM bars WHERE tf = 'H4' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 60),
m AS (SELECT symbol, min("close") AS lo, max("close") AS hi FROM x GROUP BY symbol)
SELECT symbol, t AS bar_time, {R('("close" - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)', "scaled")} FROM x JOIN m USING (symbol)""")
def sparkline_scaling(spark, sf_dir):
    from tidemark.functions.price import min_max_scaled
    from tidemark.operators.bars import last_bars
    tail = last_bars(S.bars(spark, sf_dir, "H4"), 60)
    ends = tail.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    return rounded(tail.join(ends, "symbol").select(
        "symbol", "bar_time", min_max_scaled(F.col("close"), F.col("lo"), F.col("hi")).alias("scaled")))


SIGNAL = """sig AS (
  SELECT *, CASE WHEN rsi IS NULL OR adx IS NULL THEN NULL WHEN coalesce(above, false) AND adx >= 25 AND di_plus > di_minus AND rsi >= 55 THEN 2
    WHEN NOT coalesce(above, false) AND adx >= 25 AND di_minus > di_plus AND rsi <= 45 THEN -2 WHEN coalesce(above, false) AND rsi >= 50 THEN 1
    WHEN NOT coalesce(above, false) AND rsi <= 50 THEN -1 ELSE 0 END AS code0,
    greatest(0, least(1, (adx - 15) / 10)) AS tf_factor
  FROM (SELECT *, last_close > ema AS above FROM tab)),
comp AS (
  SELECT symbol, coalesce(sum(code0 * wt * tf_factor), 0) AS raw, coalesce(sum(code0 * wt * tf_factor) / (2 * sum(wt) FILTER (WHERE code0 IS NOT NULL)) * 10, 0) AS score,
    count(code0) AS live FROM sig JOIN tfs USING (tf) GROUP BY symbol),
cls AS (SELECT *, CASE WHEN live = 0 THEN 'na' WHEN score >= 7 THEN 'strong-buy' WHEN score >= 3 THEN 'buy' WHEN score > -3 THEN 'neutral'
    WHEN score > -7 THEN 'sell' ELSE 'strong-sell' END AS cls FROM comp)"""


@query("timeframe_signals", f"""WITH RECURSIVE {TABLE}, {SIGNAL}
SELECT symbol, tf, coalesce(code0, 0) AS code, CASE code0 WHEN 2 THEN 'STRONG BUY' WHEN 1 THEN 'BUY' WHEN 0 THEN 'NEUTRAL' WHEN -1 THEN 'SELL'
  WHEN -2 THEN 'STRONG SELL' ELSE 'n/a' END AS label, {R("CASE WHEN adx IS NULL THEN 0 ELSE tf_factor END", "trend_factor")},
  {R("(last_close - ema) / ema * 100", "ema_dist_pct")},
  CASE WHEN last_close > ema THEN 'pos' WHEN ema IS NOT NULL THEN 'neg' ELSE 'na' END AS ema_zone,
  CASE WHEN adx IS NULL THEN 'na' WHEN adx >= 25 THEN 'strong' ELSE '' END AS adx_zone,
  CASE WHEN di_plus - di_minus IS NULL THEN 'na' WHEN di_plus - di_minus >= 5 THEN 'pos' WHEN di_plus - di_minus <= -5 THEN 'neg' ELSE '' END AS di_zone,
  CASE WHEN rsi IS NULL THEN 'na' WHEN rsi >= 70 THEN 'warn-high' WHEN rsi <= 30 THEN 'warn-low' ELSE '' END AS rsi_zone FROM sig""")
def timeframe_signals(spark, sf_dir):
    t = U.signal_table(I.indicator_table(S.bars(spark, sf_dir)))
    return rounded(t.select("symbol", "tf", "code", "label", "trend_factor", "ema_dist_pct", "ema_zone", "adx_zone", "di_zone", "rsi_zone"))


COMPOSITE_OUT = f"""symbol, {R("score", "score")}, {R("raw", "raw")}, CASE WHEN cls = 'na' THEN 'NO DATA' ELSE upper(replace(cls, '-', ' ')) END AS label, cls,
  CASE WHEN cls IN ('strong-buy', 'strong-sell') THEN 'touch' WHEN cls IN ('buy', 'sell') THEN 'active' ELSE 'quiet' END AS activity"""


@query("composite_signal", f"WITH RECURSIVE {TABLE}, {SIGNAL} SELECT {COMPOSITE_OUT} FROM cls")
def composite_signal(spark, sf_dir):
    return rounded(U.composite_scores(I.indicator_table(S.bars(spark, sf_dir))))


LOUD = "loud AS (SELECT * REPLACE (adx * 3 AS adx, 50 + (rsi - 50) * 4 AS rsi) FROM tab), "


@query("active_setups", f"""WITH RECURSIVE {TABLE}, {LOUD}{SIGNAL.replace("FROM tab", "FROM loud")} SELECT {COMPOSITE_OUT} FROM cls
WHERE cls NOT IN ('na', 'neutral') AND abs(score) >= 5 ORDER BY abs(score) DESC, symbol LIMIT 8""")
def active_setups(spark, sf_dir):
    """Top eight setups over the conviction floor; the stand-in's noise is amplified so that some reach it."""
    loud = I.indicator_table(S.bars(spark, sf_dir)).withColumns({"adx": F.col("adx") * 3, "rsi": (F.col("rsi") - 50.0) * 4 + 50.0})
    return rounded(U.top_setups(U.high_conviction(U.composite_scores(loud))))


@query("new_setups_since_yesterday", f"""WITH RECURSIVE {TABLE}, {SIGNAL},
prev AS (SELECT event_type AS symbol, CASE WHEN count(*) % 2 = 0 THEN 'neutral' ELSE 'sell' END AS cls FROM events GROUP BY 1)
SELECT symbol, cls, {R("score", "score")} FROM cls WHERE NOT EXISTS (SELECT 1 FROM prev WHERE prev.symbol = cls.symbol AND prev.cls = cls.cls)""")
def new_setups_since_yesterday(spark, sf_dir):
    now = U.composite_scores(I.indicator_table(S.bars(spark, sf_dir)))
    before = S.ticks(spark, sf_dir).groupBy("symbol").agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "neutral").otherwise("sell").alias("cls"))
    return rounded(U.new_setups(now, before).select("symbol", "cls", "score"))


@query("indicator_map_per_symbol", f"""WITH RECURSIVE {TABLE} SELECT symbol, count(*) AS n_tf,
  {R("max(rsi) FILTER (WHERE tf = 'H1')", "h1_rsi")}, {R("max(ema) FILTER (WHERE tf = 'D1')", "d1_ema")}, upper(symbol) AS broker_name FROM tab GROUP BY symbol""")
def indicator_map_per_symbol(spark, sf_dir):
    folded = I.indicator_map(I.indicator_table(S.bars(spark, sf_dir)))
    names = S.ticks(spark, sf_dir).select("symbol").distinct().withColumn("broker_name", F.upper("symbol"))
    out = I.with_broker_names(folded, names)
    return rounded(out.select("symbol", F.size("by_tf").cast("bigint").alias("n_tf"), F.try_element_at("by_tf", F.lit("H1"))["rsi"].alias("h1_rsi"),
                              F.try_element_at("by_tf", F.lit("D1"))["ema"].alias("d1_ema"), "broker_name"))


@query("order_time_context", f"""WITH RECURSIVE {SERIES}, {recursive_indicators("mv")},
known AS (SELECT symbol, t + 3600 AS kt, "close" > ema AS ae, adx, rsi FROM ind WHERE tf = 'H1'),
ord AS (SELECT event_id AS ticket, event_type AS symbol, epoch_us(ts) / 1e6 AS at FROM events WHERE event_type IN ('click', 'view'))
SELECT o.ticket, o.symbol, k.kt AS known_at_asof, coalesce(k.ae, false) AS ae, {R("k.adx", "adx", 1)}, {R("k.rsi", "rsi", 1)}
FROM ord o ASOF LEFT JOIN known k ON o.symbol = k.symbol AND o.at >= k.kt""")
def order_time_context(spark, sf_dir):
    """What the hourly indicators said when each order was placed (bars count from their close on)."""
    orders = S.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select(
        F.col("event_id").alias("ticket"), F.col("event_type").alias("symbol"), F.col("ts").alias("at"))
    hist = I.indicator_history(S.bars(spark, sf_dir, "H1"))
    known = hist.select(
        "symbol", F.timestamp_seconds(F.unix_seconds("bar_time") + TF_SECONDS["H1"]).alias("known_at"),
        (F.col("close") > F.col("ema")).alias("ae"), "adx", "rsi")
    # indicator rows are few beside orders and are read more than once
    out = asof_join(orders, durable(known), ["symbol"], "at", "known_at", ["ae", "adx", "rsi"], tie="ticket")
    return rounded(out.select("ticket", "symbol", "known_at_asof", F.coalesce("ae", F.lit(False)).alias("ae"),
                              one_decimal(F.col("adx")).alias("adx"), one_decimal(F.col("rsi")).alias("rsi")), 1)


@query("live_yield_overlay", f"""WITH {BARS},
anchor AS (SELECT symbol, t + 86400 AS at, "close" AS value FROM bars WHERE tf = 'D1'),
ordq AS (SELECT symbol, epoch_us(ts) / 1e6 AS qt, price AS live, 50::DOUBLE AS prev FROM ticks)
SELECT a.symbol, a.at, {R("a.value", "value")}, {R("q.live", "nominal_10y")}, {R("coalesce(round(a.value + (q.live - q.prev), 3), a.value)", "live_value", 3)}, q.live IS NOT NULL AS is_live
FROM anchor a ASOF LEFT JOIN ordq q ON a.symbol = q.symbol AND a.at >= q.qt""")
def live_yield_overlay(spark, sf_dir):
    from tidemark.operators.macro import live_overlay
    anchors = S.bars(spark, sf_dir, "D1").select(
        "symbol", F.timestamp_seconds(F.unix_seconds("bar_time") + 86400).alias("at"), F.col("close").alias("value"))
    # the last arrival counts where a symbol has several quotes of one instant
    quotes = S.ticks(spark, sf_dir).groupBy("symbol", F.col("ts").alias("qt")).agg(F.max_by("price", "seq").alias("live"))
    nominal = quotes.withColumn("prev", F.lit(50.0))
    out = live_overlay(anchors, nominal, ["symbol"], "at", "qt")
    return rounded(out.select("symbol", "at", "value", "nominal_10y", "live_value", "is_live"))




@query("bands_document_round_trip", f"""WITH RECURSIVE {BARS}, {_bands('H1')}
SELECT mode, period, side, {R("p90", "p90")}, {R("p95", "p95")}, {R("p99", "p99")}, {R("mx", "max")}, n FROM bnd""")
def bands_document_round_trip(spark, sf_dir):
    """Bands written as the nested JSON document and read back as a table."""
    tf, periods, *_ = OSC_MODES["H1"]
    document = D.bands_document(O.disparity_bands(S.bars(spark, sf_dir, tf), "H1", periods), F.lit("2024-01-31"))
    return rounded(D.parse_bands(document, "value"))


@query("snapshot_domain_documents", f"""WITH RECURSIVE {TABLE}, {SIGNAL}
SELECT 'analysis' AS domain, symbol || '/' || tf AS key, CAST(t AS VARCHAR) AS as_of, rsi IS NULL AS has_null FROM tab
UNION ALL SELECT 'composite', symbol, cls, false FROM cls""")
def snapshot_domain_documents(spark, sf_dir):
    """The full snapshot as one JSON document per (domain, key): missing indicators are explicit nulls."""
    table = durable(I.indicator_table(S.bars(spark, sf_dir)))
    analysis = D.domain_documents(table.withColumn("key", F.concat_ws("/", "symbol", "tf")), "analysis", "key", table.columns)
    scores = U.composite_scores(table)
    composite = D.domain_documents(scores, "composite", "symbol", scores.columns)
    rows = analysis.unionByName(composite)
    stamp = F.unix_seconds(F.get_json_object("document", "$.bar_time").cast("timestamp")).cast("string")
    return rows.select("domain", "key", F.coalesce(stamp, F.get_json_object("document", "$.cls")).alias("as_of"),
                       F.contains("document", F.lit('"rsi":null')).alias("has_null"))
