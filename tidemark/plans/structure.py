"""Chart-line and structure-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import lines as L
from tidemark.operators import indicators as I
from tidemark.operators import structure as G
from tidemark.plans import standins as S
from tidemark.plans.market import BARS, SERIES, R, recursive_indicators, rounded
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


# ------------------------------------------------------------------------------------------------ chart lines
# one drawing per part: kind, anchors in January 2024, prices from the retail price
DRAWN = """dr AS (SELECT p_partkey AS k, list_value('click', 'error', 'purchase', 'signup', 'view')[p_partkey % 5 + 1] AS symbol,
  list_value('horizontal', 'trendline', 'rectangle', 'channel', 'fibonacci', 'text')[p_partkey % 6 + 1] AS kind,
  list_value('R1_strong_D1', 'S_weak_H4', 'TL_up_D1', 'TL_dn_major', 'zone_supply_H1', 'zone_demand', 'note')[p_partkey % 7 + 1] || '_' || p_partkey AS name,
  1704067200 + (p_partkey % 20) * 86400 + 3600 AS t1, 1704067200 + (p_partkey % 20) * 86400 + 3600 + (p_size % 9) * 43200 AS t2,
  p_retailprice / 20 AS p1, p_retailprice / 20 + p_size % 13 - 6 AS p2, p_retailprice / 25 AS p3, p_partkey % 4 = 0 AS ray FROM part)"""


def documents(spark, sf_dir):
    """Line documents: one per drawing, as the charting side exports them.

    The file is small beside what its rows become, so they are dealt to all tasks first.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = S.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition(tasks, "p_partkey")
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = S.pick(("horizontal", "trendline", "rectangle", "channel", "fibonacci", "text"), k)
    name = F.concat_ws("_", S.pick(("R1_strong_D1", "S_weak_H4", "TL_up_D1", "TL_dn_major", "zone_supply_H1", "zone_demand", "note"), k), k.cast("string"))
    base = F.lit(1704067200) + k % 20 * 86400 + 3600

    def iso(sec):
        return F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    t1, t2 = iso(base), iso(base + size % 9 * 43200)
    p1 = F.col("p_retailprice") / 20
    p2 = p1 + size % 13 - 6
    p3 = F.col("p_retailprice") / 25

    def point(t, v):
        return F.array(t, v.cast("string"))

    def only(kind_name, item):
        return F.when(kind == kind_name, F.array(item)).otherwise(F.array().cast(item_type(item)))

    def item_type(item):
        return f"array<{p.select(item.alias('i')).schema['i'].dataType.simpleString()}>"

    ray = k % 4 == 0
    levels = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(str(r)).alias("label")) for r in (0.0, 0.382, 0.5, 1.0)])
    horizontal = F.struct(name.alias("name"), p1.alias("price"), F.lit("#FF0000").alias("color"))
    trend = F.struct(name.alias("name"), point(t1, p1).alias("point1"), point(t2, p2).alias("point2"), ray.alias("ray_right"))
    rect = F.struct(name.alias("name"), t1.alias("time1"), t2.alias("time2"), F.least(p1, p2).alias("price_low"), F.greatest(p1, p2).alias("price_high"))
    channel = F.struct(name.alias("name"), point(t1, p1).alias("main_point1"), point(t2, p2).alias("main_point2"),
                       point(t1, p3).alias("parallel_anchor"), ray.alias("ray_right"))
    fibo = F.struct(name.alias("name"), point(t1, p1).alias("point1"), point(t2, p2).alias("point2"), levels.alias("levels"))
    text = F.struct(name.alias("name"), t1.alias("time"), p1.alias("price"), F.lit("seen").alias("text"))
    doc = F.struct(
        S.pick(S.SYMBOLS, k).alias("symbol"), F.lit("2024-01-30T00:00:00Z").alias("updated_at"),
        F.struct(only("horizontal", horizontal).alias("horizontal"), only("trendline", trend).alias("trendlines"),
                 only("rectangle", rect).alias("rectangles"), only("channel", channel).alias("channels"),
                 only("fibonacci", fibo).alias("fibonacci"), only("text", text).alias("texts")).alias("lines"))
    return p.select(F.from_json(F.to_json(doc), D.LINES_DOCUMENT).alias("d")).select("d.*")


@query("chart_line_objects", f"""WITH {DRAWN} SELECT symbol, kind, name, CASE WHEN kind <> 'horizontal' THEN t1 END AS t1,
  {R("CASE WHEN kind = 'rectangle' THEN least(p1, p2) ELSE p1 END", "p1")}, CASE WHEN kind NOT IN ('horizontal', 'text') THEN t2 END AS t2,
  {R("CASE WHEN kind = 'rectangle' THEN greatest(p1, p2) WHEN kind NOT IN ('horizontal', 'text') THEN p2 END", "p2")},
  ray AND kind IN ('trendline', 'channel') AS ray_right,
  list_value('resistance', 'support', 'trend_up', 'trend_down', 'supply', 'demand', 'other')[k % 7 + 1] AS category,
  list_value('strong', 'weak', NULL, 'major', NULL, NULL, NULL)[k % 7 + 1] AS weight, list_value('D1', 'H4', 'D1', NULL, 'H1', NULL, NULL)[k % 7 + 1] AS tf FROM dr""")
def chart_line_objects(spark, sf_dir):
    return line_objects(documents(spark, sf_dir))


def line_objects(docs):
    o = D.explode_lines(docs)
    n = F.col("name")
    return rounded(o.select("symbol", "kind", "name", "t1", "p1", "t2", "p2", "ray_right", L.name_category(n).alias("category"),
                            L.name_weight(n).alias("weight"), L.name_timeframe(n).alias("tf")))


@query("lines_at_bars", f"""WITH {BARS}, {DRAWN}, h AS (SELECT * FROM bars WHERE tf = 'H4'), sp AS (SELECT min(t) AS lo, max(t) AS hi FROM h),
x AS (SELECT h.symbol, h.t, "close", kind, name, t1, t2, p1, p2, p3, ray FROM h JOIN dr USING (symbol), sp
  WHERE (CASE WHEN kind = 'horizontal' THEN true ELSE h.t >= t1 END)
    AND (CASE WHEN kind IN ('horizontal', 'text') OR (ray AND kind IN ('trendline', 'channel')) THEN true ELSE h.t <= t2 END)),
v AS (SELECT *, CASE WHEN t1 = t2 THEN p1 ELSE p1 + (p2 - p1) / (t2 - t1) * (t - t1) END AS main FROM x)
SELECT symbol, t AS bar_time, kind, name, {R("CASE WHEN kind IN ('trendline', 'channel') THEN main WHEN kind = 'rectangle' THEN least(p1, p2) ELSE p1 END", "value")},
  {R("CASE WHEN kind = 'channel' THEN main + p3 - p1 WHEN kind = 'rectangle' THEN greatest(p1, p2) END", "other_value")},
  {R("CASE WHEN kind IN ('horizontal', 'text') OR t1 = t2 THEN 0 WHEN kind = 'rectangle' THEN (greatest(p1, p2) - least(p1, p2)) / (t2 - t1) * 86400 ELSE (p2 - p1) / (t2 - t1) * 86400 END", "slope_per_day")},
  {R("CASE WHEN kind = 'fibonacci' THEN p1 + (p2 - p1) * 0.382::DOUBLE END", "fib_382")} FROM v""")
def lines_at_bars(spark, sf_dir):
    out = G.lines_at_bars(S.stored_bars(spark, sf_dir, "H4"), D.explode_lines(documents(spark, sf_dir)), digits=6)
    return out.select(
        "symbol", F.unix_seconds("bar_time").alias("bar_time"), "kind", "name", "value", "other_value", "slope_per_day",
        F.get("level_prices", F.lit(1)).alias("fib_382"))


# ------------------------------------------------------------------------------------------------ specified levels

@query("previous_period_levels", f"""WITH {BARS}, p(period) AS (VALUES ('day'), ('week'), ('month')),
g AS (SELECT symbol, period, date_trunc(period, make_timestamp(t * 1000000)) AS start, max(high) AS h, min(low) AS l FROM bars, p WHERE tf = 'D1' GROUP BY ALL)
SELECT * FROM (SELECT symbol, period, epoch_us(start) // 1000000 AS start, lag(h) OVER w AS prev_high, lag(l) OVER w AS prev_low FROM g
WINDOW w AS (PARTITION BY symbol, period ORDER BY start)) WHERE prev_high IS NOT NULL""")
def previous_period_levels(spark, sf_dir):
    return rounded(G.previous_period_levels(S.bars(spark, sf_dir, "D1")))


#: Stand-in symbols as instruments with steps of every kind; `view` stays a symbol without a listed step.
STEPPED = {"click": "XAUUSD", "error": "USDJPY", "purchase": "GBPUSD", "signup": "EURJPY"}


@query("round_number_levels", f"""WITH {BARS},
st AS (SELECT *, CASE symbol WHEN 'click' THEN 50::DOUBLE WHEN 'error' THEN 0.5::DOUBLE WHEN 'purchase' THEN 0.01::DOUBLE WHEN 'signup' THEN 0.5::DOUBLE ELSE 50::DOUBLE END AS step FROM bars WHERE tf = 'H1')
SELECT symbol, t AS bar_time, {R('floor("close" / step) * step', "round_below")}, {R('ceil("close" / step) * step', "round_above")} FROM st""")
def round_number_levels(spark, sf_dir):
    pairs = F.create_map(*[x for k, v in STEPPED.items() for x in (F.lit(k), F.lit(v))])
    out = G.round_levels(S.bars(spark, sf_dir, "H1"), G.round_step(F.coalesce(F.try_element_at(pairs, F.col("symbol")), F.col("symbol"))))
    return rounded(out.select("symbol", "bar_time", "round_below", "round_above"))


SWINGS = BARS + """,
lg AS (SELECT *, lag(high, 1) OVER w AS h1, lag(high, 2) OVER w AS h2, lead(high, 1) OVER w AS h3, lead(high, 2) OVER w AS h4,
   lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2, lead(low, 1) OVER w AS l3, lead(low, 2) OVER w AS l4
  FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY t)),
sw AS (SELECT *, high > greatest(h1, h2, h3, h4) AS swing_high, low < least(l1, l2, l3, l4) AS swing_low FROM lg WHERE h2 IS NOT NULL AND h4 IS NOT NULL)"""


@query("swing_points", f"WITH {SWINGS} SELECT symbol, tf, t AS bar_time, high, low, swing_high, swing_low FROM sw WHERE swing_high OR swing_low")
def swing_points(spark, sf_dir):
    return rounded(G.swing_points(S.bars(spark, sf_dir)).select("symbol", "tf", "bar_time", "high", "low", "swing_high", "swing_low"))


@query("session_ranges", f"""WITH {BARS}, j AS (SELECT *, make_timestamp((t + 32400) * 1000000) AS jt FROM bars WHERE tf = 'M15'),
m AS (SELECT symbol, high, low, 'asia' AS session, CAST(jt AS DATE) AS d FROM j WHERE hour(jt) >= 7 AND hour(jt) < 16
 UNION ALL SELECT symbol, high, low, 'europe', CAST(jt AS DATE) FROM j WHERE hour(jt) >= 16 AND hour(jt) < 22
 UNION ALL SELECT symbol, high, low, 'newyork', CAST(jt - INTERVAL 6 HOUR AS DATE) FROM j WHERE hour(jt) >= 21 OR hour(jt) < 6)
SELECT symbol, session, CAST(d AS VARCHAR) AS session_date, max(high) AS high, min(low) AS low FROM m GROUP BY ALL""")
def session_ranges(spark, sf_dir):
    out = G.session_ranges(S.bars(spark, sf_dir, "M15"))
    return rounded(out.withColumn("session_date", F.col("session_date").cast("string")))


@query("day_vwap", f"""WITH {BARS} SELECT symbol, t AS bar_time, {R("close / (sum((high + low + close) / 3 * tick_volume) OVER w / sum(tick_volume) OVER w)", "close_to_vwap")} FROM bars WHERE tf = 'M15'
WINDOW w AS (PARTITION BY symbol, t // 86400 ORDER BY t)""")
def day_vwap(spark, sf_dir):
    return rounded(G.day_vwap(S.bars(spark, sf_dir, "M15")).select(
        "symbol", "bar_time", (F.col("close") / F.col("vwap")).alias("close_to_vwap")))


@query("confluence_zones", f"""WITH RECURSIVE {SERIES}, {recursive_indicators("mv")},
atr AS (SELECT symbol, arg_max(atr, t) / 10 AS a FROM ind WHERE tf = 'H4' AND atr IS NOT NULL GROUP BY symbol),
lv AS (SELECT symbol, high AS price FROM bars WHERE tf = 'D1' UNION ALL SELECT symbol, low FROM bars WHERE tf = 'D1'),
d AS (SELECT symbol, price, count(*) AS c, any_value(a) AS a FROM lv JOIN atr USING (symbol) GROUP BY symbol, price),
x AS (SELECT *, price / (a * 0.3::DOUBLE) AS x FROM d WHERE a > 0),
z AS (SELECT symbol, price, x, sum(c) OVER w AS n, max(price) OVER w AS hi FROM x WINDOW w AS (PARTITION BY symbol ORDER BY x RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT symbol, price AS zone_low, hi AS zone_high, CAST(n AS BIGINT) AS n_levels, CAST(least(5, n) AS INTEGER) AS stars FROM z WHERE n >= 3
QUALIFY row_number() OVER (PARTITION BY symbol, floor(x) ORDER BY n DESC, x) = 1""")
def confluence_zones(spark, sf_dir):
    bars = S.stored_bars(spark, sf_dir, "D1", "H4")
    daily = bars.where("tf = 'D1'")
    levels = daily.select("symbol", F.explode(F.array("high", "low")).alias("price"))
    atr = I.last_finite(I.indicator_history(bars.where("tf = 'H4'"), stored=True), ["atr"], keys=["symbol"]).withColumn("atr", F.col("atr") / 10)
    return rounded(G.confluence(levels, atr))


@query("bar_patterns", f"""WITH {BARS},
nb AS (SELECT symbol, t, high AS h, low AS l, "close" AS c, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars WHERE tf = 'M15'),
ins AS (SELECT a.symbol, a.i, m.h, m.l FROM nb a JOIN nb m ON m.symbol = a.symbol AND m.i = a.i - 1 WHERE a.h <= m.h AND a.l >= m.l),
brk AS (SELECT n.symbol, n.t, CASE WHEN n.c > ins.h THEN 'inside_break_up' ELSE 'inside_break_down' END AS side
  FROM ins JOIN nb n ON n.symbol = ins.symbol AND n.i BETWEEN ins.i + 1 AND ins.i + {G.BREAK_BARS} WHERE n.c > ins.h OR n.c < ins.l
  QUALIFY row_number() OVER (PARTITION BY ins.symbol, ins.i ORDER BY n.i) = 1),
g AS (SELECT symbol, t, open AS o, high AS h, low AS l, "close" AS c, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag("close") OVER w AS c1,
  lag(open, 2) OVER w AS o2, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag("close", 2) OVER w AS c2 FROM bars WHERE tf = 'M15' WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, 'M15' AS tf, t AS bar_time, 'pin_bull' AS pattern FROM g WHERE c <> o AND least(o, c) - l >= abs(c - o) * 2 AND h - greatest(o, c) < abs(c - o) * 0.3::DOUBLE
UNION ALL SELECT symbol, 'M15', t, 'pin_bear' FROM g WHERE c <> o AND h - greatest(o, c) >= abs(c - o) * 2 AND least(o, c) - l < abs(c - o) * 0.3::DOUBLE
UNION ALL SELECT symbol, 'M15', t, 'engulf_bull' FROM g WHERE c > o AND c1 < o1 AND o <= c1 AND c >= o1
UNION ALL SELECT symbol, 'M15', t, 'engulf_bear' FROM g WHERE c < o AND c1 > o1 AND o >= c1 AND c <= o1
UNION ALL SELECT symbol, 'M15', t, 'inside' FROM g WHERE h <= h1 AND l >= l1
UNION ALL SELECT DISTINCT symbol, 'M15', t, side FROM brk
UNION ALL SELECT symbol, 'M15', t, 'reversal_bull' FROM g WHERE c2 < o2 AND l1 < l2 AND l1 < l AND c > h1
UNION ALL SELECT symbol, 'M15', t, 'reversal_bear' FROM g WHERE c2 > o2 AND h1 > h2 AND h1 > h AND c < l1""")
def bar_patterns(spark, sf_dir):
    return rounded(G.bar_patterns(S.bars(spark, sf_dir, "M15")))


PAIR_OF = {"click": "EURUSD", "error": "USDJPY", "purchase": "GBPUSD", "signup": "EURJPY", "view": "GBPJPY"}
STRENGTH = BARS + f""",
nm(symbol, pair) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in PAIR_OF.items())}),
cl AS (SELECT pair, t, "close" FROM bars JOIN nm USING (symbol) WHERE tf = 'M15' AND t <= epoch_us(TIMESTAMP '{S.NOW}') // 1000000),
wn(win, sec) AS (VALUES ('H1', 3600), ('H4', 14400), ('D1', 86400), ('W1', 604800)),
en AS (SELECT pair, win, arg_max("close", t) AS a, arg_max("close", t) FILTER (WHERE t <= epoch_us(TIMESTAMP '{S.NOW}') // 1000000 - sec) AS b FROM cl, wn GROUP BY ALL),
lg AS (SELECT win, left(pair, 3) AS currency, (a - b) / b * 100 AS v FROM en WHERE b IS NOT NULL UNION ALL SELECT win, substr(pair, 4), -(a - b) / b * 100 FROM en WHERE b IS NOT NULL),
rw AS (SELECT win, currency, avg(v) AS raw FROM lg GROUP BY ALL),
str AS (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 50 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) * 100 END AS strength FROM rw WINDOW w AS (PARTITION BY win))"""


def _strength(spark, sf_dir):
    names = F.create_map(*[x for k, v in PAIR_OF.items() for x in (F.lit(k), F.lit(v))])
    closes = S.bars(spark, sf_dir, "M15").select(names[F.col("symbol")].alias("pair"), "bar_time", "close")
    return G.currency_strength(closes, S.now())


@query("currency_strength", f"""WITH {STRENGTH} SELECT win AS "window", currency, {R("raw", "raw", 4)}, {R("strength", "strength", 4)} FROM str""")
def currency_strength(spark, sf_dir):
    return rounded(_strength(spark, sf_dir), 4)


@query("strength_pair_bias", f"""WITH {STRENGTH}, d AS (SELECT pair, b.win, b.strength - q.strength AS x FROM nm JOIN str b ON b.currency = left(pair, 3) JOIN str q ON q.currency = substr(pair, 4) AND q.win = b.win)
SELECT pair, win AS "window", {R("x", "delta", 4)}, CASE WHEN x >= 30 THEN 'STRONG BUY' WHEN x >= 10 THEN 'BUY' WHEN x > -10 THEN 'NEUTRAL' WHEN x > -30 THEN 'SELL' ELSE 'STRONG SELL' END AS bias FROM d""")
def strength_pair_bias(spark, sf_dir):
    names = F.create_map(*[x for k, v in PAIR_OF.items() for x in (F.lit(k), F.lit(v))])
    pairs = S.ticks(spark, sf_dir).select(names[F.col("symbol")].alias("pair")).distinct()
    return rounded(G.strength_bias(pairs, _strength(spark, sf_dir)), 4)


@query("correlation_matrix", f"""WITH {BARS},
rt AS (SELECT symbol, t, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM bars WHERE tf = 'H1'),
cm AS (SELECT t FROM rt WHERE r IS NOT NULL GROUP BY t HAVING count(*) = 5 ORDER BY t DESC LIMIT 500),
rk AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS rn FROM cm),
w(bars) AS (VALUES (20), (100), (500)),
sy AS (SELECT unnest(list_value({", ".join(f"'{x}'" for x in S.SYMBOLS)})) AS symbol),
have AS (SELECT bars, a.symbol AS sa, b.symbol AS sb, corr(a.r, b.r) AS c FROM w JOIN rk ON rn <= bars JOIN rt a USING (t) JOIN rt b USING (t) GROUP BY ALL)
SELECT w.bars, x.symbol AS symbol_a, y.symbol AS symbol_b, {R("coalesce(c, 0)", "corr")} FROM w CROSS JOIN sy x CROSS JOIN sy y
LEFT JOIN have ON have.bars = w.bars AND sa = x.symbol AND sb = y.symbol""")
def correlation_matrix(spark, sf_dir):
    return rounded(G.correlation_matrix(S.bars(spark, sf_dir, "H1"), S.SYMBOLS))


@query("level_touch_tiers", f"""WITH RECURSIVE {SERIES}, {recursive_indicators("mv")}
SELECT symbol, t AS bar_time, CASE WHEN abs(d) <= atr * 0.1::DOUBLE THEN 'touch' WHEN abs(d) <= atr * 0.3::DOUBLE THEN 'close' WHEN abs(d) <= atr * 0.5::DOUBLE THEN 'near' ELSE '' END AS tier
FROM (SELECT *, "close" - round("close" / 50) * 50::DOUBLE AS d FROM ind WHERE tf = 'H4')""")
def level_touch_tiers(spark, sf_dir):
    rows = I.indicator_history(S.bars(spark, sf_dir, "H4"))
    nearest = F.col("close") - F.round(F.col("close") / 50) * 50.0
    return rounded(rows.select("symbol", "bar_time", G.touch_tier(nearest, F.col("atr")).alias("tier")))


@query("rsi_divergences", f"""WITH RECURSIVE {SERIES}, {recursive_indicators("mv")}, {SWINGS[len(BARS) + 2:]},
z AS (SELECT sw.*, rsi FROM sw JOIN ind USING (symbol, tf, t) WHERE rsi IS NOT NULL AND tf = 'M15'),
a AS (SELECT *, lag(high) OVER w AS p, lag(rsi) OVER w AS r FROM z WHERE swing_high WINDOW w AS (PARTITION BY symbol ORDER BY t)),
b AS (SELECT *, lag(low) OVER w AS p, lag(rsi) OVER w AS r FROM z WHERE swing_low WINDOW w AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, tf, t AS bar_time, 'bearish' AS divergence FROM a WHERE high > p AND rsi < r
UNION ALL SELECT symbol, tf, t, 'bullish' FROM b WHERE low < p AND rsi > r""")
def rsi_divergences(spark, sf_dir):
    return rounded(G.rsi_divergence(I.indicator_history(S.bars(spark, sf_dir, "M15"))))
