"""Bar, indicator, oscillator and signal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.operators.scan import affine_scan, chain, first_value_ema, with_cell
from tidemark.plans import standins as S

# --------------------------------------------------------------------------- shared SQL
TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events)"
BARS = TICKS + """,
tfs(tf, sec, depth, wt, rk) AS (VALUES ('D1', 86400, 400, 3.0::DOUBLE, 0), ('H4', 14400, 300, 2.0::DOUBLE, 1),
  ('H1', 3600, 240, 1.5::DOUBLE, 2), ('M15', 900, 200, 1.0::DOUBLE, 3)),
bars AS (
  SELECT symbol, tf, (epoch_us(ts) // 1000000 // sec) * sec AS t,
         first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS "close", count(*) AS tick_volume
  FROM ticks CROSS JOIN tfs GROUP BY ALL)"""
# indexed series: i = 0-based position, n = length, previous bar
SERIES = BARS + """,
ser AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, tf) AS n,
         lag("close") OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY t)),
mv AS (
  SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN "close" > pc THEN "close" - pc ELSE 0::DOUBLE END AS gain,
         CASE WHEN "close" < pc THEN pc - "close" ELSE 0::DOUBLE END AS loss,
         CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0::DOUBLE END AS pdm,
         CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0::DOUBLE END AS mdm
  FROM ser)"""


def recursive_indicators(source: str) -> str:
    """Bar-by-bar recursion over a table shaped like ``mv``: an algorithm unrelated to the block scan."""
    a20, a14 = "(2::DOUBLE / 21::DOUBLE)", "(1::DOUBLE / 14::DOUBLE)"

    def step(y: str, x: str, alpha: str, ready: int, period: int, first: int) -> str:
        return (f"CASE WHEN b.i < {first} THEN 0::DOUBLE WHEN b.i <= {ready} THEN r.{y} + b.{x} / {period}::DOUBLE "
                f"ELSE r.{y} + {alpha} * (b.{x} - r.{y}) END")

    specs = [("ema", '"close"', a20, 19, 20, 0), ("atr", "tr", a14, 13, 14, 0), ("ag", "gain", a14, 14, 14, 1),
             ("al", "loss", a14, 14, 14, 1), ("sp", "pdm", a14, 14, 14, 1), ("sm", "mdm", a14, 14, 14, 1),
             ("st", "tr", a14, 14, 14, 1)]
    start = ", ".join(f"{x} / {p}::DOUBLE AS {y}" if f == 0 else f"0::DOUBLE AS {y}" for y, x, _, _, p, f in specs)
    body = ", ".join(step(y, x, al, rd, p, f) + f" AS {y}" for y, x, al, rd, p, f in specs)
    return f"""
rec AS (
  SELECT symbol, tf, t, i, n, "close", {start} FROM {source} WHERE i = 0
  UNION ALL
  SELECT b.symbol, b.tf, b.t, b.i, b.n, b."close", {body}
  FROM rec r JOIN {source} b ON b.symbol = r.symbol AND b.tf = r.tf AND b.i = r.i + 1),
dxs AS (
  SELECT symbol, tf, t, i, n, "close", CASE WHEN i >= 19 THEN ema END AS ema, CASE WHEN i >= 13 THEN atr END AS atr,
         CASE WHEN i >= 14 THEN CASE WHEN al = 0 THEN 100::DOUBLE ELSE 100 - 100 / (1 + ag / al) END END AS rsi,
         CASE WHEN i >= 14 AND n >= 29 AND st <> 0 THEN 100 * sp / st END AS di_plus,
         CASE WHEN i >= 14 AND n >= 29 AND st <> 0 THEN 100 * sm / st END AS di_minus
  FROM rec),
dx AS (
  SELECT *, CASE WHEN i >= 14 AND di_plus + di_minus > 0 THEN 100 * abs(di_plus - di_minus) / (di_plus + di_minus)
                 ELSE 0::DOUBLE END AS dx FROM dxs),
adxr AS (
  SELECT symbol, tf, i, 0::DOUBLE AS adx FROM dx WHERE i = 0
  UNION ALL
  SELECT b.symbol, b.tf, b.i, CASE WHEN b.i <= 14 THEN r.adx + b.dx / 14::DOUBLE ELSE r.adx + {a14} * (b.dx - r.adx) END
  FROM adxr r JOIN dx b ON b.symbol = r.symbol AND b.tf = r.tf AND b.i = r.i + 1),
ind AS (
  SELECT dx.*, CASE WHEN dx.i >= 14 AND n >= 29 THEN adx END AS adx
  FROM dx JOIN adxr USING (symbol, tf, i))"""


# the depth-limited series the snapshot reads
DEPTH = BARS + """,
dep AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY symbol, tf ORDER BY t DESC) AS rn, depth
                 FROM bars b JOIN tfs USING (tf)) WHERE rn <= depth),
ser AS (
  SELECT symbol, tf, t, open, high, low, "close", row_number() OVER w - 1 AS i,
         count(*) OVER (PARTITION BY symbol, tf) AS n,
         lag("close") OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM dep WINDOW w AS (PARTITION BY symbol, tf ORDER BY t)),
""" + SERIES[SERIES.index("mv AS ("):]
TABLE = DEPTH + "," + recursive_indicators("mv") + """,
tab AS (
  SELECT symbol, tf, max(t) AS t, arg_max("close", i) AS last_close,
         arg_max(ema, i) FILTER (WHERE ema IS NOT NULL) AS ema, arg_max(rsi, i) FILTER (WHERE rsi IS NOT NULL) AS rsi,
         arg_max(atr, i) FILTER (WHERE atr IS NOT NULL) AS atr, arg_max(adx, i) FILTER (WHERE adx IS NOT NULL) AS adx,
         arg_max(di_plus, i) FILTER (WHERE di_plus IS NOT NULL) AS di_plus,
         arg_max(di_minus, i) FILTER (WHERE di_minus IS NOT NULL) AS di_minus
  FROM ind WHERE i < n - 1 GROUP BY symbol, tf)"""


def rounded(df: DataFrame, digits: int = 6, **kinds) -> DataFrame:
    """Doubles rounded and timestamps as epoch seconds, so both engines can be compared by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType.typeName()
        if t == "double":
            # adding 0.0 folds negative zero
            c = F.round(c, digits) + F.lit(0.0)
        elif t == "timestamp":
            c = F.unix_seconds(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def R(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0::DOUBLE AS {name}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("bars_by_timeframe", f"WITH {BARS} SELECT symbol, tf, t AS bar_time, open, high, low, \"close\", tick_volume FROM bars")
def bars_by_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.bars(spark, sf_dir))


@query("last_bars_per_series", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, open, high, low, "close" FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY t DESC) <= 40""")
def last_bars_per_series(spark, sf_dir):
    return rounded(B.last_bars(S.bars(spark, sf_dir), 40).drop("tick_volume"))


@query("bars_in_range", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, open, high, low, "close" FROM bars
WHERE t BETWEEN epoch_us(TIMESTAMP '2024-01-10 00:00:00') // 1000000 AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000""")
def bars_in_range(spark, sf_dir):
    lo, hi, after = (F.lit(t).cast("timestamp") for t in ("2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-21 00:00:00"))
    # a bar that opens in the range ends within a day of it
    inside = (F.col("ts") >= lo) & (F.col("ts") < after)
    return rounded(B.bars_between(S.bars(spark, sf_dir, ticks_where=inside), lo, hi).drop("tick_volume"))


@query("depth_scan_all_series", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, "close" FROM bars JOIN tfs USING (tf)
QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY t DESC) <= depth""")
def depth_scan_all_series(spark, sf_dir):
    return rounded(B.depth_scan(S.bars(spark, sf_dir)).select("symbol", "tf", "bar_time", "close"))


@query("closed_bars_only", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, "close" FROM bars
QUALIFY t < max(t) OVER (PARTITION BY symbol, tf)""")
def closed_bars_only(spark, sf_dir):
    return rounded(B.closed_bars(S.bars(spark, sf_dir)).select("symbol", "tf", "bar_time", "close"))


@query("latest_tick_per_symbol", f"""WITH {TICKS} SELECT symbol, price - 0.05::DOUBLE AS bid, price + 0.05::DOUBLE AS ask,
  price AS last, epoch_us(ts) // 1000 - 7200000 AS time_msc FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) = 1""")
def latest_tick_per_symbol(spark, sf_dir):
    quotes = S.ticks(spark, sf_dir).select(
        "symbol", "seq", (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05).alias("ask"),
        F.col("price").alias("last"), F.unix_millis("ts").alias("time_msc"))
    return B.latest_ticks(quotes, F.lit(7200))


@query("chart_tails_per_symbol", f"""WITH RECURSIVE {TABLE},
tail AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY t DESC) AS rn FROM bars)
SELECT s.symbol,
  (SELECT string_agg(printf('%.2f/%.2f/%.2f/%.2f', open, high, low, "close"), ' ' ORDER BY t) FROM tail
   WHERE symbol = s.symbol AND tf = 'H4' AND rn <= 40) AS ohlc_h4,
  (SELECT string_agg(printf('%.2f', "close"), ' ' ORDER BY t) FROM tail
   WHERE symbol = s.symbol AND tf = 'M15' AND rn <= 30) AS closes_m15,
  {R("(SELECT ema FROM tab WHERE symbol = s.symbol AND tf = 'H4')", "ema_h4")}
FROM (SELECT DISTINCT symbol FROM bars) s""")
def chart_tails_per_symbol(spark, sf_dir):
    series = S.stored_bars(spark, sf_dir, "H4", "M15")
    ema = I.indicator_table(series).where("tf = 'H4'").select("symbol", F.col("ema").alias("ema_h4"))
    tails = B.chart_tails(series, ema)
    return rounded(tails.select(
        "symbol",
        F.array_join(F.transform("ohlc_h4", lambda b: F.format_string(
            "%.2f/%.2f/%.2f/%.2f", b["open"], b["high"], b["low"], b["close"])), " ").alias("ohlc_h4"),
        F.array_join(F.transform("closes_m15", lambda c: F.format_string("%.2f", c)), " ").alias("closes_m15"),
        "ema_h4"))


@query("jst_day_boundaries", f"""WITH {BARS} SELECT symbol, tf, t AS bar_time, CAST(CAST(make_timestamp((t + 32400) * 1000000) AS DATE) AS VARCHAR) AS day
FROM bars QUALIFY (t + 32400) // 86400 <> (lag(t) OVER (PARTITION BY symbol, tf ORDER BY t) + 32400) // 86400""")
def jst_day_boundaries(spark, sf_dir):
    marked = B.day_boundaries(chain(with_cell(S.bars(spark, sf_dir)), ("bar_time",)))
    return rounded(marked.select("symbol", "tf", "bar_time", F.col("day").cast("string").alias("day")))


@query("indicator_history", f"""WITH RECURSIVE {SERIES}, {recursive_indicators("mv")}
SELECT symbol, tf, t AS bar_time, {R("ema", "ema")}, {R("atr", "atr")}, {R("rsi", "rsi")}, {R("di_plus", "di_plus")},
  {R("di_minus", "di_minus")}, {R("adx", "adx")} FROM ind""")
def indicator_history(spark, sf_dir):
    rows = I.indicator_history(S.bars(spark, sf_dir))
    return rounded(rows.select("symbol", "tf", "bar_time", "ema", "atr", "rsi", "di_plus", "di_minus", "adx"))


@query("first_value_ema_history", f"""WITH RECURSIVE {SERIES},
e AS (SELECT symbol, tf, t, i, "close" AS y20, "close" AS y80 FROM ser WHERE i = 0
  UNION ALL SELECT s.symbol, s.tf, s.t, s.i, e.y20 + (2::DOUBLE / 21) * (s."close" - e.y20), e.y80 + (2::DOUBLE / 81) * (s."close" - e.y80)
  FROM e JOIN ser s ON s.symbol = e.symbol AND s.tf = e.tf AND s.i = e.i + 1)
SELECT symbol, tf, t AS bar_time, {R("y20", "ema20")}, {R("y80", "ema80")} FROM e""")
def first_value_ema_history(spark, sf_dir):
    rows = affine_scan(chain(with_cell(S.bars(spark, sf_dir))),
                       [first_value_ema("ema20", F.col("close"), 20), first_value_ema("ema80", F.col("close"), 80)])
    return rounded(rows.select("symbol", "tf", "bar_time", "ema20", "ema80"))


@query("indicator_table", f"""WITH RECURSIVE {TABLE}
SELECT symbol, tf, {R("last_close", "last_close")}, {R("ema", "ema")}, 20 AS ema_period, last_close > ema AS above_ema,
  {R("rsi", "rsi")}, {R("atr", "atr")}, {R("adx", "adx")}, {R("di_plus", "di_plus")}, {R("di_minus", "di_minus")}, t AS bar_time FROM tab""")
def indicator_table(spark, sf_dir):
    return rounded(I.indicator_table(S.bars(spark, sf_dir)))
