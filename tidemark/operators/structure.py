"""Chart lines against bars, and the structure levels of the specification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import lines as L
from tidemark.functions.clock import jst
from tidemark.functions.price import split_pair
from tidemark.operators import intervals as I
from tidemark.operators.scan import SERIES, chain, with_cell, with_neighbours
from tidemark.session import written

#: Levels of runs of 4^level days; the top one holds 45 years.
DAY_LEVELS = 7


def lines_at_bars(bars: DataFrame, lines: DataFrame, digits: int | None = None) -> DataFrame:
    """Value of every chart line at every bar it is valid for.

    A line holds from its first anchor to its second, or to its symbol's newest bar if it is a ray or a level; one without an anchor holds from
    the symbol's first bar. Its days are covered by a few aligned runs, however long it is, which are joined by equality to the runs of the
    days that have bars; what is left of a line then meets the bars of just those days. Lines of symbols without bars give no row. What does not
    depend on the bar is computed, and rounded to `digits` if given, once a line, before that, as a line becomes many rows.
    """
    days = bars.withColumn("_day", F.unix_date(F.to_date("bar_time")).cast("bigint"))
    spans = bars.groupBy("symbol").agg(F.min("bar_time").alias("_begin"), F.max("bar_time").alias("_end"))
    open_end = F.col("ray_right") | F.col("t2").isNull()
    from_ = F.coalesce(F.least("t1", "t2"), F.col("t1"), F.col("_begin"))
    anchors = [F.col(c) for c in ("t1", "p1", "t2", "p2")]
    kind, sloped = F.col("kind"), F.coalesce(F.col("kind").isin("trendline", "channel"), F.lit(False))

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits) + F.lit(0.0)

    drawn = lines.select(
        "symbol", "kind", "name", "t1", "t2", "ray_right", shown(L.slope_per_day(*anchors)).alias("slope_per_day"),
        F.transform("levels", lambda e: shown(L.fibonacci_price(F.col("p1"), F.col("p2"), e["ratio"]))).alias("level_prices"),
        F.when(sloped, F.struct(F.unix_seconds("t1").cast("double").alias("t"), F.col("p1").alias("p"), L.slope_per_second(*anchors).alias("slope"),
                                L.channel_offset(*anchors, F.col("t3"), F.col("p3")).alias("offset"))).alias("_slope"),
        F.when(~sloped, shown(F.when(kind == "rectangle", F.least("p1", "p2")).otherwise(F.col("p1")))).alias("_value"),
        F.when(kind == "rectangle", shown(F.greatest("p1", "p2"))).alias("_other"))
    bounded = drawn.join(spans, "symbol").withColumn("_from", F.greatest(from_, F.col("_begin"))).withColumn(
        "_to", F.least(F.when(open_end, F.col("_end")).otherwise(F.greatest("t1", "t2")), F.col("_end"))).drop("_begin", "_end")
    day = lambda c: F.unix_date(F.to_date(c)).cast("bigint")
    runs = I.covered(bounded.withColumn("_first", day("_from")).withColumn("_stop", day("_to") + 1), "_first", "_stop", DAY_LEVELS)
    stretches = I.runs_of_slots(days.select("symbol", "_day").distinct(), ["symbol"], "_day", DAY_LEVELS)
    laid = runs.join(stretches, ["symbol", "_level", "_node"]).drop("_level", "_node")
    met = laid.join(days.select("symbol", "tf", "bar_time", "close", "_day"), ["symbol", "_day"]).where(
        F.col("bar_time").between(F.col("_from"), F.col("_to")))
    main = F.col("_slope.p") + F.col("_slope.slope") * (F.unix_seconds("bar_time").cast("double") - F.col("_slope.t"))
    value = F.when(F.col("_slope").isNotNull(), shown(main)).otherwise(F.col("_value"))
    other = F.when(kind == "channel", shown(main + F.col("_slope.offset"))).otherwise(F.col("_other"))
    return met.select("symbol", "tf", "bar_time", "close", "kind", "name", value.alias("value"), other.alias("other_value"),
                      "slope_per_day", "level_prices")


def previous_period_levels(bars: DataFrame) -> DataFrame:
    """High and low of the previous day, week and month beside each period that has one (one row per period)."""
    periods = F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.date_trunc(p, F.col("bar_time")).alias("start")) for p in ("day", "week", "month")]))
    per = bars.select("symbol", "high", "low", periods.alias("p")).groupBy("symbol", "p.period", "p.start").agg(
        F.max("high").alias("_h"), F.min("low").alias("_l"))
    w = Window.partitionBy("symbol", "period").orderBy("start")
    return per.select("symbol", "period", "start", F.lag("_h").over(w).alias("prev_high"),
                      F.lag("_l").over(w).alias("prev_low")).where(F.col("prev_high").isNotNull())


def round_step(pair: Column) -> Column:
    """Distance of round numbers by symbol: gold, yen crosses, other six-letter pairs; the default for the rest."""
    return (F.when(pair.startswith("XAU"), dims.ROUND_STEP_GOLD).when(pair.endswith("JPY"), dims.ROUND_STEP_YEN)
            .when(F.length(pair) == 6, dims.ROUND_STEP_MAJOR).otherwise(dims.ROUND_STEP_DEFAULT))


def round_levels(prices: DataFrame, step: Column, price: str = "close") -> DataFrame:
    p = F.col(price)
    return prices.withColumn("round_below", F.floor(p / step) * step).withColumn("round_above", F.ceil(p / step) * step)


def swing_points(bars: DataFrame, wing: int = 2) -> DataFrame:
    """Fractals: a high above, or a low below, the ``wing`` bars on both sides. One bar per grid slot per series."""
    clean = bars.drop("cell", "idx", "n")
    near, w = with_neighbours(chain(with_cell(clean)), wing, wing)
    highs = [f("high", i).over(w) for f in (F.lag, F.lead) for i in range(1, wing + 1)]
    lows = [f("low", i).over(w) for f in (F.lag, F.lead) for i in range(1, wing + 1)]
    marked = near.select("*", F.greatest(*highs).alias("_nh"), F.least(*lows).alias("_nl"),
                         F.lag("high", wing).over(w).alias("_b"), F.lead("high", wing).over(w).alias("_a"))
    whole = F.col("_own") & F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return marked.where(whole).select(
        *clean.columns, (F.col("high") > F.col("_nh")).alias("swing_high"), (F.col("low") < F.col("_nl")).alias("swing_low"),
    ).where("swing_high OR swing_low")


def session_ranges(bars: DataFrame, sessions: Sequence[tuple[str, int, int]] = dims.SESSIONS_JST) -> DataFrame:
    """High and low per JST session and its opening date; sessions overlap and may cross midnight."""
    local = jst(F.col("bar_time"))
    hour, day = F.hour(local), F.to_date(local)
    member = []
    for name, start, end in sessions:
        member.append(F.when((hour >= start) & (hour < min(end, 24)), F.struct(F.lit(name).alias("session"), day.alias("session_date"))))
        if end > 24:
            member.append(F.when(hour < end - 24, F.struct(F.lit(name).alias("session"), F.date_sub(day, 1).alias("session_date"))))
    rows = bars.select("symbol", "high", "low", F.explode(F.array_compact(F.array(*member))).alias("s"))
    return rows.groupBy("symbol", "s.session", "s.session_date").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def day_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the UTC day's first bar (a day holds at most its grid's bars)."""
    w = Window.partitionBy(*SERIES, F.to_date("bar_time")).orderBy("bar_time").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("tick_volume")).over(w), F.sum("tick_volume").over(w)))


def confluence(levels: DataFrame, atr: DataFrame, width: float = dims.CONFLUENCE_ATR, least: int = 3) -> DataFrame:
    """Zones no wider than ``width`` ATR that hold three or more levels; they score 3, 4 or 5 stars.

    Prices are measured in zone widths. In every stretch of one width the level from which one width upwards holds the most
    levels opens the zone (the lowest of equals), so levels that follow each other closely never chain into one. A stretch and
    the next one meet in one window, however many levels a symbol has. ``levels``: symbol, price. ``atr``: symbol, atr. Equal
    prices are counted first, so a repeated level is one row.
    """
    distinct = levels.groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("_c")).join(atr, "symbol").where(F.col("atr") > 0)
    placed = distinct.withColumn("_x", F.col("price") / (F.col("atr") * width)).withColumn("_at", F.floor("_x"))
    met = placed.select("symbol", "price", "_c", "_x", F.explode(F.array(F.col("_at"), F.col("_at") - 1)).alias("_stretch"))
    above = Window.partitionBy("symbol", "_stretch").orderBy("_x").rangeBetween(0, 1)
    counted = met.select("*", F.sum("_c").over(above).alias("n_levels"), F.max("price").over(above).alias("zone_high"))
    best = Window.partitionBy("symbol", "_stretch").orderBy(F.col("n_levels").desc(), "_x")
    opened = counted.where((F.floor("_x") == F.col("_stretch")) & (F.col("n_levels") >= least)).withColumn("_rn", F.row_number().over(best))
    return opened.where("_rn = 1").select(
        "symbol", F.col("price").alias("zone_low"), "zone_high", "n_levels", F.least(F.lit(5), F.col("n_levels").cast("int")).alias("stars"))


#: Bars after an inside bar in which a close beyond its mother bar counts as its break.
BREAK_BARS = 5


def _breaks(n: int, side: str) -> Column:
    """Whether this bar's close is the first one beyond the mother bar of an inside bar up to ``n`` bars back, and on ``side``.

    ``_near`` holds the bars before this one, the newest first.
    """
    near = F.col("_near")

    def of(k: int) -> Column:
        inner, mother = F.get(near, F.lit(k - 1)), F.get(near, F.lit(k))
        held = F.forall(F.slice(near, 1, k - 1), lambda b: (b["close"] <= mother["high"]) & (b["close"] >= mother["low"])) if k > 1 else F.lit(True)
        beyond = F.col("close") > mother["high"] if side == "up" else F.col("close") < mother["low"]
        return (inner["high"] <= mother["high"]) & (inner["low"] >= mother["low"]) & held & beyond

    out = F.lit(False)
    for k in range(1, n + 1):
        out = out | F.coalesce(of(k), F.lit(False))
    return out


def bar_patterns(bars: DataFrame, break_bars: int = BREAK_BARS) -> DataFrame:
    """Pin bars, engulfing, inside bar, inside-bar break and three-bar reversal, one row per pattern and bar.

    An inside bar breaks at the first of the ``break_bars`` bars after it that closes beyond its mother bar; after them it never does.
    """
    near, w = with_neighbours(chain(with_cell(bars.drop("cell", "idx", "n"))), max(2, break_bars + 1))
    before = F.reverse(F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(-(break_bars + 1), -1)))
    lagged = near.select("*", before.alias("_near"), *[F.lag(c, i).over(w).alias(f"_{c}{i}") for i in (1, 2) for c in ("open", "high", "low", "close")]).where("_own")
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, h1, l1, c1 = (F.col(f"_{x}1") for x in ("open", "high", "low", "close"))
    o2, h2, l2, c2 = (F.col(f"_{x}2") for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    inside = (h <= h1) & (lo >= l1)
    found = F.array_compact(F.array(
        F.when((body > 0) & (lower >= body * 2) & (upper < body * 0.3), "pin_bull"),
        F.when((body > 0) & (upper >= body * 2) & (lower < body * 0.3), "pin_bear"),
        F.when((c > o) & (c1 < o1) & (o <= c1) & (c >= o1), "engulf_bull"),
        F.when((c < o) & (c1 > o1) & (o >= c1) & (c <= o1), "engulf_bear"),
        F.when(inside, "inside"),
        F.when(_breaks(break_bars, "up"), "inside_break_up"),
        F.when(_breaks(break_bars, "down"), "inside_break_down"),
        F.when((c2 < o2) & (l1 < l2) & (l1 < lo) & (c > h1), "reversal_bull"),
        F.when((c2 > o2) & (h1 > h2) & (h1 > h) & (c < l1), "reversal_bear"),
    ))
    return lagged.select(*SERIES, "bar_time", F.explode(found).alias("pattern"))


def currency_strength(closes: DataFrame, now: Column) -> DataFrame:
    """0-100 strength per window and currency from pair changes: + for the base leg, - for the quote leg.

    ``closes``: pair, bar_time, close. The change runs from the last close at or before the window's start to the newest.
    """
    windows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("window"), F.lit(s).alias("sec")) for k, s in dims.STRENGTH_WINDOWS_SEC.items()]))
    keyed = closes.where(F.col("bar_time") <= now).select("pair", "bar_time", "close", windows.alias("w"))
    start = F.timestamp_seconds(F.unix_seconds(now) - F.col("w.sec"))
    ends = keyed.groupBy("pair", "w.window").agg(
        F.max_by("close", "bar_time").alias("_now"),
        F.max_by("close", F.when(F.col("bar_time") <= start, F.col("bar_time"))).alias("_then"))
    base, quote = split_pair(F.col("pair"))
    change = F.try_divide(F.col("_now") - F.col("_then"), F.col("_then")) * 100.0
    legs = ends.where(F.col("_then").isNotNull()).select("window", F.explode(F.array(
        F.struct(base.alias("currency"), change.alias("v")), F.struct(quote.alias("currency"), (-change).alias("v")))).alias("l"))
    raw = legs.groupBy("window", "l.currency").agg(F.avg("l.v").alias("raw"))
    # one row per currency: the window is over a handful of currencies
    w = Window.partitionBy("window")
    lo, span = F.min("raw").over(w), F.max("raw").over(w) - F.min("raw").over(w)
    return raw.select("window", "currency", "raw",
                      F.when(span == 0, F.lit(50.0)).otherwise(F.try_divide(F.col("raw") - lo, span) * 100.0).alias("strength"))


def strength_bias(pairs: DataFrame, strength: DataFrame) -> DataFrame:
    """Base minus quote strength per pair and window, in five tiers."""
    base, quote = split_pair(F.col("pair"))
    b = strength.select("window", F.col("currency").alias("_base"), F.col("strength").alias("_b"))
    q = strength.select("window", F.col("currency").alias("_quote"), F.col("strength").alias("_q"))
    joined = pairs.select("pair", base.alias("_base"), quote.alias("_quote")).join(b, "_base").join(q, ["_quote", "window"])
    d = F.col("_b") - F.col("_q")
    label = (F.when(d >= 30, "STRONG BUY").when(d >= 10, "BUY").when(d > -10, "NEUTRAL").when(d > -30, "SELL").otherwise("STRONG SELL"))
    return joined.select("pair", "window", d.alias("delta"), label.alias("bias"))


def _common_times(returns: DataFrame, symbols: int) -> DataFrame:
    """Times at which every symbol has a return."""
    return returns.where(F.col("_r").isNotNull()).groupBy("bar_time").agg(F.count_distinct("symbol").alias("_k")).where(F.col("_k") == symbols).drop("_k")


def correlation_matrix(bars: DataFrame, symbols: Sequence[str], windows: Sequence[int] = dims.CORRELATION_WINDOWS, *, stored: bool = False) -> DataFrame:
    """Correlation of close returns over the newest bars common to all symbols; no variance counts as 0.

    Symbols may trade on different grids: each return is over the symbol's own previous bar, whatever its distance. History is read back from
    the newest bar, four times as far each time, until it holds as many common times as the widest window asks for; what a shorter reach cuts
    off lies behind all common times it holds. The moments of a pair combine, each pair is summed once, and the plan does not grow with the
    symbols. ``stored=True`` says the input is a table scan already; else its three columns are written once.
    """
    names, need = sorted(symbols), max(windows)
    own = bars.where(F.col("symbol").isin(*names)).select("symbol", "bar_time", "close")
    own = own if stored else written(own, "correlation")
    ends = own.groupBy("symbol").agg(F.unix_micros(F.min("bar_time").cast("timestamp")).alias("a"), F.unix_micros(F.max("bar_time").cast("timestamp")).alias("z")).collect()
    oldest, newest = min((r["a"] for r in ends), default=0), max((r["z"] for r in ends), default=0)  # one row a symbol
    reach = max((newest - oldest) // 64, 1)
    while True:
        start = max(oldest, newest - reach)
        part = own.where(F.col("bar_time") >= F.timestamp_micros(F.lit(start)))
        before = F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_time"))
        returns = part.select("symbol", "bar_time", (F.try_divide("close", before) - 1.0).alias("_r"))
        top = _common_times(returns, len(names)).orderBy(F.col("bar_time").desc()).limit(need)
        if start <= oldest or top.count() >= need:
            break
        reach *= 4
    # at most `need` times from here on
    ranked = top.withColumn("_rn", F.row_number().over(Window.orderBy(F.col("bar_time").desc())))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("symbol")).cast("int") - 1
    side = returns.where(F.col("_r").isNotNull()).join(F.broadcast(ranked), "bar_time").groupBy("_rn").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("i"), F.col("_r").alias("r")))).alias("_v"))
    wide = side.select(F.explode(F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: n >= F.col("_rn"))).alias("bars"), F.col("_v.r").alias("_v"))
    left = wide.select("bars", "_v", F.posexplode("_v").alias("i", "x"))
    pairs = left.select("bars", "i", "x", F.posexplode(F.slice("_v", F.col("i") + 1, len(names))).alias("d", "y"))
    corr = pairs.groupBy("bars", "i", (F.col("i") + F.col("d")).alias("j")).agg(F.corr("x", "y").alias("c"))
    k, cell = len(names), F.col("id")
    grid = bars.sparkSession.range(k * k * len(windows)).select(
        F.element_at(F.array(*[F.lit(n) for n in windows]), (cell / (k * k)).cast("int") + 1).alias("bars"),
        (cell % k).cast("int").alias("a"), (F.floor(cell / k) % k).cast("int").alias("b"))
    grid = grid.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    found = grid.join(corr, ["bars", "i", "j"], "left")
    return found.select("bars", name("a").alias("symbol_a"), name("b").alias("symbol_b"),
                        F.coalesce(F.when(~F.isnan("c"), F.col("c")), F.lit(0.0)).alias("corr"))


def touch_tier(distance: Column, atr: Column) -> Column:
    """'touch', 'close', 'near' or '' by distance in ATR."""
    a, b, c = dims.TOUCH_TIERS_ATR
    d = F.abs(distance)
    return F.when(d <= atr * a, "touch").when(d <= atr * b, "close").when(d <= atr * c, "near").otherwise("")


def rsi_divergence(rows: DataFrame) -> DataFrame:
    """Consecutive swing highs (lows) where price and RSI disagree. ``rows``: bars with rsi."""
    swings = swing_points(rows).where(F.col("rsi").isNotNull())

    def turns(kind: str, price: str, apart: Column, name: str) -> DataFrame:
        own = swings.where(kind).select(*SERIES, "bar_time", price, "rsi")
        return chain(with_cell(own), (price, "rsi")).where(apart).select(*SERIES, "bar_time", F.lit(name).alias("divergence"))

    high = turns("swing_high", "high", (F.col("high") > F.col("prev_high")) & (F.col("rsi") < F.col("prev_rsi")), "bearish")
    return high.unionByName(turns("swing_low", "low", (F.col("low") < F.col("prev_low")) & (F.col("rsi") > F.col("prev_rsi")), "bullish"))
