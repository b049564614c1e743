"""Macro payloads, positioning, calendar, symbols."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import UTC, stamp
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.functions import events as E
from tidemark.operators import events as C
from tidemark.operators import macro as M
from tidemark.operators import positioning as W
from tidemark.operators import symbols as Y
from tidemark.sources import feeds
from tidemark.sources import macro_files as MF


def latest(df):
    r = M.latest_observation(df, ["k"]).first()
    return None if r is None else (str(r.obs_date), r.value)


def body(spark, text):
    return spark.createDataFrame([("s", text)], "k string, body string")


def test_payload_formats(spark):
    js = '{"observations": [{"date": "2026-05-01", "value": "4.50"}, {"date": "2026-05-03", "value": "."}, {"date": "2026-04-01", "value": "4.25"}]}'
    assert latest(MF.parse_observation_json(body(spark, js), ["k"])) == ("2026-05-01", 4.5)
    sdmx = 'OBS_VALUE,KEY,TITLE,TIME_PERIOD\n2,a,"Level, raw",2026-05-15\n,a,x,2026-05-16\n2.25,a,x,2026-05-14\n'
    assert latest(MF.parse_sdmx_csv(body(spark, sdmx), ["k"])) == ("2026-05-15", 2.0)
    csv = "DATE,IUDBEDR\r\n02 Jan 2020,0.75\r\n03 Jan 2020,n/a\r\n06 Jan 2020,0.50\r\n\r\n"
    assert latest(MF.parse_rate_csv(body(spark, csv), ["k"])) == ("2020-01-06", 0.5)
    odd = {(r.raw_date, r.obs_date, r.value) for r in MF.parse_rate_csv(body(spark, "DATE,IUDBEDR\n05/02/2020,0.50\n"), ["k"]).collect()}
    assert odd == {("05/02/2020", None, 0.5)}
    html = '<tr><th>2026/05/14</th><td> -0.1 </td></tr><tr><th>2026/05/15</th>\n<td class="x">0.477</td></tr><tr><th>2026/05/18</th><td>NA</td></tr>'
    assert latest(MF.parse_rate_html(body(spark, html), ["k"])) == ("2026-05-15", 0.477)
    bad = body(spark, "<html>busy</html>")
    for parse in (MF.parse_observation_json, MF.parse_sdmx_csv, MF.parse_rate_csv, MF.parse_rate_html):
        rows = parse(bad, ["k"])
        assert rows.count() == 0 and MF.rejected_bodies(bad, rows, ["k"]).count() == 1
    quote = '{"chart": {"result": [{"meta": {"regularMarketPrice": 4.2, "previousClose": 4.1}}]}}'
    assert MF.parse_quotes(body(spark, quote), ["k"]).first()[1:] == (4.2, 4.1)


def obs(spark, values):
    d0 = dt.date(2026, 1, 1)
    return spark.createDataFrame([("DFII10", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, obs_date date, value double")


@pytest.mark.parametrize(("values", "direction"), [([2 + 0.05 * i for i in range(12)], -1), ([2 - 0.05 * i for i in range(12)], 1), ([2.0] * 12, 0)])
def test_real_yield_direction(spark, values, direction):
    r = M.real_yield(obs(spark, values)).first()
    assert r.gold_dir == direction and r.value == pytest.approx(values[-1]) and r.trend_5d == pytest.approx(values[-1] - values[-6])
    assert r.change_1d == pytest.approx(values[-1] - values[-2]) and len(r.series_values) == 12


def test_short_real_yield(spark):
    r = M.real_yield(obs(spark, [2.0])).first()
    assert r.prev_value is None and r.change_1d is None and r.trend_5d == 0 and r.gold_dir == 0


def test_pair_bias(spark):
    rates = spark.createDataFrame([("USD", 4.5, 4.25, False), ("JPY", 0.5, None, False), ("AUD", 4.0, None, True)],
                                  "currency string, rate double, prev_rate double, stale boolean")
    pairs = spark.createDataFrame([("USDJPY",), ("AUDUSD",), ("XAUUSD",), ("JPYUSD",)], "pair string")
    got = {r.pair: r for r in M.pair_bias(pairs, rates).collect()}
    assert (got["USDJPY"].differential, got["USDJPY"].macro_dir, got["USDJPY"].label) == (4.0, 1, "USD金利優位")
    assert (got["AUDUSD"].differential, got["AUDUSD"].macro_dir, got["AUDUSD"].label) == (0.0, 0, "—")
    assert (got["XAUUSD"].differential, got["XAUUSD"].macro_dir) == (0.25, -1)
    assert got["JPYUSD"].label == "USD金利優位"


def test_fallback_and_failures(spark):
    fresh = spark.createDataFrame([("USD", 4.5)], "currency string, rate double")
    cached = spark.createDataFrame([("USD", 4.0), ("EUR", 2.0)], "currency string, rate double")
    got = {r.currency: (r.rate, r.stale) for r in M.with_last_good(fresh, cached, ["currency"]).collect()}
    assert got == {"USD": (4.5, False), "EUR": (2.0, True)}
    att = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 3, "partial"), ("a", 3, 0, "y"), ("a", 4, 0, "z"), ("b", 1, 0, "q"), ("c", 1, 0, "e"), ("c", 2, 1, None)],
                                "source string, attempt_ts bigint, sources_ok int, error string")
    f = M.failure_streaks(att)
    assert {r.source: (r.consecutive_failures, r.last_error) for r in f.collect()} == {"a": (2, "z"), "b": (1, "q"), "c": (0, None)}
    pri = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "new")], "source string, item string")
    sec = spark.createDataFrame([("a", "sec"), ("b", "sec")], "source string, item string")
    assert sorted((r.source, r.item) for r in M.choose_feed(pri, sec, f).collect()) == [("a", "sec"), ("b", "old"), ("c", "new")]


def test_payroll_changes(spark):
    r = M.level_changes(obs(spark, [100, 150, 130, 180]).select("obs_date", "value")).first()
    assert (r.change, r.prev_change) == (50, -20)
    short = M.level_changes(obs(spark, [100]).select("obs_date", "value")).first()
    assert short.change is None and short.prev_change is None


def test_gap_fill(spark):
    rows = [("A", dt.date(2026, 1, 1), 1.0), ("A", dt.date(2026, 1, 4), 2.0), ("B", dt.date(2026, 1, 3), 9.0)]
    o = spark.createDataFrame(rows, "c string, d date, v double")
    got = [(str(r.d), r.A, r.B) for r in M.daily_wide(o, "c", "d", "v", ["A", "B"]).orderBy("d").collect()]
    assert got == [("2026-01-03", 1.0, 9.0), ("2026-01-04", 2.0, 9.0)]


RAW = "market string, report_date string, noncomm_long string, noncomm_short string, comm_long string, comm_short string, open_interest string"


def test_positioning_vectors(spark):
    rows = [("G", f"2026-0{i + 1}-06T00:00:00.000", str(n + 20), "20", "10", "300", "1000") for i, n in enumerate((80, 120, 150))]
    rows += [("G", "2026-04-01", None, "5", None, None, None), ("G", "2026-05-01", "x", "5", None, None, None), ("G", "", "1", "1", None, None, None)]
    r = W.positioning_snapshot(W.usable_rows(spark.createDataFrame(rows, RAW))).first()
    assert (r.report_date, r.net, r.net_prev, r.net_change, r.comm_net) == ("2026-03-06", 150, 120, 30, -290)
    assert r.net_pct_oi == pytest.approx(15) and r.pctile_1y == 100 and (r.direction, r.extreme) == (1, 1)
    assert r.net_history == [80, 120, 150] and r.long_share == pytest.approx(170 / 190 * 100)
    falling = [("G", f"2026-01-{i + 1:02d}", str(1000 - i), "10", None, None, "0") for i in range(20)]
    f = W.positioning_snapshot(W.usable_rows(spark.createDataFrame(falling, RAW))).first()
    assert f.pctile_1y == 5 and f.extreme == -1 and f.direction == 1 and f.net_pct_oi is None


FEED = """<?xml version="1.0"?><weeklyevents>
<event><title>Non-Farm Employment Change</title><country>USD</country><date>05-21-2026</date><time>12:30pm</time><impact>High</impact><forecast>180K</forecast><previous>175K</previous></event>
<event><title>CPI m/m</title><country>USD</country><date>05-21-2026</date><time>12:30pm</time><impact>High</impact></event>
<event><title>BOJ Press Conference</title><country>JPY</country><date>05-22-2026</date><time>6am</time><impact>High</impact></event>
<event><title>Unemployment Rate</title><country>USD</country><date>05-22-2026</date><time>All Day</time><impact>High</impact></event>
<event><title>Unemployment Rate</title><country>ZZZ</country><date>05-22-2026</date><time>6am</time><impact>High</impact></event>
<event><title>Unemployment Rate</title><country>USD</country><date>05-22-2026</date><time>6am</time><impact>Low</impact></event>
</weeklyevents>"""
PAGE = "<html><body>Rate Limited</body></html>"


def test_feed_bodies_and_files(spark, tmp_path):
    one = "<weeklyevents><event><title>FOMC Statement</title><country>usd</country><date>01-28-2026</date><time>7:00PM</time><impact>high</impact></event></weeklyevents>"
    bodies = spark.createDataFrame([(FEED,), (PAGE,), ("<weeklyevents></weeklyevents>",), (one,)], "body string")
    good, bad = feeds.split_feed(bodies)
    assert bad.count() == 1
    got = [(r.release_ts.replace(tzinfo=UTC), r.currency, r.title) for r in C.filter_feed(feeds.parse_events(good)).orderBy("release_ts").collect()]
    want = [(stamp("2026-01-28 19:00:00"), "USD", "FOMC Statement"), (stamp("2026-05-21 12:30:00"), "USD", "Non-Farm Employment Change"),
            (stamp("2026-05-22 06:00:00"), "JPY", "BOJ Press Conference")]
    assert [(t.timestamp(), c, x) for t, c, x in got] == [(t.timestamp(), c, x) for t, c, x in want]
    (tmp_path / "week.xml").write_text(FEED)
    (tmp_path / "throttled.xml").write_text(PAGE)
    assert C.filter_feed(feeds.read_event_xml(spark, str(tmp_path))).count() == 2
    assert feeds.split_feed(feeds.read_bodies(spark, str(tmp_path)))[1].count() == 1


def test_keywords_off_and_dedupe(spark):
    good = spark.createDataFrame([(FEED,)], "body string")
    ev = feeds.parse_events(good)
    assert C.filter_feed(ev, keywords=()).count() == 3
    a = C.filter_feed(ev)
    merged = C.merge_feeds(a.withColumn("forecast", F.lit("first")), a, a)
    assert merged.count() == 2 and {r.forecast for r in merged.collect()} == {"first"}


def test_schedules_follow_summer_time_and_skip_live_days(spark):
    sched = C.bank_schedule(spark)
    at = {(r.currency, r.release_ts.strftime("%Y-%m-%d %H:%M")) for r in sched.collect()}
    assert ("USD", "2026-01-28 19:00") in at and ("USD", "2026-06-17 18:00") in at
    assert ("EUR", "2026-01-29 13:15") in at and ("JPY", "2026-01-23 03:00") in at and ("AUD", "2026-05-06 04:30") in at
    live = spark.createDataFrame([(stamp("2026-03-18 01:00:00"), "USD")], "release_ts timestamp, currency string")
    now = F.lit("2026-03-01 00:00:00").cast("timestamp")
    usd = [r.release_ts.strftime("%m-%d") for r in C.upcoming(sched, live, now).where("currency = 'USD'").orderBy("release_ts").collect()]
    assert usd == ["04-29", "06-17", "07-29"]
    pay = C.payroll_schedule(spark.createDataFrame([("2026-07-02",), ("",), ("2026-07-02",)], "day string")).collect()
    assert len(pay) == 1 and pay[0].release_ts.strftime("%H:%M") == "12:30"


def test_titles_links_and_text(spark):
    df = spark.createDataFrame([("ADP Non-Farm Employment Change", "USD"), ("Non-Farm Payrolls", "USD"), ("Claimant Count", "GBP"), ("Official Bank Rate", "GBP"),
                                ("Monetary Policy Statement", "CHF"), ("Retail Sales", "USD")], "t string, c string")
    got = [(r[0], r[1]) for r in df.select(E.category(F.col("t")), E.localised_title(F.col("t"), F.col("c"))).collect()]
    assert got == [("emp", "ADP雇用統計"), ("emp", "米雇用統計 (NFP)"), ("emp", "失業率"), ("rate", "BoE 政策金利発表"), ("rate", "政策金利発表"), ("oth", "Retail Sales")]
    urls = ["https://www.bls.gov/x", "http://www.bls.gov/x", "https://evil.com/www.bls.gov", "javascript:alert(1)", "HTTPS://WWW.BLS.GOV/y", "https://[bad", None]
    links = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(E.source_link(F.col("u"))).collect()]
    assert links == ["https://www.bls.gov/x", "", "", "", "HTTPS://WWW.BLS.GOV/y", "", ""]
    nums = [3.0, 0.25, float("nan"), None, 1234567.0, 1e-5]
    text = [r[0] for r in spark.createDataFrame([(v,) for v in nums], "v double").select(E.value_text(F.col("v"))).collect()]
    assert text == ["3", "0.25", "", "", "1.23457e+06", "1e-05"]


def test_symbol_resolution(spark):
    listed = spark.createDataFrame([(n,) for n in ("XAUUSDm", "XAUUSD.a", "xauusd.pro", "EURUSDmicro", "EURUSDm", "USDJPY", "USDJPYx")], "name string")
    bases = spark.createDataFrame([("XAUUSD",), ("EURUSD",), ("USDJPY",), ("GBPUSD",)], "base string")
    got = {r.base: r.broker_name for r in Y.resolve_symbols(bases, listed).collect()}
    assert got == {"XAUUSD": "XAUUSD.a", "EURUSD": "EURUSDm", "USDJPY": "USDJPY"}


def test_front_contract(spark):
    q = [("a", "DXY_M6", 0.0, 1), ("a", "DXY_U6", 99.0, 1), ("a", "DXY_Z6", 99.0, 9), ("b", "USDX", 98.0, 1), ("b", "DXY_U6", 1.0, 1), ("c", "USDX", 0.0, 1), ("c", "DXY_H5", 5.0, 1),
         ("d", "DXYspot", 1.0, 5), ("d", "DXYx", 1.0, 7), ("e", "DXY_H6", 1.0, 1), ("e", "DXY_F25", 1.0, 1)]
    quotes = spark.createDataFrame(q, "broker string, name string, bid double, tick_time bigint")
    got = {r.broker: r.name for r in Y.front_contract(quotes, F.lit("2026-06-20").cast("timestamp")).collect()}
    assert got == {"a": "DXY_U6", "b": "USDX", "c": "DXY_H5", "d": "DXYx", "e": "DXY_F25"}


def test_server_offsets(spark):
    h = 3600
    s = [(1000, 3 * h), (2000, 3 * h + 1200), (3000, 2 * h), (4000, 3 * h), (5000, 2 * h), (6000, 2 * h + 30), (7000, 40 * h)]
    df = spark.createDataFrame([("x", t + d, t) for t, d in s], "server string, tick_time bigint, ingest_time bigint")
    got = [(r.ingest_time, r.offset_sec // h) for r in Y.server_offsets(df).orderBy("ingest_time").collect()]
    assert got == [(1000, 3), (3000, 3), (4000, 3), (5000, 3), (6000, 2)]


def test_server_wall_clock(spark):
    from tidemark.operators.bars import server_bars_to_utc
    secs = [int(stamp(t).timestamp()) for t in ("2026-01-15 12:00:00", "2026-07-15 12:00:00")]
    df = spark.createDataFrame([("ICMarketsSC-MT5-3", s) for s in secs], "server string, server_secs bigint")
    assert [r.bar_time.strftime("%H:%M") for r in server_bars_to_utc(df).orderBy("server_secs").collect()] == ["10:00", "09:00"]


def test_feed_clock(spark):
    df = spark.createDataFrame([("05-21-2026", "8:30am"), ("05-21-2026", "8AM"), ("05-21-2026", "Tentative"), ("", "8AM"), ("05-21-2026", None), ("x", "8AM")], "d string, t string")
    got = [r[0].strftime("%H:%M") if r[0] else None for r in df.select(clock.feed_time(F.col("d"), F.col("t"))).collect()]
    assert got == ["08:30", "08:00", None, None, None, None]
