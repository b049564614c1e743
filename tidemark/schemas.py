"""Explicit table schemas. Readers take these instead of inferring; times are UTC."""

from __future__ import annotations

CONTEXT = "struct<ae: boolean, adx: double, dip: double, dim: double, rsi: double>"

BARS = ("symbol string, tf string, bar_time timestamp, open double, high double, low double, close double, "
        "tick_volume bigint, spread int, real_volume bigint")
TICKS = "symbol string, bid double, ask double, last double, time_msc bigint, seq bigint"
INDICATORS = ("symbol string, tf string, last_close double, ema double, ema_period int, above_ema boolean, rsi double, atr double, "
              "adx double, di_plus double, di_minus double, bar_time timestamp")
OSCILLATOR = ("symbol string, mode string, bar_time timestamp, price double, ema_fast double, ema_mid double, ema_center double, "
              "dev_price double, dev_fast double, dev_mid double")
BANDS = "mode string, period int, side string, p90 double, p95 double, p99 double, max double, n bigint"
DEALS = ("ticket bigint, position_id bigint, symbol string, type int, entry int, volume double, price double, profit double, "
         "time double, swap double, commission double")
TRADES = ("position_id bigint, ticket bigint, symbol string, type string, volume double, entry_time double, exit_time double, "
          "entry_price double, exit_price double, profit double, swap double, commission double, is_orphan boolean, pnl double, "
          "pips double, mae_pips double, mfe_pips double, r_multiple double, sl double, tp double, "
          f"ctx map<string, {CONTEXT}>, env map<string, double>")
JOURNAL = ("ts bigint, symbol string, side string, lots double, sl double, tp double, ticket bigint, price double, "
           f"ctx map<string, {CONTEXT}>, env map<string, double>")
ACCOUNTS = ("login bigint, server string, company string, currency string, balance double, equity double, profit double, margin double, "
            "margin_free double, margin_level double, leverage int, account_allowed boolean")
POSITIONS = ("login bigint, ticket bigint, symbol string, side int, volume double, price_open double, price_current double, sl double, "
             "tp double, profit double, swap double, time bigint")
EVENTS = ("release_ts timestamp, currency string, title string, impact string, forecast string, previous string, actual string, "
          "source string, source_url string")
RATES = "currency string, obs_date date, rate double, source string, stale boolean"
POSITIONING = ("market string, report_date string, noncomm_long bigint, noncomm_short bigint, comm_long bigint, comm_short bigint, "
               "open_interest bigint")

# the driver's tables
DRIVER = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}
