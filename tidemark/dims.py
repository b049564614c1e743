"""Specification tables, keyword lists, clock times and thresholds.

Everything here must equal the published behaviour for results to agree, so it is kept as plain literals in one place.
"""

from __future__ import annotations

# --- timeframes: label -> (seconds, trend EMA period, bars read per refresh, composite weight, display rank)
TF_SECONDS = {"D1": 86400, "H4": 14400, "H1": 3600, "M15": 900, "M1": 60}
TF_DEPTH = {"D1": 400, "H4": 300, "H1": 240, "M15": 200}
TF_WEIGHT = {"D1": 3.0, "H4": 2.0, "H1": 1.5, "M15": 1.0}
TF_RANK = {"D1": 0, "H4": 1, "H1": 2, "M15": 3}
TREND_EMA_PERIOD = 20
RSI_PERIOD = ATR_PERIOD = ADX_PERIOD = 14

# --- oscillator modes: name -> (timeframe, (fast, mid, center), live depth, live display, deep depth, deep display)
OSC_MODES = {
    "M15": ("M15", (20, 80, 320), 1500, 480, 20000, 20000),
    "H1": ("H1", (20, 80, 480), 3000, 480, 20000, 20000),
}
BAND_PERCENTILES = (0.90, 0.95, 0.99)

# --- dollar index card
INDEX_NAMES = ("USDX", "DXY", "USDIDX", "USDOLLAR")
INDEX_PREFIX = "DXY"
INDEX_BARS = 120
INDEX_EMA_PERIOD = 20
SPARKLINE_CLOSES = 60
FUTURES_MONTH_CODES = {"F": 1, "G": 2, "H": 3, "J": 4, "K": 5, "M": 6, "N": 7, "Q": 8, "U": 9, "V": 10, "X": 11, "Z": 12}

# --- price units
DEFAULT_PIP_PRICE = 0.10
PIP_PRICE = {
    "XAUUSD": 0.10,
    "USDJPY": 0.01, "EURJPY": 0.01, "GBPJPY": 0.01, "AUDJPY": 0.01,
    "EURUSD": 0.0001, "GBPUSD": 0.0001, "AUDUSD": 0.0001,
}

# --- trade history ranges (label, days; None = all time)
HISTORY_RANGES = (("24h", 1), ("7d", 7), ("30d", 30), ("90d", 90), ("180d", 180), ("1Y", 365), ("all", None))
DEFAULT_RANGE_DAYS = 90

# --- deal codes
DEAL_BUY, DEAL_SELL, DEAL_BALANCE = 0, 1, 2
ENTRY_IN, ENTRY_OUT, ENTRY_INOUT = 0, 1, 2

# --- bin edges (inner thresholds)
R_MULTIPLE_BINS = (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0)
ADX_BINS = (20.0, 25.0, 30.0)
RSI_BINS = (30.0, 50.0, 70.0)
HOLD_MINUTE_BINS = (15.0, 60.0, 240.0)
WEEKDAYS_JA = ("月", "火", "水", "木", "金", "土", "日")

# --- sizing and risk
LOT_EQUITY_STEP, LOT_MIN, LOT_MAX = 100_000.0, 0.01, 10.0
DAILY_LOSS_LIMIT_PCT, MAX_DRAWDOWN_LIMIT_PCT = 3.0, 10.0
PIP_VALUE_PER_LOT = 10.0
MIN_EDGE_SAMPLE, LOW_SAMPLE = 20, 5

# --- macro
SECONDARY_WINDOW_DAYS = 7
FIAT_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "AUD", "CHF", "NZD")
REAL_YIELD_POINTS = 60
REAL_YIELD_DEAD_BAND = 0.02
COT_WEEKS = 52
COT_EXTREME_HIGH, COT_EXTREME_LOW = 90.0, 10.0

# --- broker server zones that observe summer time
SERVER_ZONES = {"ICMarketsSC-MT5-3": "Europe/Bucharest", "TitanFX-MT5-01": "Europe/Athens"}
OFFSET_TOLERANCE_SEC = 180
OFFSET_MIN_SEC, OFFSET_MAX_SEC = -12 * 3600, 14 * 3600

# --- calendar
IMPACT_ALLOWED = ("High",)
EVENT_KEYWORDS = (
    "fomc", "federal funds rate", "bank rate", "cash rate", "policy rate",
    "refinancing rate", "rate statement", "rate decision", "monetary policy",
    "interest rate", "press conference",
    "employment", "non-farm", "nonfarm", "payroll", "unemployment",
    "jobless", "hourly earnings", "earnings index", "claimant count",
    "jolts", "adp",
)
CATEGORY_EMPLOYMENT = (
    "payroll", "nonfarm", "non-farm", "employment", "unemploy", "jobless",
    "hourly earnings", "earnings index", "claimant count", "jolts", "adp",
)
CATEGORY_RATE = (
    "fomc", "federal funds rate", "bank rate", "cash rate", "policy rate",
    "refinanc", "rate statement", "rate decision", "monetary policy",
    "interest rate", "press conference",
)
TITLE_RATE_KEYWORDS = (
    "fomc", "ecb", "boe", "boj", "rba", "governing council", "mpc",
    "bank rate", "cash rate", "rate decision", "rate statement",
    "monetary policy", "interest rate", "federal funds", "refinancing",
    "policy rate",
)
TITLE_ADP = "ADP雇用統計"
TITLE_PAYROLL = "米雇用統計 (NFP)"
TITLE_UNEMPLOYMENT = "失業率"
TITLE_PRESS = "中銀総裁会見"
TITLE_RATE_DEFAULT = "政策金利発表"
TITLE_RATE_BY_CURRENCY = {
    "USD": "FOMC 政策金利発表",
    "EUR": "ECB 政策金利発表",
    "GBP": "BoE 政策金利発表",
    "JPY": "日銀 金融政策決定会合",
    "AUD": "RBA 政策金利発表",
}
UNTIMED = ("all day", "tentative", "", "n/a", "day 1", "day 2")
DISPLAY_COUNT = 12
WARNING_WINDOW_SEC = 1800
UPCOMING_COUNT = 3
FALLBACK_AFTER_FAILURES = 2
SOURCE_HOSTS = (
    "forexfactory.com", "www.forexfactory.com",
    "federalreserve.gov", "www.federalreserve.gov",
    "bls.gov", "www.bls.gov",
    "ecb.europa.eu", "www.ecb.europa.eu",
    "bankofengland.co.uk", "www.bankofengland.co.uk",
    "boj.or.jp", "www.boj.or.jp",
    "rba.gov.au", "www.rba.gov.au",
)

# --- central-bank schedules: currency, title, zone, hour, minute, link, decision dates
BANK_SCHEDULES = (
    ("USD", "FOMC Meeting (rate decision)", "America/New_York", 14, 0,
     "https://www.federalreserve.gov/monetarypolicy/fomccalendars.htm",
     ("2026-01-28", "2026-03-18", "2026-04-29", "2026-06-17", "2026-07-29",
      "2026-09-16", "2026-10-28", "2026-12-09",
      "2027-01-27", "2027-03-17", "2027-04-28", "2027-06-09", "2027-07-28",
      "2027-09-15", "2027-10-27", "2027-12-08")),
    ("EUR", "ECB Governing Council (rate decision)", "Europe/Berlin", 14, 15,
     "https://www.ecb.europa.eu/press/govcdec/html/index.en.html",
     ("2026-01-29", "2026-03-12", "2026-04-23", "2026-06-04",
      "2026-07-23", "2026-09-10", "2026-10-29", "2026-12-17")),
    ("GBP", "BoE MPC (Bank Rate decision)", "Europe/London", 12, 0,
     "https://www.bankofengland.co.uk/monetary-policy",
     ("2026-02-05", "2026-03-19", "2026-05-07", "2026-06-18",
      "2026-08-06", "2026-09-17", "2026-11-05", "2026-12-17")),
    ("JPY", "BoJ Monetary Policy Meeting (rate decision)", "Asia/Tokyo", 12, 0,
     "https://www.boj.or.jp/en/mopo/mpmdeci/index.htm",
     ("2026-01-23", "2026-03-19", "2026-04-28", "2026-06-17",
      "2026-07-31", "2026-09-19", "2026-10-29", "2026-12-18")),
    ("AUD", "RBA Cash Rate decision", "Australia/Sydney", 14, 30,
     "https://www.rba.gov.au/monetary-policy/int-rate-decisions/",
     ("2026-02-18", "2026-04-01", "2026-05-06", "2026-07-01",
      "2026-08-05", "2026-09-23", "2026-11-04", "2026-12-09")),
)
PAYROLL_TITLE = "Non-Farm Payrolls (Employment Situation)"
PAYROLL_LINK = "https://www.bls.gov/news.release/empsit.toc.htm"
PAYROLL_CLOCK = ("America/New_York", 8, 30)

# --- reporting clock: UTC+9 all year
JST_SECONDS = 9 * 3600

# --- specified structure levels
SESSIONS_JST = (("asia", 7, 16), ("europe", 16, 22), ("newyork", 21, 30))
ROUND_STEP_DEFAULT, ROUND_STEP_GOLD, ROUND_STEP_YEN, ROUND_STEP_MAJOR = 50.0, 50.0, 0.5, 0.01
CONFLUENCE_ATR = 0.3
TOUCH_TIERS_ATR = (0.1, 0.3, 0.5)
STRENGTH_WINDOWS_SEC = {"H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800}
CORRELATION_WINDOWS = (20, 100, 500)

# --- labels and patterns of the sources
NO_DIRECTION = "—"
GOLD_RATES_UP, GOLD_RATES_DOWN = "米金利上昇=金に逆風", "米金利低下=金に追風"
RATE_ADVANTAGE, NO_RATE_GAP = "金利優位", "金利差なし"
HTML_ROW = r"(?i)(\d{4}/\d{2}/\d{2})\s*</[^>]+>\s*<[^>]+>\s*(-?\d+(?:\.\d+)?|NA)"
API_KEY = "(api_key=)[^&\\s\"']+"
SLUG_REST = "[^A-Za-z0-9._-]+"
FUTURES_NAME = "_([FGHJKMNQUVXZ])(\\d{1,2})$"

# --- refresh cadence per domain, in seconds
CADENCE_SEC = {"price": 0.5, "analysis": 5.0, "history": 60.0, "calendar": 3600.0, "macro": 21600.0, "live_yield": 30.0}
