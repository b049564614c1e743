from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "scripts"))

from tidemark.session import local_session  # noqa: E402

UTC = dt.timezone.utc
START = dt.datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


def stamp(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def make_bars(spark, closes, tf="H1", symbol="XAUUSD", spread=0.2, highs=None, lows=None, start=START, step=None, skip=()):
    seconds = step or {"D1": 86400, "H4": 14400, "H1": 3600, "M15": 900, "M1": 60}[tf]
    rows = []
    for i, c in enumerate(closes):
        if i in skip:
            continue
        hi = c + spread if highs is None else highs[i]
        lo = c - spread if lows is None else lows[i]
        rows.append((symbol, tf, start + dt.timedelta(seconds=seconds * i), float(c), float(hi), float(lo), float(c), 1))
    return spark.createDataFrame(
        rows, "symbol string, tf string, bar_time timestamp, open double, high double, low double, close double, tick_volume bigint")
