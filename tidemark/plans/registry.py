"""All registered queries in one place."""

from __future__ import annotations

from tidemark.plans import accounts, calendar, landed, live, macro, market, signals, snapshots, structure, trading

_MODULES = (market, trading, signals, macro, calendar, accounts, structure, live, landed, snapshots)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "composite_signal"
