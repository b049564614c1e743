"""The domains of the full snapshot, each as documents that are read back and summed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import accounts, calendar, macro, market, signals, trading
from tidemark.sources import snapshot as N

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Domain -> the query whose rows it shows, how its documents are keyed, and a number of each row that is summed after reading back.
SOURCES = {
    "status": ("account_snapshots", N.Domain("login"), "open_count"),
    "price": ("latest_tick_per_symbol", N.Domain("symbol"), "last"),
    "performance": ("trade_range_summary", N.Domain("range_label"), "net_profit"),
    "calendar": ("calendar_display", N.Domain("date_jst", ("release_ts", "title"), 3), "release_ts"),
    "macro": ("policy_rates", N.Domain("currency"), "rate"),
    "real_yield": ("real_yield_trend", N.Domain("currency"), "value"),
    "dollar_index": ("index_card", N.Domain("symbol"), "price"),
    "oscillator_m15": ("oscillator_m15", N.Domain("symbol", ("bar_time",)), "dev_price"),
    "oscillator_h1": ("oscillator_h1_deep", N.Domain("symbol", ("bar_time",)), "dev_price"),
    "positioning": ("positioning_snapshot", N.Domain("market"), "net"),
    "symbol_metadata": ("symbol_metadata", N.Domain("base", ("key",), 20), "point"),
}


def _module(name: str):
    """The module that registers a query."""
    return next(m for m in (accounts, calendar, macro, market, signals, trading) if name in m.QUERIES)


def _register(domain: str) -> None:
    source, described, number = SOURCES[domain]
    module = _module(source)

    def run(spark, sf_dir):
        rows = module.QUERIES[source](spark, sf_dir)
        documents = N.snapshot({domain: rows}, {domain: described})
        back = N.read_blocks(documents, domain, rows.schema)
        return back.groupBy(F.lit(domain).alias("domain"), F.col("_key").alias("key")).agg(
            F.first("_n").alias("n"), F.count(F.lit(1)).alias("shown"), F.round(F.sum(F.col(number).cast("double")), 4).alias("total"))

    run.__doc__ = f"Rows of {source} as documents of the domain {domain}, read back."
    by = ", ".join(f"{c} DESC" for c in described.newest) or "1"
    QUERIES[f"snapshot_{domain}"] = run
    SQL[f"snapshot_{domain}"] = f"""WITH q AS ({module.SQL[source]}),
r AS (SELECT coalesce(CAST({described.key} AS VARCHAR), 'null') AS key, CAST({number} AS DOUBLE) AS v,
  row_number() OVER (PARTITION BY {described.key} ORDER BY {by}) AS rk FROM q)
SELECT '{domain}' AS domain, key, count(*) AS n, count(*) FILTER (WHERE rk <= {described.most}) AS shown,
  round(sum(v) FILTER (WHERE rk <= {described.most}), 4) AS total FROM r GROUP BY key"""


for _domain in SOURCES:
    _register(_domain)
