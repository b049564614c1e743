"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (warm median of 3, seconds)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import registry  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "bars_by_timeframe", "indicator_table", "composite_signal", "indicator_history", "oscillator_m15", "disparity_bands_m15",
    "index_card", "closed_trades_fifo", "trade_range_slices", "equity_curve_by_range", "win_loss_streaks", "value_at_risk",
    "edge_breakdown", "trade_excursions", "order_time_context", "policy_rates", "daily_rates_filled", "weekly_positioning_metrics",
    "latest_from_rate_html", "calendar_feed_events", "merged_calendar", "sizing_requests",
)


def once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times = {}
    for name in names:
        once(spark, name, sf_dir)
        times[name] = round(statistics.median(once(spark, name, sf_dir) for _ in range(3)), 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem", "orders", "documents")}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "input_rows": rows}))


if __name__ == "__main__":
    main()
