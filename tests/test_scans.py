"""What reaches the file scan, and statistics over symbols that trade on different grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import make_bars

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.structure import correlation_matrix

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bars_in_range", "deals_in_window"])
def test_time_bounds_reach_the_scan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_correlation_over_unequal_grids(spark):
    rng = np.random.default_rng(4)
    hourly, slow = 100 + rng.normal(size=3000).cumsum() * 0.1, 50 + rng.normal(size=750).cumsum() * 0.1
    bars = make_bars(spark, hourly, symbol="A").unionByName(make_bars(spark, slow, symbol="B", step=4 * 3600))
    got = {(r.bars, r.symbol_a, r.symbol_b): r["corr"] for r in correlation_matrix(bars, ["A", "B"], (20, 500)).collect()}
    a = pd.Series(hourly).pct_change()
    b = pd.Series(slow, index=np.arange(750) * 4).pct_change()
    both = pd.concat([a, b], axis=1, keys=["a", "b"]).dropna()
    for n in (20, 500):
        assert got[n, "A", "B"] == pytest.approx(both.tail(n).corr().iloc[0, 1], abs=1e-9)
    assert len(got) == 8


def test_correlation_reads_back_as_far_as_needed(spark):
    """A long history, a symbol with gaps and one that starts late: the newest common times only, whatever the reach."""
    import numpy as np

    rng = np.random.default_rng(8)
    closes = {s: 100 + np.cumsum(rng.normal(size=3000)) for s in "ABC"}
    keep = {"A": range(3000), "B": [i for i in range(3000) if i % 3 or i < 200], "C": range(1500, 3000)}
    rows = [(s, "H1", i, float(closes[s][i])) for s in "ABC" for i in keep[s]]
    bars = spark.createDataFrame(rows, "symbol string, tf string, i bigint, close double").select("symbol", "tf", F.timestamp_seconds(F.col("i") * 3600).alias("bar_time"), "close")
    got = {(r.bars, r.symbol_a, r.symbol_b): r["corr"] for r in correlation_matrix(bars, ["A", "B", "C"], (10, 400, 5000)).collect()}
    returns = {}
    for s in "ABC":
        own = list(keep[s])
        returns[s] = {b: closes[s][b] / closes[s][a] - 1 for a, b in zip(own, own[1:])}
    common = sorted(set(returns["A"]) & set(returns["B"]) & set(returns["C"]), reverse=True)
    for n in (10, 400, 5000):
        x = np.array([[returns[s][t] for t in common[:n]] for s in "ABC"])
        want = np.corrcoef(x)
        for i, a in enumerate("ABC"):
            for j, b in enumerate("ABC"):
                assert abs(got.pop((n, a, b)) - want[i, j]) < 1e-9
    assert not got
