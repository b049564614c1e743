"""Distributed ordered operators against plain loops, with one key holding most rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import UTC
from pyspark.sql import functions as F

from tidemark.operators.ordering import asof_join, order_blocks, running_last, running_totals
from tidemark.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n)),
        "t": rng.integers(0, 900, n).astype(float), "id": rng.permutation(n), "v": rng.integers(-5, 6, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_running_totals_and_peaks(spark, skewed, blocks):
    pdf, df = skewed
    out = running_totals(order_blocks(df, "t", "id", blocks), ["k"], ["t", "id"], {"s": F.col("v")},
                         {"p": ("s", F.col("v") > 0)}, inclusive_peaks=False).toPandas().sort_values(["k", "t", "id"])
    want = pdf.sort_values(["k", "t", "id"]).copy()
    want["s"] = want.groupby("k")["v"].cumsum()
    want["q"] = want["s"].where(want["v"] > 0)
    want["p"] = want.groupby("k")["q"].transform(lambda c: c.cummax().ffill().shift())
    assert np.allclose(out["s"], want["s"])
    assert np.allclose(out["p"].to_numpy(float), want["p"].to_numpy(float), equal_nan=True)


def test_one_instant_holding_most_rows_is_cut_by_the_tie(spark):
    rng = np.random.default_rng(3)
    n = 3000
    t = np.where(rng.random(n) < 0.6, 50.0, rng.integers(0, 100, n)).astype(float)
    pdf = pd.DataFrame({"t": t, "id": rng.permutation(n), "v": rng.integers(-5, 6, n).astype(float)})
    df = spark.createDataFrame(pdf)
    blocked = order_blocks(df, "t", "id", 20)
    sizes = blocked.groupBy("_block").count().toPandas()["count"]
    assert sizes.max() < n / 5
    seq = blocked.toPandas().sort_values(["t", "id"])["_block"]
    assert seq.is_monotonic_increasing
    out = running_totals(blocked, [], ["t", "id"], {"s": F.col("v")}, {"p": ("s", F.lit(True))}).toPandas().sort_values(["t", "id"])
    want = pdf.sort_values(["t", "id"])["v"].cumsum()
    assert np.allclose(out["s"], want) and np.allclose(out["p"], want.cummax())


def test_empty_input_has_blocks(spark):
    empty = spark.createDataFrame([], "t double, id bigint, v double")
    assert running_totals(order_blocks(empty, "t", "id"), [], ["t", "id"], {"s": F.col("v")}).count() == 0


def test_running_totals_without_keys(spark, skewed):
    pdf, df = skewed
    out = running_totals(order_blocks(df, "t", "id"), [], ["t", "id"], {"s": F.col("v")}).toPandas().sort_values(["t", "id"])
    assert np.allclose(out["s"], pdf.sort_values(["t", "id"])["v"].cumsum())


def test_running_last(spark, skewed):
    pdf, df = skewed
    blocked = order_blocks(df, "t", "id", 16)
    val = F.when(F.col("v") > 3, F.col("v"))
    out = running_last(blocked, ["k"], ["t", "id"], val, "last").toPandas().sort_values(["k", "t", "id"])
    want = pdf.sort_values(["k", "t", "id"]).copy()
    want["last"] = want["v"].where(want["v"] > 3).groupby(want["k"]).ffill()
    assert np.allclose(out["last"].to_numpy(float), want["last"].to_numpy(float), equal_nan=True)
    lag = running_last(blocked, ["k"], ["t", "id"], F.col("v"), "lag", inclusive=False).toPandas().sort_values(["k", "t", "id"])
    assert np.allclose(lag["lag"].to_numpy(float), want.groupby("k")["v"].shift().to_numpy(float), equal_nan=True)


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(2)
    base = pd.Timestamp("2026-01-01", tz="UTC")
    left = pd.DataFrame({"id": range(800), "k": np.where(rng.random(800) < 0.8, "hot", "cold"),
                         "at": base + pd.to_timedelta(rng.integers(0, 5000, 800), unit="s")})
    right = pd.DataFrame({"k": ["hot"] * 60 + ["cold"] * 5, "rt": base + pd.to_timedelta(
        np.r_[np.sort(rng.choice(5000, 60, replace=False)), [10, 11, 12, 3000, 4000]], unit="s"), "val": range(65)})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "at", "rt", ["val"], tie="id").toPandas()
    want = pd.merge_asof(left.sort_values("at"), right.sort_values("rt"), left_on="at", right_on="rt", by="k")
    assert got.sort_values("id")["val"].to_numpy(float) == pytest.approx(want.sort_values("id")["val"].to_numpy(float), nan_ok=True)
    assert len(got) == 800


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=5000), np.repeat([1.0, 2.0, 2.0, 3.0], 700), np.array([4.0]), np.arange(101.0)])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    names = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(df, ["g"], "v", names).first()
    assert [got[n] for n in names] == pytest.approx(np.percentile(values, [p * 100 for p in names.values()]).tolist(), rel=1e-12)


def test_percentiles_survive_coarse_bins(spark):
    v = np.random.default_rng(9).exponential(size=6000)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": v}))
    got = exact_percentiles(df, ["g"], "v", {"a": 0.9, "b": 0.05}, distinct=50, bins=8).first()
    assert [got.a, got.b] == pytest.approx(np.percentile(v, [90, 5]).tolist(), rel=1e-12)


def test_time_order_is_exact_for_microseconds(spark):
    t0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
    left = spark.createDataFrame([(1, "k", t0 + dt.timedelta(microseconds=5)), (2, "k", t0)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("k", t0 + dt.timedelta(microseconds=4), 7)], "k string, rt timestamp, val int")
    got = {r.id: r.val for r in asof_join(left, right, ["k"], "at", "rt", ["val"], tie="id").collect()}
    assert got == {1: 7, 2: None}


def test_null_keys_and_times_keep_their_rows(spark):
    t0 = dt.datetime(2026, 1, 1, tzinfo=UTC)
    left = spark.createDataFrame([(1, "k", t0), (2, None, t0), (3, "k", None), (4, None, None)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("k", t0, 7), (None, t0, 8), ("k", None, 9)], "k string, rt timestamp, val int")
    got = {r.id: r.val for r in asof_join(left, right, ["k"], "at", "rt", ["val"], tie="id").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}
    rows = [(None if i % 2 else "a", None if i == 4 else float(i), i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t double, id bigint, v double")
    for blocks in (1, 5):
        blocked = order_blocks(df, "t", "id", blocks)
        out = {r.id: r.s for r in running_totals(blocked, ["k"], ["t", "id"], {"s": F.col("v")}).collect()}
        # a null time comes first
        assert out == {i: (1.0 if i == 4 else (i // 2 + 2.0 if i % 2 == 0 and i < 4 else i // 2 + 1.0)) for i in range(20)}
        assert running_last(blocked, ["k"], ["t", "id"], F.col("v"), "x").count() == 20


@pytest.mark.parametrize("blocks, times", [(1000, 400), (4096, 1000)])
def test_many_blocks_with_repeated_times(spark, blocks, times):
    n = 20 * times
    df = spark.range(n).select((F.col("id") % times).cast("double").alias("t"), "id", F.lit(1.0).alias("v"))
    out = running_totals(order_blocks(df, "t", "id", blocks), [], ["t", "id"], {"s": F.col("v")})
    # rows of time t come after those of all smaller times, 20 each
    wrong = out.where(F.col("s") != F.col("t") * 20 + F.floor(F.col("id") / times) + 1).count()
    assert wrong == 0 and out.count() == n


def test_blocks_follow_the_rows(spark, monkeypatch):
    from tidemark.operators import ordering
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 100)
    df = spark.range(6000).select(F.col("id").cast("double").alias("t"))
    sizes = order_blocks(df, "t").groupBy("_block").count().toPandas()["count"]
    assert len(sizes) >= 55 and sizes.max() <= 220
