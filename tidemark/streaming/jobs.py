"""Ticks to bars to indicators as Structured Streaming queries, with the same results as the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.dims import ADX_PERIOD, ATR_PERIOD, CADENCE_SEC, RSI_PERIOD, TF_SECONDS, TREND_EMA_PERIOD
from tidemark.operators.bars import arrival_key


def tick_stream(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """File-drop source. Zone-free timestamps are UTC and are cast, since a watermark needs zoned time."""
    reader = spark.readStream.schema(schema).format(options.pop("format", "parquet"))
    raw = reader.options(**options).load(path)
    return raw.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
        for f in raw.schema.fields])


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Newest tick per symbol; run in update mode."""
    at = arrival_key(F.col("ts"), F.col("seq"))
    return ticks.groupBy("symbol").agg(*[F.max_by(c, at).alias(c) for c in ("price", "ts", "seq")])


def closed_bar_stream(ticks: DataFrame, tf: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling bars; append mode emits a bar once the watermark has passed its end, so it can never change."""
    at = arrival_key(F.col("ts"), F.col("seq"))
    windowed = ticks.withWatermark("ts", late).groupBy(
        "symbol", F.window("ts", f"{TF_SECONDS[tf]} seconds").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("tick_volume"))
    return windowed.select("symbol", F.lit(tf).alias("tf"), F.col("w.start").alias("bar_time"),
                           "open", "high", "low", "close", "tick_volume")


def split_late(ticks: DataFrame, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch, so late rows can be kept instead of silently dropped."""
    late = F.col("ts") < watermark
    return ticks.where(~late), ticks.where(late)


# ------------------------------------------------------------------------------------------------ causal indicators

#: Versions that a sink of latest rows leaves behind.
KEPT_VERSIONS = 2
INDICATOR_SCHEMA = (
    "symbol string, tf string, bar_time timestamp, close double, ema double, atr double, rsi double, di_plus double, di_minus double, adx double")
STATE_SCHEMA = "n bigint, high double, low double, close double, ys array<double>"
_PERIODS = (TREND_EMA_PERIOD, ATR_PERIOD, RSI_PERIOD, RSI_PERIOD, ADX_PERIOD, ADX_PERIOD, ADX_PERIOD, ADX_PERIOD)
_FIRST = (0, 0, 1, 1, 1, 1, 1, 1)
_ALPHA = (2.0 / (TREND_EMA_PERIOD + 1), *(1.0 / p for p in _PERIODS[1:]))


def _advance(y: float, x: float, i: int, k: int) -> float:
    """One step of recurrence ``k`` at bar ``i``: accumulate the mean while seeding, then decay."""
    if i < _FIRST[k]:
        return 0.0
    if i < _FIRST[k] + _PERIODS[k]:
        return y + x / _PERIODS[k]
    return y + _ALPHA[k] * (x - y)


def _extend(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, ph, pl, pc, ys = state.get if state.exists else (0, 0.0, 0.0, 0.0, [0.0] * 8)
    ys = list(ys)
    rows = pd.concat(list(batches)).sort_values("bar_time")
    out = []
    for t, h, lo, c in zip(rows["bar_time"], rows["high"].tolist(), rows["low"].tolist(), rows["close"].tolist()):
        tr = h - lo if n == 0 else max(h - lo, abs(h - pc), abs(lo - pc))
        diff, up, down = (0.0, 0.0, 0.0) if n == 0 else (c - pc, h - ph, pl - lo)
        xs = (c, tr, max(diff, 0.0), max(-diff, 0.0), up if up > down and up > 0 else 0.0,
              down if down > up and down > 0 else 0.0, tr)
        for k, x in enumerate(xs):
            ys[k] = _advance(ys[k], x, n, k)
        ready = n >= ADX_PERIOD
        dip = dim = None
        if ready and ys[6] != 0:
            dip, dim = 100.0 * ys[4] / ys[6], 100.0 * ys[5] / ys[6]
        dx = 100.0 * abs(dip - dim) / (dip + dim) if dip is not None and dip + dim > 0 else 0.0
        ys[7] = _advance(ys[7], dx, n, 7)
        rsi = None
        if n >= RSI_PERIOD:
            rsi = 100.0 if ys[3] == 0 else 100.0 - 100.0 / (1.0 + ys[2] / ys[3])
        out.append((*key, t, c, ys[0] if n >= TREND_EMA_PERIOD - 1 else None, ys[1] if n >= ATR_PERIOD - 1 else None,
                    rsi, dip, dim, ys[7] if ready else None))
        n, ph, pl, pc = n + 1, h, lo, c
    state.update((n, ph, pl, pc, ys))
    yield pd.DataFrame(out, columns=[f.split()[0] for f in INDICATOR_SCHEMA.split(", ")])


def indicator_stream(bars: DataFrame) -> DataFrame:
    """Indicators of closed bars as they arrive; state per series is one number per recurrence.

    Values equal the batch job's. The length rule of the batch job (no ADX below 29 bars) cannot be known ahead of a
    stream, so ADX and DI appear as soon as they are defined.
    """
    return bars.groupBy("symbol", "tf").applyInPandasWithState(
        _extend, outputStructType=INDICATOR_SCHEMA, stateStructType=STATE_SCHEMA, outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------------------------------------ setup alerts

ALERT_SCHEMA = "symbol string, cls string, score double, at timestamp"


def _alert(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")  # the scores of one symbol in one trigger
    seeded, previous = (True, state.get[0]) if state.exists else (False, None)
    out = []
    for at, cls, score in zip(rows["at"], rows["cls"], rows["score"]):
        active = cls not in ("na", "neutral") and abs(score) >= 5.0
        if seeded and active and cls != previous:
            out.append((*key, cls, score, at))
        previous, seeded = (cls if active else None), True
    state.update((previous,))
    yield pd.DataFrame(out, columns=["symbol", "cls", "score", "at"])


def setup_alerts(scores: DataFrame) -> DataFrame:
    """A row whenever a symbol newly shows a high-conviction class; the first sighting only seeds."""
    return scores.groupBy("symbol").applyInPandasWithState(
        _alert, outputStructType=ALERT_SCHEMA, stateStructType="cls string", outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------------------------------------ sinks

def upsert_latest(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: latest row per key, versioned by batch; a replayed batch rewrites its own version.

    Each version is a complete table under ``path/version=<batch>``; readers take the newest. The table has one row per
    key, so rewriting it is bounded by the number of keys. The newest ``KEPT_VERSIONS`` stay, for readers that have begun.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        held = latest_version(spark, path, before=epoch)
        if held is not None:
            both = held.select(*newest.columns).unionByName(newest)
            newest = both.groupBy(key).agg(F.max_by(F.struct(*newest.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        drop_old_versions(spark, path)

    return write


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Remove all but the newest ``KEPT_VERSIONS`` complete versions under ``path``."""
    fs, versions = _versions(spark, path)
    for old in versions[:-KEPT_VERSIONS]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)


def _versions(spark: SparkSession, path: str) -> tuple[Any, list[int]]:
    """The file system of ``path``, and the complete versions there, found by their success markers, oldest first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    return fs, sorted(int(str(m.getPath().getParent().getName()).split("=")[1]) for m in (marks or []))


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest complete version written by :func:`upsert_latest`."""
    versions = [v for v in _versions(spark, path)[1] if before is None or v < before]
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what has landed into parquet files and stop."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(upsert_latest(path, key, order)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start_domain(stream: DataFrame, domain: str, path: str, checkpoint: str, key: str, order: str):
    """One continuously running query per domain at that domain's own cadence."""
    every = f"{int(CADENCE_SEC[domain] * 1000)} milliseconds"
    return stream.writeStream.queryName(domain).outputMode("update").foreachBatch(upsert_latest(path, key, order)).option(
        "checkpointLocation", checkpoint).trigger(processingTime=every).start()
