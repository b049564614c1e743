"""Sinks that account for every row: bars with their late ticks, landed JSON with its broken lines, and change counters.

Each sink keeps what it must remember in versions by batch. A batch reads the newest version before its own and rewrites its own outputs, so
a batch that is replayed after a failure gives the same files and counts as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.dims import TF_SECONDS
from tidemark.operators.bars import arrival_key
from tidemark.streaming.jobs import drop_old_versions, latest_version

Sink = Callable[[DataFrame, int], None]


def drained(stream: DataFrame, sink: Sink, checkpoint: str) -> int:
    """Hand what has landed to the sink in batches, stop, and give the rows that the query itself says it read."""
    query: StreamingQuery = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def read_epochs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All epochs written under ``path``; none yet is an empty table if its schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/epoch=*")


# ------------------------------------------------------------------------------------------------ bars and late ticks

_PARTS = ("first", "open", "high", "low", "last", "close", "tick_volume")


def _combined(parts: DataFrame) -> DataFrame:
    """Merge the unfinished bars of a (symbol, bar): the open of the first part, the close of the last."""
    return parts.groupBy("symbol", "bar_time").agg(
        F.min("first").alias("first"), F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last").alias("last"), F.max_by("close", "last").alias("close"), F.sum("tick_volume").alias("tick_volume"))


def bars_and_late_ticks(path: str, tf: str, delay: str = "10 minutes") -> Sink:
    """Closed bars to ``path/bars``, ticks of bars closed before they came to ``path/late``, and a row of counts a batch to ``path/counts``.

    One watermark rules both: the newest tick of the batches before, less ``delay``. A tick is late if its bar had ended by then; all others
    join the unfinished bars, of which those that end by the new watermark are closed for good. On-time and late ticks add up to the input.
    Ticks without a symbol are a symbol of their own, ticks without a time are late.
    """
    seconds = TF_SECONDS[tf]
    end = F.expr(f"INTERVAL {seconds} SECONDS")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = latest_version(spark, f"{path}/open", before=epoch)
        known = latest_version(spark, f"{path}/newest", before=epoch)
        newest = known.first()["newest"] if known is not None else None  # one row
        bar = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
        mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.col("ts").isNull() | F.coalesce(F.col("bar_time") + end <= mark, F.lit(False))
        seen = Observation(f"ticks-{epoch}")
        marked = batch.withColumn("bar_time", bar).withColumn("_late", late).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if("_late").alias("late"), F.max("ts").alias("newest"))
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{path}/split/epoch={epoch}")  # one pass over the batch
        counts = seen.get
        newest = max((t for t in (newest, counts["newest"]) if t is not None), default=None)
        split = spark.read.schema(marked.schema).parquet(f"{path}/split/epoch={epoch}")
        split.where("_late").drop("_late", "bar_time").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        at = arrival_key(F.col("ts"), F.col("seq"))
        fresh = split.where("NOT _late").groupBy("symbol", "bar_time").agg(
            F.min(at).alias("first"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max(at).alias("last"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("tick_volume"))
        merged = _combined(held.select(*fresh.columns).unionByName(fresh)) if held is not None else fresh
        closed = F.coalesce(F.col("bar_time") + end <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        merged.where(closed).select("symbol", F.lit(tf).alias("tf"), "bar_time", "open", "high", "low", "close", "tick_volume").write.mode(
            "overwrite").parquet(f"{path}/bars/epoch={epoch}")
        merged.where(~closed).write.mode("overwrite").parquet(f"{path}/open/version={epoch}")
        spark.createDataFrame([(epoch, counts["n"], counts["n"] - counts["late"], counts["late"])],
                              "batch bigint, n bigint, on_time bigint, late bigint").write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
        spark.createDataFrame([(newest,)], "newest timestamp").write.mode("overwrite").parquet(f"{path}/newest/version={epoch}")
        for kept in ("open", "newest"):
            drop_old_versions(spark, f"{path}/{kept}")

    return write


# ------------------------------------------------------------------------------------------------ landed JSON

BAD = "_bad"


def json_stream(spark: SparkSession, path: str, schema: str, *, clean: str | None = None, archive: str | None = None, **options: str) -> DataFrame:
    """JSON files as they land. ``_bad`` holds the text of a record that is no JSON object of this schema.

    ``schema`` may have grown since earlier runs: fields that a file lacks are null, and fields that it has beyond them are ignored until the
    schema names them. ``clean`` is ``archive`` or ``delete`` for files that are done; ``archive`` is where they go.
    """
    reader = spark.readStream.schema(f"{schema}, {BAD} string").format("json").option("columnNameOfCorruptRecord", BAD)
    if clean:
        reader = reader.option("cleanSource", clean)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    return reader.options(**options).load(path)


def good_and_quarantined(path: str) -> Sink:
    """Records to ``path/good`` and the text of broken ones to ``path/quarantine``, both by batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_broken", F.col(BAD).isNotNull()).write.mode("overwrite").partitionBy("_broken").parquet(f"{path}/split/epoch={epoch}")
        split = batch.sparkSession.read.schema(batch.withColumn("_broken", F.lit(True)).schema).parquet(f"{path}/split/epoch={epoch}")
        split.where("NOT _broken").drop("_broken", BAD).write.mode("overwrite").parquet(f"{path}/good/epoch={epoch}")
        split.where("_broken").select(F.col(BAD).alias("text")).write.mode("overwrite").parquet(f"{path}/quarantine/epoch={epoch}")

    return write


# ------------------------------------------------------------------------------------------------ change counters

def change_counters(path: str, heavy: Collection[str], order: str | Column = "seq") -> Sink:
    """Versions per (domain, key) that rise only when the content does, under ``path/version=<batch>``.

    The batch has domain, key, payload and the order column. ``version`` counts every change, ``heavy_version`` those of heavy domains, from
    which a reader tells whether a light message will do. Within a batch each change along the order counts; a payload equal to the one before
    raises nothing. A replayed batch starts from the version before it. The table has one row per (domain, key).
    """
    at = F.col(order) if isinstance(order, str) else order

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("domain", "key", F.lit(True).alias("_new"), at.alias("_at"), F.xxhash64("payload").alias("content_hash"))
        held = latest_version(spark, path, before=epoch)
        if held is not None:  # what is held comes before all rows of the batch
            rows = rows.unionByName(held.select("domain", "key", F.lit(False).alias("_new"), F.lit(None).cast(rows.schema["_at"].dataType).alias("_at"), "content_hash"))
        along = F.struct("_new", "_at", "content_hash")
        w = Window.partitionBy("domain", "key").orderBy(along)
        same = F.coalesce(F.lag("content_hash").over(w) == F.col("content_hash"), F.lit(False))
        changed = rows.withColumn("_rise", (F.col("_new") & ~same).cast("bigint")).groupBy("domain", "key").agg(
            F.sum("_rise").alias("_rise"), F.max_by("content_hash", along).alias("content_hash"))
        zero = F.lit(0).cast("bigint")
        held = held if held is not None else changed.select("domain", "key", zero.alias("version"))
        old = held.select(F.struct("domain", "key").alias("_of"), "version")  # null keys are equal
        out = changed.join(old, F.struct("domain", "key") == F.col("_of"), "left").select(
            "domain", "key", "content_hash", (F.coalesce("version", zero) + F.col("_rise")).alias("version"))
        out = out.withColumn("heavy_version", F.when(F.col("domain").isin(*heavy), F.col("version")).otherwise(zero))
        out.write.mode("overwrite").parquet(f"{path}/version={epoch}")
        drop_old_versions(spark, path)

    return write


def counters(table: DataFrame) -> DataFrame:
    """One row: the counter of all changes and that of heavy domains."""
    return table.agg(F.coalesce(F.sum("version"), F.lit(0)).alias("version"), F.coalesce(F.sum("heavy_version"), F.lit(0)).alias("heavy_version"))
