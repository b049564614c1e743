"""Event feeds as landed XML bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.events import looks_like_feed

EVENT_FIELDS = "title string, country string, date string, time string, impact string, forecast string, previous string, actual string, url string"
EVENT_SCHEMA = f"event array<struct<{EVENT_FIELDS.replace(' string', ': string')}>>"


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """A directory of feed files through the built-in XML source; an empty feed has no rows, a single event has one."""
    return spark.read.schema(EVENT_FIELDS).option("rowTag", "event").xml(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file with its whole text, its path and its arrival time."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("ingest_time"))


def split_feed(bodies: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(event documents, quarantined bodies): a web page answered with status 200 must not pass for an empty week."""
    good = looks_like_feed(F.col(column))
    return bodies.where(good), bodies.where(~good)


def parse_events(bodies: DataFrame, column: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    parsed = bodies.select(*keep, F.explode(F.from_xml(F.col(column), EVENT_SCHEMA)["event"]).alias("_e"))
    return parsed.select(*keep, "_e.*")
