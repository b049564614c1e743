"""Bands documents, chart-line documents, snapshot documents and last-good stores."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.guards import finite_or_null

SIDE = "struct<p90: double, p95: double, p99: double, max: double, n: bigint>"
BANDS_DOCUMENT = (
    "generated_at string, modes map<string, struct<tf: string, periods: array<int>, source: string, "
    f"bands: map<string, struct<pos: {SIDE}, neg: {SIDE}>>>>")

POINT = "array<string>"
LINES_DOCUMENT = (
    "symbol string, updated_at string, lines struct<"
    "horizontal: array<struct<name: string, price: double, color: string>>, "
    f"trendlines: array<struct<name: string, point1: {POINT}, point2: {POINT}, ray_right: boolean, color: string>>, "
    "rectangles: array<struct<name: string, time1: string, time2: string, price_low: double, price_high: double, color: string>>, "
    f"channels: array<struct<name: string, main_point1: {POINT}, main_point2: {POINT}, parallel_anchor: {POINT}, ray_right: boolean, color: string>>, "
    f"fibonacci: array<struct<name: string, point1: {POINT}, point2: {POINT}, levels: array<struct<ratio: double, label: string>>, color: string>>, "
    "texts: array<struct<name: string, time: string, price: double, text: string, color: string>>>")


# ------------------------------------------------------------------------------------------------ bands

def parse_bands(documents: DataFrame, column: str = "body") -> DataFrame:
    """Bands documents -> (mode, period, side, thresholds). Absent, malformed or unknown modes give no rows."""
    doc = documents.select(F.from_json(F.col(column), BANDS_DOCUMENT)["modes"].alias("modes"))
    modes = doc.select(F.explode("modes").alias("mode", "m"))
    bands = modes.select("mode", F.explode("m.bands").alias("ema", "b"))
    sides = bands.select("mode", F.regexp_extract("ema", "(\\d+)$", 1).cast("int").alias("period"), F.explode(F.array(
        F.struct(F.lit("pos").alias("side"), F.col("b.pos").alias("v")),
        F.struct(F.lit("neg").alias("side"), F.col("b.neg").alias("v")))).alias("s"))
    return sides.where(F.col("s.v").isNotNull()).select("mode", "period", "s.side", "s.v.*")


def read_bands(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    rows = parse_bands(spark.read.text(path, wholetext=True), "value")
    return rows if mode is None else rows.where(F.col("mode") == mode)


def bands_document(bands: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """One JSON document from a bands table (six rows per mode)."""
    stats = F.struct("p90", "p95", "p99", "max", "n")
    sides = bands.groupBy("mode", "period").agg(
        F.max(F.when(F.col("side") == "pos", stats)).alias("pos"), F.max(F.when(F.col("side") == "neg", stats)).alias("neg"))
    modes = sides.groupBy("mode").agg(
        F.array_sort(F.collect_list("period")).alias("periods"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.concat(F.lit("ema"), F.col("period").cast("string")), F.struct("pos", "neg"))))).alias("bands"))
    stamp = generated_at if generated_at is not None else F.current_timestamp().cast("string")
    return modes.agg(F.to_json(F.struct(stamp.alias("generated_at"), F.map_from_entries(F.collect_list(
        F.struct("mode", F.struct(F.col("mode").alias("tf"), "periods", "bands")))).alias("modes"))).alias("value"))


def write_bands(bands: DataFrame, path: str) -> None:
    bands_document(bands).write.mode("overwrite").text(path)


# ------------------------------------------------------------------------------------------------ chart lines

def explode_lines(documents: DataFrame) -> DataFrame:
    """Line documents -> one row per chart object with up to three anchor points."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def t(c: Column) -> Column:
        return F.get(c, F.lit(0))

    def p(c: Column) -> Column:
        return F.get(c, F.lit(1)).try_cast("double")

    def shape(kind, name, t1=none_s, p1=none_d, t2=none_s, p2=none_d, t3=none_s, p3=none_d,
              ray=F.lit(False), levels=None, text=none_s, color=none_s):
        lv = levels if levels is not None else F.lit(None).cast("array<struct<ratio: double, label: string>>")
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), t1.alias("t1"), p1.alias("p1"), t2.alias("t2"), p2.alias("p2"),
            t3.alias("t3"), p3.alias("p3"), F.coalesce(ray, F.lit(False)).alias("ray_right"), lv.alias("levels"),
            text.alias("text"), color.alias("color"))

    groups = [
        F.transform("lines.horizontal", lambda o: shape("horizontal", o["name"], p1=o["price"], color=o["color"])),
        F.transform("lines.trendlines", lambda o: shape(
            "trendline", o["name"], t(o["point1"]), p(o["point1"]), t(o["point2"]), p(o["point2"]), ray=o["ray_right"], color=o["color"])),
        F.transform("lines.rectangles", lambda o: shape(
            "rectangle", o["name"], o["time1"], o["price_low"], o["time2"], o["price_high"], color=o["color"])),
        F.transform("lines.channels", lambda o: shape(
            "channel", o["name"], t(o["main_point1"]), p(o["main_point1"]), t(o["main_point2"]), p(o["main_point2"]),
            t(o["parallel_anchor"]), p(o["parallel_anchor"]), o["ray_right"], color=o["color"])),
        F.transform("lines.fibonacci", lambda o: shape(
            "fibonacci", o["name"], t(o["point1"]), p(o["point1"]), t(o["point2"]), p(o["point2"]), levels=o["levels"], color=o["color"])),
        F.transform("lines.texts", lambda o: shape("text", o["name"], o["time"], o["price"], text=o["text"], color=o["color"])),
    ]
    empty = F.array().cast("array<" + "struct<kind: string, name: string, t1: string, p1: double, t2: string, p2: double, "
                           "t3: string, p3: double, ray_right: boolean, levels: array<struct<ratio: double, label: string>>, "
                           "text: string, color: string>>")
    rows = documents.select("symbol", "updated_at", F.explode(F.concat(*[F.coalesce(g, empty) for g in groups])).alias("o"))
    stamp = {c: F.try_to_timestamp(F.col(f"o.{c}")).alias(c) for c in ("t1", "t2", "t3")}
    return rows.select("symbol", F.try_to_timestamp("updated_at").alias("updated_at"), "o.kind", "o.name",
                       stamp["t1"], "o.p1", stamp["t2"], "o.p2", stamp["t3"], "o.p3", "o.ray_right", "o.levels", "o.text", "o.color")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return explode_lines(spark.read.schema(LINES_DOCUMENT).option("multiLine", True).json(path))


# ------------------------------------------------------------------------------------------------ snapshots

def snapshot_documents(domains: DataFrame, key: str, blocks: Sequence[str], light: Sequence[str] = (),
                       partial: bool = False) -> DataFrame:
    """One JSON document per key. The light form carries only ``light`` blocks and is marked partial."""
    chosen = list(light) if partial else list(blocks)
    fields = [F.col(c) for c in chosen]
    head = [F.lit(True).alias("partial")] if partial else []
    return domains.select(key, F.to_json(F.struct(*head, "version", *fields), {"ignoreNullFields": "false"}).alias("document"))


def domain_documents(rows: DataFrame, domain: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one snapshot domain as (domain, key, document): NaN and infinities are null, nulls stay visible."""
    def clean(c: str) -> Column:
        return finite_or_null(F.col(c)).alias(c) if rows.schema[c].dataType.typeName() == "double" else F.col(c)

    body = F.to_json(F.struct(*[clean(c) for c in columns]), {"ignoreNullFields": "false"})
    return rows.select(F.lit(domain).alias("domain"), F.col(key).alias("key"), body.alias("document"))


def merge_partial(held: DataFrame, partial: DataFrame, key: str, light: Sequence[str]) -> DataFrame:
    """Newer light fields overwrite those of the held full snapshot; other blocks stay."""
    fresh = partial.select(key, *[F.col(c).alias(f"_n_{c}") for c in light], F.lit(True).alias("_has"))
    joined = held.join(fresh, key, "left")
    return joined.select(*[
        F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in light else F.col(c)
        for c in held.columns])


def changed_only(payloads: DataFrame, previous: DataFrame, key: str = "symbol", payload: str = "payload") -> DataFrame:
    """Payloads whose content differs from the last one written for their key."""
    hashed = payloads.withColumn("content_hash", F.xxhash64(payload))
    return hashed.join(previous.select(key, "content_hash"), [key, "content_hash"], "left_anti")


#: Published versions of a last-good store that stay, so that readers that have begun can end.
KEPT_GOOD = 2
_PUBLISHED = "_PUBLISHED"


def _published(spark: SparkSession, path: str) -> tuple[Any, list[str]]:
    """The file system of ``path`` and its published versions, oldest first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/{_PUBLISHED}"))
    return fs, sorted(str(m.getPath().getParent().getName()) for m in (marks or []))


def save_last_good(rows: DataFrame, path: str) -> None:
    """Publish ``rows`` as the newest version of the store; until then, and if anything fails, readers find the version before.

    The version is written aside, read back and counted against what was written, and only then marked; the mark is one empty file. The newest
    ``KEPT_GOOD`` versions stay.
    """
    spark = rows.sparkSession
    name = f"version={time.time_ns():020d}"
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{name}")
    n = spark.read.schema(rows.schema).parquet(f"{path}/{name}").count()
    if n != seen.get["n"]:
        raise RuntimeError(f"{path}/{name} holds {n} rows of {seen.get['n']} and is not published")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs, _ = _published(spark, path)
    fs.create(hadoop(f"{path}/{name}/{_PUBLISHED}"), False).close()
    for old in _published(spark, path)[1][:-KEPT_GOOD]:
        fs.delete(hadoop(f"{path}/{old}"), True)


def load_last_good(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version, marked stale."""
    versions = _published(spark, path)[1]
    if not versions:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/{versions[-1]}").withColumn("stale", F.lit(True))
