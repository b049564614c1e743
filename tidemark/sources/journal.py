"""Order journal: JSON lines, one folder per server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.guards import path_slug

JOURNAL_SCHEMA = (
    "ts bigint, symbol string, side string, lots double, sl double, tp double, ticket bigint, price double, "
    "ctx map<string, struct<ae: boolean, adx: double, dip: double, dim: double, rsi: double>>, env map<string, double>")


def append_journal(entries: DataFrame, path: str, server: str = "server") -> None:
    slugged = entries.withColumn("server_slug", path_slug(F.col(server))).drop(server)
    slugged.write.mode("append").partitionBy("server_slug").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Blank and corrupt lines are skipped."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_journal_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Journal text held in a table column; lines that are not a JSON object are dropped."""
    parsed = lines.select("*", F.from_json(F.col(column), JOURNAL_SCHEMA + ", _bad string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_j"))
    good = (F.trim(F.col(column)) != "") & F.col("_j").isNotNull() & F.col("_j._bad").isNull()
    return parsed.where(good).select(*[c for c in lines.columns if c != column], "_j.*").drop("_bad")


def recent_journal(journal: DataFrame, limit: int = 200, seq: str = "ticket") -> DataFrame:
    """Newest entries first; equal times go by `seq`, the larger first."""
    return journal.orderBy(F.coalesce("ts", F.lit(0)).desc(), F.col(seq).desc()).limit(limit)
