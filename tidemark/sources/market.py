"""Bar tables and history files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("time", T.StringType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType())])
HISTORY_CLOCK = "yyyy.MM.dd HH:mm:ss"


def read_history_csv(spark: SparkSession, path: str, symbol: Column | str, tf: str) -> DataFrame:
    """Header ``Time (EET),Open,High,Low,Close,Volume `` -> bars; only time and close are parsed when only they are used.

    The schema is given by position, so the trailing blank in the last header does not matter.
    """
    raw = spark.read.csv(path, schema=HISTORY_SCHEMA, header=True, enforceSchema=True)
    sym = F.lit(symbol) if isinstance(symbol, str) else symbol
    return raw.select(sym.alias("symbol"), F.lit(tf).alias("tf"),
                      F.try_to_timestamp("time", F.lit(HISTORY_CLOCK)).alias("bar_time"), "open", "high", "low", "close")


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by timeframe and day, so series and time predicates prune files."""
    dated = bars.withColumn("day", F.to_date("bar_time"))
    dated.repartition("tf", "day").sortWithinPartitions("symbol", "bar_time").write.mode(mode).partitionBy(
        "tf", "day").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def bars_in_days(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both the partition column and the time are bounded: partitions prune, row groups skip."""
    return bars.where(F.col("day").between(F.to_date(start), F.to_date(end)) & F.col("bar_time").between(start, end))
