"""An index of intervals over a grid of slots: aligned runs of 4^level slots.

An interval of any length is a few aligned runs, at most six a level, so what meets it can be joined by equality of (level, run).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

RADIX_BITS = 2
#: Levels built from one another before they are written.
TIER = 4


def covered(rows: DataFrame, first: str, stop: str, levels: int) -> DataFrame:
    """A row per aligned run of [first, stop): ``_level`` and ``_node`` in place of the two bigint columns. Empty intervals give no row.

    The top level lists its runs one by one.
    """
    kept = [c for c in rows.columns if c not in (first, stop)]
    rows = rows.where(F.col(first) < F.col(stop))
    length = (F.col(stop) - F.col(first)).cast("double")
    height = F.least(F.lit(levels), F.ceil(F.log2(length) / RADIX_BITS)).cast("int")
    steps = rows.select("*", F.explode(F.sequence(F.lit(0), height)).alias("_level")).selectExpr(
        *[f"`{c}`" for c in kept], "_level",
        f"-shiftright(-`{first}`, {RADIX_BITS} * _level) AS _a",
        f"shiftright(`{stop}`, {RADIX_BITS} * _level) AS _b",
    ).where("_a < _b").selectExpr("*", f"-shiftright(-_a, {RADIX_BITS}) AS _next_a", f"shiftright(_b, {RADIX_BITS}) AS _next_b")
    none = F.array().cast("array<bigint>")
    width = 1 << RADIX_BITS
    left, right = F.col("_next_a") * width, F.col("_next_b") * width
    last_level = (F.col("_next_a") >= F.col("_next_b")) | (F.col("_level") == levels)
    runs = F.when(last_level, F.sequence("_a", F.col("_b") - 1)).otherwise(F.concat(
        F.when(F.col("_a") < left, F.sequence("_a", left - 1)).otherwise(none),
        F.when(right < F.col("_b"), F.sequence(right, F.col("_b") - 1)).otherwise(none)))
    return steps.select(*[F.col(f"`{c}`") for c in kept], "_level", F.explode(runs).alias("_node"))


def levels_for(longest: int | None, most: int) -> int:
    """Levels that intervals of up to `longest` slots can use."""
    return min(most, max(0, -(-max((longest or 1) - 1, 0).bit_length() // RADIX_BITS)))


def runs_of_slots(slots: DataFrame, keys: Sequence[str], slot: str, levels: int) -> DataFrame:
    """Every run that holds one of the distinct slots, with the slot: ``levels`` + 1 rows each."""
    laid = slots.select(*keys, slot, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    return laid.withColumn("_node", F.expr(f"shiftright(`{slot}`, {RADIX_BITS} * _level)"))


def extremes_by_run(rows: DataFrame, keys: Sequence[str], slot: Column, aggregates: dict[str, Column], combine: dict[str, Column], levels: int) -> DataFrame:
    """``aggregates`` of every aligned run up to ``levels``; each level is made from the one below, about 4/3 of the rows in all.

    ``aggregates`` are columns of ``rows``, level 0 as they are; ``combine`` merges columns of their names.
    """
    level = rows.select(*keys, slot.alias("_node"), *[c.alias(n) for n, c in aggregates.items()])
    out = level.withColumn("_level", F.lit(0))
    for k in range(1, levels + 1):
        level = level.groupBy(*keys, F.shiftright("_node", RADIX_BITS).alias("_node")).agg(*[c.alias(n) for n, c in combine.items()])
        if k % TIER == 1:
            level = written(level, f"runs-{k}")
        out = out.unionByName(level.withColumn("_level", F.lit(k)))
    return out
