"""Exact percentiles (linear interpolation) of groups of any size, by refining one histogram for all groups.

The built-in exact ``percentile`` holds every distinct value of a group in one task. Here the line of values is cut at edges shared by all
groups. One combinable count by (group, bin) tells in which bins the wanted ranks lie; only these bins are cut further, until they hold few
enough distinct values to be counted one by one. Rows are never joined to anything; the driver holds the edges, of which there is a set number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of the open bins at which the values themselves are counted.
DISTINCT = 1 << 19
#: Bins into which the open part of the line is cut in each round.
BINS = 1024
_ALL = [float("-inf"), float("inf")]


def _counted(rows: DataFrame, keys: Sequence[str], edges: list[float], opened: list[int] | None, groups: tuple[str, Column] | None) -> DataFrame:
    """Rows per (keys, bin, value), the value only in opened bins (None: nowhere); keys are then laid on the groups they count for."""
    if len(edges) > 2:
        binned = Bucketizer(splits=edges, inputCol="_v", outputCol="_bin").transform(rows)
    else:
        binned = rows.withColumn("_bin", F.lit(0.0))
    value = F.lit(None).cast("double") if opened is None else F.when(F.col("_bin").cast("int").isin(opened), F.col("_v"))
    counted = binned.select(*keys, F.col("_bin").cast("int").alias("_bin"), value.alias("_value")).groupBy(*keys, "_bin", "_value").agg(
        F.count(F.lit(1)).alias("_c"))
    if groups is None:
        return counted
    name, labels = groups
    return counted.withColumn(name, F.explode(labels)).groupBy(name, "_bin", "_value").agg(F.sum("_c").alias("_c"))


def _ranked(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts with the rows of the group (``_n``) and those up to and before each bin or value."""
    group = Window.partitionBy(*keys)
    line = group.orderBy("_bin", "_value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_c").over(line)
    return counted.select("*", F.sum("_c").over(group).alias("_n"), upto.alias("_upto"), (upto - F.col("_c")).alias("_first"))


def _holds(p: float) -> tuple[Column, Column]:
    """Whether the two order statistics around a percentile lie at a ranked row."""
    k = F.floor(F.lit(p) * (F.col("_n") - 1))
    inside = lambda r: (F.col("_first") <= r) & (r < F.col("_upto"))
    return inside(k), inside(k + 1)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float], *, groups: tuple[str, Column] | None = None,
                      distinct: int = DISTINCT, bins: int = BINS) -> DataFrame:
    """One row per key with a column per entry of ``names`` (column -> probability in [0, 1]).

    Null and not-a-number values are left out, and keys without any other get no row. With ``groups`` (name, array of labels made of the
    keys) there is a row per label instead, over all keys that count for it; only counts are multiplied, never rows.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    own = [groups[0]] if groups else list(keys)
    edges, opened = _ALL, [0]
    inside, before = rows, float("inf")
    while True:
        grid = [i / bins for i in range(1, bins)]
        seen = inside.agg(F.approx_count_distinct("_v", 0.02).alias("d"), F.percentile_approx("_v", grid, F.lit(8 * bins)).alias("q")).first()
        cuts = sorted({x for x in seen["q"] or [] if abs(x) != float("inf")})
        # with very many groups most bins stay open; each group is then small, and its values are counted at once
        if seen["d"] <= distinct or seen["d"] > before / 2 or not set(cuts) - set(edges):
            break
        before = seen["d"]
        # closed bins keep one edge each, so there are never more than the open bins' new edges and two for each of them
        kept = {e for i in opened for e in (edges[i], edges[i + 1])}
        edges = sorted({*_ALL, *kept, *cuts})
        where = _ranked(_counted(rows, keys, edges, None, groups), own)
        hit = F.lit(False)
        for p in names.values():
            a, z = _holds(p)
            hit = hit | a | z
        opened = sorted(r["_bin"] for r in where.where(hit).select("_bin").distinct().collect())  # at most one a bin
        inside = rows.where(_within(edges, opened))
    ranked = _ranked(_counted(rows, keys, edges, opened, groups), own)
    picked = [c for name, p in names.items() for c in (
        F.max(F.when(_holds(p)[0], F.col("_value"))).alias(f"_a_{name}"), F.max(F.when(_holds(p)[1], F.col("_value"))).alias(f"_z_{name}"))]
    found = ranked.groupBy(*own).agg(F.max("_n").alias("_n"), *picked)
    out = []
    for name, p in names.items():
        a, z = F.col(f"_a_{name}"), F.col(f"_z_{name}")
        at = F.lit(p) * (F.col("_n") - 1)
        frac = at - F.floor(at)
        out.append(F.when(frac > 0, a + (z - a) * frac).otherwise(a).alias(name))
    return found.select(*own, *out)


def _within(edges: list[float], opened: list[int]) -> Column:
    """Values of the opened bins; neighbouring ones are one condition."""
    runs: list[list[int]] = []
    for i in opened:
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    v = F.col("_v")
    out = F.lit(False)
    for lo, hi in runs:
        out = out | ((v >= F.lit(edges[lo])) & ((v < F.lit(edges[hi])) if hi < len(edges) - 1 else F.lit(True)))
    return out
