"""Running totals, peaks and as-of joins over groups of any size.

A group (one position, one range, one symbol) may hold a large share of all rows, so it is cut along its order into
blocks at quantiles; a window sees one (group, block), and one summary row per block carries the rest across. Group and
block form one struct, whose null fields are equal to each other, so rows with null keys or times stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

BLOCK = "_block"
#: Rows that one block should hold; the number of blocks follows from the rows.
BLOCK_ROWS = 250_000
#: Quantiles read along with the row count; more are read only if more blocks are needed.
GRID = 1024
#: Block of the rows whose order is null; they come first, as nulls do in a window.
NULL_BLOCK = -1


def _quantiles(order: DataFrame, parts: int) -> tuple[int, list[float]]:
    row = order.agg(F.count("_v").alias("n"), F.percentile_approx("_v", [i / parts for i in range(1, parts)], 4 * parts).alias("q")).first()
    return row["n"], row["q"] or []


def order_blocks(df: DataFrame, number: str, tie: str | None = None, blocks: int | None = None) -> DataFrame:
    """Add ``_block``, an integer that never decreases along (number, tie), with near-equal row counts.

    There is one block per ``BLOCK_ROWS`` rows, and at least one per shuffle partition. Only boundaries reach the driver, one
    number per block. They are fixed from then on, so a recomputed task puts each row into the same block. A single value
    holding more than a block's share shows up as a repeated quantile; its rows are cut further along the numeric ``tie``
    column, at edges that are joined as a table of at most one number per block. Rows with a null number share a block before
    all others.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = df.select(F.col(number).cast("double").alias("_v"))
    rows, found = _quantiles(order, GRID)
    blocks = blocks or max(parts, -(-rows // BLOCK_ROWS))
    if blocks > GRID and rows:
        rows, found = _quantiles(order, blocks)
        cuts = found
    else:
        cuts = [found[max(i * GRID // blocks - 1, 0)] for i in range(1, blocks)] if found else []
    if not cuts:
        return df.withColumn(BLOCK, F.when(F.col(number).isNull(), F.lit(NULL_BLOCK)).otherwise(F.lit(0)).cast("long"))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    marked = df.withColumn("_number", F.col(number).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_number", outputCol="_bucket", handleInvalid="keep").transform(marked)
    bucket = F.col("_bucket").cast("long")
    heavy = {v: c for v, c in Counter(cuts).items() if c > 1}
    if tie and heavy:
        shares = max(heavy.values()) + 1
        edges = F.broadcast(_tie_edges(df, number, tie, heavy, shares))  # at most one edge per block
        out = out.join(edges, F.col("_number") == F.col("_heavy"), "left")
        passed = F.size(F.filter("_edges", lambda e: e <= F.col(tie).cast("double"))).cast("long")
        # later rows of the same bucket come after all of a heavy value's
        bucket = bucket * F.lit(blocks + 1) + F.when(F.col("_heavy").isNull(), F.lit(shares).cast("long")).otherwise(passed)
    block = F.when(F.col("_number").isNull(), F.lit(NULL_BLOCK).cast("long")).otherwise(bucket)
    return out.withColumn(BLOCK, block).drop("_number", "_bucket", "_heavy", "_edges")


def _tie_edges(df: DataFrame, number: str, tie: str, heavy: Mapping[float, int], shares: int) -> DataFrame:
    """Quantiles of ``tie`` among the rows of each heavy value, as a small table of its own."""
    inside = df.select(F.col(number).cast("double").alias("_v"), F.col(tie).cast("double").alias("_t")).where(
        F.col("_v").isin(*heavy))
    found = inside.groupBy("_v").agg(F.percentile_approx(
        "_t", [i / shares for i in range(1, shares)], F.lit(4 * shares)).alias("_c")).collect()
    # a value needs as many edges as it repeats
    rows = [(r["_v"], sorted(set((r["_c"] or [])[:: max(1, shares // (heavy[r["_v"]] + 1))]))) for r in found]
    return df.sparkSession.createDataFrame(rows, "_heavy double, _edges array<double>")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    peaks: Mapping[str, tuple[str, Column]] | None = None,
    *,
    inclusive_peaks: bool = True,
) -> DataFrame:
    """Running sums per key, and the running maximum of such a sum over the rows where a condition holds.

    ``peaks[name] = (total name, condition)``. With ``inclusive_peaks=False`` the maximum is over earlier rows only.
    ``df`` must carry ``_block`` (:func:`order_blocks`) consistent with ``order``.
    """
    peaks = peaks or {}
    w = Window.partitionBy("_group").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    peak_frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive_peaks else -1)
    local = df.select("*", F.struct(*keys, BLOCK).alias("_group"), *[c.alias(f"_u_{n}") for n, c in totals.items()])
    local = local.select("*", *[F.sum(f"_u_{n}").over(upto).alias(f"_l_{n}") for n in totals])
    local = local.select("*", *[F.when(cond, F.col(f"_l_{t}")).alias(f"_q_{n}") for n, (t, cond) in peaks.items()])
    local = local.select("*", *[F.max(f"_q_{n}").over(peak_frame).alias(f"_p_{n}") for n in peaks])

    # the summary needs only sums and block peaks; both come from the same exchanged rows
    summary = local.groupBy("_group").agg(
        *[F.sum(f"_u_{n}").alias(f"_t_{n}") for n in totals],
        *[F.max(f"_q_{n}").alias(f"_m_{n}") for n in peaks],
    )
    across = Window.partitionBy(*([F.col("_group")[k] for k in keys] or [F.lit(0)])).orderBy(F.col("_group")[BLOCK])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(0).cast(summary.schema[f"_t_{n}"].dataType) for n in totals}
    summary = summary.select(
        "*", *[F.coalesce(F.sum(f"_t_{n}").over(before), zero[n]).alias(f"_o_{n}") for n in totals])
    summary = summary.select(
        "_group",
        *[f"_o_{n}" for n in totals],
        *[F.max(F.col(f"_o_{t}") + F.col(f"_m_{n}")).over(before).alias(f"_b_{n}") for n, (t, _) in peaks.items()],
    )
    joined = local.join(summary, "_group")
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in totals],
        *[F.greatest(F.col(f"_b_{n}"), F.col(f"_o_{t}") + F.col(f"_p_{n}")).alias(n) for n, (t, _) in peaks.items()],
    )


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, *,
                 inclusive: bool = True) -> DataFrame:
    """Last non-null value so far per key (with ``inclusive=False`` before the row, which is a lag for full columns)."""
    marked = df.withColumn("_v", value).withColumn("_group", F.struct(*keys, BLOCK))
    w = Window.partitionBy("_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = marked.select("*", F.last("_v", ignorenulls=True).over(w).alias("_in"))
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))
    tails = marked.groupBy("_group").agg(F.max_by("_v", at).alias("_end"))
    return local.join(_carried(tails, keys), "_group").select(*df.columns, F.coalesce("_in", "_from").alias(name))


def _carried(tails: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every block the last ``_end`` of the blocks before it."""
    group = F.col("_group")
    before = Window.partitionBy(*([group[k] for k in keys] or [F.lit(0)])).orderBy(group[BLOCK]).rowsBetween(Window.unboundedPreceding, -1)
    return tails.select("_group", F.last("_end", ignorenulls=True).over(before).alias("_from"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    *,
    tie: str | None = None,
) -> DataFrame:
    """Backward as-of join: each left row gets the right row with the greatest ``right_time <= left_time`` of its key.

    Both sides are laid on one line, which is written once, and the last right row is carried forward, inside blocks and then
    across them, so neither a hot key nor a long gap needs one task. ``right`` must have one row per (key, time). Every left
    row stays; those with a null key or time match nothing.
    """
    packed_left = F.struct(*[F.col(c) for c in left.columns])
    packed_right = F.struct(F.col(right_time).alias("_rt"), *[F.col(c) for c in values])
    lhs = left.select(*keys, F.col(left_time).alias("_ts"), F.lit(1).alias("_side"),
                      (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), packed_left.alias("_left"))
    # right rows sort before left rows of the same time, whatever the left tie-breakers are
    rhs = right.dropna("any", subset=[*keys, right_time]).select(
        *keys, F.col(right_time).alias("_ts"), F.lit(0).alias("_side"), F.lit(-(2 ** 62)).cast("long").alias("_tie"),
        packed_right.alias("_right"))
    line = durable(lhs.unionByName(rhs, allowMissingColumns=True).withColumn("_num", F.col("_ts").cast("double")))
    line = order_blocks(line, "_num", "_tie").withColumn("_group", F.struct(*keys, BLOCK))
    w = Window.partitionBy("_group").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = line.select("*", F.last("_right", ignorenulls=True).over(w).alias("_in"))
    tails = line.groupBy("_group").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_end"))
    out = local.where(F.col("_side") == 1).join(_carried(tails, keys), "_group")
    found = F.coalesce(F.col("_in"), F.col("_from"))
    return out.select("_left.*", found["_rt"].alias(f"{right_time}_asof"), *[found[c].alias(c) for c in values])
