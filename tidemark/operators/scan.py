"""Ordered recurrences over bar series without a task that sees a whole series.

Bars sit on a time grid, so ``cell = grid slot div CELL`` holds at most ``CELL`` of them however hot a symbol is.
Work inside a cell is a window; what crosses cells is one summary row per cell. Every linear recurrence used here is an
affine map ``y -> a*y + b``; maps compose, so a cell is summarised by one pair and the carry into each cell is a fold
over those pairs (1/CELL of the rows). No look-back is truncated: flat stretches keep their exact ratios.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import chain as _flatten

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.dims import TF_SECONDS
from tidemark.session import durable

CELL = 256
#: Rows of a series that a task looks around in.
SPAN = 4096
SERIES = ("symbol", "tf")


def tf_seconds(tf: Column) -> Column:
    table = F.create_map(*_flatten.from_iterable((F.lit(k), F.lit(v)) for k, v in TF_SECONDS.items()))
    return table[tf]


def with_cell(bars: DataFrame, time: str = "bar_time", tf: str = "tf") -> DataFrame:
    slot = F.floor(F.unix_seconds(F.col(time)) / tf_seconds(F.col(tf)))
    return bars.withColumn("cell", F.floor(slot / F.lit(CELL)))


def with_neighbours(chained: DataFrame, before: int, after: int = 0, *, keys: Sequence[str] = SERIES, span: int = SPAN) -> tuple[DataFrame, WindowSpec]:
    """Rows numbered by :func:`chain`, cut in stretches of ``span``, and the window to look around in them.

    A stretch also receives the last ``before`` rows ahead of it and the first ``after`` rows behind it, so ``lag`` and ``lead`` of
    that reach are right for its own rows, which ``_own`` marks, and no task needs a whole series.
    """
    at, off = F.floor(F.col("idx") / span), F.col("idx") % span
    copies = F.array_compact(F.array(
        F.struct(at.alias("at"), F.lit(True).alias("own")),
        F.when(off >= span - before, F.struct((at + 1).alias("at"), F.lit(False).alias("own"))),
        F.when((off < after) & (at > 0), F.struct((at - 1).alias("at"), F.lit(False).alias("own")))))
    dealt = chained.select("*", F.explode(copies).alias("_c")).select("*", F.col("_c.at").alias("_stretch"), F.col("_c.own").alias("_own")).drop("_c")
    return dealt, Window.partitionBy(*keys, "_stretch").orderBy("idx")


def chain(df: DataFrame, prev: Sequence[str] = (), *, keys: Sequence[str] = SERIES, order: str = "bar_time",
          cell: str | None = "cell", stored: bool = False) -> DataFrame:
    """Add ``idx`` (0-based position in the series), ``n`` (series length) and ``prev_<col>`` columns.

    With ``cell=None`` the caller vouches that a key has few rows (a top-N scan) and plain windows are used.
    ``stored=True`` says the input is a table scan already, so it is not written again.
    """
    if cell is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select(
            "*",
            (F.row_number().over(w) - 1).cast("long").alias("idx"),
            F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"),
            *[F.lag(c).over(w).alias(f"prev_{c}") for c in prev],
        )
    # read twice here and twice by every scan that follows: bars are far smaller than what they are built from, so
    # they are written once instead of being derived again for each reader
    df = df if stored else durable(df)
    group = [*keys, cell]
    w = Window.partitionBy(*group).orderBy(order)
    inner = df.select("*", F.row_number().over(w).cast("long").alias("_rn"),
                      *[F.lag(c).over(w).alias(f"_lag_{c}") for c in prev])
    tail = F.max_by(F.struct(F.lit(1).alias("_one"), *[F.col(c) for c in prev]), F.col(order)).alias("_tail")
    cells = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_cn"), tail)
    across = Window.partitionBy(*keys).orderBy(cell)
    cells = cells.select(
        *group,
        F.coalesce(F.sum("_cn").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_cn").over(Window.partitionBy(*keys)).alias("n"),
        F.lag("_tail").over(across).alias("_ptail"),
    )
    joined = inner.join(cells, group)
    keep = [c for c in df.columns]
    return durable(joined.select(
        *keep,
        (F.col("_before") + F.col("_rn") - 1).alias("idx"),
        "n",
        *[F.when(F.col("_rn") > 1, F.col(f"_lag_{c}")).otherwise(F.col(f"_ptail.{c}")).alias(f"prev_{c}") for c in prev],
    ))


@dataclass(frozen=True)
class Recurrence:
    """``y = (1-alpha)*y + alpha*x`` from ``first + seed`` on; the seed is the mean of the first ``seed`` inputs.

    ``seed=1`` is the first-value seed. ``first`` is the series index of the first usable input (1 for differences).
    """

    name: str
    x: Column
    alpha: float
    seed: int
    first: int = 0

    def __post_init__(self) -> None:
        if self.seed <= 0 or not 0.0 < self.alpha <= 1.0:
            raise ValueError(f"period must be > 0 and alpha in (0, 1]: {self.name}")

    @property
    def ready(self) -> int:
        return self.first + self.seed - 1

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha


def sma_seeded_ema(name: str, x: Column, period: int, first: int = 0) -> Recurrence:
    if period <= 0:
        raise ValueError(f"period must be > 0, got {period}")
    return Recurrence(name, x, 2.0 / (period + 1.0), period, first)


def first_value_ema(name: str, x: Column, period: int) -> Recurrence:
    if period <= 0:
        raise ValueError(f"period must be > 0, got {period}")
    return Recurrence(name, x, 2.0 / (period + 1.0), 1, 0)


def wilder(name: str, x: Column, period: int, first: int = 0) -> Recurrence:
    if period <= 0:
        raise ValueError(f"period must be > 0, got {period}")
    return Recurrence(name, x, 1.0 / period, period, first)


def _carry_fold(specs: Sequence[Recurrence], keys: Sequence[str], cell: str):
    names = [s.name for s in specs]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell)
        out = pdf[[*keys, cell]].copy()
        for name in names:
            carry, y = [], 0.0
            for a, b in zip(pdf[f"a_{name}"].tolist(), pdf[f"b_{name}"].tolist()):
                carry.append(y)
                y = a * y + b
            out[f"c_{name}"] = carry
        return out

    return fold


def affine_scan(df: DataFrame, specs: Iterable[Recurrence], *, keys: Sequence[str] = SERIES, order: str = "bar_time",
                cell: str | None = "cell") -> DataFrame:
    """Add one column per recurrence; input must carry ``idx`` from :func:`chain`.

    Inside a partition, with ``e`` = decay steps taken so far, ``local = r^e * sum(u * r^-e)``. The exponent stays
    below ``CELL`` (or the caller's row bound when ``cell=None``), which keeps ``r^-e`` in double range for period >= 2.
    """
    specs = list(specs)
    group = [*keys] if cell is None else [*keys, cell]
    w = Window.partitionBy(*group).orderBy(order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    idx = F.col("idx")
    staged = df.select("*", F.row_number().over(w).cast("long").alias("_k"))
    steps = {s.name: F.greatest(F.lit(0), F.least(F.col("_k"), idx - F.lit(s.ready))).cast("double") for s in specs}
    unit = {
        s.name: F.when(idx < s.first, F.lit(0.0)).when(idx <= s.ready, s.x / F.lit(float(s.seed)))
        .otherwise(s.x * F.lit(s.alpha)) for s in specs
    }
    local = staged.select(
        "*",
        *[(F.pow(F.lit(s.decay), steps[s.name])
           * F.sum(unit[s.name] * F.pow(F.lit(s.decay), -steps[s.name])).over(running)).alias(f"_l_{s.name}")
          if s.decay > 0.0 else F.when(idx <= s.ready, F.sum(unit[s.name]).over(running)).otherwise(s.x)
          .alias(f"_l_{s.name}")
          for s in specs],
    )
    if cell is None:
        return local.select(*df.columns,
                            *[F.when(idx >= s.ready, F.col(f"_l_{s.name}")).alias(s.name) for s in specs])
    summary = local.groupBy(*group).agg(
        *[F.min(F.pow(F.lit(s.decay), steps[s.name])).alias(f"a_{s.name}") for s in specs],
        *[F.max_by(F.col(f"_l_{s.name}"), F.col(order)).alias(f"b_{s.name}") for s in specs],
    )
    schema = T.StructType(
        [summary.schema[c] for c in group] + [T.StructField(f"c_{s.name}", T.DoubleType()) for s in specs])
    carry = summary.groupBy(*keys).applyInPandas(_carry_fold(specs, keys, cell), schema)
    joined = local.join(carry, group)
    return joined.select(
        *df.columns,
        *[F.when(idx >= s.ready,
                 F.col(f"_l_{s.name}") + F.pow(F.lit(s.decay), steps[s.name]) * F.col(f"c_{s.name}")).alias(s.name)
          for s in specs],
    )
