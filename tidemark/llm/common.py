"""Helpers of the subpackage: tables written to the shared folder, word splitting, streaming over sorted partitions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import work_dir

#: Bytes that end a word: space and the controls tab to carriage return. bytes.split() without an argument cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
BATCH = "8m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, so that a repeated run never meets files of an earlier one."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, dense: bool = False) -> DataFrame:
    """Write once as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs a read.

    `dense` spends more on compression, for tables that hold whole texts.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd" if dense else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable, schema: T.StructType | str, release: bool = False) -> DataFrame:
    """mapInArrow with batches of bounded size, however long the texts: `BATCH` unless the session sets a size of its own.

    With `release` a worker gives the memory of a task back when the task ends; for steps of a pipeline, whose workers live through all of it.
    """
    conf = df.sparkSession.conf
    conf.set(_BATCH_SETTING, conf.get(_BATCH_SETTING, BATCH))

    def releasing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(releasing if release else run, schema)


def give_back() -> None:
    """Return freed memory to the system: what Arrow's pool holds unused, and, where the C library can, what its heap does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spread(spark: SparkSession) -> int:
    """Partitions for keyed work: the session's setting, which a cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_groups(batches: Iterable[pa.RecordBatch], key: list[str], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Cut a sorted stream into tables of at least `least` rows that never split a key; at most one key waits besides them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        full = pa.Table.from_batches(held)
        last = {k: full.column(k)[rows - 1] for k in key}
        same = np.ones(rows, bool)
        for k, v in last.items():
            same &= np.asarray(full.column(k).to_numpy() == v.as_py())
        cut = rows - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield full.slice(0, cut)
            held = full.slice(cut).to_batches()
            rows -= cut
        least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """Schema of `df` without `name`, and `name` as its last field."""
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def placed_in_groups(rows: DataFrame, group: str, order: list[str | Column], values: dict[str, Column], name: str) -> DataFrame:
    """`group` (a bigint without nulls), place (from 0, within the group by `order`) and `values` of each row, written under `name`.

    Rows are range-sorted; repeated rows and long groups are cut like any others, and a row's place is that in its partition plus what the
    group holds in the partitions before, of which there are as many as the session sets.
    """
    sort = [group, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(spread(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    ranged = ranged.select(group, *[c.alias(k) for k, c in values.items()], F.spark_partition_id().alias("_part"))
    added = "place bigint, _first boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, least = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            least = key[0] if least is None else least
            new = np.r_[key[0] != held, key[1:] != key[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.arange(n) - np.where(first < 0, -count, first)
            held, count = key[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(key == least)], names=[*batch.schema.names, "place", "_first"])

    schema = T.StructType([*ranged.schema.fields, *T._parse_datatype_string(added).fields])
    written = staged(in_batches(ranged, run, schema), name)
    parts = written.groupBy("_part").agg(F.min(group).alias("lo"), F.max(group).alias("hi"), F.max_by(F.col("place") + 1, F.struct(group, "place")).alias("n"))
    upto = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("hi").orderBy("_part")))
    before = Window.orderBy("_part")
    offsets = upto.select("_part", F.when(F.lag("hi").over(before) == F.col("lo"), F.lag("upto").over(before)).alias("_offset"))
    joined = written.join(F.broadcast(offsets), "_part")
    place = F.col("place") + F.when(F.col("_first"), F.coalesce("_offset", F.lit(0))).otherwise(0)
    return joined.select(group, place.alias("place"), *values)
