"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

#: Edges of a task; rounds over few edges write few files, whatever the number of shuffle partitions.
EDGES = 1 << 17


def _sum_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map every node of `edges` (two bigint columns) to the smallest node it reaches: columns node, root.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest node around it; only minima are gathered per
    node, so a hub needs no task that holds its neighbours. The rounds end when the edges form stars and grow with the logarithm of the
    longest chain. Self links and null ends are ignored; an empty table gives an empty table. Every round is written to the shared
    folder, in as many tasks as its edges, of which no round makes more, are worth.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    held = durable(start.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = _sum_of(held)
    while before[0]:
        tasks = -(-before[0] // EDGES)
        held = held.coalesce(tasks)
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        small = large.groupBy("u").agg(F.min("v").alias("least"))
        turned = large.join(small, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = durable(turned.unionByName(small.select("u", F.col("least").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        after = _sum_of(now)
        held, done = now, after == before
        before = after
        if done:
            break
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
