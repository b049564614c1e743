"""The trie of conversation prefixes, from sorted turn-id matrices.

A turn becomes two 64-bit hashes of its place, role and text, so equal prefixes have equal hash rows; the exclusive or of a prefix's hashes
names its node (with the depth: 128 bits). Conversations are cut in bands of some turns; a band's row also carries the name of the node it
starts from, so that bands of any depth are handled at once and no conversation is ever held whole. Rows are range-sorted into shards. In a
shard the padded matrix is put in order by numpy's lexsort, column change masks accumulated by `or` mark where nodes start at each depth, and
reduceat adds up every depth. Only nodes that touch a shard's first or last row, or end a band, may go on elsewhere: those are recombined.

Sums over subtrees need no walk over the trie: a node's smallest member is also the smallest of what remains of it below, so every node's own
value is laid on that member's row, and a subtree's sum is the sum of its rows from the node's column on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, placed_in_groups, spread, staged

BAND = 16
#: Rows summed in one window; longer runs add the sums of their blocks.
RUN = 1024
#: Rows of a conversation that meet its one row in a task.
SALT_ROWS = 1 << 16
KEY = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"
_PARTS = ("shard bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, edge boolean, parent_edge boolean, conv_id bigint, "
          "parent_conv_id bigint, n_convs bigint, n_ends bigint, words bigint, first_end bigint, ends string")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), id and words of each turn: by number, null first, then by role and text. Null roles and texts are empty."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids = {"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit("second"), "text", "role"), "words": F.regexp_count("text", F.lit(WORD)).cast("bigint")}
    return placed_in_groups(rows, "conv_id", ["turn", "role", "text"], ids, "trie-turns")


def plain_prefix(conv: Column) -> tuple[Column, Column]:
    """Conversation whose first turns are taken, and how many."""
    return conv - conv % 20, F.crc32(conv.cast("string")) % 4


def rebuilt(turns: DataFrame, prefix=plain_prefix) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, a, b, words) of the rebuilt conversations, and conversations (conv_id, total turns).

    `turns` are ordered turns. `prefix` gives, for a conversation, whose first turns replace as many of its own, and their number (at most
    three); a conversation that names itself stays as it is. A shorter or absent one gives what it has.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    source, h = prefix(F.col("conv_id"))
    convs = convs.withColumn("source", source).withColumn("h", F.when(source == F.col("conv_id"), 0).otherwise(h).cast("bigint"))
    sizes = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    convs = convs.join(sizes, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = staged(convs.select("conv_id", "n", "source", "h", "taken", "total"), "trie-convs")
    heads = turns.where("place < 3").withColumnRenamed("conv_id", "source")
    lent = convs.where("taken > 0").join(heads, "source").where("place < taken").select("conv_id", "place", "a", "b", "words", "total")
    # a long conversation meets its row in many tasks
    salted = convs.select("conv_id", "h", "taken", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {SALT_ROWS}"))).alias("salt"))
    own = turns.withColumn("salt", F.expr(f"place div {SALT_ROWS}")).join(salted, ["conv_id", "salt"]).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "words", "total")
    return lent.unionByName(own), convs.select("conv_id", "total")


def running(rows: DataFrame, at: str, value: dict[str, str], how, back: bool = False) -> DataFrame:
    """conv_id, `at` and, for each of `value`, `how` over the conversation's rows before this one (after it, if `back`); long runs by blocks."""
    far = F.expr(f"{at} div {RUN}")
    sort = (lambda c: F.desc(c)) if back else (lambda c: F.asc(c))
    rows = rows.select("conv_id", at, far.alias("far"), *value.values())
    blocks = rows.groupBy("conv_id", "far").agg(*[how(v).alias(f"in_{k}") for k, v in value.items()])
    over_blocks = Window.partitionBy("conv_id").orderBy(sort("far")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "far", *[how(f"in_{k}").over(over_blocks).alias(f"far_{k}") for k in value])
    inside = Window.partitionBy("conv_id", "far").orderBy(sort(at)).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("conv_id", at, "far", *[how(v).over(inside).alias(f"near_{k}") for k, v in value.items()])
    zero = F.lit(0).cast("bigint")
    both = lambda k: (F.coalesce(f"far_{k}", zero), F.coalesce(f"near_{k}", zero))
    join = (lambda x, y: x.bitwiseXOR(y)) if how is F.bit_xor else (lambda x, y: x + y)
    return near.join(blocks, ["conv_id", "far"]).select("conv_id", at, *[join(*both(k)).alias(k) for k in value])


def banded(turns: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """Rows conv_id, band, h1, h2 (name of the node the band starts from), turns (at most `band`), last (whether the conversation ends here)."""
    hashed = turns.select("conv_id", "place", "total", F.xxhash64("place", "a", "b").alias("a"), F.xxhash64("b", "place", "a").alias("b"), "words")
    bands = hashed.groupBy("conv_id", F.expr(f"place div {band}").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "words"))).alias("placed"), F.max("total").alias("total"),
        F.bit_xor("a").alias("x1"), F.bit_xor("b").alias("x2"))
    bands = staged(bands, "trie-bands")
    before = running(bands, "band", {"h1": "x1", "h2": "x2"}, F.bit_xor)
    turns_of = F.transform("placed", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words")))
    full = bands.join(before, ["conv_id", "band"]).select(
        "conv_id", "band", "h1", "h2", turns_of.alias("turns"), (F.expr(f"(total - 1) div {band}") == F.col("band")).alias("last"))
    zero = F.lit(0).cast("bigint")
    turnless = convs.where("total = 0").select(
        "conv_id", zero.alias("band"), zero.alias("h1"), zero.alias("h2"), F.array().cast(full.schema["turns"].dataType).alias("turns"),
        F.lit(True).alias("last"))
    return full.unionByName(turnless)


def sharded(rows: DataFrame) -> DataFrame:
    """Rows in the order of nodes; equal ones by conversation, so that no node is bound to one task."""
    order = ["band", "h1", "h2", "turns", "conv_id"]
    return rows.repartitionByRange(spread(rows.sparkSession), *order).sortWithinPartitions(*order)


class Shard:
    """The padded matrices of a run of sorted rows, and at each column the segments of rows that share a node."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda c: batch.column(batch.schema.names.index(c))
        self.conv, band, h1, h2 = (get(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "band", "h1", "h2"))
        lists = get("turns")
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        a, b, words = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        n, width = len(self.conv), int(self.sizes.max())
        there = np.arange(width) < self.sizes[:, None]
        one, two, self.words = (np.zeros((n, width), np.int64) for _ in range(3))
        one[there], two[there], self.words[there] = a, b, words
        columns = [m[:, j] for j in range(width) for m in (there, one, two)]
        self.order = np.lexsort([self.conv, *reversed([band, h1, h2, *columns])])
        self.conv, self.sizes, self.words, band, h1, h2, one, two, self.there = (
            x[self.order] for x in (self.conv, self.sizes, self.words, band, h1, h2, one, two, there))
        self.band = band
        changes = np.ones((n, width + 1), bool)
        changes[1:, 0] = (band[1:] != band[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        changes[1:, 1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (self.there[1:] != self.there[:-1])
        self.starts = np.logical_or.accumulate(changes, axis=1)
        self.k1 = np.bitwise_xor.accumulate(np.column_stack([h1, one]), axis=1)
        self.k2 = np.bitwise_xor.accumulate(np.column_stack([h2, two]), axis=1)
        self.n, self.width = n, width

    def level(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rows of the segments at `column` (0: the node a band starts from), which of them touch an end of the shard, and each row's segment."""
        first = np.flatnonzero(self.starts[:, column])
        touches = np.zeros(len(first), bool)
        touches[[0, -1]] = True
        return first, touches, np.cumsum(self.starts[:, column]) - 1


def nodes_of(batch: pa.RecordBatch, shard: int, band: int) -> pa.RecordBatch:
    """Nodes of a shard: counts, smallest member, parent, and the members that end there (hashed, or as text where the node may go on elsewhere)."""
    s = Shard(batch)
    last = batch.column(batch.schema.names.index("last")).to_numpy(zero_copy_only=False)[s.order]
    out: list[tuple] = []
    above: tuple | None = None
    for column in range(s.width + 1):
        first, edge, segment = s.level(column)
        edge = edge | (column in (0, band))
        least = np.minimum.reduceat(s.conv, first)
        held = np.diff(np.r_[first, s.n])
        ending = last & (s.sizes == column) & ((s.band == 0) | (column > 0))
        ends = np.add.reduceat(ending.astype(np.int64), first)
        going_on = (s.band[first] > 0) if column == 0 else np.zeros(len(first), bool)  # counted in the band before; here only to be named
        real = np.ones(len(first), bool) if column == 0 else s.there[first, column - 1]
        words = s.words[first, column - 1] if column else np.zeros(len(first), np.int64)
        rows = np.flatnonzero(ending)
        cuts = np.searchsorted(segment[rows], np.arange(len(first) + 1))
        convs = s.conv[rows].tolist()
        texts: list[str | None] = []
        for k in range(len(first)):
            own = convs[cuts[k] : cuts[k + 1]]
            text = ",".join(map(str, own))
            texts.append(None if not own else text if edge[k] else hashlib.sha256(text.encode()).hexdigest())
        first_end = [convs[c] if c < d else None for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in np.flatnonzero(real).tolist():
            i = int(first[k])
            depth = int(s.band[i]) * band + column
            if column == 0:
                p1 = p2 = up = None
                up_edge = True
            else:
                at = int(above[2][i])
                p1, p2, up_edge, up = int(s.k1[i, column - 1]), int(s.k2[i, column - 1]), bool(above[1][at]), int(above[0][at])
            out.append((shard, depth, int(s.k1[i, column]), int(s.k2[i, column]), p1, p2, bool(edge[k]), up_edge,
                        None if going_on[k] else int(least[k]), None if up_edge else up, 0 if going_on[k] else int(held[k]),
                        int(ends[k]), int(words[k]), first_end[k], texts[k]))
        above = least, edge, segment
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 6 + [pa.string()]
    names = [p.split()[0] for p in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def found_nodes(rows: DataFrame, band: int = BAND) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                yield nodes_of(batch, shard, band)
                shard += 1

    return in_batches(sharded(rows), run, _PARTS)


def hashed_ends(parts: DataFrame) -> DataFrame:
    """KEY and ends: SHA-256 of texts of ascending conversations, joined by commas as they pass by. Only nodes that touch a shard's end are here."""
    sent = parts.where("ends IS NOT NULL").select(*KEY, "first_end", "ends")
    sent = sent.repartition(spread(parts.sparkSession), *KEY).sortWithinPartitions(*KEY, "first_end")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], names=[*KEY, "ends"])

        key, digest = None, None
        for batch in batches:
            for *own, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if own != key:
                    if key is not None:
                        yield row(key, digest)
                    key, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key is not None:
            yield row(key, digest)

    return in_batches(sent, run, "depth bigint, k1 bigint, k2 bigint, ends string")


def recombined(parts: DataFrame) -> DataFrame:
    """Whole nodes: KEY, p1, p2, conv_id, parent_conv_id, n_convs, n_ends, words, ends (null where none end)."""
    edges = parts.where("edge").groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.max("parent_conv_id").alias("inner_parent"), F.sum("n_ends").alias("n_ends"), F.max("words").alias("words"))
    edges = staged(edges.join(hashed_ends(parts.where("edge")), KEY, "left"), "trie-edges")
    up = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2")]
    of_edges = edges.select(*up, F.col("conv_id").alias("edge_parent"))
    whole = edges.join(of_edges, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("edge_parent", "inner_parent"))
    # an inner node's parent at a shard's end is looked up under the shard, so that a parent of very many children is met in many tasks
    named = parts.where("edge").select("shard", *KEY).distinct().join(edges.select(*KEY, F.col("conv_id").alias("named")), KEY).select("shard", *up, "named")
    inner = parts.where("NOT edge").join(named, ["shard", "depth", "p1", "p2"], "left").withColumn(
        "parent_conv_id", F.coalesce("named", "parent_conv_id"))
    columns = [*KEY, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_ends", "words", "ends"]
    return whole.select(*columns).unionByName(inner.select(*columns))


def subtree_sums(rows: DataFrame, nodes: DataFrame, band: int = BAND) -> DataFrame:
    """KEY, n_leaves, saved: sums of the nodes' own values over their subtrees."""
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("bigint")
    number = F.greatest(F.expr(f"(depth - 1) div {band}"), F.lit(0))
    own = nodes.select("conv_id", number.alias("band"), (F.col("depth") - number * band).alias("slot"), leaf.alias("leaf"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = own.groupBy("conv_id", "band").agg(F.collect_list(F.struct("slot", "leaf", "saved")).alias("own"), F.sum("leaf").alias("leaves"),
                                             F.sum("saved").alias("saved"))
    laid = staged(rows.join(own, ["conv_id", "band"], "left"), "trie-laid")
    zero = F.lit(0).cast("bigint")
    filled = laid.select("conv_id", "band", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"))
    after = running(filled, "band", {"tail_leaves": "leaves", "tail_saved": "saved"}, F.sum, back=True)
    laid = laid.drop("leaves", "saved").join(after, ["conv_id", "band"])
    names = [*KEY, "edge", "n_leaves", "saved"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = Shard(batch)
            get = lambda c: batch.column(batch.schema.names.index(c))  # noqa: B023, E731
            lists = get("own")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            slot = flat.field(0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(s.n), counts)
            sums = []
            for k, tail in ((1, "tail_leaves"), (2, "tail_saved")):
                laid_out = np.zeros((s.n, s.width + 1), np.int64)
                laid_out[at, slot] = flat.field(k).to_numpy(zero_copy_only=False)
                laid_out[:, s.width] += get(tail).fill_null(0).to_numpy(zero_copy_only=False)
                sums.append(laid_out[s.order][:, ::-1].cumsum(axis=1)[:, ::-1])
            for column in range(s.width + 1):
                first, edge, _ = s.level(column)
                real = s.band[first] == 0 if column == 0 else s.there[first, column - 1]
                depth = s.band[first] * band + column
                values = [depth, s.k1[first, column], s.k2[first, column], edge, *(np.add.reduceat(x[:, column], first) for x in sums)]
                yield pa.RecordBatch.from_arrays([pa.array(v[real]) for v in values], names=names)

    parts = in_batches(sharded(laid), run, "depth bigint, k1 bigint, k2 bigint, edge boolean, n_leaves bigint, saved bigint")
    parts = staged(parts, "trie-sums")
    edges = parts.where("edge").groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return parts.where("NOT edge").drop("edge").unionByName(edges)


def prefix_trie(turns: DataFrame, prefix=plain_prefix, band: int = BAND) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, turn, role and text; other columns are ignored. Null roles and texts are empty; turns go by number, null first, and
    equal numbers by role and text; repeated rows are repeated turns. Rows without a conv_id belong to no conversation. Texts of any length
    count as a whole; a conversation of any length is cut in bands. A table without conversations has no nodes, not even a root.
    """
    made, convs = rebuilt(ordered_turns(turns), prefix)
    rows = staged(banded(made, convs, band), "trie-rows")
    nodes = staged(recombined(staged(found_nodes(rows, band), "trie-parts")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    whole = nodes.join(subtree_sums(rows, nodes, band), KEY).join(children, KEY, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
