"""SimHash fingerprints and near-duplicate groups by a grid over segment popcounts.

A 64-bit fingerprint is cut in 32 segments of two bits; its embedding is the vector of their bit counts (0 to 2). Flipping one bit moves
the vector by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance. The coordinates form `grids`
sub-grids whose distances add up: within distance d at least `grids - d` sub-grids do not move at all, so two such points lie in the same
cell of one of the grids spanned by that many sub-grids. Inside a cell a pair passes the Manhattan bound first and the exact Hamming
distance then. A cell holds each fingerprint once, is dealt in blocks when it is large, and gives only the links that join what was not
yet joined there, never all its pairs.

Near copies of a wider likeness (`survivors`) come through the same grid: it proposes links of fingerprints, which are counted exactly on the
sets of shingles and joined to groups. Likeness 0.8 is beyond what the grid can promise (about ten bits of 64), so pairs of different groups
that share a run of MinHash values are proposed and counted after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, mixed, spread, staged, whole_groups, with_field
from tidemark.llm.components import components

BITS = 64
SEGMENTS = 32
_LOW = np.uint64(0x5555555555555555)
#: Bits of a row's number that hold its place in its partition.
PLACE_BITS = 40
#: Rows of a cell that meet in one task.
BLOCK = 2048
#: Shingles of a block of texts whose sets meet in one task.
SET_BLOCK = 1 << 19
#: MinHash values of a set, and how many of them name a cell. All values are dealt in runs three times over.
SIGNS = 256
RUN = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mixed(np.arange(1, SIGNS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_DEALT = np.concatenate([mixed(np.arange(1 + k * SIGNS, 1 + (k + 1) * SIGNS, dtype=np.uint64)).argsort().reshape(-1, RUN) for k in range(3)])
#: Names of sets that a task knows again.
MET = 1 << 20
#: Shingles whose bits are summed at a time.
_STEP = 1 << 16


def shingle_hashes(text: bytes | None, width: int, seed: int, repeats: bool) -> np.ndarray:
    """XXH64 of every shingle of A-Z lower-cased words; a shorter text is one shingle, a wordless one has none. Without repeats, each once."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(width, len(parts))
    n = len(parts) - k + 1
    cuts = map(slice, starts[:n].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(joined.__getitem__, cuts)), np.uint64, n)
    return hashes if repeats else np.unique(hashes)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42, words: int = 1, repeats: bool = True) -> np.ndarray:
    """Majority votes of the bits of all shingle hashes, as unsigned integers; a text without words gives zeros.

    The first word takes the shingles' XXH64, each further one a remix of it.
    """
    return voted(shingle_hashes(text, width, seed, repeats), words)


def voted(hashes: np.ndarray, words: int) -> np.ndarray:
    """Majority votes of the bits of the hashes, `words` unsigned integers."""
    votes = np.zeros((words, BITS), np.int64)
    for at in range(0, len(hashes), _STEP):
        some = hashes[at : at + _STEP]
        for j in range(words):
            own = mixed(some + np.uint64(j)) if j else some
            bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[j] += np.add.reduce(bits, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 4, seed: int = 42) -> DataFrame:
    """All columns but the text, and the fingerprint as signed bigint `out`. Null and empty texts have fingerprint 0."""
    kept = [c for c in docs.columns if c not in (text, out)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias(out))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width, seed)[0] for t in batch.column(len(kept)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(prints)], names=[*kept, out])

    return in_batches(frame, run, with_field(frame, out, T.LongType()))


def embedding(fp: str | Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed in the same places of one bigint."""
    x = F.col(fp) if isinstance(fp, str) else fp
    upper, low = F.shiftrightunsigned(x, 1), F.lit(0x5555555555555555)
    return x.bitwiseXOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(upper).bitwiseAND(low), 1))


def sub_grids(grids: int) -> list[int]:
    """Bit masks of the sub-grids: runs of whole segments, as even as can be."""
    edges = [2 * (SEGMENTS * g // grids) for g in range(grids + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings: per segment 1 for neighbours (xor 01 or 11), 2 for the ends (xor 10)."""
    x = a ^ b
    low, high = x & _LOW, (x >> np.uint64(1)) & _LOW
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def links_in_cells(cell: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `distance` among equal, adjacent cells that join all that is linked there: a spanning forest of each cell.

    `prints` has a row of words for each place. Every pair of a cell is tested, offset by offset, and only what joins two trees is kept.
    """
    n = len(cell)
    emb = (prints ^ (prints >> np.uint64(1))) & _LOW | (prints & (prints >> np.uint64(1)) & _LOW) << np.uint64(1)
    root = np.arange(n)
    out_a, out_b = [], []
    at = np.arange(n - 1)
    j = 1
    while len(at):
        at = at[at < n - j]
        at = at[cell[at] == cell[at + j]]
        near = at[manhattan(emb[at], emb[at + j]).sum(axis=1) <= distance]
        near = near[np.bitwise_count(prints[near] ^ prints[near + j]).sum(axis=1) <= distance]
        near = near[root[near] != root[near + j]]
        if len(near):
            parent = root.copy()
            for i in near.tolist():
                a, b = i, i + j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out_a.append(i)
                    out_b.append(i + j)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            root = parent
        j += 1
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def near_links(nodes: DataFrame, words: list[str], distance: int = 4, grids: int = 6, still: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ids of different fingerprints; `nodes` holds each once, with id and the columns `words`.

    Each word is placed in C(grids, still) cells, one for every choice of `still` sub-grids that are not to move; grids - distance of them, the
    default, find every link of a one-word fingerprint. `grids` trades copies for the size of the cells: 6 and distance 4 give 15 copies and
    cells of about 3e-5 of the rows, 8 gives 70 copies and about 1.5e-7. A cell of over `block` rows is dealt in blocks by hash, and every
    two of its blocks meet in a task of their own.
    """
    still = grids - distance if still is None else still
    if not 0 < still <= grids <= SEGMENTS:
        raise ValueError("the sub-grids that do not move must be 1 to all of them")
    ways = list(combinations(sub_grids(grids), still))
    cells = [F.xxhash64(F.lit(j), F.lit(k), embedding(w).bitwiseAND(F.lit(_signed(sum(way))))) for j, w in enumerate(words) for k, way in enumerate(ways)]
    placed = nodes.select("id", *words, F.explode(F.array(*cells)).alias("cell"))
    large = placed.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).alias("blocks"))
    dealt = placed.join(staged(large, "simhash-large"), "cell", "left")  # written first, so that the join is planned by its size
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), blocks)
    met = dealt.select("id", *words, "cell", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
    unit = met.select(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "id", *words)
    dealt_out = unit.repartition(spread(nodes.sparkSession), "unit").sortWithinPartitions("unit")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["unit"]):
            prints = np.stack([part.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            a, b = links_in_cells(part.column("unit").to_numpy(), prints, distance)
            id_ = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(id_[a]), pa.array(id_[b])], names=["a", "b"])

    return dealt_out.mapInArrow(run, "a bigint, b bigint")


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (id, least and more) with root, the name of a node's group over `links`, and component_id, the group's smallest `least`."""
    roots = components(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42, distance: int = 4,
                grids: int = 6) -> DataFrame:
    """All columns of `docs` but the text, with fp and component_id: the smallest id reachable over links of `distance` or fewer bits.

    Null and empty texts have fingerprint zero and are linked like any other; a null id never becomes a group's id unless it has no
    other; repeated rows are kept and share their group. Columns named fp, root or component_id are replaced. An empty table gives none.
    """
    clean = docs.drop("fp", "component_id", "root")
    prints = staged(fingerprints(clean, text, "fp", width, seed), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min(doc_id).alias("least")).withColumn("id", F.col("fp")), "simhash-nodes")
    return prints.join(grouped(nodes, near_links(nodes, ["fp"], distance, grids)).select("fp", "component_id"), "fp")


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """Cells of a set of hashes, each named by a run of its MinHash values; none for the empty set.

    Two sets of likeness j share one run with chance j^RUN. At 0.8 they share none of all with a chance of about a millionth (one of 1.2 million simulated pairs).
    """
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(SIGNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, mixed(hashes[None, at : at + 512] ^ _SALTS[:, None]).min(axis=1), out=least)
    values = mixed(least + np.arange(SIGNS, dtype=np.uint64) * _ODD)[_DEALT].sum(axis=1, dtype=np.uint64)
    return mixed(values + np.arange(len(_DEALT), dtype=np.uint64) * _ODD).view(np.int64)


def shingle_sets(docs: DataFrame, text: str, width: int, seed: int) -> DataFrame:
    """`docs` but the text with _row, a number of the row, _set, _size and _print, name, size and fingerprint of its set of shingles, and _cells, the set's cells.

    _row has the partition in the high bits and the place in it in the low 40; it holds once the result is written. Equal sets have equal
    names; texts without words are the set 0. Of equal sets of a task only the first names its cells, so that a set met very often fills no cell.
    """
    kept = [c for c in docs.columns if c != text]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("binary").alias("_bytes"))
    added = T._parse_datatype_string("_row bigint, _set bigint, _size bigint, _print bigint, _cells array<bigint>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << PLACE_BITS
        met: dict[int, int] = {}
        for batch in batches:
            out = []
            for data in batch.column(len(kept)).to_pylist():
                hashes = shingle_hashes(data, width, seed, repeats=False)
                name = set_name(hashes)
                if name in met:
                    out.append((at, name, len(hashes), met[name], np.empty(0, np.int64)))
                else:
                    fp = int(voted(hashes, 1).view(np.int64)[0])
                    out.append((at, name, len(hashes), fp, cells_of(hashes)))
                    if len(met) < MET:
                        met[name] = fp
                at += 1
            numbers = np.array([x[:4] for x in out], np.int64).reshape(-1, 4)
            ends = np.cumsum([0, *(len(x[4]) for x in out)])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(x[4] for x in out)])))
            columns = [*(pa.array(numbers[:, k]) for k in range(4)), cells]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *added.names])

    return in_batches(frame, run, T.StructType([*frame.drop("_bytes").schema.fields, *added.fields]), release=True)


def print_links(nodes: DataFrame, distance: int = 4, grids: int = 6) -> DataFrame:
    """Links (a, b) between the `nodes` (id and fingerprint fp) that join all whose fingerprints differ by `distance` bits or fewer, or not at all."""
    prints = staged(nodes.groupBy("fp").agg(F.min("id").alias("id")), "simhash-prints")
    equal = nodes.join(prints.select("fp", F.col("id").alias("b")), "fp").where("id != b").select(F.col("id").alias("a"), "b")
    return near_links(prints, ["fp"], distance, grids).unionByName(equal)


def sharing(rows: DataFrame) -> DataFrame:
    """Links (a, b) from every set of `rows` to the least set of each of its cells. Cells pass by in order and are never held."""
    placed = rows.select(F.explode("_cells").alias("cell"), F.col("_set").alias("id"))
    dealt = placed.repartition(spread(rows.sparkSession), "cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, id_ = (c.to_numpy() for c in batch.columns)
            new = np.r_[cell[0] != last[0], cell[1:] != cell[:-1]]
            first = np.flatnonzero(new)
            if new[0]:
                least = id_[first][np.cumsum(new) - 1]
            else:
                least = np.r_[np.int64(last[1]), id_[first]][np.cumsum(new)]
            last = cell[-1], least[-1]
            pairs = np.unique(np.stack([id_, least], axis=1)[id_ != least], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def set_name(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set of hashes, given sorted; 0 for the empty one only."""
    return (xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes()) or 1) - (1 << 63) or 1 if len(hashes) else 0


def alike(sets: list[np.ndarray], likeness: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard likeness is `likeness` or more, by exact counts of common elements.

    From each set reached, all sets not yet reached are counted over lists of the sets that hold an element; sets reached leave the lists.
    """
    share = Fraction(str(likeness))
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cuts = np.r_[0, np.cumsum(sizes)]
    waiting = np.ones(len(sets), bool)

    def lists() -> tuple[np.ndarray, np.ndarray]:
        some = waiting[owner]
        order = np.argsort(code[some], kind="stable")
        return owner[some][order], np.r_[0, np.cumsum(np.bincount(code[some], minlength=code.max() + 1))]

    held, starts = lists()
    listed, left = len(sets), len(sets)
    out = []
    for first in range(len(sets)):
        if not waiting[first]:
            continue
        waiting[first] = False
        left -= 1
        reached = [first]
        while reached and left:
            x = reached.pop()
            if 2 * left < listed:
                held, starts = lists()
                listed = left
            own = code[cuts[x] : cuts[x + 1]]
            n = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            common = np.bincount(held[at], minlength=len(sets))
            found = np.flatnonzero(waiting & (common * (share.denominator + share.numerator) >= share.numerator * (sizes[x] + sizes)))
            waiting[found] = False
            left -= len(found)
            reached += found.tolist()
            out += [(x, y) for y in found.tolist()]
    return out


def verified(rows: DataFrame, text: str, nodes: DataFrame, links: DataFrame, likeness: float, width: int, seed: int, block: int = SET_BLOCK,
             joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join all nodes of Jaccard likeness `likeness` or more within each group of the proposed `links`.

    `nodes` has id, row (one of the rows with this set) and size. Each group meets as a whole: one of up to `block` shingles in one task, a
    larger one dealt in blocks by hash, every two of which meet in a task of their own. Only the texts of linked nodes are sent, picked by a
    bit per row, so that texts without a proposed link stay where they are. `joined` (node, root) are groups already known: links within them
    are passed over, and a group with a link to elsewhere meets with all its nodes.
    """
    named = nodes.select(F.col("id").alias("node"), "row", "size")
    if joined is None:
        members = components(links).join(named, "node")
    else:
        for end in ("a", "b"):
            links = links.join(joined.select(F.col("node").alias(end), F.col("root").alias("_root")), end, "left").withColumn(
                end, F.coalesce("_root", end)).drop("_root")
        groups = components(links).withColumnRenamed("node", "_group")
        known = named.join(joined.select("node", F.col("root").alias("_root")), "node", "left").withColumn("_group", F.coalesce("_root", "node"))
        members = known.join(groups, "_group").select("node", "root", "row", "size")
    members = staged(members, "simhash-members")
    large = members.groupBy("root").agg(F.ceil(F.sum("size") / block).alias("blocks")).where("blocks > 1")
    dealt = members.join(staged(large, "simhash-large"), "root", "left")  # written first, so that the join is planned by its size
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("node"), blocks)
    met = dealt.select("row", F.col("node").alias("id"), "root", mine.alias("mine"), F.sequence(F.lit(0).cast("bigint"), blocks - 1).alias("others"))
    units = F.transform("others", lambda o: F.xxhash64("root", F.least("mine", o), F.greatest("mine", o)))
    bit = lambda row: F.expr(f"shiftleft(1L, cast({row} & 63 as int))")
    picked = staged(members.groupBy(F.shiftright("row", 6).alias("_word")).agg(F.bit_or(bit("row")).alias("_bits")), "simhash-picked")
    texts = rows.select(F.col("_row").alias("row"), F.col(text).cast("binary").alias("text")).withColumn("_word", F.shiftright("row", 6))
    texts = texts.join(picked, "_word").where(F.col("_bits").bitwiseAND(bit("row")) != 0).select("row", "text")
    sent = texts.join(met.select("row", "id", units.alias("units")), "row").select(F.explode("units").alias("unit"), "id", "text")
    sent = sent.repartition(spread(rows.sparkSession), "unit").sortWithinPartitions("unit")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = alike(sets, likeness)
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        unit, ids, sets = None, [], []
        for batch in batches:
            for u, id_, data in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit:
                    if len(ids) > 1:
                        yield links_of(ids, sets)
                    unit, ids, sets = u, [], []
                ids.append(id_)
                sets.append(shingle_hashes(data, width, seed, repeats=False))
        if len(ids) > 1:
            yield links_of(ids, sets)

    return in_batches(sent, run, "a bigint, b bigint", release=True)


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, likeness: float = 0.8) -> DataFrame:
    """One row of each group of near copies, with the columns of `docs`: a row with the group's smallest id.

    Near copies share `likeness` or more of their different shingles, counted exactly; groups are what such links join. The grid of SimHash
    fingerprints proposes first, every link of four bits or fewer; between the groups found so, and what is in none, shared cells of MinHash
    values propose the rest, wide enough for a likeness of 0.8 and above. Of several rows with a group's smallest id the first one stays.
    Null ids come after all others; null and empty texts are copies of each other. An empty table gives none.

    The texts are written once with the names of their sets; only those that share a cell are sent to be compared. What goes is listed by the
    place of its rows in their partition, and that list is joined back by its size.
    """
    if likeness < 0.8:
        raise ValueError("the cells are made for a likeness of 0.8 or more")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # own columns under one name, which no other can clash with
    packed = docs.select(whole.alias("_doc"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = staged(shingle_sets(packed, "_text", width, seed), "simhash-rows", dense=True)
    own = rows.select(F.col("_id").alias("doc"), F.col("_row").alias("row"), F.col("_set").alias("id"))
    nodes = staged(rows.groupBy(F.col("_set").alias("id"), F.col("_size").alias("size"), F.col("_print").alias("fp")).agg(
        F.min("_id").alias("least"), F.min("_row").alias("row")), "simhash-nodes")
    counted = partial(verified, rows, "_doc.`" + text + "`", nodes, likeness=likeness, width=width, seed=seed)
    near = staged(counted(links=print_links(nodes.select("id", "fp"))), "simhash-near")
    rest = counted(links=sharing(rows), joined=components(near))
    groups = grouped(nodes.select("id", "least"), near.unionByName(rest))
    found = own.join(groups.select("id", "root", "component_id"), "id")
    first = found.where(F.col("doc").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("first"))
    going = found.join(first, "root").where("row != first").select(part("row").alias("_part"), place("row").alias("place"))
    gone = staged(bit_lists(going), "simhash-gone")
    kept = rows.withColumn("_part", part("_row")).join(gone, "_part", "left")
    byte = F.coalesce(F.conv(F.hex(F.substring("_gone", F.shiftright(place("_row"), 3) + 1, 1)), 16, 10), F.lit("0")).cast("bigint")
    stays = F.getbit(byte, place("_row").bitwiseAND(F.lit(7))) == 0
    return kept.where(stays).select("_doc.*")


def bit_lists(places: DataFrame) -> DataFrame:
    """_part and _gone, a bit for each place of the partition, set for the `places` (_part, place) given; the lowest bit of a byte comes first."""
    dealt = places.repartition(spread(places.sparkSession), "_part").sortWithinPartitions("_part", "place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["_part"]):
            parts, at = group.column("_part").to_numpy(), group.column("place").to_numpy()
            first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            lists = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(parts)]):
                bits = np.zeros(int(at[hi - 1]) + 1, np.uint8)
                bits[at[lo:hi]] = 1
                lists.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts[first]), pa.array(lists, pa.binary())], names=["_part", "_gone"])

    return dealt.mapInArrow(run, "_part bigint, _gone binary")


def part(row: str) -> Column:
    return F.shiftright(F.col(row), PLACE_BITS)


def place(row: str) -> Column:
    return F.col(row).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
