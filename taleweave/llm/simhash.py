"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 bits over word shingles. Equal fingerprints are one node. Links between different
fingerprints (at most ``distance`` bits apart) are found in a hierarchy of shared masked bit patterns:

* Upper nodes. The bits are cut into ``distance + 2`` blocks; two fingerprints within the distance agree on two
  blocks at least. A node is a pair of blocks and the bits shared there, so each fingerprint hangs under one
  node a pair. Rows of a node meet in one task, in the order of their Gray rank.
* A node with over ``node_rows`` fingerprints is replaced by its children: the bits it doesn't fix are cut into
  blocks again, and two of those are fixed as well. With 48 of 64 bits fixed a child holds 65,536 at most.
* Within a node, runs of the Gray order that share a bit pattern form groups, level by level. A search walks
  down from the top, adding the differing bits that each level's pattern settles, and drops a whole group once
  the sum exceeds the distance.

A node returns links that span what it found connected, never all pairs. Components of the links make the
result. Documents are joined to their fingerprint's component last.

Null and empty texts have fingerprint zero and are linked like any other. A null id takes part in linking and
is ignored when the smallest id is taken. Repeated rows share a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import listed, written
from .components import components

BITS = 64
GROUP = 16
HASH_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text: bit i is 1 if it is set in over half of the shingles' XXH64."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, HASH_ROWS):
        part = w[start : min(start + HASH_ROWS, n) + shingle - 1]
        hashes = [h(b" ".join(part), seed)] if len(part) < shingle else [h(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(shingle)), strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), shingle: int = 3, seed: int = 42) -> DataFrame:
    """``keys`` and ``fp`` (the 64 bits as a long) of every row."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(len(keys))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))], names=[f.name for f in schema])

    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order: neighbours in it differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def levels(order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The groups above a Gray-ordered array, from the lowest level to the top: the bits that all members of a group share, which of them the group above does not fix already, and the pattern."""
    same, pattern = np.full(len(order), ~np.uint64(0)), order
    out = []
    while len(same) > 1:
        starts = np.arange(0, len(same), GROUP)
        joint = np.bitwise_and.reduceat(same, starts)
        unlike = np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts)
        joint &= ~unlike
        above = np.repeat(joint, np.diff(np.append(starts, len(same))))
        out.append((same, same & ~above, pattern))
        same, pattern = joint, pattern[starts] & joint
    out.append((same, same, pattern))
    return out


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def node_links(members: np.ndarray, distance: int, rows: int = 512) -> list[tuple[int, int]]:
    """Links that span the connected fingerprints of one node, found by walking its groups."""
    order = members[np.argsort(gray_rank(members), kind="stable")]
    order = order[np.append(True, order[1:] != order[:-1])]
    forest, tree = Forest(len(order)), levels(order)
    for start in range(0, len(order), rows):
        asked = np.arange(start, min(start + rows, len(order)))
        q, at, sum_ = asked, np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int16)
        for depth in range(len(tree) - 1, -1, -1):
            _, new, pattern = tree[depth]
            if depth < len(tree) - 1:  # from groups to their members
                child = at[:, None] * GROUP + np.arange(GROUP)
                inside = child < len(new)
                q, sum_, at = np.repeat(q, GROUP)[inside.ravel()], np.repeat(sum_, GROUP)[inside.ravel()], child[inside]
            sum_ = sum_ + count_bits((order[q] ^ pattern[at]) & new[at])
            # a link joins two ways; groups that end before the query are left to their own search
            stay = (sum_ <= distance) & ((at + 1) * GROUP**depth > q)
            q, at, sum_ = q[stay], at[stay], sum_[stay]
        other = at != q
        for a, b in zip(q[other].tolist(), at[other].tolist(), strict=True):
            forest.join(a, b)
    signed = order.view(np.int64)
    return [(int(signed[i]), int(signed[r])) for i in range(len(order)) if (r := forest.root(i)) != i]


def block_masks(bits: list[int], distance: int) -> list[int]:
    """Masks of all pairs of the ``distance + 2`` blocks that ``bits`` are cut into."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), distance + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def as_long(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def under_nodes(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once under each mask: ``mask``, ``bits`` (what it has there), ``fp``."""
    each = F.explode(F.array(*[F.lit(as_long(m)) for m in masks]))
    return rows.select("fp", each.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def search_nodes(rows: DataFrame, distance: int) -> DataFrame:
    """Links ``u``, ``v`` within each (mask, bits) node of ``rows(mask, bits, fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(part: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(1)) + 1
            bounds = np.concatenate([[0], edge, [len(part)]])
            size = np.diff(bounds)
            found: list[tuple[int, int]] = []
            fps = np.ascontiguousarray(part[:, 2])
            pair = bounds[:-1][size == 2]
            near = pair[count_bits((fps[pair] ^ fps[pair + 1]).view(np.uint64)) <= distance]
            found += zip(fps[near].tolist(), fps[near + 1].tolist(), strict=True)
            for a, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found += node_links(fps[a : a + n].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for b in batches:
            rows = np.concatenate([*held, np.stack([c.to_numpy() for c in b.columns], 1)])
            if not len(rows):
                continue
            # the last node of a batch may go on in the next
            apart = np.flatnonzero((rows[:-1, :2] != rows[-1, :2]).any(1))
            last = apart[-1] + 1 if len(apart) else 0
            if last:
                yield links(rows[:last])
            held = [rows[last:]]
        if held:
            yield links(held[0])

    return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInArrow(run, "u long, v long")


def fingerprint_links(distinct: DataFrame, distance: int, node_rows: int) -> DataFrame:
    """Links between different fingerprints of ``distinct(fp)``: they span every component."""
    top = block_masks(list(range(BITS)), distance)
    rows = under_nodes(distinct, top)
    size = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(size, ["mask", "bits"])
    small = sized.where(F.col("n") <= node_rows).select("mask", "bits", "fp")
    large = sized.where(F.col("n") > node_rows).select("mask", "bits", "fp")
    lower = {m: [m | x for x in block_masks([b for b in range(BITS) if not m >> b & 1], distance)] for m in top}
    masks = F.create_map(*[x for m, below in lower.items() for x in (F.lit(as_long(m)), F.array(*[F.lit(as_long(b)) for b in below]))])
    children = large.select("fp", F.explode(masks[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp").distinct()
    return search_nodes(small.union(children), distance)


def one_of_each(keyed: DataFrame, groups: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row of ``keyed`` (with ``__hash`` of its text) for each root of its ``groups(id, __hash, root)``: that of the smallest id that is not null, of its texts the one with the least hash.

    Most groups are of one row, which stays where it is: only keys of larger groups are looked up.
    """
    best = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("__hash").alias("hash")))
    larger = written(groups.groupBy("root").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1").select("root", F.col("best.id").alias("__id"), F.col("best.hash").alias("__best")), "larger")
    touched = written(groups.join(listed(larger), "root").select(F.col(id).alias("__of"), F.col("__hash").alias("__text"), (F.col(id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__best"))).alias("__keep")).distinct(), "touched")
    same = F.col(id).eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__text"))
    alone = keyed.join(listed(touched), same, "left_anti")
    # rows that repeat id and text
    once = F.row_number().over(Window.partitionBy(id, "__hash").orderBy(F.lit(1)))
    first = keyed.join(listed(touched.where("__keep")), same, "left_semi").withColumn("__once", once).where(F.col("__once") == 1).drop("__once")
    return alone.unionByName(first)


def keep_one(docs: DataFrame, *, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id, of its texts the one with the least hash."""
    keyed = docs.withColumn("__hash", F.xxhash64(F.col(text)))
    groups = simhash_components(keyed, text=text, id=id, carry=("__hash",), rooted=True, **options)
    return one_of_each(keyed, groups, id).select(*docs.columns)


def simhash_components(
    docs: DataFrame,
    *,
    text: str = "text",
    id: str = "doc_id",
    shingle: int = 3,
    seed: int = 42,
    distance: int = 2,
    node_rows: int = 4096,
    carry: tuple[str, ...] = (),
    rooted: bool = False,
) -> DataFrame:
    """``id``, the columns to ``carry``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row; if ``rooted`` also ``root``, which two components never share."""
    rows = written(fingerprints(docs, text=text, keys=(id, *carry), shingle=shingle, seed=seed), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    linked = written(components(fingerprint_links(nodes.select("fp"), distance, node_rows)), "components")
    under = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = under.groupBy("root").agg(F.min("least").alias("component_id"))
    # most fingerprints stand alone: only linked ones meet in a second shuffle
    of = under.join(least, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select(id, *carry, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["root"] * rooted)
