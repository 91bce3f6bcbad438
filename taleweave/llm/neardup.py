"""Near-duplicates of documents: SimHash components, completed by MinHash bands; exact Jaccard similarity of word shingles decides.

* A document is the set of its shingles of ``shingle`` lower-cased words; a shorter text is one shingle, and all
  texts without a word are alike. Equal texts are one node.
* Operator 9 comes first: each node meets the least one of its component of SimHash fingerprints at most ``DISTANCE``
  bits apart, found by the Gray-order index. Pairs that hold on the words are settled, and asked nowhere again.
* Fingerprints of texts with a similarity of 0.8 differ in about ten bits, too many for any index of them. What they
  don't reach is found by bands of MinHash, of nodes that SimHash has not brought together.
* ``BANDS`` bands of ``ROWS`` least hashes each: two nodes of similarity s share a band with probability
  1 - (1 - s^ROWS)^BANDS, that is all but 3 in a million pairs at 0.8 and fewer above.
* The nodes of a band's bucket first meet one leader: of them, the one whose buckets are largest together, which
  is the middle of a group of near copies.
* Nodes that are not in one component with all others of a bucket by then meet through an exact prefix join, not
  pair by pair: of n shingles, rarest first, only the first n - ceil(0.8 n) + 1 are keys, for two sets as similar
  as that share one of them. Boilerplate that a bucket shares comes last in that order and is no key. Sizes, and
  what can still follow the places of a shared key, are filters.
* Candidates are verified on the words themselves. Components of the verified pairs make the result.

A null text counts as an empty one. Each phase is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import listed, sliced, written
from .components import components
from .simhash import one_of_each

SHINGLE, THRESHOLD = 5, 0.8
DISTANCE = 3
BANDS, ROWS = 32, 5
CHUNK = 2048

_random = np.random.default_rng(42)
MULTIPLIERS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32, endpoint=False) | np.uint32(1)
FACTORS = _random.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)
BAND_FACTORS = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) | np.uint64(1)
BAND_SEEDS = _random.integers(0, 1 << 63, BANDS, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def shingles(text: str | None, shingle: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    return set(zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else {tuple(w)}


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of 64 bits for each shingle, repeats included."""
    h = xxhash.xxh64_intdigest
    w = np.array([h(x) for x in words_of(text)], np.uint64)
    n = max(1, len(w) - shingle + 1)
    sums = np.zeros(n, np.uint64)
    for k, part in enumerate(w[i : i + n] for i in range(min(shingle, len(w)))):
        sums += part * FACTORS[k]
    return mixed(sums)


def band_keys(text: str | None, shingle: int) -> np.ndarray:
    """A hash for each band."""
    hashes = (shingle_hashes(text, shingle) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(hashes), CHUNK):
        np.minimum(least, (MULTIPLIERS[:, None] * hashes[None, start : start + CHUNK]).min(1), out=least)
    return mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * BAND_FACTORS).sum(1, dtype=np.uint64) ^ BAND_SEEDS)


def banded(keyed: DataFrame, text: str, id: str, shingle: int) -> DataFrame:
    """``id``, ``__hash`` and ``bands`` of every row."""
    schema = T.StructType([keyed.schema[id], keyed.schema["__hash"], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(x.as_py(), shingle).view(np.int64) for x in b.column(2)]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], bands], names=schema.names)

    return keyed.select(id, "__hash", F.col(text).cast("string")).mapInArrow(run, schema)


def verified(pairs: DataFrame, keyed: DataFrame, text: str, shingle: int, threshold: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            stay, of, a = [], None, set()
            for u, x, y in zip(rows.column(0), rows.column(2), rows.column(3), strict=True):
                if of is None or u != of:
                    of, a = u, shingles(x.as_py(), shingle)
                b = shingles(y.as_py(), shingle)
                both = len(a & b)
                stay.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield rows.select(["u", "v"]).filter(pa.array(stay, pa.bool_()))

    ends = written(pairs.select(F.col("u").alias("__hash")).union(pairs.select("v")).distinct(), "ends")
    texts = keyed.select("__hash", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(listed(ends), "__hash", "left_semi")
    texts = written(texts.groupBy("__hash").agg(F.first("t").alias("t")), "texts")
    first = pairs.join(texts.toDF("v", "y"), "v")
    both = first.join(texts.toDF("u", "x"), "u").select("u", "v", "x", "y")
    return both.mapInArrow(run, "u long, v long")


def hashed_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``root``, ``size`` and ``hashes`` (of its different shingles) of every row of ``texts(node, root, t)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for b in batches for s in sliced(b, 2)):
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in b.column(2)]
            sizes = np.array([len(x) for x in sets], np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "root", "size", "hashes"])

    return texts.select("node", "root", "t").mapInArrow(run, "node long, root long, size int, hashes array<long>")


def candidates(nodes: DataFrame, keyed: DataFrame, text: str, shingle: int, threshold: float) -> DataFrame:
    """Pairs ``u < v`` of ``nodes(node, root)`` with different roots that may be as similar as ``threshold``; no pair that is gets lost.

    Shingles of one node only cannot be shared: they take their places in the order, but are not joined.
    """
    texts = keyed.select(F.col("__hash").alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(listed(nodes), "node")
    sets = written(hashed_sets(texts.groupBy("node").agg(F.first("root").alias("root"), F.first("t").alias("t")), shingle), "sets")
    each = sets.select("node", "root", "size", F.explode("hashes").alias("key"))
    # a shingle within one component joins nothing
    shared = written(each.groupBy("key").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("across")).where("n > 1"), "shared")
    of = Window.partitionBy("node")
    placed = each.join(listed(shared), "key").withColumns({"of": F.count("*").over(of), "nth": F.row_number().over(of.orderBy("n", "key"))})
    place = (F.col("size") - F.col("of") + F.col("nth")).alias("place")  # from 1
    keys = placed.select("key", "node", "root", "size", "across", place).where(F.col("across") & (F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-6) + 1)).drop("across")
    keys = written(keys, "prefixes")
    x, y = (keys.toDF("key", *(side + c for c in ("node", "root", "size", "place"))) for side in "xy")
    close = F.least("xsize", "ysize") >= threshold * F.greatest("xsize", "ysize") - 1e-6
    most = 1 + F.least(F.col("xsize") - F.col("xplace"), F.col("ysize") - F.col("yplace"))
    enough = most >= threshold / (1 + threshold) * (F.col("xsize") + F.col("ysize")) - 1e-6
    pairs = x.join(y, "key").where((F.col("xroot") < F.col("yroot")) & close & enough)
    return pairs.select(F.least("xnode", "ynode").alias("u"), F.greatest("xnode", "ynode").alias("v")).distinct()


def near_groups(keyed: DataFrame, *, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, distance: int = DISTANCE) -> DataFrame:
    """``id``, ``__hash`` and ``root`` (of its component) of every row of ``keyed``, which has ``__hash`` of its text."""
    alike = simhash.simhash_components(keyed.select("__hash", text), text=text, id="__hash", distance=distance)
    close = written(alike.where("component_id <> __hash").select(F.col("component_id").alias("u"), F.col("__hash").alias("v")).distinct(), "close")
    settled = written(verified(close, keyed, text, shingle, threshold), "settled")

    rows = written(banded(keyed, text, id, shingle), "bands")
    keys = rows.groupBy("__hash").agg(F.first("bands").alias("bands")).select(F.col("__hash").alias("node"), F.explode("bands").alias("key"))
    size = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    under = settled.select(F.col("v").alias("node"), F.col("u").alias("of"))
    met = written(keys.join(listed(size), "key").join(listed(under), "node", "left").withColumn("of", F.coalesce("of", "node")), "met")
    weight = written(met.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    leader = F.max(F.struct("weight", "node", "of"))
    leaders = written(met.join(listed(weight), "node").groupBy("key").agg(leader.alias("l")).select("key", F.col("l.node").alias("u"), F.col("l.of").alias("u_of")), "leaders")
    led = written(met.join(listed(leaders), "key").where("u_of <> of").select("u", F.col("node").alias("v")).distinct(), "led")
    links = written(settled.union(verified(led, keyed, text, shingle, threshold)), "links")
    so_far = written(components(links), "so-far")

    def rooted(nodes: DataFrame, node: str) -> DataFrame:
        return nodes.join(listed(so_far).withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))

    at = written(rooted(met.select("key", "node"), "node"), "at")
    apart = written(at.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"), "apart")
    alone = written(at.join(listed(apart), "key", "left_semi").select("node", "root").distinct(), "alone")
    if not alone.isEmpty():
        tried = led.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        more = written(candidates(alone, keyed, text, shingle, threshold).join(tried, ["u", "v"], "left_anti"), "rest")
        so_far = written(components(links.union(verified(more, keyed, text, shingle, threshold))), "components")
    return rooted(rows.select(id, "__hash"), "__hash")


def keep_one(docs: DataFrame, *, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the smallest id that is not null, of its texts the one with the least hash."""
    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return one_of_each(keyed, written(near_groups(keyed, text=text, id=id, **options), "groups"), id).select(*docs.columns)
