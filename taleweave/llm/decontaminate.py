"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Texts become sets of shingles of ``shingle`` lower-cased words. A document is contaminated by an item if it
holds at least ``threshold`` of the item's shingles. Comparing sketches of both sides estimates Jaccard similarity,
which a short item inside a long document hardly moves, so the search is one-sided (containment MinHash): an item's
sketch is its bottom s shingles in a random (hash) order, and the document is asked for these. Items are partitioned
by size, in powers of two, and all items of a partition have sketches of one length: the least s such that a document
without any of them cannot hold the threshold of the partition's largest items, and so of none. That finds every
candidate; candidates are then verified by counting the item's shingles in the document exactly.

Documents are probed whole, in one pass, in Arrow batches. The sketches hold a fifth to two fifths of the benchmark's shingles and
Spark broadcasts them only if they are small. Null texts hold nothing and are clean; an item of fewer words
than a shingle is one shingle, which a document of the same few words holds. Null items match nothing. Items
that repeat a text are all listed. Repeated rows get the same result each. Empty tables give clean documents,
or no rows. Columns of the input stay as they are; an added column whose name is taken has underscores before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

#: Bytes of a text as those of its words: A-Z in lower case, white space for all else in ASCII that is no letter or digit.
FORM = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Hashes from which a batch goes on.
BATCH = 1 << 18

RESULT = ("contaminated", "n_items", "containment", "item_ids")


def shingle_hashes(text: bytes | None, k: int, factors: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``k`` words, repeats included; of the whole sequence if there are fewer words."""
    w = (text or b"").translate(FORM).split()
    if not w:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        sums += each[j : j + n] * factors[j]
    return sums


def shingled(rows: DataFrame, text: str, k: int) -> DataFrame:
    """``rows`` with ``hs``, the hashes of its shingles, in place of ``text``: each word is hashed once, and sums make the runs."""
    keys = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in keys), T.StructField("hs", T.ArrayType(T.LongType()))])
    factors = np.random.default_rng(42).integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, start, found, held = b.column(len(keys)), 0, [], 0
            for at in range(len(b)):
                found.append(shingle_hashes(texts[at].as_py(), k, factors))
                held += len(found[-1])
                if held >= BATCH or at == len(b) - 1:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, at + 1 - start) for c in b.columns[:-1]), hs], names=schema.names)
                    start, found, held = at + 1, [], 0

    return rows.select(*keys, F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def sketch_length(n: Column, threshold: float) -> Column:
    """The length of the sketches of the partition that an item of n shingles falls into: those of 2**k to 2**(k+1) - 1 shingles."""
    largest = F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) + 1) - 1
    return (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("long")


def signatures(items: DataFrame, threshold: float, seed: int = 7) -> DataFrame:
    """The sketches of ``items(item, h, n)``: the bottom shingles in hash order, as many as the item's partition has."""
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.xxhash64(F.lit(seed), "h"), "h"))
    return items.withColumn("place", order).where(F.col("place") <= sketch_length(F.col("n"), threshold)).select("item", "h")


def contamination(docs: DataFrame, items: DataFrame, *, text: str, id: str, item_id: str, item_text: str, shingle: int, threshold: float) -> DataFrame:
    """``__id``, ``__text`` (the text's hash) and the result columns of each contaminated text."""
    pairs = shingled(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")), "t", shingle).select("item", F.explode("hs").alias("h"))
    full = written(pairs.distinct().withColumn("n", F.count("*").over(Window.partitionBy("item"))), "items")
    signed = signatures(full, threshold)
    key = [F.col(id).alias("__id"), F.xxhash64(F.col(text)).alias("__text")]
    whole = docs.select(*key, F.col(text).alias("__whole"))
    probes = shingled(whole, "__whole", shingle).select("__id", "__text", F.explode("hs").alias("h"))
    found = written(probes.join(signed, "h").select("__id", "__text", "item").distinct(), "candidates")
    near = found.select(F.col("__id").alias("__of"), F.col("__text").alias("__in")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__text") == F.col("__in"))
    held = shingled(whole.join(near, same, "left_semi"), "__whole", shingle).select("__id", "__text", F.explode("hs").alias("h"))
    both = held.join(full, "h").select("__id", "__text", "item", "n", "h").distinct()
    wanted = found.select(F.col("__id").alias("__of"), F.col("__text").alias("__in"), F.col("item").alias("__item"))
    counted = both.groupBy("__id", "__text", "item", "n").agg(F.count("*").alias("held")).join(wanted, same & F.col("item").eqNullSafe(F.col("__item")), "left_semi")
    sure = counted.withColumn("share", F.col("held") / F.col("n")).where(F.col("held") >= F.col("n") * threshold - 1e-9)
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("item")), lambda x: x.cast("string")), ",")
    return sure.groupBy("__id", "__text").agg(F.count("*").alias("__items"), F.max("share").alias("__share"), listed.alias("__ids"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``containment`` (the largest) and ``item_ids`` (sorted, comma-joined)."""
    assert 0 < threshold <= 1 and shingle > 0 and not math.isnan(threshold)
    named = {c: free_name(docs, c) for c in RESULT}
    bad = contamination(docs, items, text=text, id=id, item_id=item_id, item_text=item_text, shingle=shingle, threshold=threshold)
    joined = docs.withColumn("__h", F.xxhash64(F.col(text))).join(bad, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__text")), "left")
    added = {"contaminated": F.col("__items").isNotNull(), "n_items": F.coalesce("__items", F.lit(0)).cast("long"), "containment": F.coalesce("__share", F.lit(0.0)), "item_ids": F.coalesce("__ids", F.lit(""))}
    return joined.select(*docs.columns, *(v.alias(named[k]) for k, v in added.items()))
