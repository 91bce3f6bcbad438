"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers, ``floor(scale * x)``. Queries and candidates are dealt into blocks of a bounded number of
rows, and each block of queries meets each block of candidates in a task of its own: of both sides copies are
shuffled, so neither grows with the other's whole size, and nothing passes through the driver but two counts.

Within a pair of blocks the candidates lie in vertical layout, one array a dimension. Tiles of queries accumulate
products dimension block by dimension block; after each block the mass that remains (the product of the norms of the
dimensions not yet read, by Cauchy-Schwarz) bounds what a candidate can still reach, and candidates that reach the
k-th best score so far of no query of the tile are compacted away. A pair of blocks returns k rows a query at most;
a window over those few rows, pruned before its shuffle, makes the result.

Null vectors and vectors that hold null, NaN or infinite components take no part, neither do rows with a null id. A
query's own row is the row with its id. Ties go to the smaller id; repeated vectors and ids are ranked like any
other row. Vectors of unlike length are compared over the dimensions both have. Scores are exact: sums of floats
where these stay below 2**53, and integers of any width beyond. A score of the result that no long can hold is an
error. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at most, but for chance: with 64 dimensions 16 and 32 MB.
QUERY_ROWS, CANDIDATE_ROWS = 32_768, 65_536
#: Queries that are compared at once, and candidates of a batch.
TILE, BATCH = 64, 8192
BLOCK_DIMS = 8
#: Whole numbers below this are exact as floats.
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, is_query: Column, id: str, vector: str, scale: int) -> DataFrame:
    """``asks``, ``vec_id`` and ``v`` (an array of whole doubles) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    # a float of 2**52 or more is whole, and floor() would pass it through a long
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    part = v.isNotNull() & F.col(id).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.where(part).select(F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(id).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as columns of a (dims, rows) array; short rows are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise OverflowError("a scaled component is beyond the range of a double")
    out = np.zeros((int(lengths.max()) if len(lengths) else 0, len(lengths)))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
    return out


def rest_norms(m: np.ndarray, block: int) -> np.ndarray:
    """Norms of what is left before each dimension block: shape (blocks, rows)."""
    if not len(m):
        return np.zeros((1, m.shape[1]))
    biggest = max(float(np.abs(m).max(initial=0)), 1.0)  # squares of huge components would be infinite
    squares = np.add.reduceat((m / biggest) ** 2, np.arange(0, len(m), block), axis=0)
    return biggest * np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


class Best:
    """The k best (score, id) pairs of each query of a tile so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, object)] * n
        self.least = np.full(n, -math.inf)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            cut = sorted(scores)[-self.k] if scores.dtype == object else np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], np.array([int(s) for s in scores], object)])
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            last = int(self.scores[q][-1])
            self.least[q] = float(last) if abs(last) < EXACT else np.nextafter(float(last), -math.inf)


def search_tile(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vertical: np.ndarray, best: Best, block: int) -> None:
    """Put one batch of candidates, in vertical layout, to one tile of queries."""
    dims = min(len(queries), len(vertical))
    queries, vertical = queries[:dims], vertical[:dims]
    left, left_q = rest_norms(vertical, block), rest_norms(queries, block)
    alive, partial = np.arange(len(ids)), np.zeros((len(own), len(ids)))
    wide = float(left_q[0].max(initial=0)) * float(left[0].max(initial=0)) >= EXACT / 2
    if wide:
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        partial = whole(queries).T.dot(whole(vertical)) if dims else partial
    for b, start in enumerate(range(0, 0 if wide else dims, block)):
        if (best.least > -math.inf).all():
            # a candidate whose bound only equals the k-th score may still win by its id
            bound = partial + left_q[b][:, None] * (left[b][alive] * (1 + 1e-9))[None, :] + 1e-3
            stay = np.flatnonzero((bound >= best.least[:, None]).any(0))
            if len(stay) < 0.75 * len(alive):
                alive, partial = alive[stay], partial[:, stay]
        if not len(alive):
            return
        partial = partial + queries[start : start + block].T @ vertical[start : start + block][:, alive]
    found = ids[alive]
    hits = (partial >= best.least[:, None]) & (found[None, :] != own[:, None])
    for q in np.flatnonzero(hits.any(1)):
        best.add(q, found[hits[q]], partial[q][hits[q]])


def search(asked: pa.Table, candidates: pa.Table, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``query id``, ids and scores of the k best of one block of candidates, for each query of one block."""
    query_ids, ids = asked["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    queries, vertical = matrix(asked["v"]), matrix(candidates["v"])
    for t in range(0, len(query_ids), TILE):
        own = query_ids[t : t + TILE]
        best = Best(len(own), k)
        for c in range(0, len(ids), BATCH):
            search_tile(queries[:, t : t + TILE], own, ids[c : c + BATCH], vertical[:, c : c + BATCH], best, block)
        yield from zip(own.tolist(), best.ids, best.scores, strict=True)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: int = 256,
    id: str = "vec_id",
    vector: str = "embedding",
    query_rows: int = QUERY_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
    block_dims: int = BLOCK_DIMS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that ``is_query`` picks, its k best other rows."""
    everything = integer_vectors(vectors, is_query, id, vector, scale)
    n, asking = everything.agg(F.count("*"), F.count_if("asks")).first()
    # small tables are dealt out as well, so that all cores take part
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    query_blocks, blocks = max(1, math.ceil(asking / query_rows)), max(1, math.ceil(n / candidate_rows), min(tasks, n // 1024))
    place = F.monotonically_increasing_id()
    numbers = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    asked = everything.where("asks").select((place % query_blocks).cast("int").alias("qb"), "vec_id", "v").select("qb", numbers(blocks).alias("cb"), "vec_id", "v")
    candidates = everything.select((place % blocks).cast("int").alias("cb"), "vec_id", "v").select(numbers(query_blocks).alias("qb"), "cb", "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(search(left, right, k, block_dims)) if left.num_rows and right.num_rows else []
        columns = [np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found])] if found else [[], [], []]
        return pa.table({name: pa.array([int(x) for x in c], pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    out = asked.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
