"""Approximate cosine search: cells of a coarse quantizer, product codes of what is left, exact scores for the best.

``train`` fits on a sample of about ``SAMPLE_ROWS`` rows, taken by a hash of the id: k-means in rounds of one job, in
which each task sums the rows nearest to each centre and the sums of all tasks are added up in a tree. Only centres
and code books, whose number is a parameter, are on the driver. ``encode`` gives every row its cell and its codes, in
one narrow pass, and ``build`` writes them with the cell as partition column, beside the quantizer.

``search`` asks the nearest cells of each query. Cells are dealt into blocks of a bounded number of rows, and so are the
queries of a cell, so a cell that holds a third of all rows is many tasks. Codes are scored by tables, the best of each
query are scored exactly on their vectors, and ties go to the smaller id. How many cells are asked is measured at training
on sample rows: the fewest that hold ``recall`` of their true neighbours.

Vectors that are null, zero, or hold a null, NaN or infinite component have no direction and are not in the index.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .graphs import written

#: Rows of the sample that the quantizer is fitted on, and sample rows that are asked to find how many cells to probe.
SAMPLE_ROWS, PROBE_ROWS = 65_536, 256
#: Fewer rows than this are scanned: a code book needs that many to learn from.
LEAST_ROWS = 256
#: Rows and queries of a cell that meet in one task, but for chance.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 4096
SUB_VECTORS, CODES, ROUNDS = 32, 256, 8


@dataclass
class Quantizer:
    """``centres`` (cells, dims), ``books`` (sub-vectors, codes, width of one) and how many cells a query asks."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1

    def cells(self, rows: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        apart = (self.centres**2).sum(1) / 2 - rows @ self.centres.T
        return np.argsort(apart, axis=1, kind="stable")[:, :n]

    def codes(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        left = split(rows - self.centres[cells], len(self.books))
        return np.stack([nearest(left[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the inner product of each query with each coded row of a cell."""
        out = np.repeat((queries @ self.centres[cell])[:, None], len(codes), axis=1)
        for m, table in enumerate(np.einsum("qmw,mcw->mqc", split(queries, len(self.books)), self.books)):
            out += table[:, codes[:, m]]
        return out


def split(rows: np.ndarray, parts: int) -> np.ndarray:
    """Rows in ``parts`` sub-vectors of one width, padded with zeros."""
    width = math.ceil(rows.shape[1] / parts)
    return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) / 2 - rows @ centres.T).argmin(1)


def directed(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (unit length) of the vectors that have a direction."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(v.isNotNull() & sound).select(F.col(id).alias("id"), vx.normalized(v).alias("v")).where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lloyd(sample: DataFrame, start: np.ndarray, parts: Callable[[np.ndarray], np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """k-means of each part at once: ``start`` is (parts, centres, width), ``parts(rows)`` (rows, parts, width). A centre without rows stays where it is."""
    centres = start
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(centres.shape), np.zeros(centres.shape[:2])
            for b in batches:
                rows = parts(matrix(b.column(0))) if b.num_rows else ()
                for m in range(len(centres) if len(rows) else 0):
                    at = nearest(rows[:, m], centres[m])
                    np.add.at(sums[m], at, rows[:, m])
                    counts[m] += np.bincount(at, minlength=len(counts[m]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sums, counts))], pa.binary())], names=["s"])

        each = sample.select("v").mapInArrow(run, "s binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
        sums, counts = each.treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
        moved = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def default_cells(rows: int) -> int:
    return max(2, min(64, rows // 100))


def train(vectors: DataFrame, *, id: str = "id", vector: str = "vector", cells: int | None = None, sub_vectors: int = SUB_VECTORS, sample_rows: int = SAMPLE_ROWS, k: int = 10, recall: float = 0.97) -> Quantizer | None:
    """A quantizer for ``vectors``; None if fewer than ``LEAST_ROWS`` have a direction."""
    rows = directed(vectors, id, vector)
    n = rows.count()
    if n < LEAST_ROWS:
        return None
    place = F.xxhash64("id")
    some = rows if n <= sample_rows else rows.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    sample = written(some.withColumn("place", place), "ann-sample")
    first = lambda many: np.array([r.v for r in sample.orderBy("place", "id").limit(many).select("v").collect()])
    cells = cells or default_cells(n)
    centres = lloyd(sample, first(cells)[None], lambda r: r[:, None])[0]
    coarse = Quantizer(centres, np.zeros((0, 0, 0)))
    left = lambda r: split(r - coarse.centres[coarse.cells(r)[:, 0]], sub_vectors)
    found = Quantizer(centres, lloyd(sample, left(first(CODES)).transpose(1, 0, 2), left))
    found.probes = measured_probes(sample, found, k, recall)
    return found


def measured_probes(sample: DataFrame, q: Quantizer, k: int, recall: float) -> int:
    """How many of its nearest cells a query asks until they hold ``recall`` of its ``k`` nearest rows, over ``PROBE_ROWS`` rows of the sample as queries."""
    asked = sample.orderBy("place", "id").limit(PROBE_ROWS).select("id", "v").toArrow()
    ids, queries = asked["id"].to_numpy(), matrix(asked["v"].combine_chunks())
    order = np.argsort(q.cells(queries, len(q.centres)), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, rows = b.column(0).to_numpy(), matrix(b.column(1))
            scores, cell = queries @ rows.T, q.cells(rows)[:, 0]
            scores[ids[:, None] == own[None, :]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(order[at, cell[best.ravel()]].astype(np.int32))], names=["q", "score", "probe"])

    hits = sample.select("id", "v").mapInArrow(run, "q long, score double, probe int")
    near = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "probe"))).where(F.col("rank") <= k)
    at = near.agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY probe)")).first()[0]
    return 1 + int(at or 0)


def encode(vectors: DataFrame, q: Quantizer, *, id: str = "id", vector: str = "vector") -> DataFrame:
    """``id``, ``cell`` and ``codes`` (a byte a sub-vector) of every vector with a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = matrix(b.column(1))
            cells = q.cells(rows)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in q.codes(rows, cells)], pa.binary())], names=["id", "cell", "codes"])

    return directed(vectors, id, vector).mapInArrow(run, f"id {vectors.schema[id].dataType.simpleString()}, cell int, codes binary")


def build(vectors: DataFrame, path: str, **options) -> str:
    """Train and write an index at ``path``: ``rows``, with a folder a cell, and ``quantizer``. What was there is replaced only once the new one is whole.

    Returns ``skipped`` for too few rows (they are scanned), ``kept`` if the index there holds every row, ``built`` or ``rebuilt``.
    """
    spark = vectors.sparkSession
    old = load(spark, path)
    id, vector = options.get("id", "id"), options.get("vector", "vector")
    if old:
        lacking = directed(vectors, id, vector).select("id").join(old[1].select("id"), "id", "left_anti")
        if lacking.isEmpty():
            return "kept"
    q = train(vectors, **options)
    if q is None:
        return "skipped"
    version = spark.sql("SELECT uuid()").first()[0]
    encode(vectors, q, id=id, vector=vector).write.partitionBy("cell").parquet(f"{path}/rows-{version}")
    state = [(version, bytearray(pickle.dumps((q.centres, q.books, q.probes))))]
    # the quantizer names its rows, so a reader sees the old pair or the new one
    spark.createDataFrame(state, "version string, quantizer binary").coalesce(1).write.mode("append").parquet(f"{path}/quantizer")
    return "rebuilt" if old else "built"


def load(spark: SparkSession, path: str) -> tuple[Quantizer, DataFrame] | None:
    """The newest quantizer at ``path`` and its rows; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/quantizer")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    newest = spark.read.parquet(f"{path}/quantizer").select("*", "_metadata.file_modification_time").orderBy(F.desc("file_modification_time")).first()
    return Quantizer(*pickle.loads(bytes(newest.quantizer))), spark.read.parquet(f"{path}/rows-{newest.version}")


def search(index: DataFrame, q: Quantizer, queries: DataFrame, vectors: DataFrame, k: int, *, deep: int = 10, skip_self: bool = True, digits: int = 6, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``similarity`` for ``queries(query_id, vector)`` over the rows of ``index``, whose vectors are ``vectors(id, vector)``.

    ``deep`` times ``k`` rows a query are scored exactly.
    """
    wide = k * deep + 1
    asked = directed(queries, "query_id", "vector").withColumnRenamed("id", "query_id")
    kind = asked.schema["query_id"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = q.cells(matrix(b.column(1)), q.probes)
                at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "v", "cell"])

    routed = asked.mapInArrow(route, f"query_id {kind}, v array<double>, cell int")
    # blocks of each cell, by counts of as many rows as there are cells
    rows = index.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    asks = routed.groupBy("cell").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts"))
    sizes = F.broadcast(rows.join(asks, "cell"))
    numbers = lambda upto: F.explode(F.sequence(F.lit(0), F.col(upto) - 1))
    left = routed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), numbers("blocks").alias("block"), "query_id", "v")
    right = index.join(sizes, "cell").select("cell", numbers("parts").alias("part"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "codes")

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, found = y["id"].combine_chunks(), ([], [], [])
        if x.num_rows and y.num_rows:
            codes = np.frombuffer(b"".join(y["codes"].to_pylist()), np.uint8).reshape(y.num_rows, -1)
            cell, vs = x["cell"][0].as_py(), matrix(x["v"].combine_chunks())
            for s in range(0, x.num_rows, 64):
                scores = q.scores(vs[s : s + 64], cell, codes)
                best = np.argpartition(-scores, min(wide, y.num_rows) - 1, axis=1)[:, :wide]
                found[0].append(np.repeat(np.arange(s, s + len(scores)), best.shape[1]))
                found[1].append(best.ravel())
                found[2].append(np.take_along_axis(scores, best, 1).ravel())
        at, to, score = (np.concatenate([*f, np.empty(0)]) for f in found)
        return pa.table({"query_id": x["query_id"].combine_chunks().take(pa.array(at.astype(np.int64))), "id": ids.take(pa.array(to.astype(np.int64))), "about": pa.array(score)})

    met = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(meet, f"query_id {kind}, id {index.schema['id'].dataType.simpleString()}, about double")
    near = met.where(F.col("query_id") != F.col("id")) if skip_self else met
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "id"))).where(F.col("n") < wide)
    full = near.select("query_id", "id").join(directed(vectors, "id", "vector"), "id").join(asked.withColumnRenamed("v", "w"), "query_id")
    scored = full.select("query_id", "id", F.round(vx.dot(F.col("v"), F.col("w")), digits).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
