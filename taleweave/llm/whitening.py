"""Whitening of embeddings: the axes along which they vary most, each scaled to unit variance.

Vectors become integers, ``floor(scale * x)``. What is fitted is the list of distinct integer vectors. Each partition of
it folds its batches into a count, a sum and a scatter about its own mean, and partitions are merged by Chan's formula
for two sets in a ``treeReduce``, so no task holds more than a batch of rows and a few matrices of ``d`` by ``d``. The
driver takes the eigenvectors of the merged covariance. A second pass whitens the list and merges the covariance of the
result in the same way, which has to be the identity; its largest departure is a column of every row.

Vectors that are null, that hold a null, NaN or infinite component, or one whose scaled value no long can hold, take
no part. Rows with a null id do, repeated rows stay repeated (and count once in the fit), and other columns are not
read. A vector shorter than the longest is padded with zeros. Sums are exact at any size; a deviation that no long can
hold is null. An axis without variance (fewer distinct vectors than axes, say) has null as its whitened value, 0 explained and no
part in the identity. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

LONG = 1 << 63
#: Narrow forms of whole vectors, so that a vector of small numbers is shuffled in few bytes.
KINDS = ("<i1", "<i2", "<i4", "<i8")


@dataclass
class Moments:
    """Count, exact sums (Python integers or doubles) and scatter about the mean of some rows."""

    n: int
    total: np.ndarray
    scatter: np.ndarray


def less_mean(rows: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Rows without the mean ``total / n``, of whole numbers with its whole part taken off before anything is rounded."""
    if rows.dtype.kind != "i":
        return rows - np.array(total / n, float)
    whole = np.array([t // n for t in total.tolist()], np.int64)
    rest = np.array([(t % n) / n for t in total.tolist()])
    near = int(np.abs(rows.astype(float)).max(initial=0)) < LONG // 4
    return (rows - whole if near else rows.astype(float) - whole) - rest


def moments(rows: np.ndarray) -> Moments:
    exact = rows.dtype.kind == "i"
    fits = not exact or int(np.abs(rows.astype(float)).max(initial=0)) * len(rows) < LONG // 2
    total = rows.sum(0).astype(object) if fits else rows.astype(object).sum(0)
    centred = less_mean(rows, len(rows), total)
    return Moments(len(rows), total, centred.T @ centred)


def merge(x: Moments, y: Moments) -> Moments:
    """Chan's pairwise formula."""
    if not x.n or not y.n:
        return x if x.n else y
    n = x.n + y.n
    apart = np.array([(b * x.n - a * y.n) / (x.n * y.n) for a, b in zip(x.total.tolist(), y.total.tolist(), strict=True)])
    return Moments(n, x.total + y.total, x.scatter + y.scatter + np.outer(apart, apart) * (x.n * y.n / n))


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """A list column as rows of whole numbers, padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row in the narrowest kind of integer that holds it, so equal rows have equal bytes."""
    low, high = rows.min(1, initial=0), rows.max(1, initial=0)
    need = np.zeros(len(rows), int)
    for k, kind in enumerate(KINDS[:-1]):
        need[(low < np.iinfo(kind).min) | (high > np.iinfo(kind).max)] = k + 1
    out = [b""] * len(rows)
    for k, kind in enumerate(KINDS):
        for at, row in zip(np.flatnonzero(need == k).tolist(), rows[need == k].astype(kind), strict=True):
            out[at] = row.tobytes()
    return out


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.zeros((len(values), dims), np.int64)
    for kind in KINDS if dims else ():
        at = [k for k, v in enumerate(values) if len(v) == dims * np.dtype(kind).itemsize]
        out[at] = np.frombuffer(b"".join(values[k] for k in at), kind).reshape(-1, dims)
    return out


def merged(rows: DataFrame, dims: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> Moments:
    """The moments of ``of(row)``, of ``width`` numbers, over a table of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(0, np.zeros(width, object), np.zeros((width, width)))
        for b in batches:
            if b.num_rows:
                found = merge(found, moments(of(unpacked(b.column(0), dims))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["moments"])

    parts = rows.select("x").mapInArrow(run, "moments binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    if not parts.getNumPartitions():
        return Moments(0, np.zeros(width, object), np.zeros((width, width)))
    return parts.treeReduce(merge)


@dataclass
class Whitening:
    """What a fit found: ``axes`` has a unit eigenvector a column, by falling eigenvalue."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN along an axis without variance."""
        centred = less_mean(rows, self.n, self.total)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.axes / np.sqrt(self.values), np.nan)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - sum) ** 2``, exact."""
        most = self.n * max(abs(int(rows.min(initial=0))), int(rows.max(initial=0))) + max((abs(t) for t in self.total), default=0)
        if most * most * max(rows.shape[1], 1) < LONG:
            apart = self.n * rows - self.total.astype(np.int64)
            return (apart * apart).sum(1).tolist()
        apart = self.n * rows.astype(object) - self.total
        return [int(s) if s < LONG else None for s in (apart * apart).sum(1)]


def fit(distinct: DataFrame, dims: int, components: int) -> Whitening:
    """Fit a table of distinct packed rows."""
    found = merged(distinct, dims, dims, lambda rows: rows)
    count = min(components, dims)
    if not found.n or not count:
        return Whitening(found.n, found.total, np.zeros((dims, count)), np.zeros(count), np.zeros(count), 0.0)
    covariance = found.scatter / found.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    noise = max(float(values[0]), 0.0) * dims * np.finfo(float).eps
    values = np.where(values > noise, values, 0.0)
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else values
    out = Whitening(found.n, found.total, vectors[:, :count], values[:count], explained[:count], 0.0)
    live = int((out.values > 0).sum())
    if live:
        checked = merged(distinct, dims, live, lambda rows: out.project(rows)[:, :live])
        out.identity_error = float(np.abs(checked.scatter / checked.n - np.eye(live)).max())
    return out


def whiten(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """``id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every row that takes part."""
    v = F.col(vector)
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(LONG))
    rows = vectors.where(v.isNotNull() & F.forall(v, lambda x: F.coalesce(sound(x), F.lit(False)))).select(id, v.alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(integers(b.column(0), dims, scale)), pa.binary())], names=["x"])

    found = fit(written(rows.select("v").mapInArrow(pack, "x binary").distinct(), "distinct-vectors"), dims, components)
    count = min(components, dims)
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([vectors.schema[id], *(T.StructField(*k) for k in kinds)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1), dims, scale)
            each = np.repeat(np.arange(len(x)), count)
            whitened = found.project(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), found.n, np.int64)),
                    pa.array(found.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(whitened, pa.float64(), mask=np.isnan(whitened)),
                    pa.array(np.tile(found.explained, len(x)), pa.float64()),
                    pa.array(np.full(len(each), found.identity_error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(project, schema)
