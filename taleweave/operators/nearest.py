"""Vector search: exact cosine top-k, for a batch of queries over all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Queries sent to the executors at once.
CHUNK = 8192


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column, each divided by its norm; a zero vector stays zero."""
    m = np.array(column.to_pylist(), np.float64)
    if not m.size:
        return np.zeros((0, 0))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def search(blocks: DataFrame, queries: DataFrame, k: int, *, least: float | None = None, by: str | None = None, skip_self: bool = True, digits: int = 6) -> DataFrame:
    """``query_id``, [``by``,] ``rank``, ``id``, ``similarity``: the ``k`` most similar of ``blocks(id, vector[, by])`` to each of ``queries(query_id, vector)``.

    With ``by`` the best ``k`` of each value of it (a channel), in the same pass. Queries go to the executors
    in chunks of a bounded number of rows; each task keeps the best of its rows only, and a window over those
    makes the result. Ties go to the smaller id.
    """
    spark = blocks.sparkSession
    n = queries.count()
    chunks = max(1, math.ceil(n / (CHUNK / 2)))
    rows = blocks.where(F.col("vector").isNotNull()).select("id", *([by] if by else []), "vector")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + (f"{by} {blocks.schema[by].dataType.simpleString()}, " if by else "") + f"id {blocks.schema['id'].dataType.simpleString()}, similarity double"
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    out = None
    for c in range(chunks):
        part = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c) if chunks > 1 else asked).toArrow()
        sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), unit_rows(part["vector"].combine_chunks() if part.num_rows else pa.array([]))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                own = b.column(0).to_numpy()
                groups = np.array(b.column(1).to_pylist(), object) if by else np.zeros(b.num_rows, object)
                scores = np.round(unit_rows(b.column(b.num_columns - 1)) @ q.T, digits)
                for g in sorted(set(groups), key=str):
                    at = np.flatnonzero(groups == g)
                    s, o = scores[at], own[at]
                    # all that reach the k-th score, with one more for the query's own row
                    cut = np.partition(s, max(0, len(at) - k - 1), axis=0)[max(0, len(at) - k - 1)]
                    i, j = np.nonzero(s >= cut)
                    keep = (o[i] != ids[j]) if skip_self else np.ones(len(i), bool)
                    if least is not None:
                        keep &= s[i, j] >= least
                    i, j = i[keep], j[keep]
                    columns = [pa.array(ids[j])] + ([pa.array([g] * len(i), b.schema.field(1).type)] if by else []) + [pa.array(o[i]), pa.array(s[i, j])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", *([by] if by else []), "id", "similarity"])

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    group = ["query_id", *([by] if by else [])]
    return top_k(out, group, [F.desc("similarity"), F.col("id")], k).select(*group, "rank", "id", "similarity")


def hashed_embedding(text: Column, dims: int) -> Column:
    """A deterministic stand-in for a model: normalised counts of hashed characters and bigrams."""
    from ..functions.text import char_ngrams
    from ..functions.vectors import hashed_bucket

    buckets = F.transform(F.concat(F.filter(F.split(text, ""), lambda c: c != ""), char_ngrams(text, 2)), lambda t: hashed_bucket(t, dims))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), dims), lambda acc, b: F.transform(acc, lambda x, i: x + F.when(i == b, 1.0).otherwise(0.0)))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, F.round(x / length, 6)).otherwise(0.0))


def hashed_embeddings(rows: DataFrame, text: str, dims: int) -> DataFrame:
    """``id``, ``bucket``, ``value``: the same embedding as one row a non-zero dimension, by aggregation instead of arrays."""
    from ..functions.text import char_ngrams
    from ..functions.vectors import hashed_bucket

    t = F.coalesce(F.col(text), F.lit(""))
    tokens = rows.select("id", F.explode(F.concat(F.filter(F.split(t, ""), lambda c: c != ""), char_ngrams(t, 2))).alias("token"))
    # few tokens are different ones, so each is hashed once a task at most
    counts = tokens.groupBy("id", "token").agg(F.count("*").alias("n")).groupBy("id", hashed_bucket(F.col("token"), dims).alias("bucket")).agg(F.sum("n").alias("n"))
    length = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("length"))
    return counts.join(length, "id").select("id", "bucket", F.round(F.col("n") / F.col("length"), 6).alias("value"))
