"""Ranked lists: top-k, fusion, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set

RRF_K = 60


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1. Spark prunes to ``k`` rows a group before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def fuse_ranked(hits: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the lists of ``hits(query_id, id, rank, list_no, similarity)``.

    Score is the sum of 1 / (constant + rank). Ties keep the order of first appearance: the earlier list, then
    the better rank. ``similarity`` is the best of the lists'. A single list keeps its own order.
    """
    fused = hits.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("rank_score"), F.max("similarity").alias("similarity"), F.min(F.struct("list_no", "rank")).alias("first"), F.count("*").alias("n_lists"))
    fused = fused.withColumn("rank_score", F.round("rank_score", 9))
    order = [F.desc("rank_score"), F.col("first.list_no"), F.col("first.rank"), F.col("id")]
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "rank_score", "similarity", "n_lists")


def fuse_ranks(lists: list[DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """``fuse_ranked`` of several frames ``(query_id, id, rank[, similarity])``, one a list."""
    named = [x.select("query_id", "id", "rank", (F.col("similarity") if "similarity" in x.columns else F.lit(None)).cast("double").alias("similarity"), F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
    return fuse_ranked(reduce(DataFrame.unionByName, named), k, constant)


def fuse_weighted(hits: DataFrame, by: str, weights: dict, k: int) -> DataFrame:
    """Weighted sum of the similarities of ``hits(query_id, id, similarity, by)``, by the weight of the channel ``by``; channels without one don't count."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv if kv[1] > 0])
    parts = hits.withColumn("weight", F.try_element_at(weight, F.col(by))).where(F.col("weight") > 0)
    fused = parts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("similarity") * F.col("weight")), 8).alias("score"))
    return top_k(fused, ["query_id"], [F.desc("score"), F.col("id")], k)


def lexical_score(query: Column, text: Column) -> Column:
    """Shared tokens, and a hundredth of their share of the text's tokens."""
    q, d = token_set(query), token_set(text)
    both = F.size(F.array_intersect(q, d))
    return both + F.when(F.size(d) > 0, 0.01 * both / F.size(d)).otherwise(0.0)


def rerank(hits: DataFrame, k: int) -> DataFrame:
    """``hits(query_id, id, rank, query, text)`` by lexical score, ties in the old order."""
    scored = hits.withColumn("score", F.round(lexical_score(F.col("query"), F.col("text")), 9)).withColumnRenamed("rank", "old_rank")
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("old_rank")], k)
