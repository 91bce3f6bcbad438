"""Queries on indexes that are built once and asked often: vectors in cells, analyses by volume, story blocks.

Their folders lie in the shared scratch folder, one for each run of a query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann, incremental, nearest
from ..operators import structure as st
from ..operators.graphs import shared_folder
from ..sources.versions import Versions
from . import query, retrieval, structure, table


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/taleweave-{what}-{uuid.uuid4().hex}"


def ann_hits(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of every row whose id is divisible by 100 against all rows, the index's rows, and the queries."""
    blocks, asked = retrieval.blocks(spark, sf_dir), retrieval.asked(spark, sf_dir).select("query_id", "vector")
    path = folder(spark, "ann")
    ann.build(blocks, path)
    q, rows = ann.load(spark, path)
    return ann.search(rows, q, asked, blocks, k), rows, asked


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hits(spark, sf_dir)[0]


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n, count(*) FILTER (id % 100 = 0) AS q FROM v)
SELECT n AS indexed, n AS different_ids, q AS queries, q * least(10, n - 1) AS wanted, true AS recalled FROM n""")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index holds every row, and nine tenths of the exact hits (by vector_topk's operator) are found."""
    hits, rows, asked = ann_hits(spark, sf_dir)
    exact = nearest.search(retrieval.blocks(spark, sf_dir), asked, 10)
    both = exact.join(hits.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    found = both.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))
    held = rows.agg(F.count("*").alias("indexed"), F.countDistinct("id").alias("different_ids"))
    return held.crossJoin(asked.agg(F.count("*").alias("queries"))).crossJoin(found)


@query(f"""WITH {structure.LINES}, h AS (SELECT doc_id, line, t, CASE {structure.RULES} END AS hit FROM l)
SELECT source, doc_id, line::INTEGER AS line, left(trim(regexp_replace(t, '^#{{1,3}}\\s+', '')), 60) AS title, hit.rule AS rule FROM h JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE hit IS NOT NULL""")
def incremental_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by volume (source): analysed when a third of the volumes had fewer documents, then brought up to date; as one run over everything would give."""
    docs = structure.documents(spark, sf_dir)
    catalog = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    store = Versions(spark, folder(spark, "analysis"))

    def analyse(volumes: DataFrame, rows: DataFrame) -> DataFrame:
        texts = rows.join(F.broadcast(volumes), "source", "left_semi")
        return st.chapter_lines(texts).join(texts.select("doc_id", "source"), "doc_id").select("source", "doc_id", "line", "title", "rule")

    old = (F.crc32(F.col("source").cast("binary")) % 3 != 0) | (F.col("doc_id") % 2 == 0)
    incremental.refresh(store, catalog.where(old), "source", ["doc_id", "n_chars"], lambda v: analyse(v, docs.where(old)))
    incremental.refresh(store, catalog, "source", ["doc_id", "n_chars"], lambda v: analyse(v, docs))
    return incremental.claims(store, "source")


@query("""WITH s AS (SELECT s_nationkey AS series, s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'narrative' WHEN 1 THEN 'relation' ELSE 'event' END AS kind FROM supplier),
f AS (SELECT c_nationkey AS series, c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'relation' ELSE 'event' END AS kind FROM customer WHERE c_nationkey % 2 = 0),
t AS (SELECT n_nationkey AS series FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT c_nationkey AS series, c_custkey % 5 = 0 AS stale FROM customer)
SELECT series, (SELECT count(*) FROM s WHERE s.series = t.series) AS before, (SELECT count(*) FROM s WHERE s.series = t.series AND kind <> 'narrative') AS deleted,
 (SELECT count(*) FROM f WHERE f.series = t.series) AS inserted, (SELECT count(*) FROM s WHERE s.series = t.series AND kind = 'narrative') + (SELECT count(*) FROM f WHERE f.series = t.series) AS after,
 (SELECT count(*) FROM c WHERE c.series = t.series AND NOT stale) AS cards FROM t""")
def story_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are blocks, customers cards and new story blocks; those of the nations with an even key are published."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    kind = F.element_at(F.array(F.lit("narrative"), F.lit("relation"), F.lit("event")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    blocks = supplier.select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("id"), kind.alias("kind"))
    cards = customer.select(F.col("c_nationkey").alias("series"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("stale"))
    found = customer.select(F.col("c_nationkey").alias("series"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "relation").otherwise("event").alias("kind"))
    store = Versions(spark, folder(spark, "story"))
    store.publish({"blocks": blocks, "cards": cards})
    even = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("series"))
    return incremental.publish_story(store, found, even)
