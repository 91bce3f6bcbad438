"""Queries on stores and logs. ``part`` are blocks (brand a series, type a document, container size a channel), ``conversations`` sessions, ``events`` calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stores as so
from . import query, table


@query("""WITH a AS (SELECT c_custkey AS query_id, unnest([0, 1, 2, 3]) AS pos, unnest([c_custkey * 7, c_custkey, c_custkey * 7, -1]) AS id FROM customer), f AS (SELECT query_id, id, min(pos) AS pos FROM a GROUP BY ALL) SELECT query_id, id, pos, p_name AS name FROM f JOIN part ON p_partkey = id""")
def bulk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.posexplode(F.array(k * 7, k, k * 7, F.lit(-1))).alias("pos", "id"))
    return so.by_ids(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), asked)


@query("SELECT p_brand AS series, count(*) AS before, count(*) FILTER (p_size % 3 = 0) AS removed FROM part GROUP BY p_brand")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), "p_size")
    return so.removal_counts(p, p.where("p_size % 3 <> 0"), "series")


@query("SELECT p_brand AS series, count(DISTINCT p_type) AS docs, count(*) AS blocks, string_agg(DISTINCT split_part(p_type, ' ', 1), ',' ORDER BY split_part(p_type, ' ', 1)) AS channels, count(DISTINCT p_name) AS persons FROM part GROUP BY p_brand")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("channel", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return so.listing(p, "p_brand", "p_type", "channel", "p_name").withColumnRenamed("p_brand", "series").withColumn("channels", F.array_join("channels", ","))


@query("""WITH o AS (SELECT s_nationkey AS series, 'vol' || s_suppkey AS doc_id, s_name AS title FROM supplier), n AS (SELECT series, doc_id, 'new' AS title FROM o WHERE doc_id LIKE '%3' UNION ALL SELECT series, 'extra', 'new' FROM o GROUP BY series),
r AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) SELECT series, doc_id, title, row_number() OVER (PARTITION BY series ORDER BY coalesce(try_cast(nullif(regexp_extract(doc_id, '([0-9]+)[^0-9]*$', 1), '') AS INTEGER), 1073741824), doc_id)::INTEGER AS position FROM r""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("series"), F.concat(F.lit("vol"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.col("s_name").alias("title"))
    new = old.where("doc_id LIKE '%3'").withColumn("title", F.lit("new")).unionByName(old.select("series", F.lit("extra").alias("doc_id"), F.lit("new").alias("title")).distinct())
    return so.catalog(old, new)


@query("SELECT event_id, 0 AS pos, json_extract(props, '$.k')::BIGINT AS k FROM events")
def world_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.flattened(table(spark, sf_dir, "events"), "event_id", "props", "k: bigint")


@query("""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS t, sum(length(coalesce(text, '')) * 0.25) OVER (PARTITION BY conv_id) AS all_, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations), o AS (SELECT *, all_ > 80 AND age > 2 AS old FROM s)
SELECT conv_id, count(*) FILTER (old) AS folded, count(*) FILTER (NOT old) AS kept, coalesce(string_agg(left(t, 20), ' / ' ORDER BY turn) FILTER (old), '') AS summary FROM o GROUP BY conv_id""")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.compacted(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 100, 1)


@query("SELECT event_id, user_id % 7 AS log, ((row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) - 1) // 100)::INTEGER AS file FROM events")
def trace_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("log"), "ts")
    return so.rotated(e, "log", ["ts", "event_id"], 100).select("event_id", "log", "file")


@query("""WITH c AS (SELECT user_id % 20 AS provider, event_id, event_type IN ('error', 'view') AS bad, sum((event_type NOT IN ('error', 'view'))::INTEGER) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS run FROM events)
SELECT provider, min(event_id) AS first, count(*) AS failures FROM c WHERE bad GROUP BY provider, run HAVING count(*) >= 3""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("provider"), "event_id", "event_type")
    return so.open_circuits(e, "provider", ["event_id"], F.col("event_type").isin("error", "view"), 3)


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, len(string_split(t, chr(10))) AS n, strpos(t, chr(10)) AS first, length(t) - strpos(reverse(t), chr(10)) AS last FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN n < 3 THEN 'few_chapters' END, CASE WHEN first > 500 THEN 'long_head' END, CASE WHEN length(t) - last > 500 THEN 'long_tail' END) AS lacks FROM p""")
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for chapters here."""
    t = F.col("t")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    last = F.length(t) - F.instr(F.reverse(t), "\n")
    return d.select("doc_id", F.array_join(so.completeness(t, F.instr(t, "\n"), last, F.size(F.split(t, "\n", -1)), 500), ",").alias("lacks"))


@query("""WITH b AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS t FROM conversations), m AS (SELECT id, t, regexp_extract_all(t, '[A-Z][a-z]{3,}') AS l FROM b), n AS (SELECT id, [x FOR x, i IN l IF list_position(l, x) = i] AS names, string_split(t, '.') AS s FROM m),
q AS (SELECT id, list_slice(list_filter(list_transform(names, lambda x: {'name': x, 'answer': list_filter(s, lambda y: contains(y, x))[1]}), lambda p: p.answer IS NOT NULL), 1, 3) AS q FROM n),
u AS (SELECT id, unnest(range(len(q))) AS k, unnest(q) AS p FROM q) SELECT id, k::INTEGER AS k, p.name AS name, p.answer AS answer FROM u""")
def rule_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    b = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("names"), F.split(t, r"\.", -1).alias("s"))
    return so.rule_questions(b, F.col("names"), F.col("s"), 3)


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{3,}') AS own, regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[A-Z][a-z]{3,}') AS before FROM conversations)
SELECT conv_id, turn, array_to_string([x FOR x, i IN list_concat([role], own, before) IF list_position(list_concat([role], own, before), x) = i][1:5], ',') AS names FROM t""")
def candidate_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.array_join(so.prompt_candidates(F.array("role"), of(F.col("text")), of(F.col("before")), most=5), ",").alias("names"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS t, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS text, count(*) AS n_blocks FROM w WHERE upto <= 200 OR k = 1 GROUP BY conv_id""")
def chapter_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.chapter_texts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 200)


@query("SELECT event_id, round(CASE WHEN event_type = 'error' THEN least(greatest(value, 0), 30) ELSE least(1.5 * power(2, event_id % 8), 30) END, 6)::DOUBLE AS wait FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_type") == "error", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(so.backoff(F.col("event_id") % 8, 1.5, 30.0, asked), 6).alias("wait"))
