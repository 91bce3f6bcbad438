"""Queries of role-play. Items of ``benchmark`` are questions, conversations with the same remainder of 25 their hits, roles the characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import roleplay as rp
from ..operators import story
from . import query, table

ASKED = """a AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS character FROM benchmark),
b AS (SELECT DISTINCT conv_id AS block FROM conversations), h AS (SELECT query_id, block, row_number() OVER (PARTITION BY query_id ORDER BY block)::INTEGER AS rank FROM a JOIN b ON block % 25 = query_id % 25)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "user").otherwise("assistant").alias("character"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block")).distinct().withColumn("m", F.col("block") % 25)
    met = asked(spark, sf_dir).withColumn("m", F.col("query_id") % 25).join(blocks, "m")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("block"))).select("query_id", "rank", "block")


WORDS = "list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\pL\\pN]+'), lambda w: w <> '')))"


@query(f"""WITH {ASKED}, t AS (SELECT conv_id AS block, turn AS pos, role AS speaker, text AS content, {WORDS.format('text')} AS words FROM conversations WHERE trim(coalesce(text, '')) <> ''),
k AS (SELECT speaker AS character, list(words) AS have FROM t WHERE block % 25 < 5 AND pos < 2 GROUP BY speaker),
f AS (SELECT h.query_id, h.rank AS place, t.*, (speaker = a.character)::INTEGER AS own FROM h JOIN t USING (block) JOIN a USING (query_id) LEFT JOIN k ON k.character = a.character
 WHERE NOT coalesce(len(list_filter(have, lambda x: len(list_intersect(x, words)) >= 0.8::DOUBLE * len(list_distinct(list_concat(x, words))))) > 0, false)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, words ORDER BY own DESC, place, block, pos) = 1), c AS (SELECT *, sum(own) OVER (PARTITION BY query_id) >= 2 AS enough FROM o)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, place, block, pos)::INTEGER AS rank, block, pos, speaker, content, own = 0 AS relaxed FROM c WHERE own = 1 OR NOT enough QUALIFY rank <= 3""")
def style_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards have the first two turns of a fifth of the conversations."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.col("text").alias("content"))
    known = turns.where("block % 25 < 5 AND pos < 2 AND trim(coalesce(content, '')) <> ''").groupBy(F.col("speaker").alias("character")).agg(F.collect_list("content").alias("samples"))
    return rp.style_samples(asked(spark, sf_dir), hits(spark, sf_dir), turns, known)


@query(f"""WITH {ASKED}, t AS (SELECT conv_id AS block, turn AS pos, role, 't' || conv_id || '.' || turn AS id, coalesce(text, '') AS text FROM conversations),
facts AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY h.rank, pos) AS place, id, text FROM h JOIN t USING (block) WHERE pos = 0),
s AS (SELECT conv_id AS id0, role AS source, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'n' || conv_id % 9 END AS target, turn, coalesce(text, '') AS text FROM conversations),
sd AS (SELECT id0, turn, source AS character, target AS other, text FROM s UNION ALL SELECT id0, turn, target, source, text FROM s), l AS (SELECT * FROM sd WHERE character <> other QUALIFY row_number() OVER (PARTITION BY character, other ORDER BY id0 DESC, turn DESC, 't' || id0 || '.' || turn DESC) = 1),
rel AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id0 DESC, turn DESC, 't' || id0 || '.' || turn DESC) AS place, 't' || id0 || '.' || turn AS id, text FROM a JOIN l USING (character)),
nar AS (SELECT query_id, min(h.rank) * 100 + pos AS place, id, text FROM h JOIN t USING (block) WHERE pos BETWEEN 0 AND 2 GROUP BY query_id, id, text, pos),
u AS (SELECT query_id, 0 AS k, 'fact' AS kind, 2 AS most, place, id, text FROM facts UNION ALL SELECT query_id, 1, 'relation', 3, place, id, text FROM rel UNION ALL SELECT query_id, 2, 'narrative', 4, place, id, text FROM nar),
o AS (SELECT * FROM u WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY k, place) = 1)
SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, k ORDER BY place, id)::INTEGER AS rank, id, text FROM o QUALIFY rank <= most""")
def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns are facts, turns relations of their role, and the turns within one of the second narration."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block"), F.col("turn").alias("pos"), "role", F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    q, h = asked(spark, sf_dir), hits(spark, sf_dir)
    facts = h.join(t.where("pos = 0"), "block").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "pos")))
    target = F.when(F.col("pos") % 2 == 0, "user").otherwise(F.concat(F.lit("n"), (F.col("block") % 9).cast("string")))
    relations = t.select("id", F.col("role").alias("source"), target.alias("target"), "text", F.col("block").alias("doc_id"), F.col("pos").alias("chapter_order"))
    parents = t.select(F.col("block").alias("doc_id"), F.lit(0).alias("chapter_idx"), F.col("pos").alias("idx"), "text", "id")
    around = story.expand_neighbours(h.select("query_id", "rank", F.col("block").alias("doc_id"), F.lit(0).alias("chapter_idx"), F.lit(1).cast("long").alias("idx")), parents, 1)
    narrated = around.select("query_id", (F.col("rank") * 100 + F.col("idx")).alias("place"), F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("."), F.col("idx").cast("string")).alias("id"), "text")
    return rp.evidence(q, {"fact": (facts, 2), "relation": (rp.relation_hits(q, relations), 3), "narrative": (narrated, 4)})
