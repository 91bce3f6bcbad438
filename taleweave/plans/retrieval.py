"""Queries of the retrieval engine. ``embeddings`` are blocks with a vector, ``label`` their channel; ``documents`` are blocks with text; ``benchmark`` items are questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import keyword, nearest, ranking, scope
from . import query, table

#: Questions of a vector search: every row whose id is divisible by 100, against all rows.
ASKED = 100


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where(F.col("id") % ASKED == 0).select(F.col("id").alias("query_id"), "vector", F.col("label").alias("query_label"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


COSINE = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.id AS query_id, q.label AS query_label, c.id, c.label, round(list_cosine_similarity(q.e, c.e), 6) AS similarity FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id)
"""
BIGRAMS = "CASE WHEN length({0}) < 2 THEN [] ELSE list_transform(list_zip(list_slice(string_split({0}, ''), 1, -2), list_slice(string_split({0}, ''), 2, -1)), lambda p: p[1] || p[2]) END"
BM25 = f"""
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_slice({BIGRAMS.format("text")}, 1, 8))) AS term FROM benchmark),
d AS (SELECT doc_id AS id, greatest(length(coalesce(text, '')) - 1, 0) AS len, unnest({BIGRAMS.format("coalesce(text, '')")}) AS term FROM documents),
tf AS (SELECT id, term, any_value(len) AS len, count(*) AS tf FROM d WHERE term IN (SELECT DISTINCT term FROM q) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(greatest(length(coalesce(text, '')) - 1, 0)) AS avgdl FROM documents),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY query_id, id)
"""


def ranked(source: str, partition: str, k: int, columns: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {partition} ORDER BY {order})::INTEGER AS rank FROM {source} QUALIFY rank <= {k}"


@query(f"WITH {COSINE} {ranked('s', 'query_id', 10, 'query_id, id, similarity', 'similarity DESC, id')}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(blocks(spark, sf_dir), asked(spark, sf_dir), 10)


@query(f"WITH {COSINE} {ranked('(SELECT * FROM s WHERE label < 5 AND similarity >= 0)', 'query_id', 10, 'query_id, id, similarity', 'similarity DESC, id')}")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(blocks(spark, sf_dir).where("label < 5"), asked(spark, sf_dir), 10, least=0.0)


@query(f"WITH {COSINE} {ranked('s', 'query_id, label', 3, 'query_id, label, id, similarity', 'similarity DESC, id')}")
def vector_topk_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(blocks(spark, sf_dir), asked(spark, sf_dir), 3, by="label")


CHANNELS = f"""WITH {COSINE},
c AS ({ranked('s', 'query_id, label', 6, 'query_id, label, id, similarity', 'similarity DESC, id')}),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS rank_score, max(similarity) AS similarity, min((label, rank)) AS first, count(*) AS n_lists FROM c WHERE label < 4 GROUP BY ALL)
SELECT query_id, id, rank_score, similarity, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, first, id)::INTEGER AS rank FROM f QUALIFY rank <= 10"""


@query(CHANNELS)
def multi_channel_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = nearest.search(blocks(spark, sf_dir).where("label < 4"), asked(spark, sf_dir), 6, by="label")
    return ranking.fuse_ranked(hits.withColumn("list_no", F.col("label")), 10)


@query(f"""WITH {COSINE},
c AS ({ranked('s', 'query_id, label', 20, 'query_id, label, id, similarity', 'similarity DESC, id')}),
f AS (SELECT query_id, id, round(sum(similarity * CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END), 8) AS score FROM c WHERE label < 3 GROUP BY ALL)
{ranked('f', 'query_id', 10, 'query_id, id, score', 'score DESC, id')}""")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = nearest.search(blocks(spark, sf_dir).where("label < 3"), asked(spark, sf_dir), 20, by="label")
    return ranking.fuse_weighted(hits, "label", {0: 0.5, 1: 0.3, 2: 0.2}, 10)


@query(f"WITH {BM25} {ranked('(SELECT * FROM bm WHERE score > 0)', 'query_id', 10, 'query_id, id, score', 'score DESC, id')}")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.bm25(texts(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"""WITH {BM25},
b AS ({ranked('(SELECT * FROM bm WHERE score > 0)', 'query_id', 30, 'query_id, id, score', 'score DESC, id')}),
tok AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')) AS q FROM benchmark),
dt AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')) AS d FROM documents),
r AS (SELECT query_id, id, rank AS old_rank, round(len(list_intersect(q, d)) + CASE WHEN len(d) > 0 THEN 0.01::DOUBLE * len(list_intersect(q, d)) / len(d) ELSE 0 END, 9) AS score FROM b JOIN tok USING (query_id) JOIN dt USING (id))
{ranked('r', 'query_id', 10, 'query_id, id, score, old_rank', 'score DESC, old_rank')}""")
def keyword_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked_ = texts(spark, sf_dir), questions(spark, sf_dir)
    hits = keyword.bm25(docs, asked_, 30).drop("score").join(docs.select("id", tx.empty_if_null(F.col("text")).alias("text")), "id").join(asked_, "query_id")
    return ranking.rerank(hits, 10).select("query_id", "id", "score", "old_rank", "rank")


HYBRID = f"""WITH {COSINE}, {BM25},
hv AS ({ranked('s', 'query_id', 30, 'query_id, id, similarity', 'similarity DESC, id')}),
hk AS ({ranked('(SELECT * FROM bm WHERE score > 0)', 'query_id', 30, 'query_id, id, score', 'score DESC, id')}),
u AS (SELECT query_id, id, rank, similarity, 0 AS list_no FROM hv UNION ALL SELECT query_id, id, rank, NULL, 1 FROM hk),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS rank_score, max(similarity) AS similarity, min((list_no, rank)) AS first, count(*) AS n_lists FROM u GROUP BY query_id, id)
SELECT query_id, id, rank_score, similarity, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, first, id)::INTEGER AS rank FROM f QUALIFY rank <= 10"""


@query(HYBRID)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits and keyword hits of the same questions, fused by rank."""
    by_vector = nearest.search(blocks(spark, sf_dir), asked(spark, sf_dir), 30)
    by_word = keyword.bm25(texts(spark, sf_dir), questions(spark, sf_dir), 30)
    return ranking.fuse_ranks([by_vector, by_word], 10)


@query(f"""WITH {COSINE},
l AS (SELECT *, CASE WHEN label = query_label AND similarity >= 0.3 THEN 0 WHEN label = query_label THEN 1 WHEN label % 2 = query_label % 2 THEN 2 END AS level FROM s),
m AS (SELECT query_id, id, similarity, level, min(level) OVER (PARTITION BY query_id) AS least FROM l WHERE level IS NOT NULL)
SELECT query_id, id, similarity, level::INTEGER AS level, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM m WHERE level = least QUALIFY rank <= 5""")
def filter_relax_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict scope first; a question without any hit falls back to a wider one."""
    b, q = blocks(spark, sf_dir), asked(spark, sf_dir)
    # the best few of a level are among the best few of its labels
    hits = nearest.search(b, q, 5, by="label").join(F.broadcast(q.select("query_id", "query_label")), "query_id")
    same, near = F.col("label") == F.col("query_label"), F.col("label") % 2 == F.col("query_label") % 2
    found = scope.strictest_level(hits.drop("rank"), [same & (F.col("similarity") >= 0.3), same, near])
    return ranking.top_k(found, ["query_id"], [F.desc("similarity"), F.col("id")], 5).select("query_id", "id", "similarity", "level", "rank")


@query("SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(1 / (1 + greatest(1 - list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 0)), 6) AS similarity FROM embeddings")
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vx.sanitized(F.col("vector"), 64)
    return blocks(spark, sf_dir).select("id", F.round(vx.norm(v), 6).alias("norm"), F.round(vx.similarity_of_distance(1 - vx.cosine(v, F.reverse(v))), 6).alias("similarity"))


@query(f"""WITH t AS (SELECT item_id AS id, unnest(list_concat(string_split(text, ''), {BIGRAMS.format("text")})) AS token FROM benchmark),
c AS (SELECT id, ((('0x' || substr(md5(token), 7, 2) || substr(md5(token), 5, 2) || substr(md5(token), 3, 2) || substr(md5(token), 1, 2))::BIGINT) % 64)::INTEGER AS bucket, count(*) AS n FROM t WHERE token <> '' GROUP BY ALL)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c""")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return nearest.hashed_embeddings(rows, "text", 64)


@query(f"WITH g AS (SELECT unnest({BIGRAMS.format('text')}) AS gram, doc_id FROM documents) SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY gram")
def bigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = texts(spark, sf_dir).select("id", F.explode(tx.char_ngrams(F.col("text"))).alias("gram"))
    # partial counts a document first, so that the second shuffle has no repeats
    return each.groupBy("gram", "id").agg(F.count("*").alias("n")).groupBy("gram").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
