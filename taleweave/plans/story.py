"""Queries of the story engine. ``events`` are story events: ``user_id`` a character, ``event_type`` a period; ``orders`` are relations of customers and priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nearest
from ..operators import scope as sc
from ..operators import story as so
from . import query, retrieval, table

PERIODS = ("signup", "view", "click", "purchase")


def story(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    year = F.when(F.col("value") > 80, F.floor("value").cast("int"))
    return e.select("event_id", (F.col("user_id") % 10).alias("series"), F.col("user_id").cast("string").alias("who"), F.when(F.col("event_type") == "purchase", "plot").otherwise("talk").alias("event_type"), year.alias("year"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("period"), F.dayofmonth("ts").alias("chapter_order"), F.col("props").alias("summary"), F.lit("d").alias("doc_id"))


STORY = """e AS (SELECT event_id, user_id % 10 AS series, user_id::VARCHAR AS who, CASE WHEN event_type = 'purchase' THEN 'plot' ELSE 'talk' END AS event_type, CASE WHEN value > 80 THEN floor(value)::INTEGER END AS year,
 CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS period, day(ts) AS chapter_order, props AS summary FROM events),
k AS (SELECT *, CASE WHEN year IS NOT NULL THEN 0 WHEN period <> '' THEN 1 ELSE 2 END AS tier, CASE WHEN year IS NOT NULL THEN year WHEN period <> '' THEN coalesce(list_position(['signup', 'view', 'click', 'purchase'], period) - 1, 99) ELSE 0 END AS at_ FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tier, at_, chapter_order, event_id)::INTEGER AS seq FROM k)"""


@query(f"WITH {STORY} SELECT event_id, series, seq, event_type = 'plot' AS key_event FROM c")
def chronicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.chronicle(story(spark, sf_dir), "series", eras=PERIODS).select("event_id", "series", "seq", "key_event")


@query(f"WITH {STORY} SELECT series, who, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs, count(*)::INTEGER AS n FROM c GROUP BY series, who")
def by_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = so.seqs_by(so.chronicle(story(spark, sf_dir), "series", eras=PERIODS), "series", F.col("who"), "who")
    return found.withColumn("seqs", F.array_join(F.transform("seqs", lambda x: x.cast("string")), ","))


@query(f"WITH {STORY} SELECT series, period AS era, min(seq) AS first, max(seq) AS last, count(*)::INTEGER AS n FROM c WHERE period <> '' GROUP BY series, period")
def by_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = so.seqs_by(so.chronicle(story(spark, sf_dir), "series", eras=PERIODS), "series", F.col("period"), "era")
    return found.select("series", "era", F.array_min("seqs").alias("first"), F.array_max("seqs").alias("last"), "n")


@query(f"""WITH {STORY}, t AS (SELECT series, who, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, who) AS r FROM c GROUP BY series, who QUALIFY r <= 40),
f AS (SELECT series, who, period, summary, min(seq) AS first, max(seq) AS last, count(*) AS n FROM c JOIN t USING (series, who) GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY series, who, period ORDER BY first) AS r FROM f)
SELECT series, who, period, min(first) AS seq_from, max(last) AS seq_to, sum(n)::BIGINT AS events, coalesce(string_agg(summary, '; ' ORDER BY first) FILTER (r <= 3), '') AS content FROM g GROUP BY series, who, period HAVING sum(n) >= 2""")
def lorebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.lorebook(so.chronicle(story(spark, sf_dir), "series", eras=PERIODS).drop("r"), "series", "who")


@query("""WITH n AS (SELECT item_id, list_filter(list_distinct(string_split(lower(text), ' ')), lambda w: length(w) IN (6, 7)) AS keys FROM benchmark), k AS (SELECT item_id AS entry_id, item_id % 5 AS priority, unnest(range(1, len(keys) + 1)) AS p, unnest(keys) AS key FROM n),
f AS (SELECT conv_id, turn, entry_id, priority, arg_min(key, p) AS key FROM conversations JOIN k ON contains(lower(text), key) GROUP BY conv_id, turn, entry_id, priority)
SELECT conv_id, turn, entry_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority DESC, entry_id)::INTEGER AS rank FROM f QUALIFY rank <= 6""")
def lorebook_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.length(w).isin(6, 7))
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), keys.alias("keys"), (F.col("item_id") % 5).alias("priority"), F.lit(0).alias("seq_from"))
    texts = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("text"))
    return so.activated(texts, entries, [6, 7]).select("id.conv_id", "id.turn", "entry_id", "rank")


@query("""WITH n AS (SELECT item_id, list_filter(list_distinct(string_split(lower(text), ' ')), lambda w: length(w) > 0) AS keys FROM benchmark), k AS (SELECT item_id AS entry_id, item_id % 5 AS priority, unnest(keys) AS key FROM n),
f AS (SELECT DISTINCT conv_id, turn, entry_id, priority FROM conversations JOIN k ON contains(lower(text), key))
SELECT conv_id, turn, entry_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority DESC, entry_id)::INTEGER AS rank FROM f QUALIFY rank <= 6""")
def lorebook_activation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_distinct(F.split(F.lower("text"), " "))
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry_id"), keys.alias("keys"), (F.col("item_id") % 5).alias("priority"), F.lit(0).alias("seq_from"))
    texts = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("text"))
    return so.activated(texts, entries).select("id.conv_id", "id.turn", "entry_id", "rank")


@query("""WITH r AS (SELECT o_orderkey AS pos, c_mktsegment AS source, o_orderpriority AS target, strftime(o_orderdate, '%Y-%m') AS chapter_order FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, CASE WHEN contains(source, 'AUTO') THEN target ELSE source END AS counterpart FROM r WHERE contains(source, 'AUTO') OR contains(target, 'AUTO'))
SELECT counterpart, pos, chapter_order FROM m QUALIFY row_number() OVER (PARTITION BY counterpart ORDER BY chapter_order DESC, pos DESC) = 1 ORDER BY chapter_order DESC, counterpart LIMIT 50""")
def worldkb_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    r = o.select(F.col("o_orderkey").alias("pos"), F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target"), F.date_format("o_orderdate", "yyyy-MM").alias("chapter_order"), F.lit("d").alias("doc_id"))
    return so.relations_of(r, "AUTO", 50).select("counterpart", "pos", "chapter_order")


@query("WITH o AS (SELECT c_mktsegment AS series, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d FROM orders JOIN customer ON c_custkey = o_custkey), s AS (SELECT series, list_sort(list(d)) AS l FROM o GROUP BY series) SELECT series, l[least(len(l), floor(len(l) * 0.3)::BIGINT + 1)]::INTEGER AS threshold FROM s")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    days = o.select(F.col("c_mktsegment").alias("series"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("d"))
    return sc.order_threshold(days, ["series"], "d", 0.3)


@query(f"""WITH {retrieval.COSINE}, h AS ({retrieval.ranked('s', 'query_id', 5, 'query_id, id', 'similarity DESC, id')}),
a AS (SELECT query_id, rank, id // 10 AS chapter_idx, unnest(range(id - 1, id + 2)) AS idx FROM h) SELECT query_id, chapter_idx, idx, min(rank) AS rank FROM a JOIN embeddings ON vec_id = idx AND vec_id // 10 = chapter_idx GROUP BY query_id, chapter_idx, idx""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten blocks make a chapter here."""
    b = retrieval.blocks(spark, sf_dir)
    place = (F.lit(0).alias("doc_id"), F.floor(F.col("id") / 10).alias("chapter_idx"), F.col("id").alias("idx"))
    hits = nearest.search(b, retrieval.asked(spark, sf_dir), 5).select("query_id", "rank", *place)
    return so.expand_neighbours(hits, b.select(*place, F.lit("").alias("text")), 1).select("query_id", "chapter_idx", "idx", "rank")


@query(f"""WITH {retrieval.COSINE}, h AS ({retrieval.ranked('s', 'query_id', 5, 'query_id, id', 'similarity DESC, id')}), a AS (SELECT query_id, rank, unnest([0, 1, 2]) AS p, unnest([id, id * 2, id + 7]) AS id FROM h),
f AS (SELECT query_id, id, min((rank, p)) AS f FROM a GROUP BY ALL) SELECT query_id, id, f[1]::INTEGER AS rank, f[2]::INTEGER AS p FROM (SELECT query_id, id, [min(rank), arg_min(p, (rank, p))] AS f FROM a GROUP BY query_id, id) WHERE id IN (SELECT doc_id FROM documents)""")
def ref_join_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = nearest.search(retrieval.blocks(spark, sf_dir), retrieval.asked(spark, sf_dir), 5).select("query_id", "rank", F.array(F.col("id"), F.col("id") * 2, F.col("id") + 7).alias("refs"))
    return so.first_references(hits, retrieval.texts(spark, sf_dir)).select("query_id", "id", "rank", "p")
