"""Queries of the graph engine. Suppliers that ship one order together are characters that meet; an order's month is its chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs as gr
from . import query, table


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a``, ``b``, ``order``, ``month``: two suppliers of one order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_orderstatus")
    pairs = gr.pairs_within(lines, "l_orderkey", "l_suppkey")
    return pairs.join(o, "l_orderkey")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meetings(spark, sf_dir)
    return m.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("o_orderpriority").alias("relation_type"), F.col("o_orderstatus").alias("polarity"), ((F.col("l_orderkey") % 97) / 100.0).alias("confidence"), F.col("month").alias("chapter_order"), F.col("l_orderkey").alias("pos"))


def category() -> Column:
    return gr.classified(F.col("relation_type"), F.col("polarity"), {"rival": "URGENT", "friend": "HIGH|MEDIUM"}, {"F": "enemy"})


MEET = """s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
m AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, x.l_orderkey AS pos, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS t, o_orderstatus AS pol, (x.l_orderkey % 97) / 100 AS conf
 FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey JOIN orders ON o_orderkey = x.l_orderkey)"""
CAT = "CASE WHEN t LIKE '%URGENT%' THEN 'rival' WHEN regexp_matches(t, 'HIGH|MEDIUM') THEN 'friend' WHEN pol = 'F' THEN 'enemy' ELSE 'other' END"
SYM = "y AS (SELECT a AS node, b AS other, month, 1 AS w FROM m UNION ALL SELECT b, a, month, 1 FROM m)"


@query(f"""WITH {MEET}, c AS (SELECT *, {CAT} AS cat FROM m), k AS (SELECT a, b, cat, count(*) AS n, min(pos) AS p FROM c GROUP BY ALL), mo AS (SELECT a, b, arg_max(cat, (n, -p)) AS category FROM k GROUP BY a, b),
e AS (SELECT a, b, count(*) AS weight, arg_max(pol, (conf, -pos)) AS polarity, round(max(conf), 3) AS confidence, string_agg(DISTINCT t, ',' ORDER BY t) AS relation_types, min(month) AS first_order, max(month) AS last_order FROM c GROUP BY a, b)
SELECT * FROM e JOIN mo USING (a, b) WHERE weight >= 2""")
def relation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.relation_graph(relations(spark, sf_dir), category(), least_weight=2).withColumn("relation_types", F.array_join("relation_types", ","))


@query(f"WITH {MEET} SELECT {CAT} AS category, pol AS polarity, count(*) AS n FROM m GROUP BY ALL")
def relation_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).groupBy(category().alias("category"), "polarity").agg(F.count("*").alias("n"))


@query(f"WITH {MEET} SELECT a, b, 'dialogue' AS kind, month AS chapter, count(*) AS weight FROM m GROUP BY a, b, month UNION ALL SELECT a, b, 'co_occurrence', '', count(*) FROM m GROUP BY a, b")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = meetings(spark, sf_dir)
    by_chapter = m.groupBy("a", "b", F.lit("dialogue").alias("kind"), F.col("month").alias("chapter")).agg(F.count("*").alias("weight"))
    # the second roll-up is one of the first, so the pairs are counted once
    return by_chapter.unionByName(by_chapter.groupBy("a", "b", F.lit("co_occurrence").alias("kind"), F.lit("").alias("chapter")).agg(F.sum("weight").alias("weight")))


@query(f"WITH {MEET}, {SYM}, n AS (SELECT node, other, sum(w)::BIGINT AS weight FROM y GROUP BY ALL) SELECT node, other, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other)::INTEGER AS rank FROM n QUALIFY rank <= 5")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.neighbours(meetings(spark, sf_dir).withColumn("weight", F.lit(1)), 5).select("node", "other", "weight", "rank")


@query(f"WITH {MEET}, {SYM}, c AS (SELECT DISTINCT node, month FROM y) SELECT x.node AS a, z.node AS b, count(*) AS n_shared FROM c x JOIN c z ON x.month = z.month AND x.node < z.node GROUP BY ALL")
def shared_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return gr.shared_groups(gr.members_within(lines, "l_orderkey", "l_suppkey").join(o, "l_orderkey"), "month", "node")


@query(f"WITH {MEET}, {SYM} SELECT node, count(*) AS degree, sum(w)::BIGINT AS total FROM y GROUP BY node")
def degree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(meetings(spark, sf_dir).withColumn("weight", F.lit(1)))


def strong(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Links of each supplier to the ``k`` it meets most."""
    near = gr.neighbours(meetings(spark, sf_dir).withColumn("weight", F.lit(1)), k)
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


STRONG = SYM + ", n AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, other) AS rank FROM y GROUP BY node, other), l AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM n WHERE rank <= {0})"


@query(f"""WITH RECURSIVE {MEET}, {STRONG.format(1)}, h AS (SELECT a AS node, b AS other FROM l UNION SELECT b, a FROM l), r(node, root) AS (SELECT node, node FROM h UNION SELECT h.other, r.root FROM r JOIN h ON h.node = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.connected(strong(spark, sf_dir, 1))


@query(f"""WITH RECURSIVE {MEET}, {STRONG.format(2)}, h AS (SELECT a AS node, b AS other FROM l UNION SELECT b, a FROM l), src AS (SELECT min(a) AS source FROM l),
r(source, node, hops) AS (SELECT source, source, 0 FROM src UNION SELECT r.source, h.other, r.hops + 1 FROM r JOIN h ON h.node = r.node WHERE r.hops < 4)
SELECT source, node, min(hops)::INTEGER AS hops FROM r GROUP BY ALL""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table, as the source and every hop read it
    links = gr.written(strong(spark, sf_dir, 2), "links")
    return gr.shortest_paths(links, links.agg(F.min("a").alias("source")).where("source IS NOT NULL"), 4).select("source", "node", "hops")


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the nations whose suppliers meet, a graph for each order priority."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    m = meetings(spark, sf_dir).groupBy("a", "b", "o_orderpriority").agg(F.count("*").alias("n"))
    named = m.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").where("x <> y")
    edges = named.groupBy("o_orderpriority", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("weight"))
    return gr.communities(edges, "o_orderpriority")


@query("""WITH c AS (SELECT r_regionkey AS community, list(lower(n_name)) AS members, string_agg(lower(n_name), ' ' ORDER BY n_name) || ' the and of is that' AS summary FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey),
q AS (SELECT item_id AS query_id, lower(text) AS query, list_distinct(list_transform(list_zip(list_slice(string_split(lower(text), ''), 1, -2), list_slice(string_split(lower(text), ''), 2, -1)), lambda p: p[1] || p[2])) AS grams FROM benchmark),
s AS (SELECT query_id, community, round(2.0 * len(list_filter(members, lambda m: contains(query, m))) + len(list_filter(grams, lambda g: contains(summary, g))) / len(grams) + least(1.0, len(members) / 8), 6)::DOUBLE AS score FROM q CROSS JOIN c)
SELECT query_id, community, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 2""")
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = n.groupBy(F.col("r_regionkey").alias("community")).agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("members")).withColumn("summary", F.concat(F.array_join("members", " "), F.lit(" the and of is that")))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    return gr.global_search(q, c, 2)
