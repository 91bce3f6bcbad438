"""Queries of the entity engine. ``conversations`` are turns, their roles speakers; customers, parts and nations are entities with names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import casts as ca
from ..operators import entities as en
from ..operators import turns as tn
from . import query, table


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role <> 'system' THEN role END AS own FROM conversations),
f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT conv_id, turn, coalesce(own, before) AS filled, CASE WHEN own IS NOT NULL THEN 1.0 WHEN before IS NOT NULL THEN 0.45 ELSE 0.0 END::DOUBLE AS confidence FROM f""")
def last_speaker_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.fill_speaker(talk(spark, sf_dir), "conv_id", "turn", "role", F.col("role") != "system").select("conv_id", "turn", "filled", "confidence")


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS of_key FROM conversations QUALIFY of_key <= 2)
SELECT conv_id, turn, role, of_key::INTEGER AS of_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS admitted FROM k QUALIFY admitted <= 3""")
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.admit(talk(spark, sf_dir), "conv_id", "turn", "role", 2, 3).drop("text")


@query("""WITH a AS (SELECT conv_id, role, count(*) AS n, count(DISTINCT turn // 3) AS c FROM conversations GROUP BY ALL)
SELECT conv_id, bool_and(CASE WHEN role = 'system' THEN n >= 1 ELSE n >= 2 AND c >= greatest(1, floor(3 * 0.3)) END) AS satisfied FROM a GROUP BY conv_id""")
def quota_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.quota_complete(talk(spark, sf_dir), "conv_id", "role", F.floor(F.col("turn") / 3), 3, F.col("role") != "system", 2, 1)


TIERS = """WITH a AS (SELECT c_mktsegment AS segment, c_name AS name, count(*) AS mentions, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS chapters FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT *, mentions + 10 * chapters AS activity FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY activity DESC, name) AS place FROM s)
SELECT segment, name, mentions, chapters, activity, CASE WHEN place <= 5 THEN 'main' WHEN place <= 25 THEN 'supporting' ELSE 'extra' END AS importance FROM r"""


@query(TIERS)
def importance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    o = orders(spark, sf_dir).select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    a = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("segment", "name").agg(F.count("*").alias("mentions"), F.countDistinct("month").alias("chapters"))
    return tn.tiers(a, "mentions", "chapters", "name", by=["segment"])


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT *, CASE WHEN i < n / 3 THEN 0 WHEN i < 2 * n / 3 THEN 1 ELSE 2 END AS third FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, third ORDER BY i) AS k FROM b)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY k, third) - 1)::INTEGER AS position FROM d""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.interleaved(talk(spark, sf_dir).select("conv_id", "turn"), "conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, turn, role, length(coalesce(text, '')) * 0.25 AS tokens, role = 'system' AS sys FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sys ORDER BY turn DESC) AS age, sum(tokens) OVER (PARTITION BY conv_id, sys ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, turn, role, tokens::DOUBLE AS tokens, age::INTEGER AS age FROM r WHERE (sys AND age = 1) OR (NOT sys AND age <= 6 AND (upto <= 300 OR age <= 2))""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.newest(talk(spark, sf_dir), "conv_id", "turn", "role", "text", 6, 300, least=2).select("conv_id", "turn", "role", "tokens", "age")


@query("""WITH s AS (SELECT DISTINCT conv_id, role FROM conversations), n AS (SELECT role, count(*) AS dialogue_count, count(DISTINCT conv_id) AS n_chapters FROM conversations GROUP BY role),
p AS (SELECT a.role, b.role AS other, count(*) AS n FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.role <> b.role GROUP BY ALL)
SELECT role, dialogue_count, n_chapters, string_agg(other || '=' || p.n, ',' ORDER BY p.n DESC, other) AS co_occurrence FROM n LEFT JOIN p USING (role) GROUP BY ALL""")
def roster_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.roster(talk(spark, sf_dir), "conv_id", "role")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sibling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return talk(spark, sf_dir).select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL) SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name)::INTEGER AS edits
FROM n x JOIN n y ON x.name < y.name AND left(x.name, 1) = left(y.name, 1) AND abs(length(x.name) - length(y.name)) <= 4 AND levenshtein(x.name, y.name) <= 4""")
def near_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.near_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), most=4)


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark), k AS (SELECT name FROM n WHERE regexp_full_match(name, '[a-z]{4,12}'))
SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name)::INTEGER AS edits FROM k x JOIN k y ON x.name < y.name AND levenshtein(x.name, y.name) <= 2""")
def near_duplicate_names_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ASCII letters, as DuckDB counts edits in bytes."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("name")).where(F.col("name").rlike("^[a-z]{4,12}$"))
    return en.near_pairs_exact(words)


@query("WITH a AS (SELECT lower(n_name) AS alias, min(r_name) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3 GROUP BY 1) SELECT s_suppkey, lower(n_name) AS name, coalesce(canonical, lower(n_name)) AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN a ON alias = lower(n_name)")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    aliases = n.where("n_regionkey < 3").join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.lower("n_name").alias("alias")).agg(F.min("r_name").alias("canonical"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("name"))
    return en.canonical(rows, "name", aliases)


@query("""WITH n AS (SELECT DISTINCT p_type AS name FROM part), d AS (SELECT p_brand || ' LADDER' AS key, p_brand AS entity, 0 AS prio FROM part UNION ALL SELECT p_type, min(p_brand), 1 FROM part GROUP BY p_type UNION ALL SELECT split_part(p_type, ' ', 1), min(p_name), 2 FROM part GROUP BY 1)
SELECT name, arg_min(entity, (prio, entity)) AS entity FROM n LEFT JOIN d ON key = name GROUP BY name""")
def prioritized_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ladders = [p.select(F.concat("p_brand", F.lit(" LADDER")).alias("key"), F.col("p_brand").alias("entity")), p.groupBy(F.col("p_type").alias("key")).agg(F.min("p_brand").alias("entity")), p.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("key")).agg(F.min("p_name").alias("entity"))]
    return en.prioritized(p.select(F.col("p_type").alias("name")).distinct(), "name", ladders)


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark), k AS (SELECT name FROM n WHERE length(name) IN (9, 10))
SELECT conv_id, turn, name FROM conversations JOIN k ON contains(lower(text), name)""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("name"))
    texts = talk(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("text"))
    return en.contained(texts, names, [9, 10]).select("id.conv_id", "id.turn", "name")


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark), f AS (SELECT DISTINCT conv_id, turn, name FROM conversations JOIN n ON length(name) >= 2 AND contains(lower(text), name))
SELECT conv_id, turn, name FROM f WHERE length(name) > 2 OR NOT EXISTS (SELECT 1 FROM f g WHERE g.conv_id = f.conv_id AND g.turn = f.turn AND length(g.name) > 2 AND contains(g.name, f.name))""")
def containment_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("name")).where(F.length("name") >= 2)
    texts = talk(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("text"))
    return en.prefer_longest(en.contained(texts, names)).select("id.conv_id", "id.turn", F.explode("names").alias("name"))


@query("WITH c AS (SELECT c_mktsegment AS segment, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT segment, quantile_disc(n, 0.7) AS threshold FROM c GROUP BY segment")
def percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), "c_custkey").agg(F.count("*").alias("n"))
    return en.threshold(c, "segment", "n", 0.7).withColumn("threshold", F.col("threshold").cast("long"))


@query("""WITH c AS (SELECT c_mktsegment AS segment, c_name AS name, count(*) AS mentions FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
k AS (SELECT * FROM c WHERE mentions >= 2 AND name NOT LIKE '%7'), t AS (SELECT segment, quantile_disc(mentions, 0.7) AS threshold FROM k GROUP BY segment)
SELECT segment, name, mentions, row_number() OVER (PARTITION BY segment ORDER BY mentions DESC, name)::INTEGER AS rank FROM k JOIN t USING (segment) WHERE mentions >= threshold QUALIFY rank <= 30""")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")).agg(F.count("*").alias("mentions"))
    kept = c.where((F.col("mentions") >= 2) & ~F.col("name").endswith("7") & ~nm.is_noise_name(F.col("name")))
    over = kept.join(en.threshold(kept, "segment", "mentions", 0.7), "segment").where("mentions >= threshold").drop("threshold")
    return over.withColumn("rank", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("mentions"), "name"))).where("rank <= 30")


@query("""WITH o AS (SELECT c_name AS name, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS aliases FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
w AS (SELECT c_name AS name, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS aliases FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT name, greatest(round_even(coalesce(o.n, 0) * 0.85::DOUBLE, 0), coalesce(w.n, 0))::BIGINT AS n, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(w.aliases, [])))), ',') AS aliases FROM o FULL JOIN w USING (name)""")
def full_outer_decay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"))
    side = lambda s: j.where(F.col("o_orderstatus") == s).groupBy(F.col("c_name").alias("name")).agg(F.count("*").alias("n"), F.collect_set("o_orderpriority").alias("aliases"))
    return en.decayed_merge(side("F"), side("O"), "name", "n", "aliases").withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH c AS (SELECT conv_id, unnest(range(0, len(list(turn)))) AS p, unnest(list(turn ORDER BY turn)) AS id FROM conversations GROUP BY conv_id), k AS (SELECT * FROM c WHERE id IN (SELECT turn FROM conversations WHERE role = 'system'))
SELECT conv_id, string_agg(id::VARCHAR, ',' ORDER BY p) AS evidence FROM k GROUP BY conv_id""")
def semi_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    claims = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("evidence"))
    pool = t.where("role = 'system'").select(F.col("turn").alias("id"))
    return en.bound_evidence(claims, pool, "conv_id", "evidence").withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k, strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE o_orderstatus <> 'F')
SELECT k, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) AS either FROM (SELECT k, m, bool_or(s = 'a') AS a, bool_or(s = 'b') AS b FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY k, m) GROUP BY k""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), (F.col("o_orderstatus") == "F").alias("f"))
    sets = o.groupBy("k").agg(F.collect_set(F.when(F.col("f"), F.col("m"))).alias("a"), F.collect_set(F.when(~F.col("f"), F.col("m"))).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return sets.select("k", size(F.array_intersect("a", "b")).alias("both"), size(F.array_except("a", "b")).alias("only_a"), size(F.array_union("a", "b")).alias("either"))


@query()
def turn_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir).withColumn("confidence", F.when(F.col("role") == "user", 0.9).otherwise(0.5))
    return tn.dedupe_turns(t, "conv_id", "turn", "role", "text", "confidence", unknown="system")


@query()
def diverse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = talk(spark, sf_dir)
    scored = t.select("role", F.struct("conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("score", F.when(F.length("text").between(20, 120), 2.0).otherwise(1.0) + F.when(F.col("text").rlike("[!?]"), 0.5).otherwise(0.0))
    return tn.diverse(scored.select("role", F.concat_ws(":", "id.conv_id", "id.turn").alias("id"), "text", "score"), "role", "id", "text", "score")
