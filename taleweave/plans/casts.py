"""Queries on casts of characters. Words of ``benchmark`` are names, brands of ``part`` are groups of them, suppliers that ship together meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import casts as ca
from ..operators import claims as cl
from . import graph, query, table

NAMES = "n AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name, item_id FROM benchmark), cast_ AS (SELECT DISTINCT name FROM n WHERE item_id % 2 = 0 AND regexp_full_match(name, '[a-z]{3,12}')), spk AS (SELECT DISTINCT name AS speaker FROM n WHERE item_id % 2 = 1 AND regexp_full_match(name, '[a-z]{3,12}'))"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("name"))


@query(f"""WITH {NAMES}, c AS (SELECT speaker, name, CASE WHEN speaker = name THEN 0 WHEN contains(speaker, name) OR contains(name, speaker) THEN 1 ELSE levenshtein(speaker, name) + 1 END AS step, levenshtein(speaker, name) AS e FROM spk JOIN cast_ ON speaker = name OR contains(speaker, name) OR contains(name, speaker) OR levenshtein(speaker, name) <= 2)
SELECT speaker, arg_min(name, (step, e, -length(name), name)) AS name, min(step)::INTEGER AS step FROM spk LEFT JOIN c USING (speaker) GROUP BY speaker""")
def speaker_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ASCII letters, as DuckDB counts edits in bytes."""
    w = named(spark, sf_dir).where(F.col("name").rlike("^[a-z]{3,12}$"))
    return ca.resolve_speakers(w.where("item_id % 2 = 1").select(F.col("name").alias("speaker")).distinct(), w.where("item_id % 2 = 0").select("name").distinct())


MEMBERS = "mem AS (SELECT s_suppkey AS name, (s_suppkey // 3) AS cluster FROM supplier)"


@query(f"""WITH {graph.MEET}, {MEMBERS}, bad AS (SELECT DISTINCT x.cluster FROM mem x JOIN mem y ON x.cluster = y.cluster AND x.name < y.name JOIN m ON m.a = x.name AND m.b = y.name)
SELECT cluster, name, cluster NOT IN (SELECT cluster FROM bad) AS kept FROM mem""")
def cluster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 3).alias("cluster"), F.col("s_suppkey").alias("name"))
    return ca.split_clusters(members, graph.meetings(spark, sf_dir).select("a", "b").distinct())


@query("""WITH m AS (SELECT p_brand AS cluster, p_type || CASE WHEN p_size % 5 = 0 THEN '先生' ELSE '' END AS name, count(*) AS mentions FROM part GROUP BY ALL),
k AS (SELECT *, (name LIKE '%先生')::INTEGER AS h FROM m), b AS (SELECT cluster, arg_min(name, (h, -length(name), -mentions, name)) AS canonical FROM k GROUP BY cluster)
SELECT cluster, canonical, (SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM m WHERE m.cluster = b.cluster AND name <> canonical) AS aliases FROM b""")
def canonical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat("p_type", F.when(F.col("p_size") % 5 == 0, "先生").otherwise(""))
    m = p.groupBy(F.col("p_brand").alias("cluster"), name.alias("name")).agg(F.count("*").alias("mentions"))
    return ca.canonical_names(m).withColumn("aliases", F.nullif(F.array_join("aliases", "|"), F.lit("")))


CAST = "q AS (SELECT c_custkey AS k, 'c' || c_custkey AS name, length(c_mktsegment) + c_custkey % 7 AS mentions, c_custkey % 11 AS dialogues, CASE WHEN c_custkey % 10 = 3 THEN ['c' || (c_custkey - 1)] WHEN c_custkey % 10 = 5 THEN ['c' || (c_custkey - 2), 'x' || c_custkey] ELSE [] END AS aliases FROM customer)"


def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    aliases = F.when(k % 10 == 3, F.array(name("c", k - 1))).when(k % 10 == 5, F.array(name("c", k - 2), name("x", k))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(name("c", k).alias("name"), (F.length("c_mktsegment") + k % 7).alias("mentions"), (k % 11).alias("dialogues"), aliases.alias("aliases"))


HOSTS = f"""WITH RECURSIVE {CAST}, l AS (SELECT x.name AS a, y.name AS b FROM (SELECT name, unnest(aliases) AS al FROM q) x JOIN q y ON y.name = x.al AND x.name <> y.name), h AS (SELECT a AS node, b AS other FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT name, name FROM q UNION SELECT r.node, h.other FROM r JOIN h ON h.node = r.other),
g AS (SELECT node AS name, arg_min(other, (-mentions, -length(other), other)) AS host FROM r JOIN q ON q.name = r.other GROUP BY node)"""


@query(f"{HOSTS} SELECT name, host FROM g")
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.merge_collisions(cast(spark, sf_dir))


@query(f"""{HOSTS}, e AS (SELECT host, mentions, dialogues, name, list_concat(aliases, CASE WHEN name <> host THEN [name] ELSE [] END) AS al FROM q JOIN g USING (name)),
u AS (SELECT host, string_agg(DISTINCT a, ',' ORDER BY a) FILTER (a <> host) AS aliases FROM (SELECT host, unnest(al) AS a FROM e) GROUP BY host)
SELECT e.host AS name, sum(mentions)::BIGINT AS mentions, max(dialogues) AS dialogues, coalesce(any_value(u.aliases), '') AS aliases, count(*) AS n_merged FROM e LEFT JOIN u ON u.host = e.host GROUP BY e.host""")
def character_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cast(spark, sf_dir)
    return ca.merged_cast(c, ca.merge_collisions(c)).withColumn("aliases", F.array_join("aliases", ","))


@query("""WITH o AS (SELECT s_suppkey AS id, s_suppkey AS pos, s_name AS name FROM supplier), n AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN -s_suppkey ELSE s_suppkey END AS id, s_suppkey AS pos, s_name || CASE WHEN s_suppkey % 4 = 0 THEN '!' ELSE '' END AS name FROM supplier)
SELECT o.name AS before, n.name AS after FROM o JOIN n USING (id) WHERE o.name <> n.name UNION SELECT o.name, n.name FROM o JOIN n ON o.pos = n.pos WHERE o.id NOT IN (SELECT id FROM n) AND n.id NOT IN (SELECT id FROM o) AND o.name <> n.name""")
def rename_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("character_id"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    new = s.select(F.when(F.col("pos") % 9 == 0, -F.col("pos")).otherwise(F.col("pos")).alias("character_id"), "pos", F.concat("name", F.when(F.col("pos") % 4 == 0, "!").otherwise("")).alias("name"))
    return ca.renames(s, new)


@query("""WITH g AS (SELECT p_brand AS grp, p_type AS canonical, p_name AS variant FROM part)
SELECT 'E1' AS rule, variant AS key, count(DISTINCT grp) AS n FROM g GROUP BY variant HAVING count(DISTINCT grp) > 1 UNION ALL
SELECT 'E2', canonical, count(DISTINCT grp) FROM g GROUP BY canonical HAVING count(DISTINCT grp) > 1 UNION ALL SELECT 'E3', grp, count(DISTINCT variant) FROM g GROUP BY grp HAVING count(DISTINCT variant) < 2""")
def merge_group_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.merge_violations(table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_type").alias("canonical"), F.col("p_name").alias("variant")))


@query(f"WITH {graph.MEET} SELECT a, b, count(*) AS weight, arg_max(t, (conf, -pos)) AS relation_type, arg_max(pol, (conf, -pos)) AS polarity FROM m GROUP BY a, b")
def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.simple_graph(graph.relations(spark, sf_dir))


@query(f"""WITH {graph.MEET}, r AS (SELECT a, b, pos, month, t, CASE WHEN pol = 'O' THEN '' ELSE pol END AS label FROM m), e AS (SELECT a, b, t, row_number() OVER (PARTITION BY a, b ORDER BY min(pos)) AS k FROM r GROUP BY a, b, t),
h AS (SELECT a, b, string_agg(t, ',' ORDER BY k) AS evidence FROM e WHERE k <= 3 GROUP BY a, b) SELECT a, b, count(*) AS n, arg_min(label, pos) FILTER (label <> '') AS label, min(month) AS first_chapter, any_value(evidence) AS evidence FROM r JOIN h USING (a, b) GROUP BY a, b""")
def extraction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graph.relations(spark, sf_dir).select("source", "target", F.when(F.col("polarity") == "O", "").otherwise(F.col("polarity")).alias("label"), F.col("chapter_order").alias("chapter"), F.col("relation_type").alias("evidence"), "pos")
    return ca.merged_relations(r, 3).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH c AS (SELECT user_id % 10 AS doc, day(ts) AS chapter, left(props, 40) AS key, value >= 20 AS sure FROM events), k AS (SELECT doc, chapter, key, count(*) FILTER (sure) AS s, count(*) AS n FROM c GROUP BY ALL)
SELECT doc, count(*) FILTER (s > 0) AS kept, sum(greatest(s - 1, 0))::BIGINT AS repeated, sum(n - s)::BIGINT AS unsure, count(DISTINCT chapter) FILTER (s > 0) AS chapters FROM k GROUP BY doc""")
def snapshot_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ca.reduced_claims(e.select((F.col("user_id") % 10).alias("doc"), F.dayofmonth("ts").alias("chapter"), F.col("props").alias("summary"), F.col("value").alias("confidence"), F.col("event_id").alias("pos")), 20)


@query("""WITH a AS (SELECT role, conv_id % 20 AS scene, avg(length(coalesce(text, ''))) AS l, avg(regexp_matches(coalesce(text, ''), '[?？]')::INTEGER) AS asks, avg(regexp_matches(coalesce(text, ''), '[!！]')::INTEGER) AS calls FROM conversations GROUP BY ALL)
SELECT role, scene, round(l, 4) AS avg_length, concat_ws(',', CASE WHEN l <= 20 THEN 'short' END, CASE WHEN l >= 120 THEN 'long' END, CASE WHEN asks >= 0.3 THEN 'asking' END, CASE WHEN calls >= 0.3 THEN 'calling' END) AS tags FROM a""")
def style_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("scene", F.col("conv_id") % 20)
    return ca.style_tags(t, ["role", "scene"], "text").withColumn("tags", F.array_join("tags", ","))


@query("""WITH w AS (SELECT role, conv_id, unnest(regexp_extract_all(coalesce(text, ''), '([A-Z][a-z]+)', 1)) AS name FROM conversations), c AS (SELECT role, name, count(*) AS n, min(conv_id) AS first FROM w GROUP BY ALL)
SELECT role, name, n, row_number() OVER (PARTITION BY role ORDER BY n DESC, first, name)::INTEGER AS rank FROM c QUALIFY rank <= 20""")
def candidate_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.harvest(table(spark, sf_dir, "conversations"), "([A-Z][a-z]+)", "role", "conv_id", 20)


COMMUNITY = "com AS (SELECT s_suppkey AS node, s_nationkey AS community FROM supplier), ev AS (SELECT DISTINCT l_orderkey AS event, l_suppkey AS node FROM lineitem)"


def community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("node"))


@query(f"WITH {COMMUNITY}, c AS (SELECT community, event, count(*) AS n_members FROM com JOIN ev USING (node) GROUP BY ALL) SELECT community, event, n_members, row_number() OVER (PARTITION BY community ORDER BY n_members DESC, event)::INTEGER AS rank FROM c QUALIFY rank <= 6")
def community_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("node"))
    return ca.community_events(community(spark, sf_dir), events, 6)


@query(f"""WITH {graph.MEET}, {COMMUNITY}, w AS (SELECT a, b, count(*) AS weight FROM m GROUP BY a, b), i AS (SELECT x.community, a, b, weight, row_number() OVER (PARTITION BY x.community ORDER BY weight DESC, a, b) AS k FROM w JOIN com x ON x.node = a JOIN com y ON y.node = b AND x.community = y.community QUALIFY k <= 12),
lk AS (SELECT community, string_agg(a || '-' || b || '(' || weight || ')', '; ' ORDER BY k) AS links FROM i GROUP BY community), n AS (SELECT community, count(*) AS size, string_agg(node::VARCHAR, ', ' ORDER BY node::VARCHAR) AS names FROM com GROUP BY community)
SELECT community, size, concat_ws(' | ', names, links) AS summary FROM n LEFT JOIN lk USING (community)""")
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.meetings(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("weight"))
    return ca.community_summary(community(spark, sf_dir), edges, 12)


@query("""WITH f AS (SELECT source, sha256(string_agg(md5(coalesce(text, '')), ',' ORDER BY doc_id, md5(coalesce(text, '')))) AS fingerprint FROM documents GROUP BY source),
k AS (SELECT source, CASE WHEN source LIKE '%1%' THEN 'old' ELSE fingerprint END AS known FROM f) SELECT source, fingerprint, fingerprint IS DISTINCT FROM known AS stale FROM f JOIN k USING (source)""")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    known = ca.stale(docs, docs.sparkSession.createDataFrame([], "source string, fingerprint string"), "source", "doc_id", "text")
    return ca.stale(docs, known.select("source", F.when(F.col("source").contains("1"), "old").otherwise(F.col("fingerprint")).alias("fingerprint")), "source", "doc_id", "text")


@query(f"""WITH {graph.MEET}, {graph.SYM}, nb AS (SELECT node, other, sum(w)::BIGINT AS weight, row_number() OVER (PARTITION BY node ORDER BY sum(w) DESC, other) AS place FROM y GROUP BY node, other QUALIFY place <= 3),
h AS (SELECT s_nationkey AS query_id, s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier QUALIFY rank <= 3),
j AS (SELECT query_id, rank, h.node, place, other, weight, row_number() OVER (PARTITION BY query_id, least(h.node, other), greatest(h.node, other) ORDER BY rank, place) AS seen FROM h JOIN nb ON nb.node = h.node),
c AS (SELECT query_id, rank, node, string_agg(other || ':' || weight, ', ' ORDER BY place) AS context FROM j WHERE seen = 1 GROUP BY ALL) SELECT query_id, rank::INTEGER AS rank, node, coalesce(context, '') AS context FROM h LEFT JOIN c USING (query_id, rank, node)""")
def hit_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"), F.col("s_suppkey").alias("node")).where("rank <= 3")
    return ca.enriched(s, graph.meetings(spark, sf_dir).withColumn("weight", F.lit(1)), 3)


@query("""WITH n AS (SELECT list(DISTINCT name) AS names FROM (SELECT unnest(string_split(lower(text), ' ')) AS name FROM benchmark WHERE item_id < 3) WHERE length(name) > 3),
a AS (SELECT doc_id AS id, text, list_min(list_filter(list_transform(names, lambda x: strpos(text, x)), lambda p: p > 0)) AS at_ FROM documents, n WHERE text IS NOT NULL)
SELECT id, (at_ - 1)::INTEGER AS start, substr(text, greatest(at_ - 40, 1), at_ + 80 - greatest(at_ - 40, 1)) AS snippet FROM a WHERE at_ IS NOT NULL""")
def evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted({r.name for r in named(spark, sf_dir).where("item_id < 3").where(F.length("name") > 3).select("name").distinct().collect()})
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return ca.evidence(docs, F.array(*[F.lit(n) for n in names]))


CLAIMS = """c AS (SELECT user_id % 10 AS doc, day(ts)::INTEGER AS chapter, event_id AS pos, CASE WHEN event_type IN ('click', 'view') THEN 'relation' WHEN event_type = 'error' THEN 'foreshadow' ELSE 'event' END AS kind,
 'u' || user_id % 40 AS s0, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'u' || user_id % 13 END AS t0, CASE WHEN event_id % 17 = 0 THEN '' ELSE props END AS summary, event_id % 50 AS e, CASE WHEN event_id % 4 = 0 THEN (event_id % 7)::INTEGER END AS year FROM events),
pool AS (SELECT DISTINCT doc, chapter, e FROM c WHERE pos % 3 = 0),
n AS (SELECT *, CASE WHEN s0 = 'u7' THEN 'u70' ELSE s0 END AS source, CASE WHEN t0 = 'u7' THEN 'u70' ELSE t0 END AS target, kind <> 'relation' AND summary = '' AS empty, (doc, chapter, e) IN (SELECT (doc, chapter, e) FROM pool) AS held FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, chapter, kind, left(summary, 40), empty ORDER BY pos) AS k FROM n),
j AS (SELECT *, CASE WHEN empty THEN 'empty' WHEN kind = 'relation' AND (target = '' OR source = target OR length(source) < 2 OR length(target) < 2) THEN 'weak' WHEN kind = 'event' AND k > 1 THEN 'repeat' WHEN NOT held THEN 'no_evidence' END AS dropped FROM r)"""


def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "relation").when(F.col("event_type") == "error", "foreshadow").otherwise("event")
    name = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string"))
    blank = lambda n, value: F.when(F.col("event_id") % n == 0, "").otherwise(value)
    rows = e.select(
        (F.col("user_id") % 10).alias("doc"), F.dayofmonth("ts").alias("chapter"), F.col("event_id").alias("pos"), kind.alias("kind"), name(40).alias("source"), blank(11, name(13)).alias("target"),
        blank(17, F.col("props")).alias("summary"), F.col("value").alias("confidence"), F.array(F.col("event_id") % 50).alias("evidence"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 7).cast("int")).alias("year"),
    )
    pool = rows.where("pos % 3 = 0").select("doc", "chapter", F.explode("evidence").alias("id"))
    return cl.judged(rows, pool, spark.createDataFrame([("u7", "u70")], "alias string, canonical string"))


@query(f"WITH {CLAIMS} SELECT doc, chapter, pos, kind, source, target, summary, year, row_number() OVER (PARTITION BY kind ORDER BY year IS NULL, year, doc, chapter, pos) AS place FROM j WHERE dropped IS NULL")
def snapshot_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.snapshot(judged_claims(spark, sf_dir)).select("doc", "chapter", "pos", "kind", "source", "target", "summary", "year", "place")


@query(f"""WITH {CLAIMS}, ch AS (SELECT doc, chapter, count(*) FILTER (dropped IS NULL) AS kept FROM j GROUP BY ALL)
SELECT doc, count(*) FILTER (kind = 'event' AND dropped IS NULL) AS events, count(*) FILTER (kind = 'relation' AND dropped IS NULL) AS relations, count(*) FILTER (kind = 'foreshadow' AND dropped IS NULL) AS foreshadows, count(*) FILTER (dropped = 'empty') AS empty, count(*) FILTER (dropped = 'weak') AS weak,
 count(*) FILTER (dropped = 'repeat') AS repeat, count(*) FILTER (dropped = 'no_evidence') AS no_evidence, (SELECT count(*) FROM ch WHERE ch.doc = j.doc) AS chapters, (SELECT count(*) FROM ch WHERE ch.doc = j.doc AND kept > 0) AS with_claims,
 round((SELECT count(*) FROM ch WHERE ch.doc = j.doc AND kept > 0) / (SELECT count(*) FROM ch WHERE ch.doc = j.doc), 4)::DOUBLE AS coverage FROM j GROUP BY doc""")
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.snapshot_stats(judged_claims(spark, sf_dir))
