"""Queries on what questions are about, and on ordered windows of turns. Words of ``benchmark`` are names, ``conversations`` are texts and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intent as it
from ..operators import answering as an
from ..operators import asking as ak
from ..operators import turns as tn
from . import query, retrieval, table

ALIASES = "w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS alias FROM benchmark), k AS (SELECT alias, arg_min('e' || item_id, (item_id % 3, 'e' || item_id, item_id % 4)) AS canonical, arg_min(item_id % 4, (item_id % 3, 'e' || item_id, item_id % 4)) AS series FROM w WHERE length(alias) >= 2 GROUP BY alias)"


@query(f"""WITH {ALIASES}, f AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS query, alias, canonical, series FROM conversations JOIN k ON contains(lower(text), alias)),
g AS (SELECT * FROM f WHERE length(alias) > 2 OR NOT EXISTS (SELECT 1 FROM f h WHERE h.query_id = f.query_id AND length(h.alias) > 2 AND contains(h.alias, f.alias))),
a AS (SELECT query_id, any_value(query) AS query, list_sort(list(DISTINCT canonical)) AS e, min(series) AS low, max(series) AS high FROM g GROUP BY query_id)
SELECT query_id, array_to_string(e, ',') AS entities, CASE WHEN low = high THEN low END AS series, low <> high AS crosses, query || ' ' || coalesce(array_to_string(list_filter(e, lambda x: NOT contains(query, x)), ' '), '') AS augmented FROM a""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("alias"))
    aliases = words.select("alias", F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("canonical"), (F.col("item_id") % 3).alias("kind"), (F.col("item_id") % 4).alias("series"))
    q = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lower("text").alias("query"))
    return ak.resolve_entities(q, aliases).withColumn("entities", F.array_join("entities", ","))


@query("""WITH q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 4 = 0 THEN 'who is it' ELSE '《' || n_name || '》' || CASE WHEN s_suppkey % 3 = 0 THEN '第' || (s_suppkey % 5) || '卷' ELSE '' END || '第2章' END AS query FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT *, nullif(regexp_extract(query, '《([^》]+)》', 1), '') AS title, try_cast(nullif(regexp_extract(query, '第([0-9]+)卷', 1), '') AS INTEGER) AS volume, try_cast(nullif(regexp_extract(query, '第([0-9]+)章', 1), '') AS INTEGER) AS section FROM q)
SELECT query_id, query, title, volume, section, r_name AS series, CASE WHEN volume BETWEEN 1 AND 3 AND n_name IS NOT NULL THEN n_name || '__vol0' || volume END AS doc_id FROM p LEFT JOIN nation ON n_name = title LEFT JOIN region ON r_regionkey = n_regionkey""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    title = F.concat(F.lit("《"), F.col("n_name"), F.lit("》"), F.when(k % 3 == 0, F.concat(F.lit("第"), (k % 5).cast("string"), F.lit("卷"))).otherwise(""), F.lit("第2章"))
    q = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("query_id"), F.when(k % 4 == 0, "who is it").otherwise(title).alias("query"))
    books = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("title"), F.col("r_name").alias("series"), F.explode(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("volume"))
    return ak.resolve_scope(q, books.withColumn("doc_id", F.concat("title", F.lit("__vol0"), F.col("volume").cast("string"))))


@query("""WITH t AS (SELECT DISTINCT p_brand AS doc_id, p_size AS chapter_order, p_type AS chapter_title FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_order, chapter_title) AS ordinal FROM t),
a AS (SELECT DISTINCT p_brand AS doc_id, unnest([1, 3, 5000]) AS ordinal FROM part) SELECT doc_id, ordinal::INTEGER AS ordinal, chapter_title FROM a LEFT JOIN r USING (doc_id, ordinal)""")
def chapter_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_brand").alias("doc_id")).distinct().withColumn("ordinal", F.explode(F.array(*[F.lit(n) for n in (1, 3, 5000)])))
    return ak.chapter_by_ordinal(asked, p.select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("chapter_order"), F.col("p_type").alias("chapter_title")))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(string_split(coalesce(before, ''), ' '), lambda x: contains(coalesce(text, ''), x)), '|') AS names FROM p""")
def present_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the turn before are the names claimed."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.split(F.coalesce(before, F.lit("")), " ").alias("names"))
    return ak.present_names(t, "names", "text").select("conv_id", "turn", F.array_join("names", "|").alias("names"))


GRAMS = retrieval.BIGRAMS
TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'))"
ANSWERS = f"""
al AS (SELECT alias, min(alias) OVER (PARTITION BY left(alias, 4)) AS canonical, 's' || (ascii(alias) % 3) AS series FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS alias FROM benchmark) WHERE length(alias) >= 10),
b AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, 's' || (conv_id % 3) AS series, CASE WHEN role = 'system' THEN 3 WHEN role = 'user' THEN 2 WHEN turn % 4 = 1 THEN 4 ELSE 1 END AS ch, conv_id // 3 AS ord FROM conversations),
bw AS (SELECT id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS alias FROM b), bn AS (SELECT id, list(DISTINCT canonical) AS names FROM bw JOIN al USING (alias) GROUP BY id),
q0 AS (SELECT item_id AS query_id, lower(text) || CASE item_id % 4 WHEN 0 THEN ' and earlier' WHEN 1 THEN ' and later' WHEN 2 THEN ', what happened?' ELSE '' END AS query, list_filter(list_transform(string_split(regexp_replace(lower(text), '\\.\\s+', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM benchmark),
e AS (SELECT query_id, list_sort(list(DISTINCT canonical)) AS e, min(al.series) AS lo, max(al.series) AS hi FROM q0 JOIN al ON contains(query, alias) GROUP BY query_id),
a AS (SELECT q0.query_id, query, coalesce(e, []) AS e, CASE WHEN lo = hi THEN lo END AS series, CASE item_id % 4 WHEN 0 THEN 'earlier' WHEN 1 THEN 'later' END AS period, CASE WHEN item_id % 4 = 2 THEN 'narrative' ELSE 'default' END AS intent,
  list_filter(list_concat([query], list_slice(list_filter(lines, lambda x: x <> query), 1, 2), [array_to_string(coalesce(e, []), ' ')]), lambda x: trim(x) <> '') AS vs FROM q0 LEFT JOIN e USING (query_id) JOIN benchmark ON item_id = q0.query_id),
v AS (SELECT query_id, v - 1 AS variant, vs[v] AS text FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS v FROM a)),
t AS (SELECT query_id, variant, unnest(list_distinct(list_slice({GRAMS.format("text")}, 1, 8))) AS term FROM v),
d AS (SELECT id, greatest(length(coalesce(text, '')) - 1, 0) AS len, unnest({GRAMS.format("coalesce(text, '')")}) AS term FROM b),
tf AS (SELECT id, term, any_value(len) AS len, count(*) AS tf FROM d WHERE term IN (SELECT DISTINCT term FROM t) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(greatest(length(coalesce(text, '')) - 1, 0)) AS avgdl FROM b),
bm AS (SELECT query_id, variant, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM t JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
m AS (SELECT bm.*, b.ch, CASE WHEN a.series IS NOT NULL AND a.series <> b.series THEN NULL WHEN len(a.e) = 0 OR list_has_any(a.e, coalesce(names, [])) THEN 0
  WHEN len(list_filter(coalesce(names, []), lambda n: len(list_filter(a.e, lambda x: contains(n, left(x, 2)) OR contains(n, substr(x, 3, 2)))) > 0)) > 0 THEN 1 WHEN a.series IS NOT NULL THEN 2 END AS level
  FROM bm JOIN b USING (id) LEFT JOIN bn USING (id) JOIN a USING (query_id) WHERE score > 0),
l AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS least FROM m WHERE level IS NOT NULL),
c AS (SELECT query_id, variant, ch, id, level, row_number() OVER (PARTITION BY query_id, variant, ch ORDER BY score DESC, id) AS rank FROM l WHERE level = least QUALIFY rank <= 30),
f1 AS (SELECT query_id, variant, id, level, round(sum(1 / (60 + rank)), 9) AS s, min((ch, rank)) AS first FROM c GROUP BY ALL), r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY s DESC, first, id) AS rank FROM f1 QUALIFY rank <= 30),
f2 AS (SELECT query_id, id, level, round(sum(1 / (60 + rank)), 9) AS s, min((variant, rank)) AS first FROM r1 GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, id) AS rank FROM f2 QUALIFY rank <= 30),
os AS (SELECT series, list_sort(list(ord)) AS o FROM b WHERE ch = 4 GROUP BY series),
w AS (SELECT r2.query_id, r2.id, r2.level, r2.rank AS old_rank, a.intent, b.ch, b.conv_id, b.turn, b.ord, a.period, o[least(len(o), floor(len(o) * CASE a.period WHEN 'earlier' THEN 0.3 ELSE 0.7 END)::BIGINT + 1)] AS th,
  {TOKENS.format("a.query")} AS qt, {TOKENS.format("coalesce(b.text, '')")} AS dt FROM r2 JOIN a USING (query_id) JOIN b USING (id) LEFT JOIN os ON os.series = a.series),
x AS (SELECT *, round(len(list_intersect(qt, dt)) + CASE WHEN len(dt) > 0 THEN 0.01::DOUBLE * len(list_intersect(qt, dt)) / len(dt) ELSE 0 END, 9) AS score FROM w WHERE period IS NULL OR th IS NULL OR ch <> 4 OR CASE period WHEN 'earlier' THEN ord <= th ELSE ord >= th END),
h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank)::INTEGER AS rank, id, conv_id, turn, score, level::INTEGER AS level, intent, ['narrative', 'dialogue', 'qa', 'character'][ch] AS channel FROM x QUALIFY rank <= 5)
"""


def turns_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ``conversations`` as blocks: the conversation is document and chapter, long words of questions that a turn holds are its names."""
    id_, series = (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("series")
    channel = F.when(F.col("role") == "system", "qa").when(F.col("role") == "user", "dialogue").when(F.col("turn") % 4 == 1, "character").otherwise("narrative").alias("channel")
    turns = table(spark, sf_dir, "conversations").select(id_, "conv_id", "turn", "text", series, channel, F.floor(F.col("conv_id") / 3).alias("chapter_order"))
    words = turns.select("id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("alias"))
    names = words.join(long_words(spark, sf_dir), "alias").groupBy("id").agg(F.collect_set("canonical").alias("names"))
    return turns.join(names, "id", "left")


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ten letters or more as aliases of the first that begins with the same four."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("alias")).where("length(alias) >= 10").distinct()
    first = words.groupBy(F.left("alias", F.lit(4)).alias("stem")).agg(F.min("alias").alias("canonical"))
    named = words.withColumn("stem", F.left("alias", F.lit(4))).join(first, "stem")
    return named.select("alias", "canonical", F.when(F.col("alias") == F.col("canonical"), 2).otherwise(1).alias("kind"), F.concat(F.lit("s"), (F.ascii("alias") % 3).cast("string")).alias("series"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(F.lit(" and earlier"), F.lit(" and later"), F.lit(", what happened?"), F.lit("")), (F.col("item_id") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lower("text"), end).alias("query"), F.regexp_replace(F.lower("text"), r"\.\s+", "\n").alias("lines"))
    # the sentences of a question stand for a model's rewrites of it
    asked = asked.select("query_id", "query", F.slice(it.variants(F.col("lines"), F.col("query"), 2), 2, 2).alias("rewrites"))
    return an.answer(asked, turns_as_blocks(spark, sf_dir), long_words(spark, sf_dir), 5)


@query(f"WITH {ANSWERS} SELECT query_id, rank, id, score, level, intent, channel FROM h")
def retrieval_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question against every turn: entities, scope, variants, channels, fallback, fusion, period, order by words."""
    return answered(spark, sf_dir)


@query(f"""WITH RECURSIVE {ANSWERS},
k(query_id, rank, conv_id, turn, kept) AS (SELECT query_id, 0, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT query_id FROM h) UNION ALL SELECT k.query_id, h.rank, h.conv_id, h.turn::BIGINT,
  CASE WHEN len(list_filter(k.kept, lambda o: o BETWEEN h.id - 1 AND h.id + 1 AND o // 1000 = h.conv_id)) > 0 THEN k.kept ELSE list_append(k.kept, h.id::BIGINT) END FROM k JOIN h ON h.query_id = k.query_id AND h.rank = k.rank + 1),
n AS (SELECT query_id, rank, conv_id, turn FROM k WHERE rank > 0 AND list_contains(kept, conv_id * 1000 + turn)),
p AS (SELECT n.query_id, n.rank, n.conv_id, n.turn AS centre, b.turn AS idx, trim(b.text) AS text, coalesce(sum(length(trim(b.text))) OVER (PARTITION BY n.query_id, n.rank ORDER BY b.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n JOIN b ON b.conv_id = n.conv_id AND b.turn BETWEEN n.turn - 1 AND n.turn + 1 WHERE trim(coalesce(b.text, '')) <> ''),
c2 AS (SELECT *, CASE WHEN used = 0 OR length(text) <= 900 - used THEN text WHEN 900 - used > 80 THEN left(text, (900 - used)::INTEGER) || '…' END AS piece FROM p)
SELECT query_id, rank, conv_id AS doc_id, centre AS idx, string_agg(piece, chr(10) ORDER BY idx) AS text FROM c2 WHERE piece IS NOT NULL GROUP BY query_id, rank, conv_id, centre""")
def retrieval_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands within one turn of the answers, up to 900 characters each."""
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chapter_idx"), F.col("turn").cast("long").alias("idx"), "text")
    hits = answered(spark, sf_dir).select("query_id", "rank", F.floor(F.col("id") / 1000).alias("doc_id"), F.lit(0).alias("chapter_idx"), (F.col("id") % 1000).alias("idx"))
    return an.contexts(hits, blocks, 1, 900).select("query_id", "rank", "doc_id", "idx", "text")


@query("""WITH t AS (SELECT conv_id, turn, role <> 'system' AS ok FROM conversations), w AS (SELECT conv_id, turn, list(turn) FILTER (ok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(turn) FILTER (ok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t)
SELECT conv_id, turn, coalesce(array_to_string(list_slice(b, -2, -1), ','), '') AS before, a AS after FROM w""")
def reliable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tn.reliable_neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") != "system", 2)
    return found.select("conv_id", "turn", F.array_join(F.transform("before", lambda x: x.cast("string")), ",").alias("before"), "after")


@query("""WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations QUALIFY k <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
b AS (SELECT *, CASE WHEN i < n / 3 THEN 0 WHEN i < 2 * n / 3 THEN 1 ELSE 2 END AS third FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, third ORDER BY i) AS j FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY j, third) - 1 AS position FROM d)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, position) - 1)::INTEGER AS position FROM p""")
def window_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return tn.ordered_windows(t, "conv_id", "role", "turn", 2, F.col("role") == "user").select("conv_id", "turn", "position")


@query("""WITH RECURSIVE p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS pos FROM events), r(user_id, pos) AS (SELECT user_id, min(pos) FROM p GROUP BY user_id UNION ALL SELECT r.user_id, min(p.pos) FROM r JOIN p ON p.user_id = r.user_id AND p.pos >= r.pos + 86400 GROUP BY r.user_id, r.pos) SELECT user_id, pos FROM r""")
def min_gap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("pos"))
    return tn.spaced(e, "user_id", "pos", 86_400)


@query("""SELECT conv_id, turn, left(coalesce(string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ''), 200) AS before, left(coalesce(string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), ''), 200) AS after FROM conversations""")
def moving_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2, 1, 200).select("conv_id", "turn", "before", "after")
