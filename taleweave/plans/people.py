"""Queries on the cast of texts and their structure. Words of ``benchmark`` are names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import speech as sp
from ..operators import allocation, portraits, sounds, specs
from ..operators import inventory as iv
from ..operators import structure as st
from . import query, structure, table


def words(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("name")).where(F.col("name").rlike(pattern)).distinct()


#: Words with the space behind them, none of which ends another: no two can overlap, so SQL can count them one by one.
APART = "w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark), k AS (SELECT word || ' ' AS name FROM w WHERE regexp_full_match(word, '[a-z]{3,}')), n AS (SELECT name FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.name <> k.name AND (contains(o.name, k.name) OR contains(k.name, o.name))))"


def apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.entities import contained

    known = words(spark, sf_dir, "^[a-z]{3,}$").select(F.concat("name", F.lit(" ")).alias("name"))
    inside = contained(known.select(F.col("name").alias("id"), F.col("name").alias("text")), known).where("id <> name")
    return known.join(inside.select("name"), "name", "left_anti").join(inside.select(F.col("id").alias("name")), "name", "left_anti")


@query(f"""WITH {APART}, d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, name, length(text) AS len, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS mentions, (strpos(text, name) - 1)::INTEGER AS first FROM d JOIN n ON contains(text, name))
SELECT id, name, mentions, first FROM c WHERE len <= 3000 OR mentions >= 2""")
def character_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return iv.inventory(texts, apart(spark, sf_dir))


@query()
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as names, with those that stand in others: tests hold the operator to a brute force."""
    return iv.located(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), words(spark, sf_dir, "^[a-z]{2,}$"))


TRIED = ", ".join(f"{{'rule': '{n}', 'confidence': {w}::DOUBLE, 'pos': list(pos) FILTER (regexp_matches(t, '{p}'))}}" for n, w, p in st.CHAPTER_RULES)
SPECS = f"""{structure.DOCS}, l AS (SELECT doc_id, length(text) AS n_chars, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM d),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
e AS (SELECT doc_id, any_value(n_chars) AS n_chars, [{TRIED}] AS e FROM o GROUP BY doc_id),
u AS (SELECT doc_id, n_chars, unnest(range(1, len(e) + 1)) AS p, unnest(e, max_depth := 2) FROM e),
r AS (SELECT doc_id, n_chars, p, rule, confidence, coalesce(len(pos), 0) AS hits, coalesce(round((list_max(pos) - list_min(pos)) / greatest(n_chars, 1), 6), 0)::DOUBLE AS span FROM u),
v AS (SELECT *, CASE WHEN hits < 1 THEN 'no_hits' WHEN hits > 500 THEN 'too_many_hits' WHEN n_chars >= 10000 AND hits >= 2 AND span < 0.2 THEN 'narrow' WHEN confidence < 0.6 THEN 'low_confidence' END AS why FROM r),
f AS (SELECT doc_id, coalesce(min(p) FILTER (why IS NULL), 99) AS first FROM v GROUP BY doc_id),
spec AS (SELECT doc_id, coalesce(max(rule) FILTER (p = first), 'default') AS rule, coalesce(max(confidence) FILTER (p = first), 1)::DOUBLE AS confidence, coalesce(max(hits) FILTER (p = first), 0)::BIGINT AS hits, coalesce(max(span) FILTER (p = first), 0)::DOUBLE AS span,
 coalesce(string_agg(rule || ':' || why, ',' ORDER BY p) FILTER (p < first AND hits > 0), '') AS refused FROM v JOIN f USING (doc_id) GROUP BY doc_id)"""


@query(f"WITH {SPECS} SELECT * FROM spec")
def structure_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.structure_specs(structure.documents(spark, sf_dir))


MATCHES = " OR ".join(f"(rule = '{n}' AND regexp_matches(t, '{p}'))" for n, _, p in st.CHAPTER_RULES)


@query(f"""WITH {SPECS}, m AS (SELECT doc_id, line, t, ({MATCHES}) AS begin FROM l JOIN spec USING (doc_id)), c AS (SELECT *, sum(begin::INT) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM m),
g AS (SELECT doc_id, c, coalesce(max(t) FILTER (begin), '') AS title, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT begin), '') AS text FROM c GROUP BY doc_id, c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c)::INTEGER AS chapter_idx, trim(regexp_replace(title, '^#{{1,3}}\\s+', '')) AS title, md5(text) AS digest FROM g WHERE c > 0 OR trim(text) <> ''""")
def chapters_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = structure.documents(spark, sf_dir)
    return specs.chapters_by_spec(docs, specs.structure_specs(docs)).select("doc_id", "chapter_idx", "title", F.md5("text").alias("digest"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark), k AS (SELECT name, regexp_extract_all(name, '[^aeiouy]*[aeiouy]+(?:[^aeiouy]+$)?|[^aeiouy]+$') AS s FROM w WHERE regexp_full_match(name, '[a-z]{2,}')),
p AS (SELECT x.name AS a, y.name AS b, len(x.s) AS n, len(list_filter(list_zip(x.s, y.s), lambda z: z[1] <> z[2])) AS differ FROM k x JOIN k y ON x.name < y.name AND len(x.s) = len(y.s))
SELECT a, b, CASE WHEN differ = 0 THEN 1 ELSE round(1 - 1 / n, 6) END::DOUBLE AS likeness FROM p WHERE differ = 0 OR (differ = 1 AND n >= 2)""")
def sound_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sounds.sounding_alike(sounds.with_syllables(words(spark, sf_dir, "^[a-z]{2,}$")))


#: Speakers are the first words of turns, their first four letters the canonical names; narration is that of ``benchmark``.
STORY = """t AS (SELECT conv_id AS block, turn AS pos, regexp_extract(lower(coalesce(text, '')), '^([a-z]{4,})', 1) AS speaker, text AS content,
 CASE WHEN regexp_matches(coalesce(text, ''), '(?i)shout|angry|furious') THEN 'angry' WHEN regexp_matches(coalesce(text, ''), '(?i)sob|sigh|tear') THEN 'sad' WHEN regexp_matches(coalesce(text, ''), '(?i)laugh|smile|grin') THEN 'happy' WHEN regexp_matches(coalesce(text, ''), '(?i)fear|afraid|tremble') THEN 'afraid' ELSE 'plain' END AS mood FROM conversations),
s AS (SELECT item_id * 1000 + i AS id, trim(x) AS text FROM (SELECT item_id, unnest(range(0, len(string_split_regex(lower(text), '[.!?\n]')))) AS i, unnest(string_split_regex(lower(text), '[.!?\n]')) AS x FROM benchmark) WHERE trim(x) <> ''),
said AS (SELECT * FROM t WHERE speaker <> ''), nm AS (SELECT DISTINCT speaker AS name FROM said), named AS (SELECT id, name FROM s JOIN nm ON contains(text, name)),
met AS (SELECT DISTINCT block, speaker FROM said),
raw AS (SELECT speaker AS raw, 'appearance' AS counter, '' AS key, count(*) AS n FROM said GROUP BY ALL UNION ALL SELECT speaker, 'dialogue', '', count(*) FROM said GROUP BY ALL UNION ALL SELECT name, 'appearance', '', count(*) FROM named GROUP BY ALL
 UNION ALL SELECT speaker, 'mood', mood, count(*) FROM said GROUP BY ALL UNION ALL SELECT x.speaker, 'with', left(y.speaker, 4), count(*) FROM met x JOIN met y ON x.block = y.block AND x.speaker <> y.speaker GROUP BY ALL
 UNION ALL SELECT x.name, 'with', left(y.name, 4), count(*) FROM named x JOIN named y ON x.id = y.id AND x.name <> y.name GROUP BY ALL),
cnt AS (SELECT left(raw, 4) AS name, counter, key, sum(n)::BIGINT AS n FROM raw WHERE counter <> 'with' OR left(raw, 4) <> key GROUP BY ALL)"""


def told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("block"), F.col("turn").alias("pos"), F.regexp_extract(F.lower(text), "^([a-z]{4,})", 1).alias("speaker"), F.col("text").alias("content"), sp.mood(F.col("text")).alias("mood"))
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), r"[.!?\n]", -1)).alias("i", "x"))
    sentences = each.select((F.col("item_id") * 1000 + F.col("i")).alias("id"), F.trim("x").alias("text")).where("text <> ''")
    aliases = turns.where("speaker <> ''").select(F.col("speaker").alias("alias"), F.left("speaker", F.lit(4)).alias("canonical")).distinct()
    return turns, sentences, aliases


@query(f"WITH {STORY} SELECT * FROM cnt")
def character_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portraits.counters(*told(spark, sf_dir))


@query()
def character_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sentences, aliases = told(spark, sf_dir)
    return portraits.cards(portraits.statistics(portraits.counters(turns, sentences, aliases)), turns, sentences, aliases)


@query("""WITH e AS (SELECT (user_id % 10)::BIGINT AS volume, day(ts)::INTEGER AS chapter, (hour(ts) // 4)::INTEGER AS "window", event_type AS name FROM events),
y AS (SELECT volume, chapter, "window", name, count(*) AS turns FROM e GROUP BY ALL), a AS (SELECT volume, chapter, count(*) AS activity FROM e GROUP BY ALL),
w AS (SELECT volume, chapter, "window", activity, row_number() OVER (PARTITION BY volume, chapter ORDER BY "window") AS n FROM (SELECT DISTINCT volume, chapter, "window" FROM y) JOIN a USING (volume, chapter)),
p AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY n, activity DESC, chapter, "window") AS place FROM w WHERE n <= 3),
b AS (SELECT volume, chapter, "window", place, coalesce(sum(turns) OVER (PARTITION BY volume, name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < CASE WHEN name IN ('view', 'click') THEN 12 WHEN name = 'error' THEN 40 ELSE 0 END AS open FROM y JOIN p USING (volume, chapter, "window")),
o AS (SELECT volume, chapter, "window", max(open::INT) AS open FROM b GROUP BY ALL), u AS (SELECT p.*, open, sum(open) OVER (PARTITION BY volume ORDER BY place) AS upto FROM p JOIN o USING (volume, chapter, "window"))
SELECT volume, chapter, "window", activity, place::INTEGER AS place, CASE WHEN open = 1 AND upto <= 30 THEN upto END::INTEGER AS call, CASE WHEN open = 0 THEN 'met' WHEN upto > 30 THEN 'budget' END AS reason FROM u
UNION ALL SELECT volume, chapter, "window", activity, NULL, NULL, 'chapter_cap' FROM w WHERE n > 3""")
def call_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are chapters, four hours a window, event types the names."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("volume"), F.dayofmonth("ts").alias("chapter"), F.floor(F.hour("ts") / 4).cast("int").alias("window"), F.col("event_type").alias("name"))
    yields = e.groupBy("volume", "chapter", "window", "name").agg(F.count("*").alias("turns"))
    activity = e.groupBy("volume", "chapter").agg(F.count("*").alias("activity"))
    windows = yields.select("volume", "chapter", "window").distinct().join(activity, ["volume", "chapter"])
    quotas = spark.createDataFrame([("view", 12), ("click", 12), ("error", 40)], "name string, quota int")
    return allocation.planned_calls(windows, yields, quotas, "volume", 30)
