"""Queries of the structuring engine, over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as tx
from ..operators import structure as st
from . import query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.empty_if_null(F.col("text")).alias("text"), "source")


#: The last junk form, one character over and over, without a back reference, which RE2 lacks.
SCORE = rf"""CASE WHEN trim(x) = '' THEN 0.5 WHEN length(trim(x)) < 2 THEN 0.3 WHEN regexp_matches(trim(x), '{tx.AD_LINE}') THEN 0.0
 WHEN regexp_matches(trim(x), '^[^\pL\pM\pN\p{{Pc}}]{{10,}}$') THEN 0.1 WHEN regexp_matches(trim(x), '{tx.JUNK_LINES[1]}') THEN 0.1 WHEN length(trim(x)) >= 9 AND replace(trim(x), left(trim(x), 1), '') = '' THEN 0.1 ELSE 1.0 END"""
CLEAN = f"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {SCORE} >= 0.3), chr(10))"
DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents)"
LINES = f"{DOCS}, l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM d)"


@query(f"SELECT doc_id, {CLEAN} AS text, len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN {CLEAN} = '' THEN 0 ELSE len(string_split({CLEAN}, chr(10))) END AS removed FROM documents")
def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.clean_lines(F.col("text"))
    n = lambda t: F.size(F.split(t, "\n", -1))
    return documents(spark, sf_dir).select("doc_id", clean.alias("text"), (n(F.col("text")) - F.when(clean == "", 0).otherwise(n(clean))).cast("long").alias("removed"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}\x{feff}\x{e000}-\x{f8ff}]', '', 'g'),
 array_to_string(list_transform(range(65281, 65375), lambda c: chr(c::INT)), '') || chr(12288), array_to_string(list_transform(range(33, 127), lambda c: chr(c::INT)), '') || ' '), '\n{3,}', chr(10) || chr(10), 'g'), ' {3,}', ' ', 'g')) AS digest FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.normalize_text(tx.strip_invisible(F.col("text")))).alias("digest"))


@query(f"""WITH {DOCS}, m AS (SELECT doc_id, regexp_replace(text, '([.!?。！？」』”])', '\\1' || chr(1), 'g') AS x FROM d),
s AS (SELECT doc_id, list_filter(string_split(x, chr(1)), lambda y: trim(y) <> '') AS s FROM m)
SELECT doc_id, len(s)::INTEGER AS n_sentences, coalesce(s[1], '') AS first, coalesce(s[-1], '') AS last FROM s""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"), F.coalesce(F.get("s", F.size("s") - 1), F.lit("")).alias("last"))


@query(r"""SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]')) + floor((length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]'))) * 3 / 10))::BIGINT AS tokens,
 CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / length(text) END::DOUBLE AS cjk,
 len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\x{4e00}-\x{9fff}]')))::INTEGER AS different, left(sha256(coalesce(text, '')), 16) AS fingerprint FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.estimate_tokens(t).alias("tokens"), tx.cjk_ratio(t).alias("cjk"), F.size(tx.token_set(t)).alias("different"), tx.fingerprint(t).alias("fingerprint"))


RULES = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {{'rule': '{n}', 'score': {w}::DOUBLE}}" for n, w, p in st.CHAPTER_RULES)


@query(f"WITH {LINES}, h AS (SELECT doc_id, line, t, CASE {RULES} END AS hit FROM l) SELECT doc_id, line::INTEGER AS line, left(trim(regexp_replace(t, '^#{{1,3}}\\s+', '')), 60) AS title, hit.rule AS rule, hit.score AS score FROM h WHERE hit IS NOT NULL")
def chapter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chapter_lines(documents(spark, sf_dir))


BEGINS = "(" + " OR ".join(f"regexp_matches(t, '{p}')" for _, w, p in st.CHAPTER_RULES) + ")"


@query(f"""WITH {LINES}, b AS (SELECT *, {BEGINS} AS begin FROM l), c AS (SELECT *, sum(begin::INT) OVER (PARTITION BY doc_id ORDER BY line) AS c FROM b),
g AS (SELECT doc_id, c, coalesce(max(t) FILTER (begin), '') AS title, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT begin), '') AS text FROM c GROUP BY doc_id, c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c)::INTEGER AS chapter_idx, trim(regexp_replace(title, '^#{{1,3}}\\s+', '')) AS title, text FROM g WHERE c > 0 OR trim(text) <> ''""")
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.chapters(documents(spark, sf_dir), 0.2)


@query(f"""WITH {DOCS}, n AS (SELECT doc_id, text, length(text) AS n FROM d), w AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 600 THEN [0] ELSE range(0, (ceil((n - 350) / 200)::BIGINT * 200) + 1, 200) END) AS start FROM n)
SELECT doc_id, (start // 200)::INTEGER AS window, start::INTEGER AS start, CASE WHEN n <= 600 THEN n ELSE least(start + 350, n) END::INTEGER AS "end", md5(substr(text, (start + 1)::BIGINT, (CASE WHEN n <= 600 THEN n ELSE least(start + 350, n) END - start)::BIGINT)) AS digest FROM w""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sliding_windows(documents(spark, sf_dir), 600, 350, 200).select("doc_id", "window", "start", "end", F.md5("text").alias("digest"))


@query(f"""WITH {DOCS} SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN trim(s) IN ('***', '* * *', '◇', '◆', '＊＊＊') THEN '---' ELSE s END), lambda s: trim(s) <> ''), chr(10) || chr(10)) AS text FROM d""")
def layout_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", st.layout(F.col("text")).alias("text"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line, trim(t) AS s FROM l),
p AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM s),
j AS (SELECT *, s = '' OR before IS NULL OR before = '' OR right(before, 1) IN ('。', '！', '？', '…', '!', '?', '.', '」', '』', '"') OR regexp_matches(s, '{st.BOUNDARY}') AS apart FROM p),
g AS (SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM j), m AS (SELECT doc_id, g, string_agg(s, ' ' ORDER BY line) AS s FROM g GROUP BY doc_id, g)
SELECT doc_id, string_agg(s, chr(10) ORDER BY g) AS text FROM m GROUP BY doc_id""")
def paragraph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", st.repair_paragraphs(F.col("text")).alias("text"))


@query()
def chunk_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.flat_chunks(documents(spark, sf_dir))


@query()
def chunk_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.parent_child_chunks(st.chapters(documents(spark, sf_dir), 0.5))


@query(r"""WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT page_id, regexp_extract_all(html, '"[^"\n]{1,200}"') AS m, string_split_regex(html, '"[^"\n]{1,200}"') AS g FROM d),
e AS (SELECT page_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS content, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap FROM m WHERE len(m) > 0),
s AS (SELECT *, sum(gap + length(content)) OVER (PARTITION BY page_id ORDER BY i) AS e FROM e)
SELECT page_id, (e - length(content))::BIGINT AS start, e::BIGINT AS "end", content FROM s""")
def quote_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", tx.empty_if_null(F.col("html")).alias("html"))
    return st.quote_spans(pages, "page_id", "html", pairs=(('"', '"'),))


@query(r"""SELECT page_id, md5(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')) AS digest, length(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'))::INTEGER AS n_chars FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = tx.strip_tags(tx.empty_if_null(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(bare).alias("digest"), F.length(bare).alias("n_chars"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''), '') AS title FROM pages""")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


@query("SELECT min(doc_id) AS doc_id, left(sha256(coalesce(text, '')), 16) AS fingerprint, count(*) AS n FROM documents GROUP BY 2")
def dedup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(tx.fingerprint(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INTEGER AS k, props NOT LIKE '{%}' AS cut FROM events")
def json_tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", jsonx.tolerant(fenced, "k int")["k"].alias("k"), jsonx.looks_cut(F.col("props")).alias("cut"))


@query(f"""WITH {LINES}, q AS (SELECT doc_id, line, line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS gap FROM l WHERE regexp_matches(t, '\\.$')),
b AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM q) SELECT doc_id, min(line)::INTEGER AS first_line, max(line)::INTEGER AS last_line, count(*) AS n_quotes FROM b GROUP BY doc_id, b""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.dialogue_blocks(documents(spark, sf_dir), quotes=r"\.$")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r(source, rn, doc_id, n_chars, batch, held) AS (SELECT source, rn, doc_id, n_chars, 0, n_chars FROM d WHERE rn = 1 UNION ALL
 SELECT d.source, d.rn, d.doc_id, d.n_chars, CASE WHEN r.held + d.n_chars > 20000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held + d.n_chars > 20000 THEN d.n_chars ELSE r.held + d.n_chars END FROM r JOIN d ON d.source = r.source AND d.rn = r.rn + 1)
SELECT source, doc_id, n_chars, batch FROM r""")
def chapter_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("source", "doc_id", F.length("text").alias("n_chars"))
    return st.chapter_batches(sized, 20_000, "source", "doc_id", "n_chars")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations)
SELECT conv_id, (rn // 4)::INTEGER AS block, count(*) AS n_turns, min(turn) AS first_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers, string_agg(left(coalesce(text, ''), 1200), chr(10) ORDER BY turn) AS content FROM t GROUP BY conv_id, rn // 4""")
def turns_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns a block, as the tables' conversations are short; the operator's own size is 40."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    t = table(spark, sf_dir, "conversations").withColumn("block", F.floor(rn / 4).cast("int"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.left(tx.empty_if_null(F.col("text")), F.lit(1200)).alias("t")))), lambda x: x["t"]), "\n")
    return t.groupBy("conv_id", "block").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"), content.alias("content"))
