"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_extract, langid, licenses, linededup, mixing, pieces, pii, simhash, token_counts, topk, whitening
from .common import table, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).drop("text", "source")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path, end=True), path)
    digest = lambda text: F.sha2(text, 256)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
        F.xxhash64("starts", "ends").alias("spans_hash"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    kept = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "links"), "alignment")
    scored = alignment.score(kept)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return kept.drop("links").join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", number("n_links"), number("n_best"), number("count_sum"), "groups_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


REGISTERED = (
    op1_mixing, op2_line_dedup, op3_licenses, op4_langid, op5_pii, op6_token_counts, op7_decontaminate, op8_html_extract, op9_simhash, op10_topk,
    op11_sentencepiece, op12_alignment, op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, text, regexp_extract_all(lower_ascii(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower_ascii(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ish AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw
), dsh AS (
  SELECT DISTINCT doc_id, text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw
), n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY 1
), held AS (
  SELECT doc_id, text, item_id, count(*) AS held FROM dsh JOIN ish USING (s) GROUP BY ALL
), bad AS (
  SELECT doc_id, text, count(*) AS n_items, max(held / n) AS containment, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids
  FROM held JOIN n USING (item_id) WHERE held >= n * 0.8 - 1e-9 GROUP BY ALL
)
SELECT d.doc_id, bad.n_items IS NOT NULL AS contaminated, coalesce(bad.n_items, 0)::BIGINT AS n_items, coalesce(bad.containment, 0)::DOUBLE AS containment, coalesce(bad.item_ids, '') AS item_ids
FROM documents d LEFT JOIN bad ON d.doc_id IS NOT DISTINCT FROM bad.doc_id AND d.text IS NOT DISTINCT FROM bad.text
"""
OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT coalesce(doc_id, -9223372036854775808) AS id, line, t, list_distinct(regexp_extract_all(lower_ascii(t), '[^\x20\x09-\x0D]+')) AS w FROM l
), f AS (SELECT t, w, len(w) AS n, min((id, line)) AS pos FROM s WHERE len(w) >= 5 GROUP BY ALL
), token AS (SELECT unnest(w) AS word, t, n, pos FROM f
), df AS (SELECT word, count(*) AS df FROM token GROUP BY 1
), placed AS (
  SELECT word, t, n, pos, row_number() OVER (PARTITION BY t ORDER BY df, word) AS i FROM token JOIN df USING (word)
), prefix AS (SELECT * FROM placed WHERE i <= n - ceil(n * 0.8 - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT x.t AS xt, y.t AS yt FROM prefix x JOIN prefix y ON x.word = y.word AND y.pos < x.pos AND y.n >= x.n * 0.8 - 1e-9 AND x.n >= y.n * 0.8 - 1e-9
), bad AS (
  SELECT DISTINCT xt AS t FROM pairs JOIN f x ON xt = x.t JOIN f y ON yt = y.t
  WHERE len(list_intersect(x.w, y.w)) >= (x.n + y.n - len(list_intersect(x.w, y.w))) * 0.8 - 1e-9
), kept AS (
  SELECT l.doc_id, l.text, l.line, l.t, f.t IS NOT NULL AS long, f.t IS NULL OR ((coalesce(l.doc_id, -9223372036854775808), l.line) = f.pos AND l.t NOT IN (SELECT t FROM bad)) AS stays
  FROM (SELECT DISTINCT * FROM l) l LEFT JOIN f ON l.t = f.t
), r AS (
  SELECT doc_id, text, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (stays), '') AS new, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, count(*) FILTER (stays AND long) AS n_left
  FROM kept GROUP BY ALL
)
SELECT d.doc_id, r.new AS text, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_left, 0)::BIGINT AS n_left
FROM documents d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text
"""
OP3_SQL = (
    r"""
WITH t(template, label, base, place, grams, gram) AS (VALUES """
    + ", ".join(f"({t}, '{label}', {base}, {place}, {grams}, '{gram}')" for t, label, base, place, grams, gram in licenses.template_rows())
    + r"""
), dw AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(lower_ascii(text), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (SELECT DISTINCT doc_id, text, w FROM dw
), g AS (
  SELECT doc_id, text, unnest(range(0, len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS gram FROM d WHERE len(w) >= 3
), lines AS (
  SELECT doc_id, text, template, label, base, grams, pos - place AS diagonal, list(DISTINCT place) AS places, min(pos) AS first, max(pos) AS last
  FROM g JOIN t USING (gram) GROUP BY ALL
), gaps AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal), 0) AS gap FROM lines
), merged AS (
  SELECT *, sum((gap > 2)::INT) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) AS span FROM gaps
), spans AS (
  SELECT doc_id, text, template, label, base, grams, span, len(list_distinct(flatten(list(places)))) / grams AS share, min(first) AS first, max(last) AS last,
         coalesce(list(diagonal) FILTER (base AND len(places) = grams), []) AS places
  FROM merged GROUP BY doc_id, text, template, label, base, grams, span
), r AS (
  SELECT doc_id, text, sum(len(places))::BIGINT AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (len(places) > 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (len(places) > 0 OR share >= 0.9) AS labels, max(share) AS score,
         string_agg(label || ':' || first || ':' || (last + 3), ',' ORDER BY first, label, last) FILTER (share >= 0.9) AS spans
  FROM spans GROUP BY ALL
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(spans, '') AS spans
FROM dw LEFT JOIN r ON dw.doc_id IS NOT DISTINCT FROM r.doc_id AND dw.text IS NOT DISTINCT FROM r.text
"""
)
#: A-Z only, as ``lower`` would change other letters.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(text: str) -> str:
    return re.sub(r"lower_ascii\(([\w.]+)\)", lambda m: LOWER.format(m[1]), text)


def oracle_sql() -> dict[str, str]:
    return {k: sql(v) for k, v in (("op2_line_dedup", OP2_SQL), ("op3_licenses", OP3_SQL), ("op7_decontaminate", OP7_SQL), ("op10_topk", OP10_SQL))}
