"""Attribution of quotes. Quoted values in ``pages`` are quotes; a word and ``=`` before one is a rule's hint of its speaker, of which every third is unsure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attribution as at
from ..operators import structure as st
from . import query, table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), tx.empty_if_null(F.col("html")).alias("text"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``start``, ``end``, ``content``, ``hint``, ``confidence`` of the quotes of each page."""
    rows = pages(spark, sf_dir)
    spans = st.quote_spans(rows, "id", "text", pairs=(('"', '"'),))
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end", "content")).alias("q"))
    hint = lambda q: F.regexp_extract(F.substring(F.col("text"), F.greatest(q["start"] - 20, F.lit(0)).cast("int") + 1, F.least(q["start"], F.lit(20)).cast("int")), "([a-z]+)=$", 1)
    found = rows.join(listed, "id").select("id", F.inline(F.transform("q", lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"), q["content"].alias("content"), F.nullif(hint(q), F.lit("")).alias("hint")))))
    n = F.row_number().over(Window.partitionBy("id").orderBy("start"))
    return found.withColumn("confidence", F.when(F.col("hint").isNull(), 0.0).when(n % 3 == 0, 0.3).otherwise(0.9))


@query()
def speaker_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = quotes(spark, sf_dir)
    found = at.windows(pages(spark, sf_dir), spans)
    return at.attributed(spans, found, at.proposed(found)).drop("content")


HINTS = r"""d AS (SELECT page_id AS id, coalesce(html, '') AS text FROM pages), m AS (SELECT id, text, regexp_extract_all(text, '"[^"\n]{1,200}"') AS m, string_split_regex(text, '"[^"\n]{1,200}"') AS g FROM d),
e AS (SELECT id, text, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS content, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap FROM m WHERE len(m) > 0),
s AS (SELECT *, sum(gap + length(content)) OVER (PARTITION BY id ORDER BY i) AS e FROM e), p AS (SELECT id, text, i, (e - length(content))::BIGINT AS start, e::BIGINT AS "end" FROM s),
h AS (SELECT id, start, "end", i, nullif(regexp_extract(substr(text, greatest(start - 20, 0) + 1, least(start, 20)), '([a-z]+)=$', 1), '') AS hint FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS n FROM h), c AS (SELECT *, CASE WHEN hint IS NULL THEN 0.0 WHEN n % 3 = 0 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence FROM q),
k AS (SELECT *, confidence >= 0.5 AS sure, sum((confidence >= 0.5)::INT) OVER (PARTITION BY id ORDER BY start) AS upto FROM c),
o AS (SELECT *, (start - lag("end") OVER (PARTITION BY id ORDER BY start) > 400)::INT AS jump FROM k WHERE NOT sure), r AS (SELECT *, coalesce(sum(jump) OVER (PARTITION BY id ORDER BY start), 0) AS run FROM o),
nn AS (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY start) - 1 AS w, lead(start) OVER (PARTITION BY id, run ORDER BY start) AS second, lead("end") OVER (PARTITION BY id, run ORDER BY start) AS second_end, lead(upto) OVER (PARTITION BY id, run ORDER BY start) AS second_upto FROM r),
win AS (SELECT id, start AS first, coalesce(second_end, "end") AS last, CASE WHEN second IS NULL THEN [start] ELSE [start, second] END AS targets, upto AS k0, coalesce(second_upto, upto) AS k1 FROM nn WHERE w = 0 OR second IS NOT NULL)"""


@query(f"""WITH {HINTS}, a AS (SELECT id, upto AS k, hint FROM k WHERE sure), num AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first, last)::INTEGER AS "window" FROM win)
SELECT id, "window", first, last, len(targets)::INTEGER AS n_targets, concat_ws(',', (SELECT hint FROM a WHERE a.id = num.id AND a.k = k0 - 1), (SELECT hint FROM a WHERE a.id = num.id AND a.k = k0), (SELECT hint FROM a WHERE a.id = num.id AND a.k = k1 + 1)) AS neighbours FROM num""")
def attribution_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = at.windows(pages(spark, sf_dir), quotes(spark, sf_dir))
    return found.select("id", "window", "first", "last", F.size("targets").alias("n_targets"), F.array_join("neighbours", ",").alias("neighbours"))
