"""The structure of a text: which rule its chapters follow, chosen by what the rules find, and the chapters by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import CHAPTER_RULES

#: A rule that finds more lines than this takes paragraphs for headings.
MOST_HITS = 500
#: In a text of ``LONG`` characters or more the headings stand at least this share of it apart, first to last.
LEAST_SPAN, LONG = 0.2, 10_000
LEAST_CONFIDENCE = 0.6


def numbered_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``n_chars``, ``line``, ``t``, ``at``: the lines of each text with the character at which they begin."""
    lines = docs.select(id, F.length(text).alias("n_chars"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t"))
    before = F.sum(F.length("t") + 1).over(Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("at", F.coalesce(before, F.lit(0)).cast("long"))


def verdict(hits: Column, span: Column, n_chars: Column, confidence: float) -> Column:
    """Why a rule isn't taken; null if it may be."""
    narrow = (n_chars >= LONG) & (hits >= 2) & (span < LEAST_SPAN)
    return F.when(hits < 1, "no_hits").when(hits > MOST_HITS, "too_many_hits").when(narrow, "narrow").when(F.lit(confidence < LEAST_CONFIDENCE), "low_confidence")


def structure_specs(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple = CHAPTER_RULES) -> DataFrame:
    """``id``, ``rule``, ``confidence``, ``hits``, ``span`` and ``refused`` (``rule:reason`` of the rules before it that found something).

    All rules are tried in one pass over the lines; the first in the order of ``rules`` that passes is taken,
    ``default`` (the text as one chapter) where none does. ``span`` is the distance of the first and last hit as a share of the text.
    """
    lines = numbered_lines(docs.where(F.col(text).isNotNull()), id, text)
    aggs = [F.first("n_chars").alias("n_chars")]
    for k, (_, _, pattern) in enumerate(rules):
        at = F.when(F.col("t").rlike(pattern), F.col("at"))
        aggs += [F.count(at).alias(f"h{k}"), F.min(at).alias(f"a{k}"), F.max(at).alias(f"z{k}")]
    tried = lines.groupBy(id).agg(*aggs)
    each = []
    for k, (name, weight, _) in enumerate(rules):
        span = F.coalesce(F.round((F.col(f"z{k}") - F.col(f"a{k}")) / F.greatest(F.col("n_chars"), F.lit(1)), 6), F.lit(0.0))
        each.append(F.struct(F.lit(name).alias("rule"), F.lit(weight).alias("confidence"), F.col(f"h{k}").alias("hits"), span.alias("span"), verdict(F.col(f"h{k}"), span, F.col("n_chars"), weight).alias("why")))
    none = F.struct(F.lit("default").alias("rule"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("span"), F.lit(None).cast("string").alias("why"))
    found = tried.select(id, F.array(*each).alias("e"))
    place = F.array_position(F.transform("e", lambda x: x["why"].isNull()), True).cast("int")
    taken = F.when(F.col("p") > 0, F.get("e", F.col("p") - 1)).otherwise(none)
    passed = F.when(F.col("p") > 0, F.slice("e", 1, F.greatest(F.col("p") - 1, F.lit(0)))).otherwise(F.col("e"))
    refused = F.transform(F.filter(passed, lambda x: x["hits"] > 0), lambda x: F.concat(x["rule"], F.lit(":"), x["why"]))
    return found.withColumn("p", place).select(id, taken.alias("s"), F.array_join(refused, ",").alias("refused")).select(id, "s.rule", "s.confidence", "s.hits", "s.span", "refused")


def chapters_by_spec(docs: DataFrame, specs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple = CHAPTER_RULES) -> DataFrame:
    """``id``, ``chapter_idx``, ``title``, ``text``: each text cut by the rule that was chosen for it; what stands before the first heading is a chapter without a title, if it isn't blank."""
    lines = docs.where(F.col(text).isNotNull()).join(specs.select(id, "rule"), id).select(id, "rule", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t"))
    begins = F.lit(False)
    for name, _, pattern in rules:
        begins = begins | ((F.col("rule") == name) & F.col("t").rlike(pattern))
    marked = lines.withColumn("begin", begins.cast("int")).withColumn("c", F.sum("begin").over(Window.partitionBy(id).orderBy("line")))
    listed = F.array_sort(F.collect_list(F.when(F.col("begin") == 0, F.struct("line", "t"))))
    grouped = marked.groupBy(id, "c").agg(F.max(F.when(F.col("begin") == 1, F.trim(F.regexp_replace("t", r"^#{1,3}\s+", "")))).alias("title"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"))
    parts = grouped.where((F.col("c") > 0) | (F.trim("text") != "")).withColumn("title", F.coalesce("title", F.lit("")))
    return parts.withColumn("chapter_idx", F.row_number().over(Window.partitionBy(id).orderBy("c"))).select(id, "chapter_idx", "title", "text")
