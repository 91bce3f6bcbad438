"""Stored blocks, catalogs and logs: lookups, listings, what a deletion takes, folding and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(blocks: DataFrame, asked: DataFrame, id: str = "id") -> DataFrame:
    """``asked(query_id, pos, id)`` joined to ``blocks``: each id once for a query, at its first place; unknown ids go."""
    first = asked.groupBy("query_id", id).agg(F.min("pos").alias("pos"))
    return first.join(blocks, id)


def removal_counts(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """``by``, ``before``, ``removed``: rows before and those gone since."""
    a, b = before.groupBy(by).agg(F.count("*").alias("before")), after.groupBy(by).agg(F.count("*").alias("after"))
    return a.join(b, by, "left").select(by, "before", (F.col("before") - F.coalesce("after", F.lit(0))).alias("removed"))


def listing(blocks: DataFrame, series: str, doc: str, channel: str, person: str) -> DataFrame:
    """``series``, ``docs``, ``blocks``, ``channels`` and ``persons`` (different ones, sorted) of stored blocks."""
    return blocks.groupBy(series).agg(F.countDistinct(doc).alias("docs"), F.count("*").alias("blocks"), F.array_sort(F.collect_set(channel)).alias("channels"), F.countDistinct(person).alias("persons"))


def catalog(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their ``doc_id``, and ``position`` in the series by the number in the id, then the id."""
    rows = old.join(new, doc, "left_anti").unionByName(new)
    number = F.coalesce(F.regexp_extract(doc, r"(\d+)\D*$", 1).try_cast("int"), F.lit(1 << 30))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("series").orderBy(number, doc)))


def flattened(rows: DataFrame, id: str, json: str, schema: str) -> DataFrame:
    """``id``, ``pos`` and the fields of each object of a JSON array (or of one object); what isn't JSON has no rows."""
    listed = F.when(F.trim(json).startswith("["), F.from_json(json, f"array<struct<{schema}>>")).otherwise(F.array_compact(F.array(F.from_json(json, f"struct<{schema}>"))))
    return rows.select(id, F.posexplode(listed).alias("pos", "o")).where(F.col("o").isNotNull()).select(id, "pos", "o.*")


def compacted(rows: DataFrame, by: str, order: str, text: str, most: float, keep: int, head: int = 20) -> DataFrame:
    """``by``, ``folded``, ``kept``, ``summary``: sessions of over four fifths of ``most`` tokens fold all but their newest ``2 * keep`` rows, of which the summary has the first ``head`` characters each; others fold nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = Window.partitionBy(by)
    sized = rows.withColumns({"__all": F.sum(F.length(t) * 0.25).over(w), "__age": F.row_number().over(w.orderBy(F.desc(order)))})
    old = (F.col("__all") > 0.8 * most) & (F.col("__age") > 2 * keep)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(old, F.struct(F.col(order).alias("o"), F.left(t, F.lit(head)).alias("t"))))), lambda x: x["t"]), " / ")
    return sized.groupBy(by).agg(F.count_if(old).alias("folded"), F.count_if(~old).alias("kept"), said.alias("summary"))


def rotated(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """``rows`` with ``file``, the number of the file they fall in when one is full at ``most`` entries."""
    return rows.withColumn("file", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / most).cast("int"))


def open_circuits(calls: DataFrame, by: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """``by``, ``first``, ``failures``: runs of ``least`` or more failures in a row, by the order of their first."""
    w = Window.partitionBy(by).orderBy(*order)
    runs = calls.withColumn("__run", F.sum((~failed).cast("int")).over(w)).where(failed)
    return runs.groupBy(by, "__run").agg(F.min(order[-1]).alias("first"), F.count("*").alias("failures")).where(F.col("failures") >= least).drop("__run")


def completeness(text: Column, first: Column, last: Column, chapters: Column, most: int = 2000, least: int = 3) -> Column:
    """What a book cut into chapters lacks: ``few_chapters``, ``long_head`` (characters before the first), ``long_tail`` (after the last)."""
    return F.array_compact(F.array(F.when(chapters < least, "few_chapters"), F.when(first > most, "long_head"), F.when(F.length(text) - last > most, "long_tail")))


def rule_questions(blocks: DataFrame, names: Column, sentences: Column, most: int) -> DataFrame:
    """``id``, ``k``, ``name``, ``answer``: for the first ``most`` of a block's ``names`` that it holds, the first sentence with the name."""
    pairs = F.transform(names, lambda n: F.struct(n.alias("name"), F.get(F.filter(sentences, lambda s: F.contains(s, n)), F.lit(0)).alias("answer")))
    held = F.slice(F.filter(pairs, lambda p: p["answer"].isNotNull()), 1, most)
    return blocks.select("id", F.posexplode(held).alias("k", "p")).select("id", "k", "p.name", "p.answer")


def prompt_candidates(*lists: Column, most: int = 10) -> Column:
    """Names in the order of the lists, each once, ``most`` of them."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), 1, most)


def chapter_texts(blocks: DataFrame, by: list[str], order: str, text: str, most: int) -> DataFrame:
    """``by``, ``text``, ``n_blocks``: blocks of a chapter in order, as many whole ones as fit into ``most`` characters; the first always does."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fit = blocks.withColumns({"__upto": upto, "__k": F.row_number().over(w)}).where((F.col("__upto") <= most) | (F.col("__k") == 1))
    return fit.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("n_blocks"))


def backoff(attempt: Column, base: float = 1.0, most: float = 30.0, retry_after: Column | None = None) -> Column:
    """Seconds to wait before a retry: doubling from ``base`` up to ``most``; what the server asks for counts first, up to ``most``."""
    own = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return own if retry_after is None else F.when(retry_after.isNotNull(), F.least(F.greatest(retry_after.cast("double"), F.lit(0.0)), F.lit(most))).otherwise(own)
