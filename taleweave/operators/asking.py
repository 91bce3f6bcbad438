"""What a question is about: entities it names, the scope it sets, chapters by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import entities


def resolve_entities(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id``, ``entities`` (sorted), ``series`` (of all of them, null if there are several), ``crosses`` (several series), ``augmented`` (the query and the canonical names it lacks).

    ``aliases(alias, canonical, kind, series)``; of the entities of one surface form that with the least ``kind``
    counts (0 title, 1 alias, 2 canonical), of equals the smallest name. Names of three characters or more count
    anywhere, of two only outside of longer ones, of one never. A query without a name has no row.
    """
    texts = queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"))
    known = aliases.where(F.length("alias") >= 2).groupBy("alias").agg(F.min(F.struct("kind", "canonical", "series")).alias("best"))
    named = entities.prefer_longest(entities.contained(texts, known.select(F.col("alias").alias("name")))).select("id", F.explode("names").alias("alias"))
    found = named.join(known, "alias").select(F.col("id").alias("query_id"), "best.canonical", "best.series").groupBy("query_id").agg(F.array_sort(F.collect_set("canonical")).alias("entities"), F.min("series").alias("low"), F.max("series").alias("high"))
    missing = F.filter("entities", lambda e: ~F.contains(F.col("query"), e))
    return found.join(queries, "query_id").select("query_id", "entities", F.when(F.col("low") == F.col("high"), F.col("low")).alias("series"), (F.col("low") != F.col("high")).alias("crosses"), F.concat_ws(" ", F.col("query"), F.array_join(missing, " ")).alias("augmented"))


def resolve_scope(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``queries`` with ``title`` (what stands in 《》), ``volume`` and ``section`` (numbers in words or digits), and of ``catalog(title, series, volume, doc_id)`` the ``doc_id`` they point to.

    A title without a volume means the whole series: its ``doc_id`` is null.
    """
    title = F.nullif(F.regexp_extract("query", "《([^》]+)》", 1), F.lit(""))
    asked = queries.withColumns({"title": title, "volume": tx.volume_hint(F.col("query")), "section": tx.section_hint(F.col("query"))})
    books = catalog.select(F.col("title").alias("__t"), F.col("volume").alias("__v"), "series", "doc_id")
    series = books.select("__t", "series").distinct()
    named = asked.join(series, F.col("title") == F.col("__t"), "left").drop("__t")
    docs = books.select(F.col("__t"), F.col("__v"), "doc_id")
    return named.join(docs, (F.col("title") == F.col("__t")) & (F.col("volume") == F.col("__v")), "left").drop("__t", "__v")


def chapter_by_ordinal(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """``asked(doc_id, ordinal)`` with ``chapter_title``: the title that is ``ordinal``-th in ``chapters(doc_id, chapter_order, chapter_title)``, in the order of chapter and title."""
    titles = chapters.select("doc_id", "chapter_order", "chapter_title").distinct()
    ranked = titles.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_order", "chapter_title")))
    return asked.join(ranked.select("doc_id", "ordinal", "chapter_title"), ["doc_id", "ordinal"], "left")


def present_names(rows: DataFrame, names: str, text: str) -> DataFrame:
    """``rows`` with only those ``names`` that their ``text`` holds: what a model made up goes."""
    return rows.withColumn(names, F.filter(names, lambda n: F.contains(F.coalesce(F.col(text), F.lit("")), n)))


def mentions(texts: DataFrame, names: Column) -> DataFrame:
    """``id``, ``start``, ``end``, ``name`` of ``texts(id, text)``: where the ``names`` (an array of the row) stand, long names first, of equals the smallest; what overlaps a place already taken is skipped.

    The longest name takes its places first, which a leftmost match doesn't do: names are replaced one after
    another by a mark of their own length, so no place is taken twice.
    """
    order = F.array_sort(F.transform(F.array_distinct(F.filter(names, lambda n: F.length(n) > 0)), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("name"))))
    start = F.struct(F.col("text").alias("left"), F.array().cast("array<struct<start:int,end:int,name:string>>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        parts = F.split(acc["left"], F.concat(F.lit("\\Q"), n["name"], F.lit("\\E")), -1)

        def placed(p: Column) -> Column:
            lengths = F.transform(p, lambda x: F.length(x))
            upto = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x) + (i - 1) * F.length(n["name"])
            places = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(upto(i).alias("start"), (upto(i) + F.length(n["name"])).alias("end"), n["name"].alias("name")))).otherwise(F.array().cast("array<struct<start:int,end:int,name:string>>"))
            return F.struct(F.replace(acc["left"], n["name"], F.repeat(F.lit("\u0000"), F.length(n["name"]))).alias("left"), F.concat(acc["found"], places).alias("found"))

        return tx.bound(parts, placed)

    found = F.aggregate(order, start, step, lambda acc: acc["found"])
    return texts.where(F.col("text").isNotNull()).select("id", F.inline(found))
