"""Stories: chronicles, lore entries, and the tables they are looked up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Eras in their order; fixed values.
ERAS = ("转生前", "转生", "转生后", "建国前", "建国", "建国后", "魔王时期", "大战", "大战后", "结局后", "其他")
ANY_ERA = "其他"


def era_rank(period: Column, eras: tuple[str, ...] = ERAS) -> Column:
    at = F.array_position(F.array(*[F.lit(e) for e in eras]), period)
    return F.when(at > 0, at - 1).otherwise(99)


def chronicle(events: DataFrame, by: str, *, eras: tuple[str, ...] = ERAS, key_types: tuple[str, ...] = ("world", "plot")) -> DataFrame:
    """``events(by, event_id, event_type, year, period, doc_id, chapter_order)`` with ``seq`` and ``key_event``: those with a year first, then by era, then by chapter."""
    tier = F.when(F.col("year").isNotNull(), 0).when(F.coalesce("period", F.lit("")) != "", 1).otherwise(2)
    at = F.when(tier == 0, F.col("year").cast("long")).when(tier == 1, era_rank(F.col("period"), eras)).otherwise(F.lit(0))
    seq = F.row_number().over(Window.partitionBy(by).orderBy(tier, at, "doc_id", "chapter_order", "event_id"))
    return events.withColumns({"seq": seq, "key_event": F.col("event_type").isin(*key_types)})


def seqs_by(chronicle_: DataFrame, by: str, member: Column, name: str) -> DataFrame:
    """``by``, ``name``, ``seqs`` (ascending), ``n``: the places of each member, era or type."""
    listed = chronicle_.select(by, member.alias(name), "seq").where(F.col(name).isNotNull() & (F.col(name) != ""))
    return listed.groupBy(by, name).agg(F.array_sort(F.collect_set("seq")).alias("seqs")).withColumn("n", F.size("seqs"))


def lorebook(chronicle_: DataFrame, by: str, entity: str, least: int = 2, most_entities: int = 40, most_summaries: int = 3) -> DataFrame:
    """One entry for each entity and period with ``least`` events or more: first and last place, and the first different summaries. Of each group the entities with most events."""
    rows = chronicle_.where(F.col(entity).isNotNull())
    totals = rows.groupBy(by, entity).agg(F.count("*").alias("total"))
    top = totals.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), entity))).where(F.col("r") <= most_entities).select(by, entity)
    # the first place of each summary: repeats go before anything is listed
    firsts = rows.join(top, [by, entity]).groupBy(by, entity, "period", "summary").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy(by, entity, "period").orderBy("first")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most_summaries, F.struct("first", "summary")))), lambda x: x["summary"]), "; ")
    return ranked.groupBy(by, entity, "period").agg(F.min("first").alias("seq_from"), F.max("last").alias("seq_to"), F.sum("n").alias("events"), text.alias("content")).where(F.col("events") >= least)


def first_of_keys(keys: DataFrame, order: list, k: int) -> DataFrame:
    """Of ``keys(name, p, entry_id, priority, seq_from)`` the first ``k`` entries of each name, with the first place ``p`` it has there."""
    once = keys.groupBy("name", "entry_id", "priority", "seq_from").agg(F.min("p").alias("p"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("r") <= k).drop("r")


def activated(texts: DataFrame, entries: DataFrame, lengths: list[int] | None = None, k: int = 6) -> DataFrame:
    """``id``, ``rank``, ``entry_id``, ``key`` of ``entries(entry_id, keys, priority, seq_from)`` with a key in ``texts(id, text)``; the first key that is there counts.

    Of the entries that share a key only the first ``k`` meet the texts that hold it: any other has ``k`` before it in
    each of these texts, whatever else they hold.
    """
    from .entities import contained

    entry, first = ["entry_id", "priority", "seq_from"], [F.desc("priority"), "seq_from", "entry_id"]
    keys = entries.select(*entry, F.posexplode("keys").alias("p", "name"))
    met = contained(texts, keys.select("name"), lengths).join(first_of_keys(keys, first, k), "name")
    found = met.groupBy("id", *entry).agg(F.min("p").alias("p"))
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*first))).where(F.col("rank") <= k)
    named = keys.groupBy(*entry, "p").agg(F.min("name").alias("key"))
    return top.join(named, [*entry, "p"]).select("id", "rank", "entry_id", "key")


def time_matches(era: Column, year_from: Column, year_to: Column, asked_era: Column, asked_year: Column) -> Column:
    """Same era (or the entry's is any), else within its years, else unlimited."""
    by_era = F.when((era != "") & (asked_era != ""), (era == asked_era) | (era == ANY_ERA))
    by_year = F.when(asked_year.isNotNull() & (year_from.isNotNull() | year_to.isNotNull()), (F.coalesce(year_from, asked_year) <= asked_year) & (asked_year <= F.coalesce(year_to, asked_year)))
    return F.coalesce(by_era, by_year, F.lit(True))


def relations_of(relations: DataFrame, name: str, most: int) -> DataFrame:
    """The latest record of each counterpart of entities whose name holds ``name``, on either side."""
    mine = F.contains(F.col("source"), F.lit(name))
    both = relations.where(mine | F.contains(F.col("target"), F.lit(name))).withColumn("counterpart", F.when(mine, F.col("target")).otherwise(F.col("source")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("counterpart").orderBy(F.desc("doc_id"), F.desc("chapter_order"), F.desc("pos")))).where("r = 1").drop("r").orderBy(F.desc("chapter_order"), "counterpart").limit(min(max(most, 1), 50))


def expand_neighbours(hits: DataFrame, parents: DataFrame, radius: int) -> DataFrame:
    """``query_id``, ``doc_id``, ``chapter_idx``, ``idx``, ``rank``, ``text``: each hit's parent and those of its chapter within ``radius`` of it; what two hits share stays with the first.

    The band is a join by equality on the exploded offsets, not a range join, and never crosses chapters.
    """
    place = ["doc_id", "chapter_idx", "idx"]
    around = hits.select("query_id", "rank", "doc_id", "chapter_idx", F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"))
    first = around.groupBy("query_id", *place).agg(F.min("rank").alias("rank"))
    return first.join(parents.select(*place, "text"), place).select("query_id", *place, "rank", "text")


def first_references(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id``, ``id``, ``rank``, ``p``: blocks that ``hits(query_id, rank, refs)`` refer to; each once, by the first reference."""
    each = hits.select("query_id", "rank", F.posexplode("refs").alias("p", "id"))
    first = each.groupBy("query_id", "id").agg(F.min(F.struct("rank", "p")).alias("f")).select("query_id", "id", "f.*")
    return first.join(blocks.select("id").distinct(), "id", "left_semi").select("query_id", "id", "rank", "p")
