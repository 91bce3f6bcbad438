"""Characters: whom a speaker name means, how entries of a cast merge, what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import strip_honorific
from . import entities, graphs


def resolve_speakers(speakers: DataFrame, cast: DataFrame) -> DataFrame:
    """``speakers(speaker)`` with ``name`` of ``cast(name)`` and ``step``: 0 equal, 1 one inside the other, 2 one edit, 3 two edits; null if none fits.

    Of the names of the first step that has one, the nearest in edits, then the longest, then the smallest.
    """
    asked, known = speakers.select("speaker").where(F.length("speaker") > 0).distinct(), cast.select("name").where(F.length("name") > 0).distinct()
    equal = asked.join(known, F.col("speaker") == F.col("name")).select("speaker", "name", F.lit(0).alias("step"))
    outer = entities.contained(asked.select(F.col("speaker").alias("id"), F.col("speaker").alias("text")), known).select(F.col("id").alias("speaker"), "name")
    inner = entities.contained(known.select(F.col("name").alias("id"), F.col("name").alias("text")), asked.select(F.col("speaker").alias("name"))).select(F.col("name").alias("speaker"), F.col("id").alias("name"))
    both = outer.unionByName(inner).where("speaker <> name").withColumn("step", F.lit(1))
    # only pairs of one speaker and one name count
    near = entities.near_pairs_exact(asked.select(F.col("speaker").alias("name")).unionByName(known))
    near = near.select(F.col("a").alias("speaker"), F.col("b").alias("name"), "edits").unionByName(near.select(F.col("b").alias("speaker"), F.col("a").alias("name"), "edits"))
    near = near.join(asked, "speaker", "left_semi").join(known, "name", "left_semi").select("speaker", "name", (F.col("edits") + 1).cast("int").alias("step"))
    found = equal.unionByName(both).unionByName(near)
    order = F.struct("step", F.levenshtein("speaker", "name").alias("edits"), (-F.length("name")).alias("l"), "name")
    best = found.groupBy("speaker").agg(F.min(order).alias("b")).select("speaker", "b.name", "b.step")
    return speakers.join(best, "speaker", "left")


def split_clusters(members: DataFrame, meetings: DataFrame) -> DataFrame:
    """``cluster``, ``name``, ``kept``: of ``members(cluster, name)`` a cluster two of whose names meet each other (``meetings(a, b)``) names several persons; then each name is a cluster of its own."""
    sides = members.toDF("cluster", "a").join(meetings.select("a", "b"), "a").join(members.toDF("cluster", "b"), ["cluster", "b"])
    broken = sides.where("a <> b").select("cluster").distinct().withColumn("broken", F.lit(True))
    return members.join(broken, "cluster", "left").select("cluster", "name", F.col("broken").isNull().alias("kept"))


def canonical_names(members: DataFrame) -> DataFrame:
    """``cluster``, ``canonical``, ``aliases`` (sorted, without it) of ``members(cluster, name, mentions)``: the name without an honorific, then the longest, the most mentioned, the smallest."""
    order = F.struct((strip_honorific(F.col("name")) != F.col("name")).alias("h"), (-F.length("name")).alias("l"), (-F.col("mentions")).alias("m"), "name")
    found = members.groupBy("cluster").agg(F.min(order).alias("best"), F.array_sort(F.collect_set("name")).alias("names"))
    return found.select("cluster", F.col("best.name").alias("canonical"), F.array_remove("names", F.col("best.name")).alias("aliases"))


def merge_collisions(cast: DataFrame) -> DataFrame:
    """``name``, ``host``: of ``cast(name, mentions, aliases)`` entries that list each other's names as aliases fall together; the most mentioned, then the longest name hosts."""
    links = cast.select("name", F.explode("aliases").alias("alias")).join(cast.select(F.col("name").alias("alias")), "alias").where("name <> alias").select(F.least("name", "alias").alias("a"), F.greatest("name", "alias").alias("b")).distinct()
    of = graphs.connected(links).select(F.col("node").alias("name"), "root")
    rooted = cast.join(of, "name", "left").withColumn("root", F.coalesce("root", F.col("name")))
    host = rooted.groupBy("root").agg(F.min(F.struct((-F.col("mentions")).alias("m"), (-F.length("name")).alias("l"), "name")).alias("b")).select("root", F.col("b.name").alias("host"))
    return rooted.join(host, "root").select("name", "host")


def merged_cast(cast: DataFrame, hosts: DataFrame) -> DataFrame:
    """``name``, ``mentions``, ``dialogues``, ``aliases``, ``n_merged``: entries of ``cast`` under their ``hosts(name, host)``: mentions add up, the largest dialogue count stays, names merged become aliases."""
    rows = cast.join(hosts, "name", "left").withColumn("host", F.coalesce("host", F.col("name")))
    other = F.when(F.col("host") != F.col("name"), F.array("name")).otherwise(F.array().cast("array<string>"))
    flat = F.flatten(F.collect_list(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), other)))
    found = rows.groupBy("host").agg(F.sum("mentions").alias("mentions"), F.max("dialogues").alias("dialogues"), F.array_sort(F.array_distinct(flat)).alias("aliases"), F.count("*").alias("n_merged"))
    return found.select(F.col("host").alias("name"), "mentions", "dialogues", F.array_remove("aliases", F.col("host")).alias("aliases"), "n_merged")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """``before``, ``after``: names that changed between ``old`` and ``new(character_id, pos, name)``, by id, else by place for rows whose id is on one side only."""
    a, b = old.toDF("character_id", "ap", "before"), new.toDF("character_id", "bp", "after")
    by_id = a.join(b, "character_id").where("before <> after").select("before", "after")
    left, right = a.join(b, "character_id", "left_anti"), b.join(a, "character_id", "left_anti")
    return by_id.unionByName(left.join(right, left["ap"] == right["bp"]).where("before <> after").select("before", "after")).distinct()


def merge_violations(groups: DataFrame) -> DataFrame:
    """``rule``, ``key``, ``n`` for ``groups(group, canonical, variant)``: E1 a variant in several groups, E2 a canonical name of several groups, E3 a group of fewer than two variants."""
    rule = lambda name, by, of, bad: groups.groupBy(F.col(by).alias("key")).agg(F.countDistinct(of).alias("n")).where(bad).select(F.lit(name).alias("rule"), F.col("key").cast("string").alias("key"), "n")
    return rule("E1", "variant", "group", "n > 1").unionByName(rule("E2", "canonical", "group", "n > 1")).unionByName(rule("E3", "group", "variant", "n < 2"))


def simple_graph(relations: DataFrame) -> DataFrame:
    """``a``, ``b``, ``weight`` (records), and ``relation_type`` and ``polarity`` of the surest record of ``relations`` (of equals the first)."""
    r = relations.where("source <> target").withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    best = F.max_by(F.struct("relation_type", "polarity"), F.struct("confidence", (-F.col("pos")).alias("p")))
    return r.groupBy("a", "b").agg(F.count("*").alias("weight"), best.alias("best")).select("a", "b", "weight", "best.*")


def merged_relations(relations: DataFrame, most: int = 8) -> DataFrame:
    """``a``, ``b``, ``n``, ``label`` (the first that isn't empty), ``first_chapter``, ``evidence`` (the first ``most`` different ones) of extracted ``relations(source, target, label, chapter, evidence, pos)``."""
    r = relations.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    pairs = r.groupBy("a", "b").agg(F.count("*").alias("n"), F.min_by("label", F.when(F.col("label") != "", F.col("pos"))).alias("label"), F.min("chapter").alias("first_chapter"))
    each = r.groupBy("a", "b", "evidence").agg(F.min("pos").alias("pos"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy("pos"))).where(F.col("k") <= most)
    held = first.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    return pairs.join(held, ["a", "b"])


def reduced_claims(claims: DataFrame, least: float) -> DataFrame:
    """``doc``, ``kept``, ``repeated``, ``unsure``, ``chapters``: how many of ``claims(doc, chapter, summary, confidence, pos)`` stay: those of ``least`` confidence, one for each document, chapter and first 40 characters of the summary."""
    sure = F.coalesce(F.col("confidence"), F.lit(0.0)) >= least
    keys = claims.withColumn("key", F.left("summary", F.lit(40))).groupBy("doc", "chapter", "key").agg(F.count_if(sure).alias("sure"), F.count("*").alias("all"))
    return keys.groupBy("doc").agg(F.count_if(F.col("sure") > 0).alias("kept"), F.sum(F.greatest(F.col("sure") - 1, F.lit(0))).alias("repeated"), F.sum(F.col("all") - F.col("sure")).alias("unsure"), F.countDistinct(F.when(F.col("sure") > 0, F.col("chapter"))).alias("chapters"))


def style_tags(turns: DataFrame, by: list[str], text: str) -> DataFrame:
    """``by``, ``avg_length``, ``tags``: how a speaker speaks: short or long lines, many questions, many exclamations."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda marks: F.avg(F.regexp_like(t, F.lit(marks)).cast("int"))
    found = turns.groupBy(*by).agg(F.avg(F.length(t)).alias("avg_length"), share("[?？]").alias("asks"), share("[!！]").alias("calls"))
    tags = F.array_compact(F.array(F.when(F.col("avg_length") <= 20, "short"), F.when(F.col("avg_length") >= 120, "long"), F.when(F.col("asks") >= 0.3, "asking"), F.when(F.col("calls") >= 0.3, "calling")))
    return found.select(*by, F.round("avg_length", 4).alias("avg_length"), tags.alias("tags"))


def harvest(texts: DataFrame, pattern: str, by: str, id: str, k: int) -> DataFrame:
    """``by``, ``rank``, ``name``, ``n``: the ``k`` most frequent matches of a name pattern, of equals that of the smallest row."""
    each = texts.select(by, id, F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern), F.lit(1))).alias("name"))
    counts = each.groupBy(by, "name").agg(F.count("*").alias("n"), F.min(id).alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first", "name"))).where(F.col("rank") <= k).select(by, "rank", "name", "n")


def community_events(members: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """``community``, ``rank``, ``event``, ``n_members``: the ``most`` events that most of a community's ``members(community, node)`` take part in (``events(event, node)``), of equals the smallest."""
    n = members.join(events.select("event", "node").distinct(), "node").groupBy("community", "event").agg(F.count("*").alias("n_members"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n_members"), "event"))).where(F.col("rank") <= most)


def community_summary(members: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``community``, ``size``, ``summary``: members in order and the ``most`` strongest of ``edges(a, b, weight)`` inside."""
    inside = edges.join(members.toDF("community", "a"), "a").join(members.toDF("community", "b"), ["community", "b"])
    top = inside.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "a", "b"))).where(F.col("k") <= most)
    said = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "a", "b", "weight"))), lambda e: F.format_string("%s-%s(%d)", e["a"].cast("string"), e["b"].cast("string"), e["weight"])), "; ").alias("links"))
    cast = members.groupBy("community").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ", ").alias("names"))
    return cast.join(said, "community", "left").select("community", "size", F.concat_ws(" | ", "names", "links").alias("summary"))


def stale(rows: DataFrame, known: DataFrame, by: str, id: str, text: str) -> DataFrame:
    """``by``, ``fingerprint``, ``stale``: groups whose rows changed since ``known(by, fingerprint)``: the fingerprint is of the rows' own ones, in order."""
    own = rows.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(id).alias("i"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("m")))), lambda x: x["m"]), ","), 256).alias("fingerprint"))
    return own.join(known.withColumnRenamed("fingerprint", "__f"), by, "left").select(by, "fingerprint", (~F.col("fingerprint").eqNullSafe(F.col("__f"))).alias("stale"))


def enriched(hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``hits(query_id, rank, node)`` with ``context``: the ``k`` strongest neighbours of the hit's character, pairs that an earlier hit of the query has shown left out."""
    near = graphs.neighbours(edges, k).select("node", F.col("rank").alias("place"), "other", "weight")
    both = hits.join(near, "node").withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")})
    once = both.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy("rank", "place"))).where("seen = 1")
    listed = once.groupBy("query_id", "rank", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other", "weight"))), lambda x: F.format_string("%s:%d", x["other"].cast("string"), x["weight"])).alias("c"))
    return hits.join(listed, ["query_id", "rank", "node"], "left").select(*hits.columns, F.array_join(F.coalesce("c", F.array().cast("array<string>")), ", ").alias("context"))


def evidence(texts: DataFrame, names: Column, before: int = 40, after: int = 80) -> DataFrame:
    """``id``, ``start``, ``snippet`` of ``texts(id, text)``: what stands around the first place of any of the ``names``."""
    at = F.array_min(F.transform(names, lambda n: F.nullif(F.position(n, F.col("text")), F.lit(0))))
    found = texts.withColumn("__at", at).where(F.col("__at").isNotNull())
    start = F.greatest(F.col("__at") - before, F.lit(1))
    return found.select("id", (F.col("__at") - 1).cast("int").alias("start"), F.substring(F.col("text"), start, F.col("__at") + after - start).alias("snippet"))


def roster(turns: DataFrame, block: str, speaker: str, most: int = 20) -> DataFrame:
    """``speaker``, ``dialogue_count``, ``n_chapters``, ``co_occurrence`` (the ``most`` speakers it shares most blocks with, as ``name=n``)."""
    n = turns.groupBy(speaker).agg(F.count("*").alias("dialogue_count"), F.countDistinct(block).alias("n_chapters"))
    # speakers of one block meet in its own set, which one chapter's cast bounds
    sets = turns.groupBy(block).agg(F.collect_set(speaker).alias("cast"))
    pairs = sets.select("cast", F.explode("cast").alias(speaker)).select(speaker, F.explode(F.filter("cast", lambda x: x != F.col(speaker))).alias("other")).groupBy(speaker, "other").agg(F.count("*").alias("n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "other"))), 1, most)
    top = pairs.groupBy(speaker).agg(F.array_join(F.transform(first, lambda x: F.concat(x["other"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("co_occurrence"))
    return n.join(top, speaker, "left")


def quota_complete(turns: DataFrame, by: str, speaker: str, chapter: Column, chapters: int, main: Column, target: int, least: int, share: float = 0.3) -> DataFrame:
    """``by``, ``satisfied``: whether main speakers have ``target`` turns in a ``share`` of the ``chapters`` (one at least), and all others ``least`` turns."""
    a = turns.groupBy(by, speaker).agg(F.count("*").alias("n"), F.countDistinct(chapter).alias("c"))
    enough = F.when(main, (F.col("n") >= target) & (F.col("c") >= max(1, int(chapters * share)))).otherwise(F.col("n") >= least)
    return a.groupBy(by).agg(F.bool_and(enough).alias("satisfied"))
