"""What is known of each character: counts that merge under canonical names, and cards made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_noise_name
from . import entities, graphs, inventory
from .ranking import top_k


def counters(turns: DataFrame, sentences: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name``, ``counter``, ``key``, ``n``: every count of every character, as one row, so that parts of them add up.

    ``turns(block, pos, speaker, content, mood)`` and ``sentences(id, text)``; ``aliases(alias, canonical)``. Counters:
    ``appearance`` (turns, and sentences that hold a name of it, once for each of its names) and ``dialogue`` without a
    key, ``mood`` by mood, ``with`` by the other character: blocks both speak in, and sentences that name both. What a
    character shares with itself under two names doesn't count.
    """
    said = turns.where(F.coalesce("speaker", F.lit("")) != "")
    names = said.select(F.col("speaker").alias("name")).distinct()
    named = inventory.present(sentences, names)
    spoken = said.groupBy("speaker").agg(F.count("*").alias("n")).select(F.col("speaker").alias("raw"), "n")
    row = lambda counter: (F.lit(counter).alias("counter"), F.lit("").alias("key"), "n")
    seen = named.groupBy("name").agg(F.count("*").alias("n")).select(F.col("name").alias("raw"), "n")
    moods = said.where(F.coalesce("mood", F.lit("")) != "").groupBy("speaker", "mood").agg(F.count("*").alias("n")).select(F.col("speaker").alias("raw"), F.lit("mood").alias("counter"), F.col("mood").alias("key"), "n")
    met = graphs.shared_groups(said.select("block", "speaker"), "block", "speaker").unionByName(graphs.shared_groups(named.withColumnRenamed("name", "speaker"), "id", "speaker"))
    both = graphs.symmetric(met, ["n_shared"]).select(F.col("node").alias("raw"), F.lit("with").alias("counter"), F.col("other").alias("key"), F.col("n_shared").alias("n"))
    each = spoken.select("raw", *row("appearance")).unionByName(spoken.select("raw", *row("dialogue"))).unionByName(seen.select("raw", *row("appearance"))).unionByName(moods).unionByName(both)
    one = entities.canonical(each, "raw", aliases).withColumnRenamed("canonical", "name")
    other = aliases.select(F.col("alias").alias("key"), F.col("canonical").alias("to"))
    mapped = one.join(other, "key", "left").withColumn("key", F.when(F.col("counter") == "with", F.coalesce("to", "key")).otherwise(F.col("key")))
    return mapped.where((F.col("counter") != "with") | (F.col("key") != F.col("name"))).groupBy("name", "counter", "key").agg(F.sum("n").alias("n"))


def statistics(counts: DataFrame, least: int = 3, spoken: int = 2, most: int = 8) -> DataFrame:
    """``name``, ``appearance``, ``dialogue``, ``moods`` and ``company`` (``key=n``, most first, ``most`` at most) of the characters of ``counters`` with ``least`` appearances or ``spoken`` turns whose name isn't noise."""
    total = lambda counter: F.coalesce(F.sum(F.when(F.col("counter") == counter, F.col("n"))), F.lit(0)).cast("long").alias(counter)
    sums = counts.groupBy("name").agg(total("appearance"), total("dialogue"))
    ranked = top_k(counts.where("counter IN ('mood', 'with')"), ["name", "counter"], [F.desc("n"), F.col("key")], most)
    listed = ranked.groupBy("name", "counter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "n"))), lambda x: F.concat(x["key"], F.lit("="), x["n"].cast("string"))), ",").alias("l"))
    of = lambda counter, out: listed.where(F.col("counter") == counter).select("name", F.col("l").alias(out))
    kept = sums.where(((F.col("appearance") >= least) | (F.col("dialogue") >= spoken)) & ~is_noise_name(F.col("name")))
    return kept.join(of("mood", "moods"), "name", "left").join(of("with", "company"), "name", "left").fillna("", ["moods", "company"])


def cards(stats: DataFrame, turns: DataFrame, sentences: DataFrame, aliases: DataFrame, samples: int = 3, snippets: int = 2) -> DataFrame:
    """``stats`` with ``aliases`` (sorted), ``samples`` (the first different things a character says), ``snippets`` (the first different sentences that name it) and ``card``, all of it as one text."""
    known = stats.select("name")
    said = entities.canonical(turns.where(F.coalesce("speaker", F.lit("")) != "").select("speaker", "content", "block", "pos"), "speaker", aliases).select(F.col("canonical").alias("name"), "content", F.struct("block", "pos").alias("at"), "speaker")
    raw = said.select("speaker").distinct().select(F.col("speaker").alias("name"))
    named = entities.canonical(inventory.present(sentences, raw), "name", aliases).select("id", F.col("canonical").alias("who")).distinct()
    told = named.join(sentences, "id").select(F.col("who").alias("name"), F.col("text").alias("content"), F.col("id").alias("at"))

    def first(rows: DataFrame, k: int, out: str) -> DataFrame:
        different = rows.join(known, "name", "left_semi").where(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy("name", "content").agg(F.min("at").alias("at"))
        top = top_k(different, ["name"], [F.col("at"), F.col("content")], k)
        return top.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias(out))

    called = said.where("speaker <> name").groupBy("name").agg(F.array_sort(F.collect_set("speaker")).alias("aliases"))
    none = F.array().cast("array<string>")
    full = stats.join(called, "name", "left").join(first(said, samples, "samples"), "name", "left").join(first(told, snippets, "snippets"), "name", "left").withColumns({c: F.coalesce(c, none) for c in ("aliases", "samples", "snippets")})
    part = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    card = F.concat_ws("\n", F.col("name"), part("also", F.array_join("aliases", ", ")), part("moods", F.col("moods")), part("with", F.col("company")), part("says", F.array_join("samples", " / ")), part("told", F.array_join("snippets", " / ")))
    return full.withColumn("card", card)
