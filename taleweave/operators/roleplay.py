"""What a character's voice is drawn from: samples of its speech, and evidence of several kinds for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import empty_if_null
from .graphs import written
from .ranking import top_k

#: Share of words from which two sayings are one.
ALIKE = 0.8


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(empty_if_null(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))


def alike(a: Column, b: Column, least: float = ALIKE) -> Column:
    """Whether two sets of words share ``least`` of their union; two empty ones are alike."""
    return F.size(F.array_intersect(a, b)) >= least * F.size(F.array_union(a, b))


def like_known(said: DataFrame, known: DataFrame, least: float = ALIKE) -> DataFrame:
    """``key``, ``have``: which sets of ``said(key, words)`` are ``alike`` which of ``known(key, words)``; keys stand for sets, both sides hold each once.

    Sets that share ``least`` of their union share one of the rarest words of either: of a set of n the first
    n - ceil(least * n) + 1 in the order of rareness. They meet by these, if their sizes and what can still follow
    allow it; only such pairs fetch their words and are compared.
    """
    counts = known.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def head(sets: DataFrame) -> DataFrame:
        # a word that no card has is the rarest, and meets nothing
        each = sets.select("key", F.size("words").alias("n"), F.explode("words").alias("w")).join(counts, "w", "left").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("ws"))
        most = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
        return each.select("key", "n", F.posexplode(F.slice("ws", F.lit(1), most)).alias("p", "x")).where("x.df > 0").select("key", "n", "p", "x.w")

    x, y = head(said), head(known).select(F.col("key").alias("have"), F.col("n").alias("m"), F.col("p").alias("q"), "w")
    sized = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)
    follow = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9
    pairs = x.join(y, "w").where(sized & follow).select("key", "have").distinct()
    met = pairs.join(said, "key").join(known.select(F.col("key").alias("have"), F.col("words").alias("held")), "have").where(alike(F.col("held"), F.col("words"), least)).select("key", "have")
    none = F.size("words") == 0
    return met.unionByName(said.where(none).select("key").join(known.where(none).select(F.col("key").alias("have")), how="cross"))


def style_samples(asked: DataFrame, hits: DataFrame, turns: DataFrame, known: DataFrame, *, k: int = 3, few: int = 2, least: float = ALIKE) -> DataFrame:
    """``query_id``, ``rank``, ``block``, ``pos``, ``speaker``, ``content``, ``relaxed``: what the character of each question says in the blocks it found, that the character's card lacks.

    ``asked(query_id, character)``, ``hits(query_id, rank, block)``, ``turns(block, pos, speaker, content)``, ``known(character,
    samples)`` with the sayings a card has. A saying like one of the card's is left out, of equal sets of words the first
    stays. Where a question has fewer than ``few`` sayings of its character, those of all speakers follow them
    (``relaxed``); where it has enough, they don't. One plan for all questions; each set of words is compared with a
    card once for each character, not for each question.
    """
    # a set of words goes by its hash, and texts stay behind until the few that are shown are known
    key = F.sha2(F.array_join("words", " "), 256).alias("key")
    spoken = turns.where(F.trim(empty_if_null(F.col("content"))) != "").select("block", "pos", "speaker", "content", F.array_sort(word_set(F.col("content"))).alias("words"))
    said = written(spoken.select("*", key, F.monotonically_increasing_id().alias("row")), "said")
    cards = known.select("character", F.explode("samples").alias("sample")).select("character", F.array_sort(word_set(F.col("sample"))).alias("words")).join(asked.select("character").distinct(), "character", "left_semi")
    cards = written(cards.select("character", "words", key).distinct(), "cards")
    sets = lambda rows: rows.groupBy("key").agg(F.first("words").alias("words"))
    stale = like_known(sets(said), sets(cards), least).join(cards.select("character", F.col("key").alias("have")), "have").select("character", "key").distinct()
    found = hits.withColumnRenamed("rank", "place").join(said.select("block", "pos", "speaker", "key", "row"), "block").join(asked, "query_id")
    fresh = found.join(stale, ["character", "key"], "left_anti")
    own = (F.col("speaker") == F.col("character")).cast("int")
    first = fresh.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("own"), "place", "block", "pos"))).where("n = 1")
    counted = first.withColumn("enough", F.sum("own").over(Window.partitionBy("query_id")) >= few).where("own = 1 OR NOT enough")
    top = top_k(counted, ["query_id"], [F.desc("own"), F.col("place"), F.col("block"), F.col("pos")], k)
    return top.select("query_id", "rank", "row", (F.col("own") == 0).alias("relaxed")).join(said, "row").select("query_id", "rank", "block", "pos", "speaker", "content", "relaxed")


def evidence(asked: DataFrame, kinds: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """``query_id``, ``kind``, ``rank``, ``id``, ``text`` for each of ``asked(query_id, ...)``: of every kind of evidence its first few, what an earlier kind has shown left out.

    ``kinds`` maps a name to its hits ``(query_id, place, id, text)`` and how many of them are kept, in the order in
    which kinds count: facts and what they refer to, relations, narration around hits.
    """
    out = None
    for n, (kind, (rows, most)) in enumerate(kinds.items()):
        part = rows.select("query_id", F.lit(n).alias("k"), F.lit(kind).alias("kind"), F.lit(most).alias("most"), "place", "id", "text")
        out = part if out is None else out.unionByName(part)
    mine = out.where(empty_if_null(F.col("text")) != "").join(asked.select("query_id").distinct(), "query_id", "left_semi")
    once = mine.withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("k", "place"))).where("seen = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "k").orderBy("place", "id"))).where("rank <= most")
    return ranked.select("query_id", "kind", "rank", "id", "text")


def relation_hits(asked: DataFrame, relations: DataFrame) -> DataFrame:
    """``query_id``, ``place``, ``id``, ``text``: of ``relations(id, source, target, text, doc_id, chapter_order)`` the latest of the question's ``character`` with each counterpart, the latest first."""
    sides = relations.select("id", F.col("source").alias("character"), F.col("target").alias("other"), "text", "doc_id", "chapter_order").unionByName(relations.select("id", F.col("target").alias("character"), F.col("source").alias("other"), "text", "doc_id", "chapter_order")).where("character <> other")
    newest = [F.desc("doc_id"), F.desc("chapter_order"), F.desc("id")]
    # the latest of each pair, before any question meets it
    last = sides.withColumn("r", F.row_number().over(Window.partitionBy("character", "other").orderBy(*newest))).where("r = 1")
    met = asked.select("query_id", "character").join(last, "character")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*newest))).select("query_id", "place", "id", "text")
