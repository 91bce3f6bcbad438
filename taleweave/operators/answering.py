"""Answers to a batch of questions: what each is about, where it looks, what it finds, and the text around that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as it
from ..functions import names as nm
from ..functions import text as tx
from . import asking, keyword, ranking, scope
from .graphs import written

#: Channels in the order of the intents' weights.
CHANNELS = ("narrative", "dialogue", "qa", "character")
# Words that ask for the early or the late part of a story, and the shares of it that they mean.
EARLIER = ("前期", "早期", "最初", "一开始", "刚开始", "起初", "初遇", "刚认识", "早先", "开头", "一开始认识")
LATER = ("后期", "后来", "最终", "最后", "最新", "现在", "之后", "近期", "如今", "结尾", "结局", "末尾")
EARLY_SHARE, LATE_SHARE = 0.3, 0.7
#: The same in English.
EARLIER_EN, LATER_EN = r"(?i)\bearlier\b", r"(?i)\blater\b"
#: Characters of a neighbourhood, and the least rest for which a last piece is cut.
MOST_CHARS, LEAST_REST = 3500, 80


def plan_questions(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``queries(query_id, query[, rewrites])`` with ``entities``, ``series`` (null: any), ``intent``, ``weights``, ``period`` (earlier, later or null) and ``variants``.

    Variants are the question, its rewrites, and the names of its entities alone, which a keyword search would
    not reach behind a question's first terms; blank and repeated ones go.
    """
    none = F.array().cast("array<string>")
    rewrites = F.coalesce(F.col("rewrites"), none) if "rewrites" in queries.columns else none
    asked = queries.select("query_id", tx.empty_if_null(F.col("query")).alias("query"), rewrites.alias("rewrites"))
    about = asking.resolve_entities(asked.select("query_id", "query"), aliases).select("query_id", "entities", "series")
    full = asked.join(about, "query_id", "left").withColumn("entities", F.coalesce("entities", none))
    words = F.concat(F.array("query"), "rewrites", F.array(F.array_join("entities", " ")))
    early, late = F.col("query").rlike("|".join((*EARLIER, EARLIER_EN))), F.col("query").rlike("|".join((*LATER, LATER_EN)))
    period = F.when(early, "earlier").when(late, "later")
    planned = full.withColumns({"route": it.intent(F.col("query")), "period": period, "variants": F.array_distinct(F.filter(words, lambda v: F.trim(v) != ""))})
    return planned.select("query_id", "query", "entities", "series", "period", "variants", "route.intent", "route.weights")


def levels() -> list[Column]:
    """Conditions on a block (``names``, ``block_series``) for a question (``entities``, ``series``), each wider than the one before.

    Its names exactly; a name that holds a part of one of them; no names, but only for a question with a series:
    without one nothing would limit the search.
    """
    inside = F.col("series").isNull() | (F.col("series") == F.col("block_series"))
    exact = (F.size("entities") == 0) | F.coalesce(F.arrays_overlap("entities", "names"), F.lit(False))
    partly = F.exists(nm.relaxed_names(F.col("entities")), lambda part: F.exists("names", lambda n: F.contains(n, part)))
    return [inside & exact, inside & partly, inside & F.col("series").isNotNull()]


def search(planned: DataFrame, blocks: DataFrame, k: int, wide: int = 6) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``level``, ``n_lists``: the ``k * wide`` best of ``blocks(id, text, channel, series, names, ...)`` for each of ``plan_questions``.

    Each variant searches each channel that its intent weighs; of the hits those of the strictest of ``levels`` count
    that any variant of the question reaches. Lists of channels are fused by rank to one a variant, those to one a
    question. One search serves all of it. Each list is cut within its level before levels are compared, so that
    only ``k * wide`` rows a list and level meet in a window of a question.
    """
    most = k * wide
    each = planned.select("query_id", F.posexplode("variants").alias("variant", "query"))
    found = keyword.scores(blocks.select("id", "text"), each.select(F.struct("query_id", "variant").alias("query_id"), "query"))
    hits = found.select("query_id.*", "id", "score").where("score > 0")
    at = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel")).cast("int")
    places = blocks.select("id", at.alias("at"), F.col("series").alias("block_series"), F.coalesce("names", F.array().cast("array<string>")).alias("names")).where("at > 0")
    met = hits.join(places, "id").join(planned.select("query_id", "entities", "series", "weights"), "query_id").where(F.get("weights", F.col("at") - 1) > 0)
    level = F.lit(None).cast("int")
    for n, holds in reversed(list(enumerate(levels()))):
        level = F.when(holds, n).otherwise(level)
    lists = ["query_id", "variant", "at", "level"]
    cut = ranking.top_k(met.select("query_id", "variant", "at", "id", "score", level.alias("level")).where("level IS NOT NULL"), lists, [F.desc("score"), F.col("id")], most)
    least = cut.withColumn("least", F.min("level").over(Window.partitionBy("query_id"))).where("level = least")
    channels = least.select(F.struct("query_id", "variant", "level").alias("query_id"), "id", "rank", F.col("at").alias("list_no"), F.lit(None).cast("double").alias("similarity"))
    by_variant = ranking.fuse_ranked(channels, most).select("query_id.query_id", "query_id.variant", "query_id.level", "id", "rank", "similarity")
    fused = ranking.fuse_ranked(by_variant.select(F.struct("query_id", "level").alias("query_id"), "id", "rank", F.col("variant").alias("list_no"), "similarity"), most)
    return fused.select("query_id.query_id", "rank", "id", "query_id.level", "n_lists")


def in_period(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """``hits(period, series, channel, chapter_order, ...)`` without the relations of the other part of the story.

    Only blocks of the channel ``character`` and questions with a series are limited; such a block without an order
    goes. The parts end and begin at shares of the orders of the series' relations in ``blocks``.
    """
    orders = blocks.where((F.col("channel") == "character") & F.col("series").isNotNull()).select("series", "chapter_order")
    bounds = [scope.order_threshold(orders, ["series"], "chapter_order", share).withColumn("period", F.lit(name)) for name, share in (("earlier", EARLY_SHARE), ("later", LATE_SHARE))]
    limited = hits.join(bounds[0].unionByName(bounds[1]), ["series", "period"], "left")
    within = F.when(F.col("period") == "earlier", F.col("chapter_order") <= F.col("threshold")).otherwise(F.col("chapter_order") >= F.col("threshold"))
    return limited.where(F.col("threshold").isNull() | (F.col("channel") != "character") | F.coalesce(within, F.lit(False))).drop("threshold")


def answer(queries: DataFrame, blocks: DataFrame, aliases: DataFrame, k: int, wide: int = 6) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``, ``level``, ``intent``, ``channel``: the ``k`` best blocks of every question.

    ``queries(query_id, query[, rewrites])``, ``blocks(id, text, channel, series, names, chapter_order)`` with ``channel`` of
    ``CHANNELS``, ``aliases(alias, canonical, kind, series)``. Entities, scope, intent and variants of a question, the
    search, the period it asks for, and the order by shared words. Texts are fetched for ``k * wide`` hits a question
    only. Questions that find nothing have no row; blocks without text are no hits.
    """
    # written once: a table's size is known, so that the terms asked for are broadcast where they are few and n-grams nobody asks for aren't shuffled
    planned = written(plan_questions(queries, aliases), "questions")
    found = search(planned, blocks, k, wide)
    details = planned.select("query_id", "query", "series", "period", "intent")
    full = found.join(blocks.select("id", "channel", "chapter_order", tx.empty_if_null(F.col("text")).alias("text")), "id").join(details, "query_id")
    return ranking.rerank(in_period(full, blocks), k).select("query_id", "rank", "id", "score", "level", "intent", "channel")


def contexts(hits: DataFrame, parents: DataFrame, radius: int = 1, most: int = MOST_CHARS) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``chapter_idx``, ``idx``, ``text``: what stands around each of ``hits(query_id, rank, doc_id, chapter_idx, idx)``.

    A hit that stands within ``radius`` of an earlier one of its question that is kept, in the same chapter, is covered by
    it and goes. The texts of ``parents(doc_id, chapter_idx, idx, text)`` within ``radius`` follow each other, trimmed,
    blank ones left out (where all are blank, the hit has no row), up to ``most`` characters; the first that doesn't fit is cut if over ``LEAST_REST`` are left.
    A question's hits are folded in one row: they are the few that a search keeps.
    """
    place = ["doc_id", "chapter_idx", "idx"]
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *place))).alias("all"))
    near = lambda a, b: (a["doc_id"] == b["doc_id"]) & (a["chapter_idx"] == b["chapter_idx"]) & (F.abs(a["idx"] - b["idx"]) <= radius)
    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda acc, h: F.when(F.exists(acc, lambda o: near(o, h)), acc).otherwise(F.concat(acc, F.array(h))))
    centres = listed.select("query_id", F.inline(kept))
    around = centres.select("query_id", "rank", "doc_id", "chapter_idx", F.col("idx").alias("centre"), F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"))
    texts = parents.select(*place, F.trim(tx.empty_if_null(F.col("text"))).alias("text")).where("text <> ''")
    key = ["query_id", "rank", "doc_id", "chapter_idx"]
    before = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    met = around.join(texts, place).withColumn("used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    # the first piece is whole; after one that doesn't fit, all that came before is over the bound, so nothing follows it
    rest = F.lit(most) - F.col("used")
    piece = F.when((F.col("used") == 0) | (F.length("text") <= rest), F.col("text")).when(rest > LEAST_REST, F.concat(F.left("text", rest.cast("int")), F.lit("…")))
    pieces = met.withColumn("piece", piece).where("piece IS NOT NULL")
    return pieces.groupBy(*key, F.col("centre").alias("idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "piece"))), lambda x: x["piece"]), "\n").alias("text"))
