"""Who says what stands in quotes: windows over the quotes that lack a speaker, proposals of each window, and one verdict.

``spans(id, start, end, content, hint, confidence)`` are the quotes of a text, ``hint`` a speaker that a rule found
beside the quote, or null. A quote whose hint is sure enough is reliable; all others are put into windows of
``width`` neighbours, a window every ``step`` of them, so that each stands in several. A window ends where the next
quote is more than ``gap`` characters on. It carries what stands before and after it, the reliable speakers nearest to it,
and the candidates: those speakers, hints of its own quotes, and the text's most frequent ones.

Any model can answer a window with proposals ``(id, start, speaker, confidence, source)``; ``proposed`` is the rule that
needs none. ``attributed`` merges proposals: a reliable hint stands, then the surest proposal of a candidate, and what
stays unresolved says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k

ACCEPT, RELIABLE = 0.5, 0.5
#: Characters read beside a window, and kept of its nearest sentences.
REACH, KEPT = 300, 200
SENTENCE = r"(?<=[.!?。！？\n])"


def reliable(least: float = RELIABLE) -> Column:
    return F.col("hint").isNotNull() & (F.col("hint") != "") & (F.coalesce("confidence", F.lit(0.0)) >= least)


def nearest_sentences(part: Column, n: int, before: bool) -> Column:
    """The last (``before``) or first ``n`` sentences of a part of a text, trimmed, of ``KEPT`` characters at most."""
    said = F.filter(F.split(part, SENTENCE, -1), lambda s: F.trim(s) != "")
    if before:
        joined = F.trim(F.array_join(F.slice(said, F.greatest(F.size(said) - n + 1, F.lit(1)), F.lit(n)), ""))
        return F.right(joined, F.lit(KEPT))
    return F.left(F.trim(F.array_join(F.slice(said, 1, n), "")), F.lit(KEPT))


def windows(texts: DataFrame, spans: DataFrame, *, width: int = 2, step: int = 1, gap: int = 400, sentences: int = 2, candidates: int = 12, least: float = RELIABLE) -> DataFrame:
    """``id``, ``window``, ``targets`` (starts of its quotes), ``first``, ``last``, ``before``, ``after``, ``neighbours`` and ``candidates`` of the windows of ``texts(id, text)``."""
    by = Window.partitionBy("id")
    placed = spans.withColumn("sure", reliable(least))
    # reliable quotes are numbered, and every quote knows how many stand before it: neighbours meet by equality
    numbered = placed.withColumn("upto", F.sum(F.col("sure").cast("int")).over(by.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    anchors = numbered.where("sure").select("id", F.col("upto").alias("k"), "hint")
    open_ = numbered.where("NOT sure").withColumn("jump", (F.col("start") - F.lag("end").over(by.orderBy("start")) > gap).cast("int"))
    run = open_.withColumn("run", F.coalesce(F.sum("jump").over(by.orderBy("start")), F.lit(0)))
    ranked = run.withColumn("n", F.row_number().over(Window.partitionBy("id", "run").orderBy("start")) - 1)
    # a quote stands in the windows that begin at most width - 1 before it
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("n") - k), lambda w: (w >= 0) & (w % step == 0))
    inside = ranked.select("*", F.explode(starts).alias("w"))
    member = F.struct("start", "end", "hint", "upto")
    grouped = inside.groupBy("id", "run", "w").agg(F.array_sort(F.collect_list(member)).alias("m"))
    # a window whose quotes all stand in the one before it says nothing new
    grouped = grouped.where((F.col("w") == 0) | (F.size("m") > width - step))
    shaped = grouped.select("id", F.get("m", F.lit(0))["start"].alias("first"), F.get("m", F.size("m") - 1)["end"].alias("last"), F.transform("m", lambda x: x["start"]).alias("targets"), F.transform("m", lambda x: x["hint"]).alias("hints"), F.get("m", F.lit(0))["upto"].alias("k0"), F.get("m", F.size("m") - 1)["upto"].alias("k1"))
    shaped = shaped.withColumn("window", F.row_number().over(by.orderBy("first", "last")))
    asked = shaped.select("id", "window", F.inline(F.array(F.struct((F.col("k0") - 1).alias("k"), F.lit(0).alias("p")), F.struct(F.col("k0").alias("k"), F.lit(1).alias("p")), F.struct((F.col("k1") + 1).alias("k"), F.lit(2).alias("p")))))
    near = asked.join(anchors, ["id", "k"]).groupBy("id", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "hint"))), lambda x: x["hint"]).alias("neighbours"))
    counts = placed.where(F.col("hint").isNotNull() & (F.col("hint") != "")).groupBy("id", "hint").agg(F.count("*").alias("n"), F.min("start").alias("s"))
    common = top_k(counts, ["id"], [F.desc("n"), F.col("s"), F.col("hint")], candidates - 1).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hint"))), lambda x: x["hint"]).alias("common"))
    none = F.array().cast("array<string>")
    named = F.array_distinct(F.concat(F.coalesce("neighbours", none), F.filter("hints", lambda h: h.isNotNull() & (h != "")), F.coalesce("common", none)))
    full = shaped.join(near, ["id", "window"], "left").join(common, "id", "left").select("id", "window", "targets", "first", "last", F.coalesce("neighbours", none).alias("neighbours"), F.slice(named, 1, candidates).alias("candidates"))
    # the windows of a text meet it once, as one array, and are cut out of it there
    listed = full.groupBy("id").agg(F.collect_list(F.struct("window", "targets", "first", "last", "neighbours", "candidates")).alias("ws"))

    def beside(w: Column) -> Column:
        start = F.greatest(w["first"] - REACH, F.lit(0)).cast("int")
        before = nearest_sentences(F.substring(F.col("text"), start + 1, (w["first"] - start).cast("int")), sentences, True)
        after = nearest_sentences(F.substring(F.col("text"), (w["last"] + 1).cast("int"), F.lit(REACH)), sentences, False)
        return F.struct(*(w[c].alias(c) for c in ("window", "targets", "first", "last", "neighbours", "candidates")), before.alias("before"), after.alias("after"))

    return texts.where(F.col("text").isNotNull()).select("id", "text").join(listed, "id").select("id", F.inline(F.transform("ws", beside))).select("id", "window", "targets", "first", "last", "before", "after", "neighbours", "candidates")


def proposed(found: DataFrame) -> DataFrame:
    """``id``, ``start``, ``window``, ``speaker``, ``confidence``, ``source``: for each quote of a window the candidate named last before it (0.6), else first after it (0.55), else the reliable speaker before the last one, as speakers take turns (0.4)."""
    back = lambda c: F.position(F.reverse(c), F.reverse(F.col("before")))
    last = F.array_min(F.transform(F.filter("candidates", lambda c: F.contains(F.col("before"), c)), lambda c: F.struct(back(c).alias("p"), (-F.length(c)).alias("l"), c.alias("c"))))
    named_before = last["c"]
    first = F.array_min(F.transform(F.filter("candidates", lambda c: F.contains(F.col("after"), c)), lambda c: F.struct(F.position(c, F.col("after")).alias("p"), (-F.length(c)).alias("l"), c.alias("c"))))
    turn = F.get("neighbours", F.lit(0))
    hit = F.when(named_before.isNotNull(), F.struct(named_before.alias("speaker"), F.lit(0.6).alias("confidence"), F.lit("before").alias("source"))).when(first.isNotNull(), F.struct(first["c"].alias("speaker"), F.lit(0.55).alias("confidence"), F.lit("after").alias("source"))).when(turn.isNotNull(), F.struct(turn.alias("speaker"), F.lit(0.4).alias("confidence"), F.lit("turn").alias("source")))
    return found.withColumn("hit", hit).where(F.col("hit").isNotNull()).select("id", F.explode("targets").alias("start"), "window", "hit.*")


#: Sources of proposals, the surest kind first.
SOURCES = ("before", "after", "turn")


def attributed(spans: DataFrame, found: DataFrame, proposals: DataFrame, *, accept: float = ACCEPT, least: float = RELIABLE, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """``id``, ``start``, ``end``, ``content``, ``speaker``, ``confidence``, ``source`` and ``reason`` of every quote.

    A reliable hint: ``rule``. Of the proposals that name a candidate of a window of the quote the surest, of equals
    that of the earlier source, then of the earlier window: ``window``, below ``accept`` ``low_confidence``. Else
    ``unresolved``, with the ``reason`` ``no_window`` (none was made of its text), ``no_candidate`` or ``no_proposal``.
    """
    held = found.select("id", F.explode("targets").alias("start"), "window", "candidates")
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    kept = proposals.join(held.select("id", "start", "window", "candidates"), ["id", "start", "window"]).where(F.array_contains("candidates", F.col("speaker")))
    order = F.struct((-F.col("confidence")).alias("c"), F.when(rank > 0, rank).otherwise(99).alias("r"), "window", "speaker")
    best = kept.groupBy("id", "start").agg(F.min_by(F.struct("speaker", "confidence"), order).alias("best"))
    seen = held.groupBy("id", "start").agg(F.max(F.size("candidates")).alias("most"))
    all_ = spans.join(best, ["id", "start"], "left").join(seen, ["id", "start"], "left")
    sure, got = reliable(least), F.col("best").isNotNull()
    return all_.select(
        "id", "start", "end", "content",
        F.when(sure, F.col("hint")).otherwise(F.col("best.speaker")).alias("speaker"),
        F.when(sure, F.col("confidence")).otherwise(F.coalesce("best.confidence", F.lit(0.0))).alias("confidence"),
        F.when(sure, "rule").when(got & (F.col("best.confidence") >= accept), "window").when(got, "low_confidence").otherwise("unresolved").alias("source"),
        F.when(~sure & ~got, F.when(F.col("most").isNull(), "no_window").when(F.col("most") == 0, "no_candidate").otherwise("no_proposal")).alias("reason"),
    )
