"""Ordered rows: speakers, quotas, histories, and lists that interleave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_speaker(turns: DataFrame, by: str, order: str, speaker: str, reliable: Column, confidence: float = 0.45) -> DataFrame:
    """``turns`` with ``filled`` (the row's own reliable speaker, else the last one before it) and ``confidence``."""
    before = F.last(F.when(reliable, F.col(speaker)), ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumns({"filled": F.when(reliable, F.col(speaker)).otherwise(before), "confidence": F.when(reliable, 1.0).when(before.isNotNull(), confidence).otherwise(0.0)})


def admit(turns: DataFrame, by: str, order: str, key: str, quota: int, most: int) -> DataFrame:
    """Turns that a quota admits: the first ``quota`` of each key, of those the first ``most`` of all."""
    own = turns.withColumn("of_key", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).where(F.col("of_key") <= quota)
    return own.withColumn("admitted", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("admitted") <= most)


def tiers(entities: DataFrame, mentions: str, chapters: str, name: str, main: int = 5, supporting: int = 20, blacklist: tuple[str, ...] = (), by: list[str] | None = None) -> DataFrame:
    """``entities`` with ``activity`` (mentions and ten times the active chapters) and ``importance``; those on the blacklist are extra and not ranked."""
    out = F.col(name).isin(*blacklist) if blacklist else F.lit(False)
    active = F.col(mentions) + 10 * F.col(chapters)
    # the rank only matters among the first, so Spark may prune: join the few that have one
    scored = entities.withColumn("activity", active)
    place = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("activity"), name))
    top = scored.where(~out).withColumn("place", place).where(F.col("place") <= main + supporting).select(*(by or []), name, "place")
    keys = [*(by or []), name]
    return scored.join(top, keys, "left").withColumn("importance", F.when(F.col("place") <= main, "main").when(F.col("place").isNotNull(), "supporting").otherwise("extra")).drop("place")


def interleaved(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with ``position``: the thirds of each group, dealt in turn (head, middle, tail)."""
    w = Window.partitionBy(by)
    place = F.row_number().over(w.orderBy(order)) - 1
    third = F.when(F.col("__i") < F.col("__n") / 3, 0).when(F.col("__i") < 2 * F.col("__n") / 3, 1).otherwise(2)
    dealt = rows.withColumns({"__i": place, "__n": F.count("*").over(w)}).withColumn("__third", third).withColumn("__turn", F.row_number().over(Window.partitionBy(by, "__third").orderBy("__i")))
    return dealt.withColumn("position", F.row_number().over(w.orderBy("__turn", "__third")) - 1).drop("__i", "__n", "__third", "__turn")


def newest(rows: DataFrame, by: str, order: str, role: str, text: str, keep: int, most_tokens: float, least: int = 4, tokens_per_char: float = 0.25) -> DataFrame:
    """The system row of each group, and its newest rows: at most ``keep``, and as many as stay under ``most_tokens`` (estimated), ``least`` rows at least."""
    system = F.col(role) == "system"
    back = Window.partitionBy(by, system).orderBy(F.desc(order))
    sized = rows.withColumn("tokens", F.length(F.coalesce(F.col(text), F.lit(""))) * tokens_per_char)
    ranked = sized.withColumns({"age": F.row_number().over(back), "upto": F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return ranked.where((system & (F.col("age") == 1)) | (~system & (F.col("age") <= keep) & ((F.col("upto") <= most_tokens) | (F.col("age") <= least)))).drop("upto")


def dedupe_turns(turns: DataFrame, by: str, order: str, speaker: str, content: str, confidence: str, unknown: str = "未知") -> DataFrame:
    """``by``, ``position``, ``speaker``, ``content``, ``confidence``: one turn for each content without marks and spaces.

    A named speaker beats an unknown one and a higher confidence a lower one, in order; the place of the first
    stays. The fold isn't associative, so the turns of one content are folded in order: groups are those of
    (conversation, content), never a whole conversation.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(content)), r"^[「」『』\"“”'‘’]+|[「」『』\"“”'‘’]+$", ""), r"(?U)\s+", "")
    silent = F.col(content).rlike(r"(?U)^[—\-–−･・….\s]*$")
    who = F.coalesce(F.nullif(F.trim(F.col(speaker)), F.lit("")), F.lit(unknown))
    rows = turns.where(F.col(content).isNotNull() & ~silent).select(by, F.col(order).alias("o"), who.alias("s"), F.col(content).alias("c"), F.coalesce(F.col(confidence), F.lit(0.0)).alias("f"), bare.alias("key")).where("key <> ''")
    listed = rows.groupBy(by, "key").agg(F.array_sort(F.collect_list(F.struct("o", "s", "c", "f"))).alias("t"))

    def better(a: Column, b: Column) -> Column:
        # compatible speakers (same, or one unknown) let a name win; a conflict goes by confidence alone
        alike = (a["s"] == b["s"]) | (a["s"] == unknown) | (b["s"] == unknown)
        wins = F.when(alike, (b["s"] != unknown) & ((a["s"] == unknown) | (b["f"] > a["f"]))).otherwise(b["f"] > a["f"])
        return F.when(wins, b).otherwise(a)

    first = F.get("t", F.lit(0))
    won = F.aggregate(F.slice("t", F.lit(2), F.size("t")), first, better)
    return listed.select(by, first["o"].alias("position"), won["s"].alias("speaker"), won["c"].alias("content"), won["f"].alias("confidence"))


def diverse(rows: DataFrame, by: str, id: str, text: str, score: str, most: int = 8, likeness: float = 0.8) -> DataFrame:
    """The ``most`` best rows of each group, without any whose characters are too much like a better one's.

    A greedy choice depends on its order: rows come sorted by score, and only the chosen few of one group are
    held, whatever its size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = object()
        chosen: list[set[str]] = []
        for frame in frames:
            keep = []
            for n, (k, t) in enumerate(zip(frame[by], frame[text], strict=True)):
                if k != key:
                    key, chosen = k, []
                if len(chosen) == most:
                    continue
                own = set(t or "")
                if all(len(own & c) <= likeness * len(own | c) for c in chosen):
                    chosen.append(own)
                    keep.append(n)
            yield frame.iloc[keep]

    fields = rows.select(by, id, text, score)
    return fields.repartition(by).sortWithinPartitions(by, F.desc(score), id).mapInPandas(run, fields.schema)


def reliable_neighbours(rows: DataFrame, by: str, order: str, reliable: Column, most: int = 2) -> DataFrame:
    """``rows`` with ``before``, the orders of the last ``most`` reliable rows before each, and ``after``, that of the first one after.

    Each look back is a window's last value before the one it found, so no row gathers all that stand before it.
    """
    w = Window.partitionBy(by).orderBy(order)
    own = F.when(reliable, F.col(order))
    # a reliable row knows the ones before it, and each row the last reliable one
    chain = F.when(reliable, F.array_compact(F.array(*[F.lag("__own", k).over(Window.partitionBy(by, "__ok").orderBy(order)) for k in range(most - 1, 0, -1)], F.col("__own"))))
    marked = rows.withColumns({"__own": own, "__ok": reliable}).withColumn("__chain", chain)
    before = F.last("__chain", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__own", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return marked.withColumns({"before": F.coalesce(before, F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>")), "after": after}).drop("__own", "__ok", "__chain")


def ordered_windows(rows: DataFrame, by: str, chapter: str, order: str, most: int, promoted: Column) -> DataFrame:
    """``rows`` with ``position``: at most ``most`` of each chapter, thirds dealt in turn, and those that are ``promoted`` before all others."""
    capped = rows.withColumn("__k", F.row_number().over(Window.partitionBy(by, chapter).orderBy(order))).where(F.col("__k") <= most).drop("__k")
    dealt = interleaved(capped, by, order)
    return dealt.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(promoted.desc(), "position")) - 1)


def spaced(rows: DataFrame, by: str, position: str, gap: int) -> DataFrame:
    """``by``, ``position``: the first position of each group, and from then on each that is ``gap`` or more after the last one taken.

    A stream over positions in order, with one number of state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = object()
        last = 0
        for frame in frames:
            keep = []
            for n, (k, p) in enumerate(zip(frame[by], frame[position], strict=True)):
                if k != key or p >= last + gap:
                    key, last = k, p
                    keep.append(n)
            yield frame.iloc[keep]

    fields = rows.select(by, position).where(F.col(position).isNotNull()).distinct()
    return fields.repartition(by).sortWithinPartitions(by, position).mapInPandas(run, fields.schema)


def context(rows: DataFrame, by: str, order: str, text: str, before: int, after: int, most: int) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the texts of so many rows on either side, cut at ``most`` characters."""
    w = Window.partitionBy(by).orderBy(order)
    t = F.coalesce(F.col(text), F.lit(""))
    joined = lambda a, b: F.left(F.array_join(F.collect_list(t).over(w.rowsBetween(a, b)), " "), F.lit(most))
    return rows.withColumns({"before": joined(-before, -1), "after": joined(1, after)})
