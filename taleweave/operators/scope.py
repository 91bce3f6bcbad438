"""Metadata filters, their relaxation, and time windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import series_of


@dataclass(frozen=True)
class Scope:
    """What a search is limited to; empty parts limit nothing."""

    series: str | None = None
    doc_ids: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    chapter: str | None = None
    chapter_has: tuple[str, ...] = ()
    granularity: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))

    def condition(self) -> Column:
        """All parts together; names match any of characters, persons or the card's own name."""
        out = F.lit(True)
        if self.series is not None:
            out &= series_of(self.column("doc_id")) == self.series
        if self.doc_ids:
            out &= self.column("doc_id").isin(*self.doc_ids)
        if self.names:
            known = F.array_compact(F.concat(F.coalesce(self.column("characters"), F.array()), F.coalesce(self.column("all_person"), F.array()), F.array(self.column("character_name"))))
            out &= F.arrays_overlap(known, F.array(*[F.lit(n) for n in self.names]))
        if self.chapter is not None:
            out &= self.column("chapter_title") == self.chapter
        if self.chapter_has:
            out &= F.exists(F.array(*[F.lit(x) for x in self.chapter_has]), lambda x: F.contains(self.column("chapter_title"), x))
        if self.granularity == "child":
            out &= F.coalesce(self.column("granularity"), F.lit("")) != "parent"
        if self.granularity == "parent":
            out &= F.coalesce(self.column("granularity"), F.lit("")) != "child"
        return out


def strictest_level(hits: DataFrame, levels: list[Column], by: str = "query_id") -> DataFrame:
    """Rows of the strictest of ``levels`` (conditions, each wider than the one before) that has any row for the query.

    One pass: each row gets its first level that holds, and each query keeps the rows of its least level.
    """
    level = F.lit(None).cast("int")
    for n in range(len(levels) - 1, -1, -1):
        level = F.when(levels[n], n).otherwise(level)
    found = hits.withColumn("level", level).where(F.col("level").isNotNull())
    return found.withColumn("least", F.min("level").over(Window.partitionBy(by))).where(F.col("level") == F.col("least")).drop("least")


def order_threshold(orders: DataFrame, by: list[str], order: str, share: float) -> DataFrame:
    """``threshold``: the sorted orders' element at floor(n * share), at most the last.

    Orders are counted first, so that a group has one row a different order when its counts are summed up.
    """
    counts = orders.where(F.col(order).isNotNull()).groupBy(*by, order).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = F.sum("__n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(w)})
    reached = F.col("__upto") >= F.least(F.col("__all"), F.floor(F.col("__all") * share) + 1)
    return summed.where(reached).groupBy(*by).agg(F.min(order).alias("threshold"))
