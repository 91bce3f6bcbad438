"""A bounded number of calls dealt over chapters, and given up where nobody is left to ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def planned_calls(windows: DataFrame, yields: DataFrame, quotas: DataFrame, by: str, calls: int, per_chapter: int = 3) -> DataFrame:
    """``windows(by, chapter, window, activity)`` with ``place``, ``call`` and ``reason``.

    Of each volume (``by``) the first window of every chapter comes first, the chapters of most ``activity`` before the
    others, then the second windows, up to ``per_chapter`` of a chapter. ``yields(by, chapter, window, name, turns)`` is
    what a window gives of each name, ``quotas(name, quota)`` how much of a name is wanted (names without one: nothing).
    A window all of whose names have met their quota is passed over and its call goes to the next one, until ``calls``
    are spent: ``call`` numbers those that are made; ``reason`` is ``chapter_cap``, ``no_names``, ``met`` or
    ``budget`` for the others.

    A name's count over all windows before is its count over those that were called, as long as it is below its quota:
    a window that holds such a name is never passed over. So running sums decide, and nothing is simulated.
    """
    keys = [by, "chapter", "window"]
    n = F.row_number().over(Window.partitionBy(by, "chapter").orderBy("window"))
    numbered = windows.withColumn("n", n)
    order = Window.partitionBy(by).orderBy("n", F.desc("activity"), "chapter", "window")
    placed = numbered.where(F.col("n") <= per_chapter).withColumn("place", F.row_number().over(order))
    wanted = yields.where("turns > 0").join(quotas.select("name", "quota"), "name", "left").join(placed.select(*keys, "place"), keys)
    before = F.sum("turns").over(Window.partitionBy(by, "name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    open_ = wanted.withColumn("open", F.coalesce(before, F.lit(0)) < F.coalesce("quota", F.lit(0)))
    asked = open_.groupBy(*keys).agg(F.max(F.col("open").cast("int")).alias("open"))
    judged = placed.join(asked, keys, "left")
    upto = F.sum(F.coalesce("open", F.lit(0))).over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = judged.withColumn("upto", upto)
    made = (F.col("open") == 1) & (F.col("upto") <= calls)
    reason = F.when(F.col("open").isNull(), "no_names").when(F.col("open") == 0, "met").when(F.col("upto") > calls, "budget")
    inside = counted.select(*windows.columns, "place", F.when(made, F.col("upto")).cast("int").alias("call"), reason.alias("reason"))
    outside = numbered.where(F.col("n") > per_chapter).select(*windows.columns, F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("call"), F.lit("chapter_cap").alias("reason"))
    return inside.unionByName(outside)
