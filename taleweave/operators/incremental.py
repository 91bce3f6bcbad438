"""Analyses kept up to date: only what changed is read again; what was found is published as one.

``refresh`` compares a fingerprint of each volume, made of its catalog and not of its texts, with that of the last run.
Only volumes that are new or changed are analysed, into a run's own folder with the volume as partition column; the table
of volumes says which run holds each volume's rows, and publishing it is what makes the new rows count and the old ones
of the same volumes not. Volumes that are gone, and those whose analysis finds nothing, so lose their old rows without
anything being rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import Versions, replaced
from .graphs import written


def fingerprints(catalog: DataFrame, by: str, marks: list[str], version: str = "") -> DataFrame:
    """``by``, ``fingerprint`` of each volume's rows of ``catalog``, whatever their order; ``version`` is that of the analysis.

    Sums of two hashes of each row and the number of rows: no volume's rows are gathered.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), *marks).cast("decimal(20,0)")).cast("string") for seed in (0, 1)]
    found = catalog.groupBy(by).agg(F.count("*").cast("string").alias("__n"), sums[0].alias("__a"), sums[1].alias("__b"))
    return found.select(by, F.sha2(F.concat_ws(":", F.lit(version), "__n", "__a", "__b"), 256).alias("fingerprint"))


def refresh(store: Versions, catalog: DataFrame, by: str, marks: list[str], analyse: Callable[[DataFrame], DataFrame], version: str = "1") -> DataFrame:
    """Bring the analysis in ``store`` up to date; ``by``, ``state`` (new, changed, gone, kept) of each volume.

    ``analyse(volumes)`` gets the volumes to read again (``by``) and returns their rows, with the column ``by``.
    Nothing is analysed, read or written if all volumes are as they were.
    """
    known = store.read("volumes")
    prints = fingerprints(catalog, by, marks, version)
    old = known if known is not None else prints.limit(0).select(by, "fingerprint", F.lit("").alias("run"))
    both = prints.join(old.select(by, F.col("fingerprint").alias("__f"), "run"), by, "full_outer")
    state = F.when(F.col("__f").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("__f"), "changed").otherwise("kept")
    compared = written(both.withColumn("state", state), "volumes")
    todo = compared.where("state IN ('new', 'changed')").select(by)
    if not todo.isEmpty():
        run = uuid.uuid4().hex
        analyse(todo).write.partitionBy(by).parquet(f"{store.path}/claims/run={run}")
        fresh = F.when(F.col("state") == "kept", F.col("run")).otherwise(F.lit(run))
        store.publish({"volumes": compared.where("state <> 'gone'").select(by, "fingerprint", fresh.alias("run"))})
    elif not compared.where("state = 'gone'").isEmpty():
        store.publish({"volumes": compared.where("state <> 'gone'").select(by, "fingerprint", "run")})
    return compared.select(by, "state")


def claims(store: Versions, by: str) -> DataFrame:
    """The rows that count: of each volume those of its last run. Folders of other runs are pruned by the join with the table of volumes."""
    volumes = store.read("volumes").select(by, "run")
    kind = volumes.schema[by].dataType
    rows = store.spark.read.option("basePath", f"{store.path}/claims").parquet(f"{store.path}/claims").withColumns({"run": F.col("run").cast("string"), by: F.col(by).cast(kind)})
    return rows.join(F.broadcast(volumes), [by, "run"], "left_semi").drop("run")


#: Kinds of blocks that a story index consists of.
STORY_KINDS = ("relation", "event")


def publish_story(store: Versions, found: DataFrame, series: DataFrame) -> DataFrame:
    """Replace the story blocks of some series and mark their cards stale, as one; the counts of it.

    ``store`` has ``blocks(series, id, kind, ...)`` and ``cards(series, name, ..., stale)``; ``found`` are the new
    blocks, of ``series(series)`` only. One row a series: ``before``, ``deleted``, ``inserted``, ``after`` (blocks) and
    ``cards`` (those that became stale). Readers see both tables as they were, or both as they are then.
    """
    blocks, cards = store.read("blocks"), store.read("cards")
    story = F.col("kind").isin(*STORY_KINDS)
    touched = series.select("series").distinct()
    rest = blocks.join(touched.withColumn("__t", F.lit(True)), "series", "left").where(F.col("__t").isNull() | ~story).select(*blocks.columns)
    new = found.join(touched, "series", "left_semi").where(story).select(*blocks.columns)
    marked = cards.join(touched.withColumn("__t", F.lit(True)), "series", "left").select(*[(F.col("stale") | F.col("__t").isNotNull()).alias("stale") if c == "stale" else F.col(c) for c in cards.columns])
    store.publish({"blocks": rest.unionByName(new), "cards": marked})
    was = blocks.groupBy("series").agg(F.count("*").alias("before"), F.count_if(story).alias("deleted"))
    now = store.read("blocks").groupBy("series").agg(F.count("*").alias("after"), F.count_if(story).alias("inserted"))
    stale = cards.where("NOT stale").groupBy("series").agg(F.count("*").alias("cards"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = touched.join(was, "series", "left").join(now, "series", "left").join(stale, "series", "left")
    return counts.select("series", *(number(c) for c in ("before", "deleted", "inserted", "after", "cards")))


def merged_partitions(existing: DataFrame | None, partial: DataFrame, by: str, keys: DataFrame, order: list[str]) -> DataFrame:
    """``existing`` with the rows of some volumes replaced by ``partial``, and every row's new place (``pos``) in its volume."""
    rows = replaced(existing, partial, by, keys)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
