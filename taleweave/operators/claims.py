"""Claims of a story, chapter by chapter, reduced to those that count: each with its reason if it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_weak_entity
from . import entities

SUMMARY, KEY = 120, 40


def judged(claims: DataFrame, pool: DataFrame, aliases: DataFrame, most: int = SUMMARY) -> DataFrame:
    """``claims(doc, chapter, pos, kind, source, target, summary, confidence, evidence, year)`` with canonical names, the summary cut, only the ``evidence`` that ``pool(doc, chapter, id)`` has, and ``dropped``.

    ``kind`` is ``event``, ``relation`` or ``foreshadow``; ``pos`` is unique. ``dropped`` is ``empty`` (no summary, of a
    relation no name at all), ``weak`` (a relation of one name or of a weak one), ``repeat`` (an event with the document,
    chapter and first characters of an earlier one, whatever becomes of that), ``no_evidence``, or null.
    """
    text = F.left(F.trim(F.coalesce("summary", F.lit(""))), F.lit(most))
    each = claims.withColumns({"summary": text, "source": F.trim(F.coalesce("source", F.lit(""))), "target": F.trim(F.coalesce("target", F.lit("")))})
    for side in ("source", "target"):
        each = entities.canonical(each, side, aliases).drop(side).withColumnRenamed("canonical", side)
    cited = claims.select("doc", "chapter", "pos", F.posexplode("evidence").alias("p", "id")).join(pool.select("doc", "chapter", "id").distinct(), ["doc", "chapter", "id"])
    bound = cited.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias("held"))
    event, relation = F.col("kind") == "event", F.col("kind") == "relation"
    empty = F.when(relation, (F.col("source") == "") & (F.col("target") == "")).otherwise(F.col("summary") == "")
    nth = F.row_number().over(Window.partitionBy("doc", "chapter", "kind", F.left("summary", F.lit(KEY)), empty).orderBy("pos"))
    weak = (F.col("source") == "") | (F.col("target") == "") | (F.col("source") == F.col("target")) | is_weak_entity(F.col("source")) | is_weak_entity(F.col("target"))
    full = each.withColumns({"__empty": empty, "__n": nth}).join(bound, "pos", "left")
    dropped = F.when(F.col("__empty"), "empty").when(relation & weak, "weak").when(event & (F.col("__n") > 1), "repeat").when(F.col("held").isNull(), "no_evidence")
    return full.withColumns({"dropped": dropped, "evidence": F.coalesce("held", F.array().cast(claims.schema["evidence"].dataType))}).drop("__empty", "__n", "held").select(*claims.columns, "dropped")


def snapshot(found: DataFrame) -> DataFrame:
    """The claims of ``judged`` that count, with their ``place`` in the story of their ``kind``: those with a year first, then by document, chapter and position."""
    kept = found.where(F.col("dropped").isNull()).drop("dropped")
    order = [F.col("year").isNull(), F.col("year"), F.col("doc"), F.col("chapter"), F.col("pos")]
    # years and documents are counted before, so that no task orders a whole kind
    groups = kept.groupBy("kind", "year", "doc").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("kind").orderBy(F.col("year").isNull(), "year", "doc").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.withColumn("__before", F.coalesce(before, F.lit(0))).withColumnsRenamed({"kind": "__k", "year": "__y", "doc": "__d"}).drop("__n")
    met = kept.join(offsets, (F.col("kind") == F.col("__k")) & F.col("year").eqNullSafe(F.col("__y")) & F.col("doc").eqNullSafe(F.col("__d")))
    return met.withColumn("place", (F.col("__before") + F.row_number().over(Window.partitionBy("kind", "year", "doc").orderBy(*order[3:]))).cast("long")).drop("__k", "__y", "__d", "__before")


def snapshot_stats(found: DataFrame) -> DataFrame:
    """``doc``, counts of what stays by kind and of what goes by reason, ``chapters``, ``with_claims`` and ``coverage`` (their share)."""
    chapters = found.groupBy("doc", "chapter").agg(*[F.count_if((F.col("kind") == k) & F.col("dropped").isNull()).alias(f"{k}s") for k in ("event", "relation", "foreshadow")], *[F.count_if(F.col("dropped") == r).alias(r) for r in ("empty", "weak", "repeat", "no_evidence")])
    sums = [F.sum(c).alias(c) for c in ("events", "relations", "foreshadows", "empty", "weak", "repeat", "no_evidence")]
    some = F.count_if(F.col("events") + F.col("relations") + F.col("foreshadows") > 0)
    return chapters.groupBy("doc").agg(*sums, F.count("*").alias("chapters"), some.alias("with_claims"), F.round(some / F.count("*"), 4).alias("coverage"))
