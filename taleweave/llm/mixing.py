"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources, in code point order with null last, have the weights of a
cycle and share ``share`` times all words by weight; a target stops at ``most`` times its source's size and
the excess is shared anew. Rates of documents are those nearest to 1 in entropy that meet each source's
target and stay at ``most`` or less: ``min(most, exp(lambda * size))`` with one multiplier a source, the
solution of the convex dual. Newton steps, kept inside a bracket, find the multipliers; each step is one
aggregation of (source, size) counts, which stand for the documents exactly.

Rates become copies size by size, from the longest to the shortest, and what rounding owes in words is carried
on, so a source's words come within a few words of its target. Within one size the documents with the smallest hashes take the copies that are left. Large
groups of one source and size are dealt over hash buckets, so that no task ranks more than a few thousand.

Sums are taken in decimals, so reruns and other partitionings agree. A null text has size 0 and a null source
is a source. A source of size 0 has target 0. Rows repeated in all columns share a rank in any order.
An empty table gives no rows. Columns of the input stay as they are; an added column whose name is taken has
underscores before it. Multipliers that do not settle are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TOKEN, free_name, written

BUCKET_ROWS = 4096
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def sized(docs: DataFrame, text: str, source: str, id: str) -> DataFrame:
    """``docs`` with its key columns ``__source``, ``__size`` and ``__tie``."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long")
    return docs.withColumns({"__source": F.col(source), "__size": size, "__tie": F.xxhash64(F.col(id), F.col(text))})


def source_targets(counts: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``__source``, ``source_size``, ``target`` and ``least`` (its smallest size above 0) from (source, size) counts."""
    sizes = counts.groupBy("__source").agg(F.sum(F.col("n") * F.col("__size")).alias("source_size"), F.min(F.when(F.col("__size") > 0, F.col("__size"))).alias("least"), F.sum("n").alias("docs"))
    # one row a source: the list of sources that a mixture weighs
    place = F.row_number().over(Window.orderBy(F.col("__source").isNull(), "__source")) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[place % len(weights)]
    sizes = written(sizes.withColumn("weight", weight), "sources")
    whole = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    pool, level = share * float(whole[0] or 0), 0.0
    if pool:
        level = pool / whole[1]
        while True:
            above = F.col("weight") * level > most * F.col("source_size")
            full, rest = sizes.agg(F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
            raised = (pool - (full or 0)) / rest if rest else math.inf
            if raised <= level * (1 + 1e-15):
                break
            level = raised
    return sizes.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")) if level else F.lit(0.0))


def multipliers(counts: DataFrame, targets: DataFrame, most: float, tolerance: float, most_steps: int) -> DataFrame:
    """``targets`` with ``multiplier`` and ``unit``: a document's rate is min(most, exp(multiplier * size / unit)). Null where all documents stand at ``most``."""
    unit = F.col("source_size") / F.col("docs")
    ratio = F.log(F.col("target") / F.col("source_size"))
    scale = unit / F.col("least")
    # at 0 all words are taken once; at the other end all documents stand at most, or too few words are taken
    state = targets.withColumn("unit", unit).withColumns(
        {"open": (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)), "multiplier": ratio, "low": F.when(ratio < 0, ratio * scale).otherwise(0.0), "high": F.when(ratio < 0, 0.0).otherwise(math.log(most) * scale)}
    )
    state = written(state, "multipliers")
    cell = F.col("n") * F.col("__size")
    grown = F.col("multiplier") * F.col("__size") / F.col("unit")
    capped = grown >= math.log(most)
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(most_steps):
        joined = counts.join(state.where("open").select(F.col("__source").alias("__of"), "multiplier", "unit"), F.col("__source").eqNullSafe(F.col("__of")))
        sums = joined.groupBy("__of").agg(exact(cell * F.when(capped, most).otherwise(F.exp(grown))).alias("words"), exact(F.when(~capped, cell * F.col("__size") / F.col("unit") * F.exp(grown))).alias("slope"))
        over = F.col("words") - F.col("target")
        low, high = F.when(over <= 0, F.col("multiplier")).otherwise(F.col("low")), F.when(over >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - over / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = ~(F.abs(over) > tolerance * F.col("target")) | (high - low < 1e-13)
        step = F.when(done, F.col("multiplier")).when(inside, newton).otherwise((low + high) / 2)
        merged = state.join(sums, F.col("__source").eqNullSafe(F.col("__of")), "left").withColumn("__done", ~F.col("open") | F.coalesce(done, F.lit(True)))
        moved = merged.withColumns({"__low": low, "__high": high, "__step": step})
        state = written(
            moved.select(*[c for c in targets.columns], "unit", "open", *[F.when(F.col("open"), F.col(new)).alias(c) for c, new in (("multiplier", "__step"), ("low", "__low"), ("high", "__high"))], "__done"),
            "multipliers",
        )
        if not state.where(~F.col("__done")).limit(1).count():
            break
        state = state.drop("__done")
    else:
        raise RuntimeError(f"multipliers did not settle in {most_steps} steps")
    return state.select(*targets.columns, "open", "multiplier", "unit")


def rounded(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` with ``m``, the copies that all documents of a source and size take together.

    From the longest size to the shortest, the words that rounding owes are carried on, so that a source ends
    within half of its shortest documents unless all of them are at a limit. The rows are streamed: a source
    has one row a size, however many documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, carry = object(), 0.0
        for b in batches:
            out = []
            for of, size, n, rate in zip(*(b.column(c).to_pylist() for c in ("__source", "__size", "n", "rate")), strict=True):
                if of != source:
                    source, carry = of, 0.0
                owed = n * rate * size + carry
                m = min(most * n, max(0, math.floor(owed / size + 0.5))) if size else 0
                carry = owed - m * size
                out.append(m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "m"])

    schema = T.StructType([*cells.schema, T.StructField("m", T.LongType())])
    return cells.repartition("__source").sortWithinPartitions("__source", F.desc("__size")).mapInArrow(run, schema)


def mix_sources(
    docs: DataFrame,
    *,
    share: float = 1.5,
    weights: tuple[float, ...] = (3, 1, 2),
    most: int = 2,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    tolerance: float = 1e-7,
    most_steps: int = 80,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` (0 to ``most``) and ``taken`` words."""
    named = {c: free_name(docs, c) for c in ADDED}
    keys = written(sized(docs, text, source, id).select("__source", "__size", "__tie"), "sizes")
    counts = written(keys.groupBy("__source", "__size").agg(F.count("*").alias("n")), "counts")
    targets = source_targets(counts, share, weights, most)
    state = multipliers(counts, targets, most, tolerance, most_steps)
    of = state.select(F.col("__source").alias("__of"), "source_size", "target", "open", "multiplier", "unit")
    rate = F.when(F.col("source_size") == 0, 0.0).when(~F.col("open"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("__size") / F.col("unit"))))
    cells = counts.join(of, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("rate", rate)
    cells = rounded(cells.select(*counts.columns, "source_size", "target", "rate"), most)
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    cells = written(cells.select(F.col("__source").alias("__s"), F.col("__size").alias("__z"), F.col("n").alias("__n"), *(F.col(c).alias("__" + c) for c in ("source_size", "target", "rate")), F.col("m").alias("__copies"), buckets.alias("__buckets")), "cells")

    def in_cell(rows: DataFrame) -> DataFrame:
        joined = rows.join(cells, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")))
        return joined.withColumn("__bucket", F.pmod("__tie", F.col("__buckets")))

    dealt = in_cell(keys).groupBy("__source", "__size", "__bucket").agg(F.count("*").alias("k"), F.first("__n").alias("n"), F.first("__copies").alias("m"))
    over = Window.partitionBy("__source", "__size").orderBy("__bucket")
    upto = F.sum("k").over(over)
    share_of = lambda c: F.floor(c.cast("decimal(20,0)") * F.col("m").cast("decimal(18,0)") / F.col("n").cast("decimal(18,0)"))
    dealt = written(
        dealt.withColumn("__upto", upto).select(F.col("__source").alias("__bs"), F.col("__size").alias("__bz"), F.col("__bucket").alias("__b"), F.col("k").alias("__k"), (share_of(F.col("__upto")) - share_of(F.col("__upto") - F.col("k"))).cast("long").alias("__m")),
        "buckets",
    )
    rows = in_cell(sized(docs, text, source, id)).join(dealt, F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__size") == F.col("__bz")) & (F.col("__bucket") == F.col("__b")))
    place = F.row_number().over(Window.partitionBy("__source", "__size", "__bucket").orderBy("__tie", id))
    each = F.floor(F.col("__m") / F.col("__k")) + (place <= F.col("__m") % F.col("__k")).cast("long")
    copies = F.when(F.col("__size") == 0, 0).otherwise(each).cast("long")
    added = {"size": F.col("__size"), "source_size": F.col("__source_size").cast("long"), "target": F.col("__target").cast("double"), "rate": F.col("__rate"), "copies": F.col("__taken"), "taken": F.col("__taken") * F.col("__size")}
    return rows.withColumn("__taken", copies).select(*docs.columns, *(v.alias(named[k]) for k, v in added.items()))
