"""The cast of a text: where known names stand, how often, and which of them are one person.

``located`` finds all names in one pass over a text, by an automaton that each task builds from the broadcast names, so
its cost is that of the text and of what is found, not of the names. More names than ``MOST_NAMES`` go in parts, each a
pass of its own, whose places are brought together by text before they are settled.

Of places that overlap the longest name's counts, of equally long names the smallest one's, then the first place's; the
places of one name never overlap each other. Names of less than two characters, null and empty names are not looked
for; a null text has none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs

#: Names that one automaton holds at most: about 300 MB in a task.
MOST_NAMES = 500_000

Place = tuple[int, int, str]


def automaton(names: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for n in names:
        out.add_word(n, n)
    out.make_automaton()
    return out


def places(text: str, found) -> list[Place]:
    """Start, end and name of each place of each name, those of one name without overlaps."""
    out, last = [], {}
    for at, name in found.iter(text) if len(found) else ():
        start = at + 1 - len(name)
        if start >= last.get(name, 0):
            last[name] = at + 1
            out.append((start, at + 1, name))
    return out


def settled(every: Iterable[Place]) -> list[Place]:
    """The places that count, in order. What is longer comes first, so a place that overlaps one taken has an end inside it."""
    ordered = sorted(every, key=lambda p: (p[0] - p[1], p[2], p[0]))
    taken = np.zeros(max((p[1] for p in ordered), default=0), bool)
    out = []
    for start, end, name in ordered:
        if not (taken[start] or taken[end - 1]):
            taken[start:end] = True
            out.append((start, end, name))
    return sorted(out)


def batch(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
    """``rows`` of (place of the id, start, end, name)."""
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["id", "start", "end", "name"])


def passes(texts: DataFrame, names: DataFrame, most_names: int, keep: Callable[[list[Place], int], list[Place]]) -> tuple[DataFrame, int]:
    """``id``, ``start``, ``end``, ``name`` of what ``keep(places, parts)`` leaves of each text's places, and the number of passes."""
    known = names.select("name").where(F.length("name") >= 2).distinct()
    n = known.count()
    parts = 1 if n <= most_names else math.ceil(2 * n / most_names)
    schema = f"id {texts.schema['id'].dataType.simpleString()}, start int, end int, name string"
    rows = texts.where(F.col("text").isNotNull()).select("id", "text")
    out = None
    for part in range(parts):
        some = known.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part) if parts > 1 else known
        sent = texts.sparkSession.sparkContext.broadcast(some.toArrow()["name"].to_pylist())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = automaton(sent.value)
            for b in batches:
                for start in range(0, b.num_rows, 256):
                    some = b.slice(start, 256)
                    yield batch([(k, *p) for k, t in enumerate(some.column(1).to_pylist()) for p in keep(places(t, found), parts)], some.column(0))

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out, parts


def present(texts: DataFrame, names: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``id``, ``name``: which ``names(name)`` of two characters or more each of ``texts(id, text)`` holds, inside of longer ones too."""

    def once(every: list[Place], parts: int) -> list[Place]:
        return list({p[2]: p for p in every}.values())

    return passes(texts, names, most_names, once)[0].select("id", "name")


def located(texts: DataFrame, names: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``id``, ``start``, ``end``, ``name``: where the ``names(name)`` stand in ``texts(id, text)``, ids being unique."""
    out, parts = passes(texts, names, most_names, lambda every, parts: settled(every) if parts == 1 else every)
    if parts == 1:
        return out

    def settle(group: pa.Table) -> pa.Table:
        found = settled(zip(*(group[c].to_pylist() for c in ("start", "end", "name")), strict=True))
        return pa.Table.from_batches([batch([(0, *p) for p in found], group["id"].combine_chunks())])

    return out.groupBy("id").applyInArrow(settle, out.schema)


def inventory(texts: DataFrame, names: DataFrame, least: int = 2, short: int = 3000) -> DataFrame:
    """``id``, ``name``, ``mentions``, ``first``: the names with ``least`` mentions or more in a text; in one of ``short`` characters or fewer one is enough."""
    counts = located(texts, names).groupBy("id", "name").agg(F.count("*").alias("mentions"), F.min("start").alias("first"))
    brief = texts.select("id", (F.length("text") <= short).alias("brief"))
    return counts.join(brief, "id").where(F.col("brief") | (F.col("mentions") >= least)).drop("brief")


def clustered(found: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``name``, ``mentions``, ``aliases``: entries of ``inventory`` under one name, for names that ``links(a, b)`` connect; the most mentioned over all texts, then the longest, then the smallest stands for them."""
    roots = graphs.connected(links.select("a", "b")).select(F.col("node").alias("name"), "root")
    rooted = found.join(roots, "name", "left").withColumn("root", F.coalesce("root", F.col("name")))
    totals = rooted.groupBy("root", "name").agg(F.sum("mentions").alias("n"))
    best = totals.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), F.desc(F.length("name")), "name"))).where("r = 1").select("root", F.col("name").alias("head"))
    rows = rooted.join(best, "root")
    merged = rows.groupBy("id", "head").agg(F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set(F.when(F.col("name") != F.col("head"), F.col("name")))).alias("aliases"))
    return merged.select("id", F.col("head").alias("name"), "mentions", "aliases")
