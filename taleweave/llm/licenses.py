"""License scan by diagonal voting.

Texts and license templates become words; every run of ``K`` words is a gram. Grams of a text are joined to
the places of the same grams in the templates. A pair of places votes for the diagonal of its offset (place in
the text less place in the template): a passage copied from a template puts all its votes on one diagonal, and
words put in or left out move the rest to a neighbouring one. Diagonals of a template that lie within
``slack`` of each other are merged, and a merged span is verified: it needs ``threshold`` of the template's
grams at different places.

Phrases of the base are templates too, found where all their grams stand on a single diagonal.

Only DataFrame operations run on texts. A text's grams are first tested for membership in the fixed set of
template grams, so that only hits leave the row; templates are a fixed table, and votes are aggregated by
text. Null and empty texts have no words, no labels and score 0. Repeated rows get the same result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, words, written

K = 3

#: Phrases and labels of the base.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Statements of public licenses and how texts usually refer to them.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("released under the terms of the mit license", "mit"),
    ("spdx license identifier mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("spdx license identifier apache 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("spdx license identifier gpl 3 0", "gpl-3"),
    ("gnu general public license version 3 29 june 2007", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("spdx license identifier gpl 2 0", "gpl-2"),
    ("gnu general public license version 2 june 1991", "gpl-2"),
    ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("spdx license identifier lgpl", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("spdx license identifier agpl", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("spdx license identifier bsd", "bsd"),
    ("spdx license identifier mpl 2 0", "mpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("spdx license identifier isc", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("spdx license identifier unlicense", "unlicense"),
)


def template_rows() -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, base, place, grams, gram) of every gram of every template."""
    out = []
    for t, (text, label, base) in enumerate([*((x, y, True) for x, y in BASE), *((x, y, False) for x, y in TEMPLATES)]):
        w = text.split()
        grams = [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]
        out += [(t, label, base, i, len(grams), g) for i, g in enumerate(grams)]
    return out


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template int, label string, base boolean, place int, grams int, gram string")


def gram_hits(w: Column, grams: list[str]) -> Column:
    """(pos, gram) of each run of ``K`` words that some template has."""
    heads, pairs = sorted({g.split()[0] for g in grams}), sorted(grams)
    starts = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)])
    # most words begin no template gram, so the gram itself is rarely built
    at = F.filter(starts, lambda i: F.get(w, i).isin(heads) & gram(i).isin(pairs))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")))


def scan_licenses(docs: DataFrame, *, text: str = "text", id: str = "doc_id", slack: int = 2, threshold: float = 0.9) -> DataFrame:
    """``id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans`` of every row.

    ``spans`` lists the verified spans as ``label:first word:end``, the end exclusive.
    """
    spark = docs.sparkSession
    rows = template_rows()
    # two steps, so that words are made once: inside one select each use would make them anew
    worded = docs.select(F.col(id), F.xxhash64(F.col(text)).alias("__text"), words(ascii_lower(F.col(text))).alias("__words"))
    # the words are bound to a lambda's argument for the same reason
    found = F.element_at(F.transform(F.array("__words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), gram_hits(w, sorted({r[5] for r in rows})).alias("hits"))), 1)
    base = written(worded.select(F.col(id), "__text", found.alias("f")).select(F.col(id), "__text", "f.n_words", "f.hits"), "grams")
    hits = base.where(F.size("hits") > 0).select(F.col(id).alias("__id"), "__text", "hits").distinct().select("__id", "__text", F.inline("hits"))
    votes = hits.join(F.broadcast(template_table(spark)), "gram").withColumn("diagonal", F.col("pos") - F.col("place"))
    lines = votes.groupBy("__id", "__text", "template", "label", "base", "grams", "diagonal").agg(F.collect_set("place").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    over = Window.partitionBy("__id", "__text", "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(over), F.lit(0))
    merged = lines.withColumn("gap", gap).withColumn("span", F.sum((F.col("gap") > slack).cast("int")).over(over))
    spans = merged.groupBy("__id", "__text", "template", "label", "base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.collect_list(F.when(F.size("places") == F.col("grams"), F.col("diagonal").cast("long"))).alias("whole"),
    )
    share = F.col("covered") / F.col("grams")
    kept = spans.withColumn("share", share).withColumn("places", F.when(F.col("base"), F.col("whole")).otherwise(F.array().cast("array<bigint>")))
    verified = F.col("share") >= threshold
    of_row = kept.groupBy("__id", "__text").agg(
        F.sum(F.size("places")).cast("long").alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"),
        F.max(F.array_max("places")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.size("places") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(verified | (F.size("places") > 0), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("first", "label", (F.col("last") + K).alias("end"))))).alias("spans"),
    )
    joined = base.join(of_row, F.col(id).eqNullSafe(F.col("__id")) & (base["__text"] == of_row["__text"]), "left")
    return joined.select(
        F.col(id), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["end"])), ","), F.lit("")).alias("spans"),
    )
