"""Entities: aliases, likeness joins, containment, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import strip_honorific
from ..functions.text import char_ngrams


def canonical(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``canonical`` from ``aliases(alias, canonical)``; what has no entry stands for itself."""
    return rows.join(aliases.withColumnRenamed("canonical", "__c"), F.col(name) == F.col("alias"), "left").withColumn("canonical", F.coalesce("__c", F.col(name))).drop("__c", "alias")


def prioritized(names: DataFrame, name: str, ladders: list[DataFrame]) -> DataFrame:
    """``names`` with ``entity``: the match of the first of ``ladders(key, entity)`` that has one, of equals the smallest; the last is asked without honorifics."""
    dims = reduce(DataFrame.unionByName, [d.select("key", "entity").withColumn("prio", F.lit(n)) for n, d in enumerate(ladders)])
    bare = F.array_distinct(F.array(F.struct(F.col(name).alias("key"), F.lit(0).alias("stripped")), F.struct(strip_honorific(F.col(name)).alias("key"), F.lit(1).alias("stripped"))))
    asked = names.select(name).distinct().select(name, F.explode(bare).alias("k")).select(name, "k.*")
    found = asked.join(dims, "key").groupBy(name).agg(F.min(F.struct("stripped", "prio", "entity")).alias("best"))
    return names.join(found, name, "left").withColumn("entity", F.col("best.entity")).drop("best")


def near_pairs(names: DataFrame, most: int = 2, head: int = 1) -> DataFrame:
    """``a``, ``b`` (a < b) of ``names(name)`` within ``most`` edits that share their first ``head`` characters.

    Only names with the same head and lengths at most ``most`` apart meet.
    """
    n = names.select("name").where(F.col("name").isNotNull()).distinct().select("name", F.left("name", F.lit(head)).alias("head"), F.length("name").alias("len"))
    x, y = n.toDF("a", "head", "la").withColumn("l", F.explode(F.sequence(F.col("la") - most, F.col("la") + most))), n.toDF("b", "head", "l")
    return x.join(y, ["head", "l"]).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", most) >= 0)).select("a", "b", F.levenshtein("a", "b").alias("edits"))


def shortened(name: Column, most: int) -> Column:
    """A name and what is left of it without up to ``most`` of its characters."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, cut))))
    return out


def near_pairs_exact(names: DataFrame, most: int = 2) -> DataFrame:
    """``a``, ``b`` (a < b), ``edits`` of all different ``names(name)`` within ``most`` (1 or 2) edits, whatever their first characters.

    Names within k edits are equal once each has lost up to k of its characters, so they meet by equality of
    what is left; a name of n characters has about n * n / 2 such forms. A form that many names share makes
    their pairs, as all of them are within 2k edits of each other.
    """
    n = names.select("name").where(F.col("name").isNotNull()).distinct()
    forms = n.select("name", F.explode(shortened(F.col("name"), most)).alias("form"))
    met = forms.toDF("a", "form").join(forms.toDF("b", "form"), "form").where("a < b").select("a", "b").distinct()
    return met.where(F.levenshtein("a", "b", most) >= 0).select("a", "b", F.levenshtein("a", "b").alias("edits"))


#: Words up to this length are cut by place; longer ones are split into characters once, as a place is found from the start.
SHORT_WORD = 64


def substrings(words: Column, lengths: list[int]) -> Column:
    """The different substrings of an array of ``words``: of the ``lengths``, for short words also of those between them."""
    least, most = min(lengths), max(lengths)

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(w) - (least - 1))
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(w) - i + 1)), lambda n: F.substring(w, i, n))))

    short = F.transform(F.filter(words, lambda w: F.length(w).between(least, SHORT_WORD)), cut)
    long = F.transform(F.filter(words, lambda w: F.length(w) > max(SHORT_WORD, least - 1)), lambda w: F.concat(*[char_ngrams(w, n) for n in lengths]))
    return F.array_distinct(F.flatten(F.concat(short, long)))


def contained(texts: DataFrame, names: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """``id``, ``name``: which of ``names(name)`` each of ``texts(id, text)`` holds as a substring; empty names don't count. With ``lengths``, names of other lengths don't either.

    A join by equality on substrings of the names' lengths instead of a test of every text with every name. A name
    without a space stands inside one word, so those are looked for in the different words of a text only; names with
    one are, in its n-grams. The lengths are those that the names have: the driver gets two numbers for each.
    """
    known = names.select("name").where(F.length("name") > 0).distinct()
    known = known if lengths is None else known.where(F.length("name").isin(*lengths))
    spaced = F.contains("name", F.lit(" "))
    found = sorted((r.s, r.n) for r in known.select(spaced.alias("s"), F.length("name").alias("n")).distinct().collect())
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    if inside := [n for s, n in found if not s]:
        # the words end in a projection of their own; beside the functions that use them they would be made again for each
        words = texts.select("id", F.array_distinct(F.split(text, " ", -1)).alias("words"))
        parts.append((words.select("id", substrings(F.col("words"), inside).alias("grams")), known.where(~spaced)))
    if across := [n for s, n in found if s]:
        parts.append((texts.select("id", F.array_distinct(F.concat(*[char_ngrams(text, n) for n in across])).alias("grams")), known.where(spaced)))
    if not parts:
        return texts.select("id").join(known, F.lit(False))
    return reduce(DataFrame.unionAll, [grams.select("id", F.explode("grams").alias("name")).join(some, "name").select("id", "name") for grams, some in parts])


def prefer_longest(found: DataFrame) -> DataFrame:
    """``found(id, name)`` as one row an id: names, long ones first, two characters only outside of longer ones."""
    listed = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("l"), F.col("name")))).alias("n"))
    names = F.transform("n", lambda x: x["name"])
    return listed.select("id", F.filter(names, lambda x: (F.length(x) > 2) | ~F.exists(names, lambda y: (F.length(y) > 2) & F.contains(y, x))).alias("names"))


def decayed_merge(old: DataFrame, new: DataFrame, key: str, count: str, aliases: str, decay: float = 0.85) -> DataFrame:
    """Full outer merge of two inventories: counts of the old fade (rounded half to even), the larger stays, aliases are united."""
    a, b = old.select(key, F.col(count).alias("oc"), F.col(aliases).alias("oa")), new.select(key, F.col(count).alias("nc"), F.col(aliases).alias("na"))
    none = F.array().cast("array<string>")
    return a.join(b, key, "full_outer").select(key, F.greatest(F.bround(F.coalesce("oc", F.lit(0)) * F.lit(decay)), F.coalesce("nc", F.lit(0)).cast("double")).cast("long").alias(count), F.array_sort(F.array_union(F.coalesce("oa", none), F.coalesce("na", none))).alias(aliases))


def threshold(rows: DataFrame, by: str, count: str, share: float) -> DataFrame:
    """``by``, ``threshold``: the nearest-rank percentile of ``count``."""
    return rows.groupBy(by).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {count})").alias("threshold"))


def mode_first(rows: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """``by``, ``value``: the most frequent value of each group, of equals the one seen first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("p")).alias("p"))).alias(value))


def bound_evidence(claims: DataFrame, pool: DataFrame, key: str, evidence: str) -> DataFrame:
    """Claims with the evidence ids that ``pool(id)`` has, in order; a claim without any goes."""
    each = claims.select(key, F.posexplode(evidence).alias("p", "id"))
    kept = each.join(pool.select("id").distinct(), "id", "left_semi").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias(evidence))
    return claims.drop(evidence).join(kept, key)


def occurrences(text: Column, name: Column) -> Column:
    """How often a name stands in a text, without overlaps."""
    return F.when(F.length(name) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).cast("int"))
