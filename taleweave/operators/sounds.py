"""Names that sound alike: syllables, and the pairs of names that share all of them or all but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A syllable of a name in Latin letters: consonants, vowels, and the consonants that end the name.
LATIN = r"[^aeiouy]*[aeiouy]+(?:[^aeiouy]+$)?|[^aeiouy]+$"


def latin_syllables(name: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(name), "[^a-z]", ""), F.lit(LATIN), F.lit(0))


def with_syllables(names: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """``names(name)`` with ``syllables``: one for each character that ``readings(char, syllable)`` has (toneless), those of the Latin rule without it.

    A character without a reading stands for itself. Each name's characters meet the readings by equality.
    """
    known = names.select("name").where(F.length("name") > 0).distinct()
    if readings is None:
        return known.withColumn("syllables", latin_syllables(F.col("name")))
    chars = known.select("name", F.posexplode(F.filter(F.split("name", ""), lambda c: c != "")).alias("p", "char"))
    read = chars.join(readings.groupBy("char").agg(F.min("syllable").alias("syllable")), "char", "left")
    listed = F.array_sort(F.collect_list(F.struct("p", F.coalesce("syllable", F.col("char")).alias("s"))))
    return read.groupBy("name").agg(F.transform(listed, lambda x: x["s"]).alias("syllables"))


def sound_likeness(a: Column, b: Column) -> Column:
    """1 for equal syllables, 1 - 1/n for n syllables each of which one differs, else 0."""
    differ = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] != p["y"]))
    return F.when(F.size(a) != F.size(b), 0.0).when(differ == 0, 1.0).when(differ == 1, 1 - 1 / F.size(a)).otherwise(0.0)


def sounding_alike(spoken: DataFrame) -> DataFrame:
    """``a``, ``b`` (a < b), ``likeness`` of the names of ``spoken(name, syllables)`` that share all syllables, or all but one of two or more.

    Names meet by equality of their syllables with one of them masked; all names under one masked form are
    pairs of the result, so nothing meets in vain. A pair that shares all syllables is taken once, by the whole.
    """
    named = spoken.where(F.size("syllables") > 0)
    whole = named.select("name", F.array_join("syllables", "\u0001").alias("key"))
    equal = whole.toDF("a", "key").join(whole.toDF("b", "key"), "key").where("a < b").select("a", "b", F.lit(1.0).alias("likeness"))
    hidden = F.transform(F.sequence(F.lit(0), F.size("syllables") - 1), lambda i: F.struct(F.array_join(F.transform("syllables", lambda s, j: F.when(i == j, "\u0002").otherwise(s)), "\u0001").alias("key"), F.get("syllables", i).alias("own")))
    masked = named.where(F.size("syllables") >= 2).select("name", F.size("syllables").alias("n"), F.inline(hidden))
    x, y = masked.toDF("a", "n", "key", "own_a"), masked.select("name", "key", "own").toDF("b", "key", "own_b")
    near = x.join(y, "key").where("a < b AND own_a <> own_b").select("a", "b", F.round(1 - 1 / F.col("n"), 6).alias("likeness"))
    return equal.unionByName(near)
