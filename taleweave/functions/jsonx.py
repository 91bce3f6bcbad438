"""Tolerant reading of JSON in model output, and checks on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_block(text: Column) -> Column:
    """The outermost object or array of a text, without a code fence around it; null if there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", "")
    found = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)^[^\[{]*(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")))
    return F.coalesce(found, F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")))


def tolerant(text: Column, schema: str) -> Column:
    return F.from_json(json_block(text), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedControlChars": "true"})


def looks_cut(text: Column) -> Column:
    """Whether more brackets open than close, as in an answer cut off."""
    n = lambda c: F.length(text) - F.length(F.translate(text, c, ""))
    return (n("{") > n("}")) | (n("[") > n("]"))


def story_time(raw: Column) -> Column:
    """Normal form of a story time: whole year or null, confidence within 0 and 1, and -1 as the year before rebirth."""
    period = F.coalesce(F.trim(raw["period"]), F.lit(""))
    year = raw["year"].cast("string").try_cast("int")
    return F.struct(F.coalesce(year, F.when(period == "转生前", -1)).alias("year"), period.alias("period"), F.coalesce(F.trim(raw["label"]), F.lit("")).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"))
