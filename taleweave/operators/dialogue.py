"""Dialogue in lines of text: who says what, by rule and by what stands before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.speech import clean_speaker
from .graphs import written

OPEN, CLOSE = r"[\"“「『]", r"[\"”」』]"
#: (rule, confidence, pattern, group of the speaker, group of what is said) of a line; the first that matches counts, group 0 is nobody.
LINE_RULES = (
    ("named_colon", 0.92, rf"^\s*([^\s:：\"“「『][^:：\"“「『]{{0,19}})[:：]\s*{OPEN}(.+){CLOSE}\s*$", 1, 2),
    ("named_colon_bare", 0.80, r"^\s*([^\s:：\"“「『][^:：\"“「『]{0,19})[:：]\s*([^\"“「『]+)$", 1, 2),
    ("postfix_said", 0.88, rf"^\s*{OPEN}(.+?){CLOSE}\s*[,，]?\s*(?:said|asked|cried)\s+(\S+?)[.。]?\s*$", 2, 1),
    ("said_prefix", 0.85, rf"^\s*(\S+)\s+(?:said|asked|cried)[,，:：]?\s*{OPEN}(.+){CLOSE}\s*$", 1, 2),
    ("quote", 0.0, rf"^\s*{OPEN}(.+){CLOSE}\s*$", 0, 1),
)


def parse_lines(lines: DataFrame, by: str, order: str, text: str, rules: tuple = LINE_RULES, inherit: float = 0.45) -> DataFrame:
    """``by``, ``order``, ``speaker``, ``content``, ``rule``, ``confidence`` of the lines of ``text`` in which someone speaks.

    A quote without a name inherits the last named speaker of its group, at the confidence ``inherit``; where none
    stands before it, it is unresolved.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hit = F.lit(None).cast("struct<speaker:string,content:string,rule:string,confidence:double>")
    for rule, confidence, pattern, who, said in reversed(rules):
        speaker = clean_speaker(F.regexp_extract(t, pattern, who)) if who else F.lit(None).cast("string")
        hit = F.when(t.rlike(pattern), F.struct(speaker.alias("speaker"), F.trim(F.regexp_extract(t, pattern, said)).alias("content"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"))).otherwise(hit)
    spoken = lines.withColumn("__hit", hit).where(F.col("__hit").isNotNull()).select(by, order, "__hit.*")
    before = F.last("speaker", ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    found = spoken.withColumn("__before", before)
    named = F.col("speaker").isNotNull()
    return found.select(
        by, order, F.coalesce("speaker", "__before").alias("speaker"), "content", F.when(named, F.col("rule")).when(F.col("__before").isNotNull(), "inherited").otherwise("unresolved").alias("rule"), F.when(named, F.col("confidence")).when(F.col("__before").isNotNull(), inherit).otherwise(0.0).alias("confidence")
    )


def best_matches(left: DataFrame, right: DataFrame, by: str, least: float = 0.45) -> DataFrame:
    """``by``, ``l``, ``r``, ``score``: what ``left(by, l, text)`` and ``right(by, r, text)`` of one group fit best: equal texts 3, one inside the other 2, else the likeness of their characters from ``least``; each side's best partner must be the other (of equals the first).

    A right row serves one left row only. Groups are windows of a text, whose rows are few.
    """
    both = left.select(by, "l", F.col("text").alias("x")).join(right.select(by, "r", F.col("text").alias("y")), by)
    a, b = (F.array_distinct(F.filter(F.split(F.col(c), ""), lambda z: z != "")) for c in "xy")
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    score = F.when(F.col("x") == F.col("y"), 3.0).when(F.contains("x", "y") | F.contains("y", "x"), 2.0).otherwise(F.round(share, 6))
    scored = both.withColumn("score", score).where(F.col("score") >= least)
    place = lambda one, other: F.row_number().over(Window.partitionBy(by, one).orderBy(F.desc("score"), other))
    return scored.withColumns({"__l": place("l", "r"), "__r": place("r", "l")}).where("__l = 1 AND __r = 1").select(by, "l", "r", "score")


def matched_once(left: DataFrame, right: DataFrame, by: str, least: float = 0.45) -> DataFrame:
    """``by``, ``l``, ``r``, ``score`` as ``best_matches`` scores them, each row of a side in one pair at most: the best pair first, of equals that with the first ``l``, then ``r``; a row whose best partner is taken gets its next best.

    Rows meet by characters: of the rarer ones of its group, as many of a text as a partner of ``least`` likeness must
    share one of, against all characters of the other. Pairs are taken in rounds: in each those that are each other's
    best among what is left, which is what taking them one by one from the best on gives.
    """

    def chars(rows: DataFrame, key: str) -> DataFrame:
        distinct = F.array_distinct(F.filter(F.split("text", ""), lambda z: z != ""))
        return rows.where(F.length("text") > 0).select(by, key, F.col("text"), F.size(distinct).alias("n"), F.explode(distinct).alias("c"))

    a, b = chars(left, "l"), chars(right, "r")
    counts = a.select(by, "c").unionAll(b.select(by, "c")).groupBy(by, "c").agg(F.count("*").alias("df"))
    head = lambda rows, key: rows.join(counts, [by, "c"]).withColumn("p", F.row_number().over(Window.partitionBy(by, key).orderBy("df", "c"))).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    met = head(a, "l").select(by, "l", "c").join(b.select(by, "r", "c"), [by, "c"]).select(by, "l", "r").unionAll(a.select(by, "l", "c").join(head(b, "r").select(by, "r", "c"), [by, "c"]).select(by, "l", "r")).distinct()
    both = met.join(left.select(by, "l", F.col("text").alias("x")), [by, "l"]).join(right.select(by, "r", F.col("text").alias("y")), [by, "r"])
    x, y = (F.array_distinct(F.filter(F.split(F.col(c), ""), lambda z: z != "")) for c in "xy")
    score = F.when(F.col("x") == F.col("y"), 3.0).when(F.contains("x", "y") | F.contains("y", "x"), 2.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 6))
    rest = written(both.withColumn("score", score).where(F.col("score") >= least).select(by, "l", "r", "score"), "pairs")
    taken = rest.limit(0)
    while not rest.isEmpty():
        place = lambda one, other: F.row_number().over(Window.partitionBy(by, one).orderBy(F.desc("score"), other))
        best = written(rest.withColumns({"__l": place("l", "r"), "__r": place("r", "l")}).where("__l = 1 AND __r = 1").select(by, "l", "r", "score"), "matches")
        taken = taken.unionByName(best)
        rest = written(rest.join(best.select(by, "l"), [by, "l"], "left_anti").join(best.select(by, "r"), [by, "r"], "left_anti"), "pairs")
    return taken
