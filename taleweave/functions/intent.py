"""What a question asks for: an ordered cascade of patterns, and the channels that each kind searches.

A model may route instead; this is the deterministic form that stands in for one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (intent, pattern, confidence) in the order in which they are tried; the first that matches counts.
CASCADE = (
    ("global", r"(?i)整本|全书|主线|overall|whole (?:book|story)|main plot", 0.9),
    ("imitate", r"(?i)模仿|语气|口吻|in the (?:style|voice) of|imitate|speak like", 0.9),
    ("relation", r"(?i)关系|恩怨|relationship|relation between|how .+ know each other", 0.85),
    ("character", r"(?i)是谁|性格|身份|who is|personality|character of", 0.85),
    ("narrative", r"(?i)发生了什么|经过|情节|what happens|what happened|plot of|scene", 0.8),
    ("question", r"(?i)[?？]\s*$|^(?:who|what|when|where|why|how|which)\b|吗$|呢$", 0.6),
)
#: Weights of the channels (narrative, dialogue, qa, character) of each intent.
CHANNELS = {
    "global": (1.0, 0.2, 0.5, 0.5), "imitate": (0.2, 1.0, 0.1, 0.6), "relation": (0.6, 0.3, 0.4, 1.0), "character": (0.5, 0.4, 0.4, 1.0),
    "narrative": (1.0, 0.3, 0.4, 0.2), "question": (0.7, 0.3, 1.0, 0.4), "default": (1.0, 0.5, 0.5, 0.5),
}


def intent(query: Column) -> Column:
    """``intent``, ``confidence`` and ``weights`` of a question; ``default`` at 0.3 if no pattern matches."""
    kind = lambda name, sure: F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"), F.array(*[F.lit(w) for w in CHANNELS[name]]).alias("weights"))
    out = kind("default", 0.3)
    for name, pattern, sure in reversed(CASCADE):
        out = F.when(query.rlike(pattern), kind(name, sure)).otherwise(out)
    return out


def variants(answer: Column, query: Column, most: int = 3) -> Column:
    """The question, then the ``most`` different rewrites that a model's answer lists, without thoughts, fences, bullets and quotes."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?(?:</think>|$)", ""), r"```[A-Za-z]*", "")
    lines = F.transform(F.split(bare, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]|[0-9]+[.)、])\s*", ""), r"^[\"“「']|[\"”」']$", ""))
    kept = F.filter(F.array_distinct(F.transform(lines, F.trim)), lambda x: (x != "") & (x != query))
    return F.concat(F.array(query), F.slice(kept, 1, most))
