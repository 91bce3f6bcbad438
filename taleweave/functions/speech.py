"""Speech and what is said of it: speaker names, moods, questions, and texts put together for a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that show a mood, one pattern a mood, in the order in which they are asked.
MOODS = {"angry": r"(?iu)怒|骂|shout|angry|furious", "sad": r"(?iu)哭|泪|叹|sob|sigh|tear", "happy": r"(?iu)笑|喜|laugh|smile|grin", "afraid": r"(?iu)怕|惊|恐|fear|afraid|tremble"}
#: The same in English only.
MOODS_EN = {"angry": r"(?iu)shout|angry|furious", "sad": r"(?iu)sob|sigh|tear", "happy": r"(?iu)laugh|smile|grin", "afraid": r"(?iu)fear|afraid|tremble"}
#: Where a word of ASCII letters ends or begins, whatever other letters stand beside it: Java's own ``\b`` is that of ASCII only from version 19 on.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: How a question begins.
ASKS_EN = rf"^(?iu:who|what|when|where|why|how|which|is|are|does|did|can){EDGE}"
ASKS = ASKS_EN + "|^(?:谁|什么|为什么|怎么|哪)"
#: All space separators of Unicode; ``trim`` alone takes off the plain one.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: What stands before or after the name of a speaker.
SPEAKER_DEBRIS = r"^[\s\"“「『(（\[【]+|[\s\"”」』)）\]】:：,，、.。]+$|(?:说道|问道|答道|喊道|说|问|答|喊|道)$"


def mood(text: Column, moods: dict[str, str] | None = None) -> Column:
    """The first mood whose words a text has, else ``plain``."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit("plain")
    for name, pattern in reversed(list((moods or MOODS).items())):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def clean_speaker(name: Column, rounds: int = 4, debris: str = SPEAKER_DEBRIS) -> Column:
    """A speaker's name without marks and verbs of saying, taken off again and again, at most ``rounds`` times."""
    out = F.trim(F.coalesce(name, F.lit("")))
    for _ in range(rounds):
        out = F.trim(F.regexp_replace(out, debris, ""))
    return out


def is_question(text: Column, asks: str = ASKS) -> Column:
    """Ends in a question mark, or begins with a word that asks; spaces of any kind around it don't count, a line feed at the end does."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return t.rlike(r"[?？]\z") | t.rlike(asks)


def eligible(confidence: Column, evidence: Column, least: float = 0.35) -> Column:
    """Null if a claim may be a block of its own, else why not."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < least, "low_confidence").when(F.coalesce(F.size(evidence), F.lit(0)) < 1, "no_evidence")


def needs_approval(tool: Column, argument: Column, always: tuple[str, ...], patterns: dict[str, str]) -> Column:
    """Whether a tool call waits for a person: some tools always, others by what they are asked to do."""
    out = tool.isin(*always) if always else F.lit(False)
    for name, pattern in patterns.items():
        out = out | ((tool == name) & F.coalesce(argument, F.lit("")).rlike(pattern))
    return out


def relation_text(source: Column, target: Column, relation: Column, chapter: Column, summary: Column) -> Column:
    """A relation as one text for a vector."""
    return F.concat_ws(" | ", F.concat(source, F.lit(" - "), target), relation, F.nullif(chapter, F.lit("")), F.nullif(summary, F.lit("")))


def numbered(items: Column, most: int) -> Column:
    """The first ``most`` items as numbered lines."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
