"""Names of people: normal forms, noise and likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Honorifics that end or begin a name; fixed values, extended by parameters.
HONORIFIC_SUFFIXES = ("先生", "小姐", "大人", "殿下", "阁下", "同学", "老师", "前辈", "桑", "酱", "君", "様", "さん", "ちゃん", " jr", " sr", " esq")
HONORIFIC_PREFIXES = ("老", "小", "阿", "mr ", "mrs ", "ms ", "dr ", "sir ", "lady ")
#: Pronouns and the plurals that are formed from them: speakers that name nobody. Callers add the words of their corpus.
PRONOUNS = ("我", "你", "他", "她", "它")
NOISE_NAMES = (*PRONOUNS, *(p + "们" for p in PRONOUNS), *"i you he she it we they nobody narrator".split())
NOISE_ENDINGS = r"(?:说|道|问|答|喊|叫|笑|想|着|了|的|地)$"
NOISE_STARTS = r"^(?:他|她|它|我|你|这|那).{0,3}$"


def alternation(parts: tuple[str, ...]) -> str:
    return "|".join(sorted((p.replace(".", r"\.") for p in parts), key=lambda p: (-len(p), p)))


def strip_honorific(name: Column, suffixes: tuple[str, ...] = HONORIFIC_SUFFIXES, least: int = 2) -> Column:
    """A name without its honorific ending, if at least ``least`` characters stay."""
    bare = F.regexp_replace(name, rf"(?i)(?:{alternation(suffixes)})$", "")
    return F.when(F.length(bare) >= least, bare).otherwise(name)


def strip_title(name: Column, prefixes: tuple[str, ...] = HONORIFIC_PREFIXES, least: int = 2) -> Column:
    bare = F.regexp_replace(name, rf"(?i)^(?:{alternation(prefixes)})", "")
    return F.when(F.length(bare) >= least, bare).otherwise(name)


def normalize_name(name: Column, translations: dict[str, str] | None = None) -> Column:
    """Trimmed, without punctuation at its ends, translated where a translation is known."""
    bare = F.regexp_replace(F.trim(name), r"^[\s,.:;!?'\"“”「」『』（）()\-·，。：；！？]+|[\s,.:;!?'\"“”「」『』（）()\-·，。：；！？]+$", "")
    if not translations:
        return bare
    known = F.create_map(*[F.lit(x) for kv in translations.items() for x in kv])
    return F.coalesce(F.try_element_at(known, bare), bare)


def is_noise_name(name: Column, names: tuple[str, ...] = NOISE_NAMES) -> Column:
    """Pronouns, single characters, and what is rather a verb phrase."""
    n = F.trim(name)
    return n.isNull() | (F.length(n) < 2) | F.lower(n).isin(*names) | n.rlike(NOISE_ENDINGS) | n.rlike(NOISE_STARTS)


def is_weak_entity(name: Column, reject: str = r"[?？!！…]|第.+章|众人|所有") -> Column:
    return ~F.length(name).between(2, 16) | name.rlike(reject)


def within_edits(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of edited characters."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def matched_names(text: Column, names: list[str]) -> Column:
    """The names a text holds, long ones first: three characters or more as any substring, two only if no longer name holds them, one never."""
    known = sorted({n for n in names if n and len(n) >= 2}, key=lambda n: (-len(n), n))
    free = [n for n in known if len(n) > 2 or not any(n in m for m in known if len(m) > 2)]
    return F.filter(F.array(*[F.lit(n) for n in free]).cast("array<string>"), lambda n: F.contains(text, n))


def relaxed_names(names: Column) -> Column:
    """Each name, its first two characters if it has three or more, and its third and fourth if it has four or more."""
    short = F.transform(names, lambda n: F.array_compact(F.array(n, F.when(F.length(n) >= 3, F.left(n, F.lit(2))), F.when(F.length(n) >= 4, n.substr(3, 2)))))
    return F.array_distinct(F.flatten(short))
