"""Text expressions: pure Column builders, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: an expression used twice inside another is computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Character n-grams in order, repeats included; a text shorter than ``n`` has none.

    The text is split once: taking substrings by place would read it from its start for each of them.
    """

    def grams(c: Column) -> Column:
        return F.when(F.size(c) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)])))

    return bound(chars(text), grams)


def token_set(text: Column) -> Column:
    """Different lower-cased ASCII words and single CJK characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|" + CJK), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """One token a CJK character, 0.3 any other, rounded down."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.floor((F.length(text) - cjk) * 3 / 10)).cast("long")


def cjk_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(text, F.lit(CJK)) / F.length(text))


def strip_invisible(text: Column) -> Column:
    """Without control characters (but tab, line feed, carriage return), zero-width and private-use ones."""
    return F.regexp_replace(text, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}\x{feff}\x{e000}-\x{f8ff}]", "")


FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))


def normalize_text(text: Column) -> Column:
    """Full-width ASCII and the ideographic space become plain; three line feeds or more become two, three spaces or more one."""
    t = F.translate(text, FULL_WIDTH + "　", HALF_WIDTH + " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), " {3,}", " ")


#: Lines of advertisement and of nothing but marks; fixed values of the cleaning rules.
# What makes a line an advert, and what makes it junk.
AD_LINE = (
    r"(?i)("
    r"www\.[a-z0-9.-]+"
    r"|http[s]?://[^\s]+"
    r"|请记住.*?(?:网址|域名|地址)"
    r"|更多精彩.*?(?:请访问|尽在|请关注)"
    r"|本章未完.*?(?:请点击|下一页)"
    r"|求(?:推荐票|月票|收藏|订阅|打赏)"
    r"|本书.*?(?:首发|来自|转载)"
    r"|看最快更新.*?(?:就上|就来)"
    r"|如果.*?(?:觉得好看|觉得不错|喜欢).*?(?:请收藏|请投票|请推荐)"
    r"|^[（(]?(?:译注|注|※|\*).*?[）)]?\s*$"
    r"|^\s*[\|｜].*?[\|｜]\s*$"
    r")"
)
JUNK_LINES = (r"(?U)^[^\w\u4e00-\u9fff]{10,}$", r"^[\d\s.,;:!?，。；：！？、]+$", r"^(.)\1{8,}$")
MIN_SCORE = 0.3


def line_score(line: Column, ads: str = AD_LINE, junk: tuple[str, ...] = JUNK_LINES) -> Column:
    """0 (advert) to 1 (text); blank lines have 0.5 and single characters 0.3."""
    t = F.trim(line)
    score = F.when(t == "", 0.5).when(F.length(t) < 2, 0.3).when(t.rlike(ads), 0.0)
    for pattern in junk:
        score = score.when(t.rlike(pattern), 0.1)
    return score.otherwise(1.0)


def clean_lines(text: Column, least: float = MIN_SCORE) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: line_score(x) >= least), "\n")


#: Markdown marks and what replaces them, in this order.
MARKDOWN = (
    (r"(?m)^#{1,6}[ \t]+", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`\n]+)`", "$1"), (r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    (r"\[([^\]\n]+)\]\([^)\n]*\)", "$1"), (r"(?m)^>[ \t]?", ""), (r"(?m)^[-*+][ \t]+", ""), (r"(?m)^(?:-{3,}|\*{3,})[ \t]*$", ""),
)


def strip_markdown(text: Column) -> Column:
    for pattern, new in MARKDOWN:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


SENTENCE_END = r"(?<=[.!?。！？」』”])"


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    """Sentences with their closing marks; blank ones are left out."""
    return F.filter(F.split(text, end, -1), lambda s: F.trim(s) != "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def page_title(html: Column, short: int = 60) -> Column:
    """The title element, else the first h1, else the first short line of the text."""
    def inner(tag: str) -> Column:
        return F.nullif(F.trim(strip_tags(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))), F.lit(""))

    lines = F.filter(F.split(strip_tags(html), "\n", -1), lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= short))
    return F.coalesce(inner("title"), inner("h1"), F.trim(F.get(lines, F.lit(0))), F.lit(""))


def clip(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit(mark)))


def clip_head_tail(text: Column, most: int, mark: str = "…") -> Column:
    """The first 70% and the last 30% of ``most`` characters of a longer text."""
    head = int(most * 0.7)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(most - head))))


#: Numerals of one character.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def numeral(text: Column) -> Column:
    """0 to 99 in Chinese numerals or any number in digits; null for anything else."""
    digit = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    t = F.trim(text)
    tens, ones = F.regexp_extract(t, "^(.?)十(.?)$", 1), F.regexp_extract(t, "^(.?)十(.?)$", 2)
    part = lambda c, default: F.when(c == "", default).otherwise(F.try_element_at(digit, c))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(F.length(t) == 1, F.when(t == "十", 10).otherwise(F.try_element_at(digit, t))).when(t.rlike("^.?十.?$"), part(tens, 1) * 10 + part(ones, 0))


def series_of(doc_id: Column) -> Column:
    """The series of a document id ``series__volNN``."""
    return F.regexp_replace(doc_id, r"(?i)__vol\d+$", "")


def volume_of(doc_id: Column) -> Column:
    return F.regexp_extract(doc_id, r"(?i)__vol(\d+)$", 1).try_cast("int")


def make_doc_id(series: Column, volume: Column) -> Column:
    return F.when(volume.isNull(), series).otherwise(F.format_string("%s__vol%02d", series, volume))


def volume_hint(query: Column) -> Column:
    return F.coalesce(numeral(F.regexp_extract(query, "第([一二三四五六七八九十两零〇0-9]+)[卷册部]", 1)), F.regexp_extract(query, r"(?i)\bvol(?:ume)?\.?\s*([0-9]+)", 1).try_cast("int"))


def section_hint(query: Column) -> Column:
    return F.coalesce(numeral(F.regexp_extract(query, "第([一二三四五六七八九十两零〇0-9]+)[章回节话]", 1)), F.regexp_extract(query, r"(?i)\bchapter\s*([0-9]+)", 1).try_cast("int"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "-"), F.lit("-"))


def fingerprint(text: Column) -> Column:
    return F.left(F.sha2(empty_if_null(text), 256), F.lit(16))
