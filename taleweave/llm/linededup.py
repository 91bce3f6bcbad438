"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words. A line with ``least`` different words or more goes if an earlier
line, by document id and line number, has a Jaccard similarity of ``threshold`` or more to it, or is the same
string. Shorter lines stay. Whatever else matches, the earliest line of all stays.

* Equal lines are brought together by a 128-bit hash; only the first of each goes on, with its prefix.
* Words of a line are ordered by rarity: words fall into a fixed number of hash buckets, counted over all
  lines, and the order is that of the bucket's count, roughly, then of the word's hash. Any total order is exact; this
  one needs no vocabulary.
* Two similar lines share a word among the rarest few of each (the prefix). Prefixes are joined by word, under
  the length filter and the positional filter: words that stand before the first shared one have no partner.
  A pair shows at the start of each run of shared words only.
* A word of over ``hot`` prefixes doesn't join alone: similar lines share at least two words of the prefix that is
  one word longer, so such a word joins together with each word after it.
* A set also has 128 parity bits. Sets differ in as many words as their bits do, at least, which drops nearly all
  candidates that are not similar before any text is fetched.
* Groups of near copies would pair each line with each. So each line first meets the line that comes before it
  among those with the same two neighbouring words of the prefix (dealt over ``SALTS`` lists, so that no words fill
  a task). That settles nearly all lines of a large group; only lines not settled so ask all others. Verification
  is on the words.

Only DataFrame operations run on texts. Each phase is written to the shared folder, so a lost executor costs
no more than the phase. A null text stays null; empty lines stay. Rows with one id count as one document:
lines at equal places of them don't remove each other, so repeated rows get the same result. A null id comes
before all others. Ids that aren't integers are ordered as strings. Columns of the input stay as they are; an added
column whose name is taken has underscores before it. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import free_name, listed, written

BUCKET_BITS = 17
SALTS, LEADING, BEFORE, ASKED = 2, 3, 6, 8
#: All pairs of so many lines are about ``ASKED`` a line.
CROWD = 2 * ASKED
#: Words from which a line has its second 64 parity bits.
LONG = 64
ADDED = ("n_lines", "n_removed", "n_left")
SPACE = r"[\x20\x09-\x0D]+"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: an expression used twice inside another is computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(line: Column) -> Column:
    """The words of a line in a form in which they are equal just if they are equal but for the case of A-Z; some may be empty.

    The bytes are read as Latin-1 and lower-cased: besides A-Z that changes lead bytes of UTF-8 sequences, always to
    such of longer sequences, so that different words stay different. It takes a fraction of the time of ``translate``,
    as does splitting at the space alone where a line has no other white space. ASCII is the same in Latin-1.
    """
    plain = F.when(F.octet_length(line) == F.char_length(line), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.split(F.lower(plain), F.when(odd, F.lit(SPACE)).otherwise(F.lit(" ")), -1)


def word_hashes(line: Column) -> Column:
    """One number for each different word."""
    return F.array_remove(F.array_distinct(F.transform(tokens(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def needed(n: Column, threshold: float) -> Column:
    """The least overlap that a set of n words has with any similar one."""
    return F.ceil(n * threshold - 1e-9).cast("int")


class Rarity:
    """Hash buckets by the number of words they hold, over all texts, as a constant of the plan.

    The driver gets the levels of all buckets as one short string, ``levels``, not as a row a bucket. A bucket's level
    is the logarithm of its count of two in eighths, so that the constant is short; words of one level are in the
    order of their hashes. ``calm`` is the first level that buckets of over ``hot`` words can have.
    """

    def __init__(self, texts: DataFrame, hot: int) -> None:
        lines = texts.select(F.explode(lines_of(F.col("text"))).alias("t"))
        counts = lines.select(F.explode(tokens(F.col("t"))).alias("w")).select(self.bucket(F.xxhash64("w")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
        level = F.coalesce(F.floor(F.log2(F.col("n") + 1) * 8), F.lit(0)).cast("int").alias("level")
        every = texts.sparkSession.range(1 << BUCKET_BITS).join(counts, F.col("id") == F.col("bucket"), "left").select(F.struct("id", level).alias("at"))
        self.levels = every.agg(F.array_join(F.sort_array(F.collect_list("at"))["level"].cast("array<string>"), ",")).first()[0]
        self.calm = self.level(hot)

    @staticmethod
    def level(n: int) -> int:
        return int(8 * math.log2(n + 1))

    @staticmethod
    def bucket(h: Column) -> Column:
        return h.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")

    def ordered(self, hashes: Column) -> Column:
        """Words, given by their hashes, as numbers, rarest first: the level in the 9 highest bits below the sign, then of the hash all but its lowest 10 bits."""
        levels = F.split(F.lit(self.levels), ",").cast("array<bigint>")
        # never null, as Spark then sorts plain numbers
        return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(levels, self.bucket(h)), F.lit(0).cast("bigint")), 54).bitwiseXOR(F.shiftrightunsigned(h, 10))))

    def is_calm(self, number: Column) -> Column:
        return number < F.lit(min(self.calm << 54, (1 << 63) - 1))


def parity(hashes: Column, second: bool = False) -> Column:
    """64 bits, each the parity of the words it stands for: two sets differ in as many words as their bits differ, at least. ``second``: only of the words with the seventh highest bit."""
    shift = lambda one, h: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 58).cast("int"))
    one = lambda h: F.shiftrightunsigned(h, 57).bitwiseAND(F.lit(1).cast("bigint")) if second else F.lit(1).cast("bigint")
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(shift(one(h), h)))


def packed(high: Column, low: Column) -> Column:
    """Two numbers of 32 bits as one."""
    return F.call_function("shiftleft", high.cast("bigint"), F.lit(32)).bitwiseOR(low.cast("bigint"))


def high(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def unlike(x, y) -> Column:
    """In how many words the sets differ, at least, by their parity bits; ``x`` and ``y`` give a side's columns by name."""
    first, more = x("bits").bitwiseXOR(y("bits")), x("more").bitwiseXOR(y("more"))
    return F.when((low(x("ln")) >= LONG) & (low(y("ln")) >= LONG), F.bit_count(first) + F.bit_count(more)).otherwise(F.bit_count(first.bitwiseXOR(more)))


def close_enough(x, y, x_at: Column, y_at: Column, threshold: float) -> Column:
    """The length filter, the positional filter on the first shared word, at x_at and y_at, and the parity filter."""
    xn, yn = low(x("ln")), low(y("ln"))
    # not rounded, which takes longer: it is only a little wider, and not at all for parity bits, which are odd in number just if both lengths together are
    differ = (xn + yn) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (xn >= yn * threshold - 1e-9) & (yn >= xn * threshold - 1e-9) & (x_at + y_at <= differ) & (unlike(x, y) <= differ)


def later(x, y) -> Column:
    return (x("id") > y("id")) | ((x("id") == y("id")) & (high(x("ln")) > high(y("ln"))))


def first_lines(keyed: DataFrame, rarity: Rarity, threshold: float, least: int) -> DataFrame:
    """Of each string with ``least`` words or more the first place ``id``, ``line``, the hashes ``h`` and ``g``, how many ``copies`` it has, its number of words ``n``, ``bits`` and ``more``, its prefix and one word more, rarest first, and how many of these are ``calm``, that is surely in few lines."""

    # outer, so that no filter on the generated array is inferred, which would compute it twice; the words of a line
    # are no lambda's, for what stands in a lambda is interpreted, not compiled
    lines = keyed.select("id", F.posexplode_outer(lines_of(F.col("text"))).alias("line", "t")).where(F.octet_length("t") >= 2 * least - 1)
    each = lines.select("id", "line", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), word_hashes(F.col("t")).alias("w"))
    n = F.size("w")
    longer = F.slice(rarity.ordered(F.col("w")), F.lit(1), F.least(n, n - needed(n, threshold) + 2))
    more = F.when(n >= LONG, parity(F.col("w"), second=True)).otherwise(F.lit(0).cast("bigint"))
    of = lambda x: F.when(n >= least, x)
    each = each.select("id", "line", "h", "g", n.alias("n"), of(parity(F.col("w"))).alias("all"), of(more).alias("more"), of(longer).alias("p"))
    # a prefix keeps 32 bits of a word: words that fall together only make a candidate more; of the words without the
    # bit are what the second ones leave of all
    prefix, calm = F.transform("p", lambda w: F.hash(w)), F.size(F.filter("p", rarity.is_calm))
    each = each.select("id", "line", "h", "g", "n", F.col("all").bitwiseXOR(F.col("more")).alias("bits"), "more", prefix.alias("prefix"), calm.alias("calm"))
    rest = [F.first(c).alias(c) for c in ("n", "bits", "more", "prefix", "calm")]
    first = each.groupBy("h", "g").agg(F.min(F.struct("id", "line")).alias("at"), F.count("*").alias("copies"), *rest)
    # only here: before, the filter would go below and compute the words twice
    return first.where(F.col("n") >= least).select("at.id", "at.line", "h", "g", "copies", "n", "bits", "more", "prefix", "calm")


def verified(pairs: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``line``, ``h`` and ``g`` of the later line of each of ``pairs(xid, xline, yid, yline)`` that is similar."""
    ends = pairs.select(F.col("xid").alias("id"), F.col("xline").alias("line")).union(pairs.select("yid", "yline"))
    ends = written(ends.distinct(), "ends")
    lines = keyed.select("id", F.posexplode_outer(lines_of(F.col("text"))).alias("line", "t")).where(F.col("t").isNotNull())
    lines = lines.join(listed(ends), ["id", "line"], "left_semi")
    both = pairs.join(lines.toDF("yid", "yline", "yt"), ["yid", "yline"]).join(lines.toDF("xid", "xline", "xt"), ["xid", "xline"])
    sets = F.array(F.struct(F.array_remove(F.array_distinct(tokens(F.col("xt"))), "").alias("x"), F.array_remove(F.array_distinct(tokens(F.col("yt"))), "").alias("y")))

    def similar(s: Column) -> Column:
        return bound(F.size(F.array_intersect(s["x"], s["y"])), lambda o: o >= (F.size(s["x"]) + F.size(s["y"]) - o) * threshold - 1e-9)

    return both.where(F.element_at(F.transform(sets, similar), 1)).select(F.col("xid").alias("id"), F.col("xline").alias("line"), F.xxhash64("xt").alias("h"), F.xxhash64(F.lit(1), "xt").alias("g")).distinct()


def neighbours(firsts: DataFrame, threshold: float) -> DataFrame:
    """Each line with one before it of those with the same two neighbouring words of the prefix, if they may be similar.

    The last words of the prefix are taken: in a large group of near copies these are the words of the group, while
    the rarest words of a line are those that it has alone. Of the first line of a list and the ``BEFORE`` that stand
    right before, over all lists of a line, the ``ASKED`` with the most like parity bits are its neighbours. Lists of
    ``CROWD`` lines or fewer are left to the join: all their pairs are hardly more than ``ASKED`` for each line.
    """
    salt = F.pmod(F.xxhash64("id", "line"), F.lit(SALTS))
    last = F.col("n") - needed(F.col("n"), threshold)
    pair = lambda k: F.when(last > k, F.xxhash64(F.get("prefix", last - k), F.get("prefix", last - k - 1), salt))
    side = F.struct("id", packed(F.col("line"), F.col("n")).alias("ln"), "bits", "more").alias("x")
    rows = firsts.select(side, F.explode(F.array(*[pair(k) for k in range(LEADING)])).alias("key")).where(F.col("key").isNotNull())
    crowded = rows.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") > CROWD).select("key")
    rows = rows.join(listed(written(crowded, "crowded")), "key", "left_semi")
    before = Window.partitionBy("key").orderBy("x.id", "x.ln")
    met = rows.select("x", F.first("x").over(before).alias("y0"), *[F.lag("x", k).over(before).alias(f"y{k}") for k in range(1, BEFORE + 1)])
    # most words have one line alone
    met = met.where(F.col("y1").isNotNull()).select("x", F.array(*[f"y{k}" for k in range(BEFORE + 1)]).alias("ys"))
    x = lambda c: F.col("x")[c]

    def near(y: Column) -> Column:
        of = lambda c: y[c]
        return F.when(y.isNotNull() & later(x, of) & close_enough(x, of, F.lit(0), F.lit(0), threshold), F.struct(unlike(x, of).alias("d"), y["id"].alias("id"), y["ln"].alias("ln")))

    pairs = met.select("x", F.explode(F.array_compact(F.transform("ys", near))).alias("y")).groupBy("x.id", "x.ln").agg(F.collect_set("y").alias("ys"))
    best = pairs.select("id", "ln", F.explode(F.slice(F.array_sort("ys"), 1, ASKED)).alias("y"))
    return best.select(F.col("id").alias("xid"), high(F.col("ln")).alias("xline"), F.col("y.id").alias("yid"), high(F.col("y.ln")).alias("yline"))


def postings(asked: DataFrame, firsts: DataFrame, threshold: float, hot: int) -> DataFrame:
    """``key``, ``id``, ``ln`` (line and words), ``pi`` (the word before and, twice, the place of the word; odd if the line asks), ``bits``, ``more``."""
    known = ("id", packed(F.col("line"), F.col("n")).alias("ln"), "bits", "more")
    own = F.col("n") - needed(F.col("n"), threshold) + 1
    about = lambda before, i: packed(before, i * 2 + F.col("asks").cast("int"))
    frequent = written(firsts.select(F.explode(F.slice("prefix", F.col("calm") + 1, F.size("prefix"))).alias("word")).groupBy("word").agg(F.count("*").alias("lines")).where(F.col("lines") > hot).select("word"), "frequent")
    before = lambda i: F.coalesce(F.get("prefix", i - 1), F.lit(0))
    # the first word has none before it: a number that no pair has in common stands for it
    each = asked.select("n", *known, "asks", "prefix", F.posexplode_outer("prefix").alias("i", "word")).where(F.col("i") < own)
    alone = each.select("word", "id", "ln", "bits", "more", about(before(F.col("i")), F.col("i")).alias("pi"))
    if frequent.isEmpty():
        return alone.select(F.col("word").cast("bigint").alias("key"), "id", "ln", "pi", "bits", "more")
    alone = alone.join(listed(frequent), "word", "left_anti").select(F.col("word").cast("bigint").alias("key"), "id", "ln", "pi", "bits", "more")
    places = asked.where(F.col("calm") < F.size("prefix")).select("h", "g", *known, "asks", "prefix", F.posexplode("prefix").alias("i", "word")).join(listed(frequent), "word", "left_semi")
    lines = places.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in ("id", "ln", "bits", "more", "asks", "prefix")), F.collect_set("i").alias("at"))
    twos = F.flatten(F.transform("at", lambda i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda b: F.struct(i.alias("i"), F.xxhash64(F.get("prefix", i), b).alias("key")))))
    by_two = lines.select("id", "ln", "bits", "more", "asks", F.inline(twos)).select("key", "id", "ln", packed(F.lit(0), F.col("i") * 2 + F.col("asks").cast("int")).alias("pi"), "bits", "more")
    return alone.union(by_two)


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of an asking line and an earlier one that share a key and may be similar."""
    x, y = (rows.toDF("key", *(side + c for c in ("id", "ln", "pi", "bits", "more"))) for side in "xy")
    xi, yi = low(F.col("xpi")), low(F.col("ypi"))
    # of both sides, lest one side be filtered before the rows are dealt out, which would deal them out twice
    asks = (xi.bitwiseAND(F.lit(1)) == 1) | (yi < 0)
    # at 0 there is no word before
    starts = (high(F.col("xpi")) != high(F.col("ypi"))) | (xi < 2) | (yi < 2) | (high(F.col("xpi")) == 0)
    of_x, of_y = (lambda c: F.col("x" + c)), (lambda c: F.col("y" + c))
    near = close_enough(of_x, of_y, F.shiftright(xi, 1), F.shiftright(yi, 1), threshold)
    return x.join(y, "key").where(later(of_x, of_y) & near & starts & asks).select("xid", high(F.col("xln")).alias("xline"), "yid", high(F.col("yln")).alias("yline")).distinct()


def key_of(id: Column, kind: T.DataType) -> Column:
    """An id that is never null: null comes first."""
    if isinstance(kind, T.IntegralType):
        return F.coalesce(id.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit("1"), id.cast("string")), F.lit("0"))


def many_words(line: Column, least: int) -> Column:
    """Whether a line has ``least`` different words: most lines show it in their first words."""
    some = F.substring(line, 1, 16 * least)
    enough = F.size(F.array_distinct(tokens(some))) > least + 1  # the last can be cut, one can be empty
    return enough | (F.size(word_hashes(line)) >= least)


def dedup_lines(docs: DataFrame, *, text: str = "text", id: str = "doc_id", threshold: float = 0.8, least: int = 5, hot: int = 4096) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``, and ``n_lines``, ``n_removed``, ``n_left`` (lines of ``least`` words or more that stay)."""
    named = {c: free_name(docs, c) for c in ADDED}
    key, whole = key_of(F.col(id), docs.schema[id].dataType), F.xxhash64(F.col(text).cast("string"))
    keyed = docs.where(F.col(text).isNotNull()).select(key.alias("id"), whole.alias("of"), F.col(text).cast("string").alias("text"))
    firsts = written(first_lines(keyed, Rarity(keyed, hot), threshold, least), "firsts")
    place = ["id", "line", "h", "g"]
    alike = written(verified(written(neighbours(firsts, threshold), "neighbours"), keyed, threshold), "alike")
    settled = written(firsts.select(*place).join(listed(alike), place, "left_semi"), "settled")
    asked = firsts.join(listed(settled.withColumn("settled", F.lit(True))), place, "left").withColumn("asks", F.col("settled").isNull())
    pairs = written(candidates(postings(asked, firsts, threshold, hot), threshold), "pairs")
    found = written(settled.union(verified(pairs, keyed, threshold)).distinct(), "found")

    # strings of which a line goes: those with copies, and those like an earlier one
    fate = firsts.join(listed(found.withColumn("goes", F.lit(True))), place, "left").where((F.col("copies") > 1) | F.col("goes")).select("h", "g", F.col("id").alias("at"), F.col("line").alias("at_line"), F.coalesce("goes", F.lit(False)).alias("goes"))
    hashes = F.transform(lines_of(F.col("text")), lambda t, k: F.struct(k.cast("int").alias("line"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("g")))
    occurs = keyed.select("id", "of", F.inline(hashes)).join(listed(written(fate, "fate")), ["h", "g"])
    going = occurs.where(F.col("goes") | (F.col("id") != F.col("at")) | (F.col("line") != F.col("at_line")))
    going = written(going.groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.collect_set("line").alias("__going")), "going")
    if (going.agg(F.sum(F.size("__going"))).first()[0] or 0) <= common.BROADCAST_ROWS:  # then no text is dealt out
        going = F.broadcast(going)

    out = docs.withColumns({"__key": key, "__whole": whole}).join(going, (F.col("__key") == F.col("__id")) & (F.col("__whole") == F.col("__of")), "left")

    def cut(all_: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "__going")
        left = F.when(F.col("__going").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda k: F.get(all_, k)), "\n"))
        return F.struct(left.alias("text"), F.size(all_).alias("n"), F.size(F.filter(all_, lambda t: many_words(t, least))).alias("long"))

    out = out.withColumn("__new", F.when(F.col(text).isNotNull(), bound(lines_of(F.col(text).cast("string")), cut)))
    gone = F.coalesce(F.size("__going"), F.lit(0))
    counts = {"n_lines": F.col("__new.n"), "n_removed": F.when(F.col(text).isNotNull(), F.greatest(gone, F.lit(0))), "n_left": F.col("__new.long") - F.greatest(gone, F.lit(0))}
    return out.select(*[F.col("__new.text").alias(text) if c == text else F.col(c) for c in docs.columns], *(F.coalesce(v, F.lit(0)).cast("long").alias(named[k]) for k, v in counts.items()))
