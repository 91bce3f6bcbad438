"""Structuring texts: lines, chapters, windows, chunks, dialogue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def preprocess(docs: DataFrame, text: str = "text") -> DataFrame:
    """Invisible characters out, junk lines out, then normal form; with the lines before and after."""
    t = tx.strip_invisible(tx.empty_if_null(F.col(text)))
    clean = tx.clean_lines(t)
    return docs.withColumns({"lines_in": F.size(F.split(t, "\n", -1)), "lines_out": F.when(clean == "", 0).otherwise(F.size(F.split(clean, "\n", -1))), text: tx.normalize_text(clean)})


#: A line that begins a paragraph of its own.
BOUNDARY = r"^(?:[#*\-]|[(（【\[]|[\x{4e00}-\x{9fff}]{1,3}[:：;；]|[\"“「][^\n]*[\"”」]$|.{1,4}$)"
SENTENCE_ENDS = tuple("。！？…!?.」』\"")


def repair_paragraphs(text: Column, boundary: str = BOUNDARY) -> Column:
    """Lines joined to the one before unless that ends a sentence, or they begin a paragraph; blank lines stay."""
    lines = F.split(text, "\n", -1)
    ends = lambda s: F.right(s, F.lit(1)).isin(*SENTENCE_ENDS)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        s = F.trim(line)
        flushed = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        joins = acc["open"].isNotNull() & ~ends(acc["open"]) & ~s.rlike(boundary)
        return F.when(s == "", F.struct(F.array_append(flushed, F.lit("")).alias("done"), F.lit(None).cast("string").alias("open"))).when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), s).alias("open"))).otherwise(F.struct(flushed.alias("done"), s.alias("open")))

    end = lambda acc: F.array_join(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])), "\n")
    return F.aggregate(lines, start, step, end)


def layout(text: Column, separators: tuple[str, ...] = ("***", "* * *", "◇", "◆", "＊＊＊")) -> Column:
    """One blank line between paragraphs; a line that is a scene separator becomes ``---``."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda s: F.when(F.trim(s).isin(*separators), "---").otherwise(s)), lambda s: F.trim(s) != "")
    return F.array_join(lines, "\n\n")


# The line rules that chapter boundaries are defined by (name, weight, pattern), in their order; the first
# that matches a line counts.
CHAPTER_RULES = (
    ("markdown_heading", 0.95, r"^#{1,3}\s+(.+)"),
    ("zh_chapter", 0.98, r"^第[一二三四五六七八九十百千零两\d]+[章回节卷篇部話话](?:\s|$)"),
    ("en_chapter", 0.95, r"^(?:CHAPTER|Chapter|chapter)\s+(?:[IVXLCDM]+|\d+|[A-Z][a-z]+)"),
    ("ja_episode", 0.90, r"^第[一二三四五六七八九十百千零两\d]+[話话]\s"),
    ("ja_volume", 0.85, r"^第[一二三四五六七八九十百千零两\d]+[巻卷]"),
    ("ja_lightnovel_counter", 0.92, r"^第[一二三四五六七八九十百千零两\d]+[敗胜负]"),
    ("ja_episode2", 0.90, r"^(?:第[一二三四五六七八九十百千零两\d]+話|Episode\s*[0-9]+)"),
    ("circled_number", 0.75, r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]"),
    ("paren_number", 0.70, r"^[（(【]\s*[一二三四五六七八九十百千零两\d]+\s*[）)】]"),
    ("bare_number", 0.60, r"^[一二三四五六七八九十百千零两\d]+[、.．]\s*$"),
    ("short_line", 0.25, r"^.{4,40}$"),
)


def chapter_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple = CHAPTER_RULES) -> DataFrame:
    """``id``, ``line``, ``title``, ``rule``, ``score`` of each line that a rule takes for a chapter's start."""
    lines = docs.select(id, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t"))
    hit = F.lit(None).cast("struct<rule:string,score:double>")
    for name, weight, pattern in reversed(rules):
        hit = F.when(F.col("t").rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(weight).alias("score"))).otherwise(hit)
    title = F.left(F.trim(F.regexp_replace("t", r"^#{1,3}\s+", "")), F.lit(60))
    return lines.withColumn("hit", hit).where(F.col("hit").isNotNull()).select(id, "line", title.alias("title"), "hit.rule", "hit.score")


def chapters(docs: DataFrame, least_score: float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``chapter_idx``, ``title``, ``text``: the texts cut at lines whose rule has ``least_score``; a text without any is one chapter."""
    rules = tuple(r for r in CHAPTER_RULES if r[1] >= least_score)
    begins = lambda t: F.exists(F.array(*[F.lit(r[2]) for r in rules]), lambda p: F.rlike(t, p))
    lines = docs.select(id, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t")).withColumn("begin", begins(F.col("t")).cast("int"))
    marked = lines.withColumn("c", F.sum("begin").over(Window.partitionBy(id).orderBy("line")))
    grouped = marked.groupBy(id, "c").agg(F.array_sort(F.collect_list(F.struct("line", "t", "begin"))).alias("l"))
    head = F.get("l", F.lit(0))
    body = F.array_join(F.transform(F.filter("l", lambda x: x["begin"] == 0), lambda x: x["t"]), "\n")
    parts = grouped.select(id, "c", F.when(head["begin"] == 1, F.trim(F.regexp_replace(head["t"], r"^#{1,3}\s+", ""))).otherwise("").alias("title"), body.alias("text")).where((F.col("c") > 0) | (F.trim("text") != ""))
    return parts.withColumn("chapter_idx", F.row_number().over(Window.partitionBy(id).orderBy("c"))).select(id, "chapter_idx", "title", "text")


def skip_reason(title: Column, text: Column, least: int = 80, black: str = r"(?i)^(?:后记|前言|目录|版权|afterword|contents|copyright)", quotes: str = r"[\"“”「」『』]") -> Column:
    """Why a chapter has no dialogue worth reading; null if it may have."""
    n = F.regexp_count(text, F.lit(quotes))
    return F.when(F.trim(text) == "", "empty").when(title.rlike(black), F.when(n > 0, "title_blacklist_has_quotes").otherwise("title_blacklist")).when((F.length(text) < least) & (n == 0), "too_short_no_quotes").when(n == 0, "no_quotes")


def sliding_windows(docs: DataFrame, most: int, width: int, stride: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``window``, ``start``, ``end``, ``text``: a text of ``most`` characters or fewer whole, a longer one in overlapping windows up to its end.

    A text is cut into pieces of one stride once, and windows are put together from them: a substring for each
    window would read the text from its start each time.
    """
    full, rest = divmod(width, stride)
    parts = F.struct(F.length(text).alias("n"), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("pieces"))

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((t["n"] - width) / stride).cast("int")))
        join = lambda i: F.concat(F.array_join(F.slice(t["pieces"], i + 1, F.lit(full)), ""), F.coalesce(F.left(F.get(t["pieces"], i + full), F.lit(rest)), F.lit("")))
        window = lambda i: F.struct(i.cast("int").alias("window"), (i * stride).cast("int").alias("start"), F.least(i * stride + width, t["n"]).cast("int").alias("end"), join(i).alias("text"))
        return F.when(t["n"] <= most, F.array(F.struct(F.lit(0).alias("window"), F.lit(0).alias("start"), t["n"].cast("int").alias("end"), F.col(text).alias("text")))).otherwise(F.transform(starts, window))

    return docs.where(F.col(text).isNotNull()).select(id, tx.bound(parts, cut).alias("w")).select(id, F.inline("w"))


def flat_chunks(docs: DataFrame, most: int = 500, overlap: int = 50, least: int = 150, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``chunk``, ``text``: paragraphs packed up to ``most`` characters; a chunk begins with the last paragraphs of the one before, ``overlap`` characters or more. What is shorter than ``least`` is joined to its neighbour, so no text is lost."""

    def pack(source: str) -> list[str]:
        paragraphs = [p for p in source.split("\n") if p.strip()]
        out: list[list[str]] = []
        held: list[str] = []
        fresh = carried = 0
        for p in paragraphs:
            if fresh and sum(map(len, held)) + len(p) > most and sum(map(len, held)) >= least:
                out.append(held)
                back: list[str] = []
                for q in reversed(held):
                    if sum(map(len, back)) >= overlap or sum(map(len, back)) + len(q) > most // 2:
                        break
                    back.insert(0, q)
                held, fresh, carried = back, 0, len(back)
            held.append(p)
            fresh += len(p)
        if fresh:
            if out and fresh < least:
                out[-1] = out[-1] + held[carried:]
            else:
                out.append(held)
        return ["\n".join(c) for c in out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(i, n, c) for i, t in zip(frame[id], frame[text], strict=True) for n, c in enumerate(pack(t or ""))], columns=[id, "chunk", "text"])

    return docs.select(id, text).mapInPandas(run, f"{id} {docs.schema[id].dataType.simpleString()}, chunk int, text string")


def packed(parts: Column, most: int) -> Column:
    """Parts packed greedily into strings of ``most`` characters; a longer part stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(part) <= most)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], part).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), part.alias("open")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def parent_child_chunks(chapter_rows: DataFrame, parent: int = 800, child: int = 150, id: str = "doc_id") -> DataFrame:
    """Parents (paragraphs packed to ``parent`` characters) and their children (sentences packed to ``child``) of ``chapters``, with ids, and each child's neighbours."""
    paragraphs = F.filter(F.split("text", "\n", -1), lambda p: F.trim(p) != "")
    parents = chapter_rows.select(id, "chapter_idx", F.posexplode(packed(F.transform(paragraphs, lambda p: F.concat(p, F.lit("\n"))), parent)).alias("narr_idx", "text"))
    pid = F.format_string("%s_c%03d_n%04d", F.col(id).cast("string"), "chapter_idx", "narr_idx")
    parents = parents.withColumn("global_id", pid)
    children = parents.select(id, "chapter_idx", "narr_idx", F.col("global_id").alias("parent_id"), F.posexplode(packed(tx.sentences(F.col("text")), child)).alias("child_idx", "text"))
    children = children.withColumn("global_id", F.format_string("%s__s%03d", "parent_id", "child_idx"))
    # siblings are numbered, so their ids need no window
    count = F.count("*").over(Window.partitionBy("parent_id"))
    near = lambda k, there: F.when(there, F.format_string("%s__s%03d", "parent_id", F.col("child_idx") + k))
    children = children.withColumn("n", count).withColumns({"prev_id": near(-1, F.col("child_idx") > 0), "next_id": near(1, F.col("child_idx") + 1 < F.col("n"))}).drop("n")
    return parents.withColumn("granularity", F.lit("parent")).unionByName(children.withColumn("granularity", F.lit("child")), allowMissingColumns=True)


#: Pairs of quote marks.
QUOTES = (("「", "」"), ("『", "』"), ("“", "”"), ('"', '"'))


def quote_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 200, pairs: tuple = QUOTES) -> DataFrame:
    """``id``, ``start``, ``end``, ``content`` of quotes of ``most`` characters or fewer on one line; where two overlap, that which begins first, of those the earlier pair's.

    Places come from the lengths of the parts between matches, so no function of Python's is needed.
    """
    pattern = "|".join(f"{a}[^{a}{b}\n]{{1,{most}}}{b}" for a, b in pairs)
    t = F.col(text)
    found = docs.where(t.rlike(pattern)).select(id, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(t, pattern, -1), lambda p: F.length(p)).alias("gaps"))
    each = found.select(id, F.posexplode(F.transform("m", lambda x, i: F.struct(x.alias("content"), F.get("gaps", i).alias("gap")))).alias("i", "x"))
    end = F.sum(F.col("x.gap") + F.length("x.content")).over(Window.partitionBy(id).orderBy("i"))
    return each.withColumn("end", end).select(id, (F.col("end") - F.length("x.content")).alias("start"), "end", F.col("x.content").alias("content"))


def dialogue_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", most_gap: int = 2, quotes: str = r"[\"“”「」『』]") -> DataFrame:
    """``id``, ``first_line``, ``last_line``, ``n_quotes``: runs of quoted lines with at most ``most_gap`` others between."""
    lines = docs.select(id, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t")).where(F.col("t").rlike(quotes))
    w = Window.partitionBy(id).orderBy("line")
    gap = F.col("line") - F.lag("line").over(w) - 1
    return lines.withColumn("new", F.coalesce((gap > most_gap).cast("int"), F.lit(0))).withColumn("b", F.sum("new").over(w)).groupBy(id, "b").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_quotes")).drop("b")


def chapter_batches(rows: DataFrame, most: int, by: str, order: str, size: str) -> DataFrame:
    """``rows`` with ``batch``: whole rows in order, packed greedily up to ``most``; a larger row is a batch of its own.

    A running sum that resets, kept as a stream over rows in order, one row of state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = object()
        batch = held = 0
        for frame in frames:
            out = []
            for k, n in zip(frame[by], frame[size], strict=True):
                if k != key:
                    key, batch, held = k, 0, 0
                elif held + n > most:
                    batch, held = batch + 1, 0
                held += n
                out.append(batch)
            yield frame.assign(batch=out)

    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", batch int")
