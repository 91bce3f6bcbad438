"""File sources: uploads, texts of unknown encoding, EPUB, JSON lines; and keyed tables of Parquet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that may be loaded, and the first bytes of formats that may not.
EXTENSIONS = ("epub", "txt", "md")
MAGIC = {"pdf": b"%PDF", "png": b"\x89PNG", "jpg": b"\xff\xd8\xff", "gif": b"GIF8"}
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gb18030", "gbk", "shift_jis", "big5", "euc-jp", "cp932")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def upload_error(path: Column, content: Column) -> Column:
    """Why a file can't be loaded; null if it can."""
    extension = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(~extension.isin(*EXTENSIONS), F.concat(F.lit("extension not allowed: "), extension))
    for name, magic in MAGIC.items():
        out = out.when(F.startswith(head, F.lit(magic.hex().upper())), f"content is {name}")
    return out.when((extension == "epub") & (head != "504B0304"), "not a zip archive").when((extension != "epub") & (head == "504B0304"), "content is zip")


def cjk_share(text: str) -> float:
    return sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in text) / max(1, len(text))


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: UTF-8 if it is that, else the first that decodes to a text with some CJK, else UTF-8 with replacements."""
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        pass
    for encoding in ENCODINGS[1:]:
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if cjk_share(text) > 0.05:
            return text, encoding
    return data.decode("utf-8", "replace"), "utf-8/replace"


def read_texts(files: DataFrame) -> DataFrame:
    """``path``, ``text``, ``encoding`` of ``files(path, content)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [decode(x) for x in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "text": [t for t, _ in found], "encoding": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, encoding string")


SKIPPED_FILES = re.compile(r"(?:nav|toc|cover|copyright|colophon|index)[^/]*$", re.I)
HEADINGS = {"h2": "## ", "h3": "### ", "h4": "#### "}
SILENT = {"script", "style", "head", "nav", "header", "footer", "h1"}
BLOCKS = {"p", "div", "li", "blockquote", "h2", "h3", "h4", "h5", "h6", "section", "tr"}


class Chapter(HTMLParser):
    """The text of one chapter file as Markdown; a void tag breaks a line where it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.title = ""
        self.inside = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in ("title", "h1"):
            self.inside = tag
        if tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in BLOCKS:
            self.out.append("\n\n" + HEADINGS.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.silent:
            self.silent -= 1
        if tag == self.inside:
            self.inside = ""
        if tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.inside and not self.title:
            self.title = data.strip()
        if not self.silent:
            self.out.append(re.sub(r"[ \t\r\n]+", " ", data))

    def text(self) -> str:
        lines = (line.strip() for line in "".join(self.out).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", name)]


def spine(archive: zipfile.ZipFile) -> list[str]:
    """Chapter files in reading order: the package's spine, else all pages in natural order."""
    names = archive.namelist()
    package = next((n for n in names if n.lower().endswith(".opf")), None)
    if package:
        root = ElementTree.fromstring(archive.read(package))
        items = {x.get("id"): x.get("href") for x in root.iter() if x.tag.endswith("}item")}
        listed = [normpath(join(dirname(package), items[x.get("idref")])) for x in root.iter() if x.tag.endswith("}itemref") and items.get(x.get("idref"))]
        found = [n for n in listed if n in names]
        if found:
            return found
    return sorted((n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))), key=natural)


def read_epub(data: bytes, least: int = 100) -> list[tuple[int, str, str]]:
    """(order, title, text) of the chapters of a book; files without ``least`` characters and those of the apparatus are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        out = []
        for name in spine(archive):
            if SKIPPED_FILES.search(name):
                continue
            page = Chapter()
            page.feed(archive.read(name).decode("utf-8", "replace"))
            page.close()
            body = page.text()
            if len(body) >= least:
                out.append((len(out), page.title or body.split("\n")[0][:60], body))
        if not out and (plain := next((n for n in archive.namelist() if n.lower().endswith(".txt")), None)):
            text, _ = decode(archive.read(plain))
            out.append((0, plain, text))
        return out


def read_books(files: DataFrame) -> DataFrame:
    """``path``, ``chapter_order``, ``title``, ``text`` of EPUB ``files(path, content)``; a broken archive gives one row with its error as title."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *c) for c in read_epub(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows.append((path, -1, f"error: {e}", ""))
            yield pd.DataFrame(rows, columns=["path", "chapter_order", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, chapter_order int, title string, text string")


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with their keys. Parquet has no merge, so the result is written as a new version."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def without(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def unseen(new: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose text's fingerprint isn't in ``known(fingerprint)``."""
    from ..functions.text import fingerprint

    return new.withColumn("fingerprint", fingerprint(F.col(text))).join(known.select("fingerprint"), "fingerprint", "left_anti")


def chapters_of_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``chapter_idx``, ``text``: the parents of each chapter joined in order."""
    parents = blocks.where("granularity = 'parent'")
    ordered = F.array_sort(F.collect_list(F.struct("narr_idx", "text")))
    return parents.groupBy("doc_id", "chapter_idx").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
