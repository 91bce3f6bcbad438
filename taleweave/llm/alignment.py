"""Alignment of two tokenizers: where the tokens of both end at the same byte, and how often two ids end together.

``align`` encodes each text with both vocabularies. The tokens of a slice of an Arrow batch lie one after another,
documents known by their byte offsets in the slice: the ends of each side are counted per byte once, a byte where
both occur is a cut, and sums over the cuts, told apart at the documents' offsets, give groups and links of each. A
document's last byte is always a cut, so no group crosses it. ``score`` then counts every pair of ids that ends
together over the whole corpus and sums these counts up for each document.

Both sides read a space and the text: a byte-level file gets the space before the text, a SentencePiece model puts its
own there. Special strings inside texts are plain text. A null or empty text, or one that a side's tokens don't spell
byte for byte (a model that reads another character as a space, say), has no tokens. Repeated rows each count, null
keys pass through, other columns are not read, and an empty table gives an empty result.

Pairs are counted per slice before they are dealt out. The counts of at most ``BROADCAST_PAIRS`` pairs, the most
frequent, are sent to all tasks; links whose pair is not among them, none of which can be frequent, are joined.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .pieces import SPACE, codec, lists, slices
from .token_counts import as_bytes, byte_level, pieces, plain_byte_level

#: Pairs of ids whose counts are broadcast at most: about 100 MB in a task's memory.
BROADCAST_PAIRS = 2_000_000


class Side:
    """One tokenizer: ids of many texts at once, the bytes of each id, and its number with what may follow it."""

    def __init__(self, widths: list[int], marks: str) -> None:
        self.width = np.array(widths, np.int64)
        self.inner, self.last = (np.array([f"{i}{mark}" for i in range(len(widths))], object) for mark in marks)

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text with a space before it, and whether the tokenizer reads just that."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they spell a space and the text: tokens are what is read piece by piece, so it is enough that none of its bytes is left out."""
        ids, same = self.read(texts)
        return ids, [ok and int(self.width[i].sum()) == 1 + len(t.encode()) for i, ok, t in zip(ids, same, texts, strict=True)]


class ByteLevel(Side):
    def __init__(self, path: str, marks: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not plain_byte_level(spec):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        by_id = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items() if i not in added} | {i: t.encode() for i, t in added.items()}
        super().__init__([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], marks)
        self.ids = byte_level(path, spec, {})

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        parts = [list(pieces(f" {t}", 16_384)) for t in texts]
        got = iter(self.ids([p for ps in parts for p in ps]))
        return [np.concatenate([np.array(next(got), np.int32) for _ in ps]) for ps in parts], [True] * len(texts)


class Pieces(Side):
    def __init__(self, path: str, marks: str) -> None:
        self.codec = codec(path)
        if not self.codec.fallback or not self.codec.normalise.dummy or self.codec.normalise.suffix:
            raise ValueError(f"{path}: a model with byte pieces that puts a space before the text is needed")
        super().__init__([len(b.decode().replace(SPACE, " ").encode()) if len(b) > 1 else 1 for b in self.codec.bytes], marks)

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        norms = [self.codec.normalised(t) for t in texts]
        # a text with a character that the model writes a space as doesn't come back
        return self.codec.ids(norms), [n.replace(SPACE, " ") == f" {t}" for t, n in zip(texts, norms, strict=True)]


@lru_cache(maxsize=4)
def side(path: str, marks: str = ",|") -> Side:
    return (Pieces if path.endswith(".model") else ByteLevel)(path, marks)


class Aligned:
    """The tokens of both sides of some documents, laid end to end."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], left: Side, right: Side) -> None:
        self.left, self.right = left, right
        self.n_a, self.n_b = (np.array([len(x) for x in ids]) for ids in (a, b))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        if not left.width[self.a].all() or not right.width[self.b].all():
            raise ValueError("a token without bytes has no place")
        self.ends_a, self.ends_b = np.cumsum(left.width[self.a]), np.cumsum(right.width[self.b])
        # both sides of a document spell the same bytes
        self.bounds = np.concatenate([[0], self.ends_a[np.cumsum(self.n_a) - 1]])
        n = int(self.bounds[-1]) + 1
        marks_a, marks_b = np.bincount(self.ends_a, minlength=n), np.bincount(self.ends_b, minlength=n)
        self.cut = (marks_a > 0) & (marks_b > 0)
        self.upto, self.upto_a, self.upto_b = np.cumsum(self.cut), np.cumsum(marks_a), np.cumsum(marks_b)
        self.n_groups = self.upto[self.bounds[1:]] - self.upto[self.bounds[:-1]]

    def links(self) -> list[np.ndarray]:
        """The pairs of ids that end together, a document at a time: the first id in the upper half of a long."""
        at = np.flatnonzero(self.cut)
        pairs = (self.a[self.upto_a[at] - 1].astype(np.int64) << 32) | self.b[self.upto_b[at] - 1]
        return np.split(pairs, np.cumsum(self.n_groups)[:-1])

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        closes_a, closes_b = self.cut[self.ends_a], self.cut[self.ends_b]
        # a token comes after all of its own side before it, and after the other side's of the groups before its own
        begins = np.concatenate([[0], np.flatnonzero(self.cut)])
        group_a, group_b = self.upto[self.ends_a - 1], self.upto[self.ends_b - 1]
        place_a = np.arange(len(self.a)) + self.upto_b[begins[group_a]]
        place_b = np.arange(len(self.b)) + self.upto_a[begins[group_b + 1]]
        out = np.empty(len(self.a) + len(self.b), object)
        out[place_a] = np.where(closes_a, self.left.last[self.a], self.left.inner[self.a])
        out[place_b] = np.where(closes_b, self.right.last[self.b], self.right.inner[self.b])
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(out[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def align(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 18) -> DataFrame:
    """``keys``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` and ``links`` (pairs of ids as longs, the first in the upper half) of every row.

    One narrow pass; a task holds an Arrow batch of texts and the tokens of about ``batch_bytes`` of them.
    """
    counts = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]
    schema = T.StructType([*(docs.schema[k] for k in keys), *counts, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = side(a_path, ",|"), side(b_path, ",;")
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keys)).to_pylist()]
            for part in slices([len(t) for t in texts], batch_bytes):
                columns = aligned(texts[part], left, right)
                own = [c.slice(part.start, part.stop - part.start) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)

    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, schema)


def aligned(texts: list[str], left: Side, right: Side) -> list[pa.Array]:
    given = [k for k, t in enumerate(texts) if t]
    (a, sound_a), (b, sound_b) = (tokenizer.encode([texts[k] for k in given]) for tokenizer in (left, right))
    good = [k for k, (x, y) in enumerate(zip(sound_a, sound_b, strict=True)) if x and y]
    given, a, b = ([x[k] for k in good] for x in (given, a, b))
    numbers, groups = np.zeros((3, len(texts)), np.int64), [""] * len(texts)
    links = [np.empty(0, np.int64)] * len(texts)
    if given:
        found = Aligned(a, b, left, right)
        numbers[:, given] = [found.n_a, found.n_b, found.n_groups]
        for k, g, pairs in zip(given, found.groups(), found.links(), strict=True):
            groups[k], links[k] = g, pairs
    return [*(pa.array(n) for n in numbers), pa.array(groups, pa.string()), lists(links, pa.int64())]


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, ``count`` over all rows, and ``best``: whether no other first id is linked more often with the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts, "pairs")
    second = (F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).alias("second")
    # of each second id one row, so never more than the vocabulary
    most = counts.groupBy(second).agg(F.max("count").alias("most"))
    return counts.select("*", second).join(F.broadcast(most), "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score(links: DataFrame, *, row: str = "row", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``row``, ``n_links``, ``n_best`` and ``count_sum`` of the rows with links; ``links`` is a written table, ``row`` unique in it."""
    counts = written(pair_counts(links), "pair-counts")
    each = links.select(row, F.explode("links").alias("pair"))
    sums = (F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    if counts.count() <= broadcast_pairs:
        return each.join(F.broadcast(counts), "pair").groupBy(row).agg(*sums)
    # the most frequent pairs reach all tasks; of the rest none has more than the count at the limit
    rare = counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count"))
    least, total = None, 0
    for level in rare.toLocalIterator():
        total += level["n"]
        if total > broadcast_pairs:
            break
        least = level["count"]
    frequent = F.lit(False) if least is None else F.col("count") >= least
    head = each.join(F.broadcast(counts.where(frequent)), "pair", "left")
    tail = head.where(F.col("count").isNull()).select(row, "pair").join(counts.where(~frequent), "pair")
    both = head.where(F.col("count").isNotNull()).select(row, "count", "best").unionByName(tail.select(row, "count", "best"))
    return both.groupBy(row).agg(*sums)
