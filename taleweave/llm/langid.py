"""Language identification by prediction by partial matching.

For each language the bytes of a bounded sample of labelled texts make a context tree of orders 0 to
``max_order``. A symbol that a context has seen costs the code length of its count over the context's count
plus its number of different symbols (method C); any other costs the escape and is coded one order lower, at
last by 1 of 256. Statistics are frozen after training, so each n-gram has one exact code length a language,
and a text's code length is a sum of table look-ups. The language with the shortest code wins; the score is
its probability against the others.

Bytes are read with A-Z as a-z. A null text and a text without a letter are ``und`` with score 0, as is any
text where no labelled row exists to learn from. Rows with a null language or text teach nothing. Ties go to
the first language by code point. Texts are scored whole, a long one in segments that overlap by the context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, written

#: Bound of the training sample, a language: rows, and bytes after which no further row is taken.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 1_500_000
#: Labels up to which their counts are broadcast.
BROADCAST_LABELS = 10_000
SEGMENT = 1 << 18
DENSE_CELLS = 1 << 24
UND = "und"


def folded(data: bytes, order: int) -> np.ndarray:
    return np.frombuffer(b"\n" * order + data.lower(), np.uint8)


def sample(labelled: DataFrame, text: str, lang: str, rows: int, size: int) -> DataFrame:
    """At most ``rows`` different texts a language, in the order of a hash, until ``size`` bytes are reached."""
    kept = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    hashed = kept.withColumn("h", F.xxhash64("text"))
    # copies count once: else one text with many of them could fill the sample, or keep all others out
    counted = written(hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "labels")
    if counted.count() <= BROADCAST_LABELS:  # else the join would deal all texts out by language
        counted = F.broadcast(counted)
    # a hash threshold first, so that the window sees about twice the rows it keeps and no more
    near = hashed.join(counted, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * 2 * rows / F.col("n"))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("r", F.row_number().over(order)).withColumn("before", before).where((F.col("r") <= rows) & (F.col("before") < size)).select("lang", "text")


def ngram_counts(texts: DataFrame, max_order: int) -> DataFrame:
    """``lang``, ``length``, ``gram`` (big-endian bytes as a number) and ``n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            data = [folded(x.as_py().encode("utf-8", "surrogatepass"), max_order) for x in b.column(1)]
            for lang in sorted(set(langs)):
                for length in range(1, max_order + 2):
                    grams = []
                    for x in (d for d, of in zip(data, langs, strict=True) if of == lang):
                        code = np.zeros(len(x) - max_order, np.int64)
                        for k in range(length):
                            code = code * 256 + x[max_order - length + 1 + k : len(x) - length + 1 + k]
                        grams.append(code)
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), length, np.int32)), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "length", "gram", "n"])

    return texts.mapInArrow(run, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """From (id of an n-gram, class of the next byte) to the id of the longer n-gram, 0 if never seen."""

    def __init__(self, keys: np.ndarray, rows: int, classes: int) -> None:
        self.classes, self.table, self.keys = classes, None, keys
        if rows * classes <= DENSE_CELLS:
            self.table = np.zeros(rows * classes, np.int32)
            self.table[keys] = np.arange(1, len(keys) + 1)

    def __call__(self, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
        key = ids.astype(np.int64) * self.classes + classes
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0).astype(np.int32)


@dataclass
class Model:
    """Frozen code lengths. ``cost[k]`` and ``escape[k]`` have a row for each n-gram of k bytes and a column a language; row 0 stands for what was never seen."""

    langs: list[str]
    order: int
    classes: np.ndarray
    lookups: list[Lookup]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ``order`` ones, for each language."""
        c, k = self.classes[data], self.order
        ids = [c]
        for lookup in self.lookups:
            last = ids[-1]
            nxt = np.zeros(len(c), np.int32)
            nxt[1:] = lookup(last[:-1], c[1:])
            ids.append(nxt)
        bits = self.cost[k + 1][ids[k][k:]]
        rest = np.flatnonzero(ids[k][k:] == 0) + k
        for n in range(k, 0, -1):
            if not len(rest):
                break
            bits[rest - k] += self.escape[n][ids[n - 1][rest - 1]] + self.cost[n][ids[n - 1][rest]]
            rest = rest[ids[n - 1][rest] == 0]
        return bits

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(4096, SEGMENT * 4 // max(4, len(self.langs)))
        held: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            parts = [folded(texts[i], self.order) for i in held]
            each = self.positions(np.concatenate(parts))
            starts = np.cumsum([0, *map(len, parts[:-1])])
            # a text's padding follows the text before it, at places that count for neither
            bounds = np.stack([starts, starts + np.array([len(p) - self.order for p in parts])], 1).ravel()
            out[held] = np.add.reduceat(np.concatenate([each, np.zeros((self.order + 1, each.shape[1]), each.dtype)]), bounds, axis=0, dtype=np.float64)[::2]
            held.clear()
            size = 0

        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > step:
                data = folded(t, self.order)
                for s in range(0, len(t), step):
                    out[i] += self.positions(data[s : s + step + self.order]).sum(0, dtype=np.float64)
                continue
            held.append(i)
            size += len(t)
            if size >= step:
                flush()
        if held:
            flush()
        return out


def fitted(counts: pa.Table, max_order: int) -> Model:
    """The model of n-gram counts, which the bound of the sample bounds."""
    langs = sorted(set(counts["lang"].to_pylist()))
    of, length = np.searchsorted(langs, counts["lang"].to_pylist()) if langs else np.zeros(0, int), counts["length"].to_numpy()
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    seen: list[np.ndarray] = []
    tables: list[np.ndarray] = []
    for k in range(1, max_order + 2):
        here = length == k
        codes, at = np.unique(gram[here], return_inverse=True)
        t = np.zeros((len(codes) + 1, len(langs)))
        np.add.at(t, (at + 1, of[here]), n[here])
        seen.append(codes)
        tables.append(t)
    classes = np.zeros(256, np.int32)
    # the padding is a context too
    symbols = np.unique(np.append(seen[0], 10))
    seen[0], old = symbols, seen[0]
    t = np.zeros((len(symbols) + 1, len(langs)))
    t[np.searchsorted(symbols, old) + 1] = tables[0][1:]
    tables[0] = t
    classes[symbols] = np.arange(1, len(symbols) + 1)
    width = len(symbols) + 1

    # contexts that stand in the padding only are n-grams as well
    for k in range(2, max_order + 1):
        need = np.unique(np.concatenate([seen[k - 1], seen[k] >> 8 if k < len(seen) else seen[k - 1], [sum(10 << 8 * j for j in range(k))]]))
        t = np.zeros((len(need) + 1, len(langs)))
        t[np.searchsorted(need, seen[k - 1]) + 1] = tables[k - 1][1:]
        seen[k - 1], tables[k - 1] = need, t

    def row(k: int, codes: np.ndarray) -> np.ndarray:
        """Rows of n-grams of k bytes, 0 where there is none."""
        at = np.minimum(np.searchsorted(seen[k - 1], codes), len(seen[k - 1]) - 1)
        return np.where(seen[k - 1][at] == codes, at + 1, 0)

    with np.errstate(divide="ignore", invalid="ignore"):
        total, kinds = tables[0].sum(0), (tables[0] > 0).sum(0)
        esc = np.log2((total + kinds) / kinds)
        cost = [np.zeros((1, len(langs))), np.where(tables[0] > 0, np.log2((total + kinds) / tables[0]), esc + 8)]
        escape: list[np.ndarray] = [esc[None, :]]
        for k in range(2, max_order + 2):
            context = row(k - 1, seen[k - 1] >> 8)
            shape = (len(seen[k - 2]) + 1, len(langs))
            total, kinds = np.zeros(shape), np.zeros(shape)
            np.add.at(total, context, tables[k - 1][1:])
            np.add.at(kinds, context, tables[k - 1][1:] > 0)
            esc = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            esc[0] = 0
            escape.append(esc)
            lower = cost[k - 1][row(k - 1, seen[k - 1] & ((1 << 8 * (k - 1)) - 1))]
            own = np.log2((total + kinds)[context] / tables[k - 1][1:])
            full = np.where(tables[k - 1][1:] > 0, own, esc[context] + lower)
            cost.append(np.concatenate([np.zeros((1, len(langs))), full]))
    lookups = [Lookup(row(k - 1, seen[k - 1] >> 8) * width + classes[seen[k - 1] & 255], len(seen[k - 2]) + 1, width) for k in range(2, max_order + 2)]
    return Model(langs, max_order, classes, lookups, [c.astype(np.float32) for c in cost], [e.astype(np.float32) for e in escape])


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", max_order: int = 3, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    return fitted(ngram_counts(sample(labelled, text, lang, rows, size), max_order).toArrow(), max_order)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``lang_pred``, ``score`` and ``bits_per_byte`` (of the predicted language) of every row, in one narrow pass.

    A text that is among the keys is sent to Python once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = keys.index(text) if text in keys and docs.schema[text].dataType == T.StringType() else len(keys)
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in (s for b in batches for s in sliced(b, at)):
            texts = [x.as_py().encode("utf-8", "surrogatepass") if ok.as_py() else b"" for x, ok in zip(b.column(at), b.column(b.num_columns - 1), strict=True)]
            known = np.array([bool(t) and bool(m.langs) for t in texts], bool)
            pred, score, rate = np.full(len(texts), UND, object), np.zeros(len(texts)), np.zeros(len(texts))
            if known.any():
                bits = m.bits(texts)
                best = bits.argmin(1)
                least = bits[np.arange(len(texts)), best]
                chance = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                pred[known] = np.array(m.langs, object)[best[known]]
                score[known] = chance[known]
                rate[known] = (least / np.array([max(1, len(t)) for t in texts]))[known]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], names=[f.name for f in schema])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    own = [] if at < len(keys) else [F.col(text).cast("string")]
    return docs.select(*keys, *own, letter.alias("__letter")).mapInArrow(run, schema)


def fold(id: Column) -> Column:
    """crc32 of an id as text, modulo 4; null for a null id."""
    return F.crc32(id.cast("string")) % 4
