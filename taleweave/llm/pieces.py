"""SentencePiece encoding that keeps the place of every piece in the text's own bytes, and decoding.

A text is normalised here, not by the library: the model's compiled character map (a double array over UTF-8 bytes)
is opened into its rules once a worker, and at each place the longest rule that fits replaces what it matches, after
the model's own symbols. Every normalised character remembers the byte at which its source stands. Spaces are then
dropped, escaped and prefixed as the model says. What comes out is encoded by the library with the same model whose
normaliser is switched off, in stretches cut at words' ends if no piece of the vocabulary goes on behind one, and the
pieces' lengths, summed up, give their places in the normalised text and through it in the source. A piece that ends inside what one
rule made ends where that rule's source begins; of the bytes of a character that the vocabulary lacks the last one
has the character's span, the others an empty one at its start. All this is the library's own convention.

``encode`` returns ``ids``, ``starts`` and ``ends`` (byte offsets, end exclusive), ``decode`` a text. Both are one
narrow pass in which a task holds one Arrow batch of texts and the ids of about ``batch_bytes`` of them. A null or
empty text has no pieces but the end id, if that is asked for; null ids decode to null. Repeated rows and null keys
pass through, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
WORD_END = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
#: Kinds of pieces in a model file.
SYMBOL, BYTE = 4, 6
BPE = 2


def compiled_rules(charmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: its size, a double array of 32-bit units, and replacements that end with a zero byte."""
    if not charmap:
        return {}
    size = int.from_bytes(charmap[:4], "little")
    units = np.frombuffer(charmap[4 : 4 + size], "<u4").astype(np.int64)
    texts = charmap[4 + size :]

    def below(at: np.ndarray) -> np.ndarray:
        unit = units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    found, labels = {}, np.arange(1, 256)
    bases, keys = below(np.zeros(1, np.int64)), [b""]
    while len(keys):
        places = np.minimum(bases[:, None] ^ labels, len(units) - 1)
        row, column = np.nonzero((units[places] & 0x800000FF) == labels)
        at = places[row, column]
        keys = [keys[r] + bytes([labels[c]]) for r, c in zip(row.tolist(), column.tolist(), strict=True)]
        bases = below(at)
        for k in np.flatnonzero(units[at] & 0x100).tolist():
            start = int(units[bases[k]] & 0x7FFFFFFF)
            found[keys[k].decode()] = texts[start : texts.index(b"\0", start)].decode()
    return found


class Normaliser:
    def __init__(self, spec, symbols: list[str], suffix: bool) -> None:
        self.rules, self.symbols = compiled_rules(spec.precompiled_charsmap), set(symbols)
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.longest = max(map(len, [*self.rules, *self.symbols]), default=0)
        long = [k for k in self.rules if len(k) > 1]
        self.alone = marked([k for k in self.rules if len(k) == 1] + [s[0] for s in self.symbols])
        self.first, self.second = marked(k[0] for k in long), marked(k[1] for k in long)

    def edits(self, text: str, code: np.ndarray) -> list[tuple[int, int, str]]:
        """(start, end, replacement) of each place where a symbol stands or a rule fits, the longest first."""
        if not self.longest:
            return []
        maybe = self.alone[code]
        maybe[:-1] |= self.first[code[:-1]] & self.second[code[1:]]
        out, at = [], 0
        for start in np.flatnonzero(maybe).tolist():
            if start < at:
                continue
            longest = [text[start : start + n] for n in range(min(self.longest, len(text) - start), 0, -1)]
            found = next((k for k in longest if k in self.symbols), None)
            new = found
            if found is None and (found := next((k for k in longest if k in self.rules), None)) is not None:
                new = self.rules[found]
            if found is not None:
                at = start + len(found)
                out.append((start, at, new))
        return out

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of ``text`` it comes from."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        place = np.concatenate([[0], np.cumsum(widths(code))])
        edits = self.edits(text, code)
        head = self.heading(text, edits) if self.squeeze else 0
        if head == len(text):
            return "", place[:1]
        unit = np.arange(len(code))
        if edits:
            starts, ends = (np.array([e[k] for e in edits]) for k in (0, 1))
            inside = np.zeros(len(code) + 1, np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            plain = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
            made = np.frombuffer("".join(e[2] for e in edits).encode("utf-32-le"), "<u4")
            unit = np.concatenate([plain, np.repeat(starts, [len(e[2]) for e in edits])])
            order = np.argsort(unit, kind="stable")
            code, unit = np.concatenate([code[plain], made])[order], unit[order]
        if self.squeeze and len(code):
            kept = ~squeezed(code == 32, unit)
            code, unit = code[kept], unit[kept]
        at, end = place[unit], place[-1:]
        space = ord(SPACE if self.escape else " ")
        code = np.where(code == 32, np.uint32(space), code)
        if self.dummy and not self.suffix:
            code, at = np.concatenate([[space], code]), np.concatenate([place[head : head + 1], at])
        if self.squeeze:
            solid = np.flatnonzero(code != space)
            left = int(solid[-1]) + 1 if len(solid) else 0
            end = at[left : left + 1] if left < len(at) else end
            code, at = code[:left], at[:left]
        if self.dummy and self.suffix:
            code, at = np.concatenate([code, [space]]), np.concatenate([at, end])
        return code.astype("<u4").tobytes().decode("utf-32-le"), np.concatenate([at, end])

    @staticmethod
    def heading(text: str, edits: list[tuple[int, int, str]]) -> int:
        """Characters at the start that become single spaces."""
        at, made = 0, iter(edits)
        nxt = next(made, None)
        while at < len(text):
            if nxt and nxt[0] == at:
                if nxt[2] != " ":
                    break
                at, nxt = nxt[1], next(made, None)
            elif text[at] == " ":
                at += 1
            else:
                break
        return at


def marked(chars: Iterable[str]) -> np.ndarray:
    """A flag for every code point: whether it is one of ``chars``."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def squeezed(space: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Spaces that lead what one rule made, where a space or nothing stands before it."""
    first = np.concatenate([[True], unit[1:] != unit[:-1]])
    of = np.cumsum(first) - 1
    before = np.concatenate([[True], space[:-1]])
    solid = np.cumsum(~space)
    return space & (solid == (solid - ~space)[first][of]) & before[first][of]


def widths(code: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


class Codec:
    """A model file, its normaliser, and the same model without one."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model, proto = model, sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normaliser(proto.normalizer_spec, [p.piece for p in proto.pieces if p.type == SYMBOL], proto.trainer_spec.treat_whitespace_as_suffix)
        self.fallback = proto.trainer_spec.byte_fallback
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() for p in proto.pieces]
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        #: Whether merges stop before each run of spaces, as no piece holds a space behind anything else.
        self.apart = self.fallback and proto.trainer_spec.model_type == BPE and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces)
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


    @cached_property
    def own(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def stretches(self, norm: str, limit: int) -> Iterator[str]:
        """Parts of a normalised text of ``limit`` characters or a little more, between which no piece and so no merge crosses."""
        start = 0
        while self.apart and len(norm) - start > limit and (end := WORD_END.search(norm, start + limit)):
            yield norm[start : end.start()]
            start = end.start()
        yield norm[start:]

    def ids(self, norms: list[str], limit: int = 4096) -> list[np.ndarray]:
        """Ids of normalised texts."""
        parts = [list(self.stretches(n, limit)) for n in norms]
        got = iter(self.bare.encode([p for ps in parts for p in ps], num_threads=1) if parts else ())
        return [np.concatenate([np.array(next(got), np.int32) for _ in ps]) for ps in parts]

    def normalised(self, text: str) -> str:
        n = self.normalise
        if n.longest or n.squeeze or n.suffix or not n.escape or not text:
            return n(text)[0] if text else ""
        return (SPACE if n.dummy else "") + text.replace(" ", SPACE)

    def encode(self, texts: list[str], limit: int = 4096) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, starts and ends of the pieces of each text."""
        made = [self.normalise(t) if t else ("", np.zeros(1, np.int64)) for t in texts]
        if not self.fallback:
            return [self.spelled(*m) for m in made]
        ids = self.ids([norm for norm, _ in made], limit)
        return [(i, *self.spans(norm, at, np.cumsum(self.width[i]))) for i, (norm, at) in zip(ids, made, strict=True)]

    def spans(self, norm: str, at: np.ndarray, ends: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        source = np.concatenate([np.repeat(at[:-1], widths(np.frombuffer(norm.encode("utf-32-le"), "<u4"))), at[-1:]])
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)] if starts is None else starts
        return source[starts], source[ends]

    def spelled(self, norm: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a model without byte pieces, where an unknown piece can have any length: the library says which."""
        found = self.bare.encode(norm, return_type="proto").pieces if norm else []
        starts, ends = (np.array([getattr(p, k) for p in found], np.int64) for k in ("begin", "end"))
        return (np.array([p.id for p in found], np.int32), *self.spans(norm, at, ends, starts))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Neighbouring rows of about ``limit`` bytes together, one row at least."""
    start = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > limit:
            yield slice(start, k)
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0)]), kind, safe=False))


def id_lists(column: pa.ListArray) -> list[list[int] | None]:
    """The lists of a column, taken from its values at once: ``to_pylist`` makes an object of Arrow's for each id."""
    if column.values.null_count:
        return column.to_pylist()
    ends = column.offsets.to_pylist()
    flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist()
    return [flat[a - ends[0] : b - ends[0]] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def encode(docs: DataFrame, path: str, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), begin: bool = False, end: bool = False, batch_bytes: int = 1 << 18) -> DataFrame:
    """``keys``, ``ids``, ``starts`` and ``ends`` of every row; ``begin`` and ``end`` add those ids, with empty spans.

    ``path`` is the model file as every executor sees it.
    """
    whole = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("ids", whole), T.StructField("starts", whole), T.StructField("ends", whole)])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for b in batches:
            texts = [x or "" for x in b.column(len(keys)).to_pylist()]
            for part in slices([len(t) for t in texts], batch_bytes):
                found = []
                for t, (ids, starts, ends) in zip(texts[part], model.encode(texts[part]), strict=True):
                    size = len(t.encode())
                    before, after = ([model.own.bos_id()] if begin else []), ([model.own.eos_id()] if end else [])
                    found.append((np.concatenate([before, ids, after]), np.concatenate([[0] * len(before), starts, [size] * len(after)]), np.concatenate([[0] * len(before), ends, [size] * len(after)])))
                own = [c.slice(part.start, part.stop - part.start) for c in b.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*own, *(lists([f[k] for f in found], pa.int32()) for k in range(3))], names=names)

    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded", batch_bytes: int = 1 << 18) -> DataFrame:
    """``encoded`` with the text of ``ids`` in ``out``: control pieces give nothing, bytes that are no character U+FFFD."""
    schema = T.StructType([*encoded.schema, T.StructField(out, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path).own
        for b in batches:
            lengths = [4 * (n or 0) for n in b.column(at).value_lengths().to_pylist()]
            for part in slices(lengths, batch_bytes):
                rows = b.slice(part.start, part.stop - part.start)
                texts = [None if x is None else model.decode(x) if x else "" for x in id_lists(rows.column(at))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
