"""Token counts by batch encoding in an Arrow function that returns lengths only.

``count_tokens`` adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to the key columns. Texts are cut into
pieces at safe boundaries and the pieces are encoded in batches of about ``batch_bytes``; the ids themselves
never leave the batch. A boundary is safe before white space that follows anything else, and between a letter and a
full-width stop or comma: the pre-tokenizer of a byte-level vocabulary always ends a token there, whatever stands
around it. Texts are cut only if no special string holds such a boundary. A run without a boundary stays whole, so
counts are those of the whole text. Pieces with a long run of white space go through the tokenizer file's own library,
as the pattern of the faster one gives up on such runs.

Null and empty texts count 0 bytes and 0 tokens. Special strings inside a text count as their one special
token, which is the tokenizer file's own default. Repeated rows and null keys pass through unchanged.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = re.compile(r"(?<=[^ \t\n\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])(?=[ \t\n\r])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])(?=[\u3001\u3002\uff01\uff0c\uff1f])")


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cut ``text`` at safe boundaries into pieces of ``limit`` characters or a little more."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


#: A run of white space that the faster library is not asked to split.
LONG_SPACE = re.compile(r"\s{4096}")


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE without anything else."""
    before = spec.get("pre_tokenizer") or {}
    return (
        spec["model"].get("type", "BPE") == "BPE"
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


@lru_cache(maxsize=4)
def own_library(path: str, plain: bool = False):
    """The tokenizer as its own library reads it; ``plain``: special strings are ordinary text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = plain
    return own


def byte_level(path: str, spec: dict, special: dict[str, int]):
    """A function from a list of texts to their ids, for a plain byte-level file; strings not in ``special`` are plain text.

    The file's vocabulary is encoded by the faster of the two installed libraries; ``tests/llm`` holds the two equal.
    """
    import tiktoken

    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {as_bytes(token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast, allowed = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special), set(special)

    def ids(texts: list[str]) -> list[list[int]]:
        return [own_library(path, not special).encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else fast.encode(t, allowed_special=allowed, disallowed_special=()) for t in texts]

    return ids


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to their token counts, and whether a text may be cut at safe boundaries."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not plain_byte_level(spec):
        own = own_library(path)
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)], False
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = byte_level(path, spec, special)
    return lambda texts: [len(x) for x in ids(texts)], not any(SAFE.search(f"x{t}x") for t in special)


#: The split that the ByteLevel pre-tokenizer stands for (a published constant of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def shown() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def as_bytes(token: str) -> bytes:
    return bytes(shown()[c] for c in token)


def counts(texts: list[str], path: str, piece_chars: int, batch_bytes: int) -> list[int]:
    """Token counts of whole texts, encoded in batches of pieces."""
    (encode, cuts), total = encoder(path), [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for k, n in zip(owner, encode(batch), strict=True):
            total[k] += n
        batch.clear()
        owner.clear()
        size = 0

    for k, text in enumerate(texts):
        for piece in (pieces(text, piece_chars) if cuts else [text]) if text else ():
            batch.append(piece)
            owner.append(k)
            size += len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                flush()
    flush()
    return total


def count_tokens(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    limit: int = 1024,
    piece_chars: int = 16_384,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``keys``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    One narrow pass: no shuffle, and a task holds one Arrow batch of texts and one batch of pieces.
    ``path`` is the tokenizer file as every executor sees it.
    """
    fields = [docs.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(len(keys)).to_pylist()]
            n = counts(texts, path, piece_chars, batch_bytes)
            out = [*b.columns[: len(keys)], b.column(len(keys) + 1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")
    return docs.select(*keys, F.col(text).cast("string"), size).mapInArrow(run, schema)
