"""SentencePiece spans, alignment of tokenizers and token counts against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from taleweave.llm import alignment, common, pieces, queries, token_counts

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab  \t\n\r\x00\x01­​　ﬁﾊﾟ①¨éÅ중文中😀ﷺ﻿x0.,<", "Å", "é", "the ", "ing", "▁", "</s>", "<0x41>", "<|endoftext|>", "<sym>"]


def noise(seed, n, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(longest))) for _ in range(n)] + ["", " ", "   ", "\x01", " \x01 a", "▁▁", "word " * 3000, "a" * 9000]


def variant(*, rule=None, squeeze=False, dummy=True, suffix=False, symbols=(), fallback=True):
    """The model with another normaliser, symbols of its own, or without byte pieces."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    if rule:
        made = sentencepiece_model_pb2.ModelProto()
        made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, dummy
    proto.trainer_spec.treat_whitespace_as_suffix, proto.trainer_spec.byte_fallback = suffix, fallback
    for k, s in enumerate(symbols):
        proto.pieces[1000 + k].piece, proto.pieces[1000 + k].type = s, pieces.SYMBOL
    for p in proto.pieces:
        p.type = 5 if p.type == pieces.BYTE and not fallback else p.type
    return proto.SerializeToString()


VARIANTS = [{}, {"rule": "nmt_nfkc", "squeeze": True}, {"rule": "nfkc", "dummy": False}, {"rule": "nmt_nfkc_cf", "squeeze": True, "suffix": True}, {"rule": "nmt_nfkc", "symbols": ("<sym>", "é", "中文")}, {"rule": "nmt_nfkc", "squeeze": True, "fallback": False}]


@pytest.mark.parametrize("kind", VARIANTS, ids=str)
def test_ids_and_spans_are_the_librarys(kind):
    model = variant(**kind)
    library, texts = sentencepiece.SentencePieceProcessor(model_proto=model), noise(1, 1500)
    for text, (ids, starts, ends) in zip(texts, pieces.Codec(model).encode(texts, limit=8), strict=True):
        want = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)) == want, repr(text)


SCHEMA = "doc_id long, text string, ids string, groups string, Links long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    texts = [None, "", " ", "same", "same", *noise(7, 150), "é" * 20_000, " " * 20_000 + "x", "the tale " * 5000]
    texts += [" ".join(r.choice(["low", "lower", "newest", "tokenization", "été", "naïve"]) for _ in range(40)) for _ in range(60)]
    return [(None if k == 3 else k, t, "ids", "g", 5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pieces_of_a_table(spark, docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.decode(pieces.encode(docs, MODEL, end=True, batch_bytes=500), MODEL).collect()
    key = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_eos=True)
        want[i, key(ids), library.decode(ids)] += 1
    assert Counter((x.doc_id, key(x.ids), x.decoded) for x in got) == want
    assert all(len(x.ids) == len(x.starts) == len(x.ends) for x in got)
    whole = {i: (t or "").encode() for i, t, *_ in rows}
    for x in got:
        assert x.starts[-1] == x.ends[-1] == len(whole[x.doc_id]) and all(s <= e for s, e in zip(x.starts, x.ends, strict=True))
        assert b"".join(whole[x.doc_id][s:e] for s, e in zip(x.starts, x.ends, strict=True)) == whole[x.doc_id]
    begun = pieces.encode(docs.where("doc_id = 4"), MODEL, begin=True).first()
    assert begun.ids[0] == library.bos_id() and begun.starts[:2] == [0, 0] and begun.ids[1:] == library.encode("same")


def test_decoding_of_odd_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [None, [], [2], [1, 2], [3 + 0xE4, 3 + 0xB8], [28705, 28705, 295], list(range(3, 400))]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, ids array<int>")
    assert {x.k: x.decoded for x in pieces.decode(t, MODEL).collect()} == {k: None if x is None else library.decode(x) for k, x in enumerate(ids)}


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert pieces.decode(pieces.encode(nothing, MODEL), MODEL).collect() == []
    found = common.written(alignment.align(nothing, BYTES, MODEL).withColumn("row", F.monotonically_increasing_id()), "nothing")
    assert found.collect() == [] and alignment.score(found).collect() == []


def brute(text):
    """Counts, groups and links of one text from the libraries' own tokens."""
    own, library = brute.own, brute.library
    raw = f" {text}".encode()
    a, b = own.encode(f" {text}", add_special_tokens=False).ids, library.encode(text or "")
    left = [token_counts.as_bytes(own.id_to_token(i)) for i in a]
    right = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in b)]
    if not text or b"".join(left) != raw or b"".join(right) != raw:
        return 0, 0, "", []
    place = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    ends_a, ends_b = place(left), place(right)
    cuts, out, before = sorted(set(ends_a) & set(ends_b)), [], 0
    for c in cuts:
        of = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if before < e <= c)  # noqa: B023, E731
        out.append(f"{of(a, ends_a)}|{of(b, ends_b)}")
        before = c
    by_end = dict(zip(ends_b, b, strict=True))
    return len(a), len(b), ";".join(out), [(i, by_end[e]) for i, e in zip(a, ends_a, strict=True) if e in by_end]


@pytest.mark.parametrize("limit", [0, 20, 1_000_000])
def test_alignment_of_a_table(spark, docs, rows, limit):
    brute.own, brute.library = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    brute.own.encode_special_tokens = True
    short = [r for r in rows if r[1] is None or len(r[1]) < 1000]
    table = spark.createDataFrame(short, SCHEMA).repartition(3)
    found = common.written(alignment.align(table, BYTES, MODEL, batch_bytes=300).withColumn("row", F.monotonically_increasing_id()), "t")
    scored = {x.row: x for x in alignment.score(found, broadcast_pairs=limit).collect()}
    truth = [(i, *brute(t)) for i, t, *_ in short]
    counts = Counter(pair for *_, links in truth for pair in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter((i, a, b, g, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links)) for i, a, b, g, links in truth)
    got = Counter()
    for x in found.collect():
        s = scored.get(x.row)
        assert (s is not None) == (x.n_groups > 0)
        got[(x.doc_id, x.n_a, x.n_b, x.groups, x.n_groups, s.n_best if s else 0, s.count_sum if s else 0)] += 1
    assert got == want and sum(n > 1 for n in counts.values()) > 50


def test_alignment_of_long_texts(spark, docs, rows):
    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    want = {t: own.encode(f" {t}", add_special_tokens=False).ids for _, t, *_ in rows if t and len(t) > 5000}
    texts = sorted(want)
    left, right = alignment.side(BYTES, ",|"), alignment.side(MODEL, ",;")
    n_a, n_b, n_groups, groups, links = (x.to_pylist() for x in alignment.aligned(texts, left, right))
    for k, t in enumerate(texts):
        assert n_a[k] == len(want[t]) and n_groups[k] == len(links[k]) == groups[k].count("|") and n_b[k]
        assert [int(i) for g in groups[k].split(";") for i in g.split("|")[0].split(",")] == want[t]


def test_sides_that_cannot_be_aligned(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        alignment.side(public_tokenizers.path("word_bpe_49k.json"))
    path = tmp_path / "bare.model"
    path.write_bytes(variant(dummy=False))
    with pytest.raises(ValueError, match="space"):
        alignment.side(str(path))


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\t" * 2_000_000 + "b", " \n" * 500_000 + "x", "x" + "\n" * 2_000_000, "x  y" + "　" * 600_000 + "<|endoftext|>  z"], ids=["spaces", "tabs inside", "mixed leading", "line feeds trailing", "wide"])
def test_counts_of_long_white_space(text):
    own = Tokenizer.from_file(BYTES)
    assert token_counts.counts([text, "a b"], BYTES, 16_384, 1 << 20) == [len(own.encode(text, add_special_tokens=False).ids), 2]


def test_registered_digests(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: library.encode(t or "", add_eos=True) for i, t, *_ in rows}
    got = {x.doc_id: x for x in queries.op11_sentencepiece(spark, str(tmp_path)).collect()}
    assert {i: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for i, x in got.items()} == {i: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in ids.items()}
    brute.own, brute.library = Tokenizer.from_file(BYTES), library
    brute.own.encode_special_tokens = True
    for x in queries.op12_alignment(spark, str(tmp_path)).collect():
        text = next(t for i, t, *_ in rows if i == x.doc_id)
        if not text or len(text) < 1000:
            a, b, groups, links = brute(text)
            assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256) == (a, b, len(links), len(links), sha(groups) if groups else "")


def test_ids_are_read_as_lists_at_once():
    ids = pa.array([[1, 2], None, [], [3], [4, 5, 6]], pa.list_(pa.int32()))
    for start in range(6):
        for size in range(6 - start):
            part = ids.slice(start, size)
            assert pieces.id_lists(part) == part.to_pylist()
    assert pieces.id_lists(pa.array([[1, None], [2]])) == [[1, None], [2]]
    assert pieces.id_lists(pa.array([[1 << 40]])) == [[1 << 40]]
    hidden = pa.ListArray.from_arrays([0, 2, 3], pa.array([1, 2, 3]), mask=pa.array([True, False]))
    assert pieces.id_lists(hidden) == [None, [3]]
