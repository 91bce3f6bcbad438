"""Answers to questions on a small story: scope, fallback, variants, period, and what stands around a hit."""

import pytest

from taleweave.operators import answering as an

BLOCK = "id long, text string, channel string, series string, names array<string>, chapter_order int"
ALIAS = "alias string, canonical string, kind int, series string"
ALIASES = [("ember", "emberlynn", 1, "a"), ("emberlynn", "emberlynn", 2, "a"), ("torvald", "torvald", 2, "b"), (None, "x", 1, "a")]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        (1, "emberlynn opened the gate", "narrative", "a", ["emberlynn"], 1),
        (2, "the gate of the castle", "narrative", "a", ["emissary"], 2),
        (3, "the gate was shut", "dialogue", "b", ["torvald"], 3),
        (4, "the gate again", "character", "a", ["emberlynn"], 9),
        (5, "the gate at first", "character", "a", ["emberlynn"], 1),
        (6, "the gate, no order", "character", "a", ["emberlynn"], None),
        (7, None, "narrative", "a", None, None),
        (8, "the gate elsewhere", "unheard", "a", ["emberlynn"], 1),
        (9, "the gate of nobody", None, None, None, None),
        (10, "", "qa", "b", [], 1),
    ]
    return spark.createDataFrame(rows, BLOCK)


def asked(spark, blocks, rows, k=10, aliases=ALIASES):
    q = spark.createDataFrame(rows, "query_id long, query string, rewrites array<string>")
    found = an.answer(q, blocks, spark.createDataFrame(aliases, ALIAS), k).collect()
    return {i: {r.id: r.level for r in found if r.query_id == i} for i in {x.query_id for x in found}}


def test_scope_and_fallback(spark, blocks):
    got = asked(spark, blocks, [(1, "gate emberlynn", None), (2, "gate torvald", None), (3, "the gate", []), (4, None, None), (5, "zzqq", None)])
    assert got[1] == {1: 0, 4: 0, 5: 0, 6: 0}
    assert got[2] == {3: 0}
    assert set(got[3]) == {1, 2, 3, 4, 5, 6} and set(got[3].values()) == {0}
    assert 4 not in got and 5 not in got
    # without exact names a part of the name counts, without that the series alone
    rest = blocks.where("id IN (2, 3)")
    assert asked(spark, rest, [(1, "gate emberlynn", None)]) == {1: {2: 1}}
    assert asked(spark, rest.where("id = 3"), [(1, "gate emberlynn", None)]) == {}


def test_series_alone_is_the_last_scope(spark, blocks):
    from pyspark.sql import functions as F

    nameless = blocks.where("id IN (2, 3)").withColumn("names", F.lit(None).cast("array<string>"))
    assert asked(spark, nameless, [(1, "gate emberlynn", None)]) == {1: {2: 2}}
    # names of several series leave no scope, so there is nothing to fall back to
    assert asked(spark, nameless, [(1, "gate emberlynn torvald", None)]) == {}


def test_variants_find_more(spark, blocks):
    one = blocks.where("id = 1")
    question = "wwwwvvvvwwww"
    assert asked(spark, one, [(1, question, None)]) == {}
    assert asked(spark, one, [(1, question, ["", "gate"])]) == {1: {1: 0}}
    planned = an.plan_questions(spark.createDataFrame([(1, "who is ember", ["who is ember", " "])], "query_id long, query string, rewrites array<string>"), spark.createDataFrame(ALIASES, ALIAS)).first()
    assert planned.variants == ["who is ember", "emberlynn"] and planned.series == "a" and planned.intent == "character"


def test_period_limits_relations_only(spark, blocks):
    early, late = asked(spark, blocks, [(1, "gate emberlynn earlier", None)])[1], asked(spark, blocks, [(1, "gate 后来 emberlynn", None)])[1]
    assert set(early) == {1, 5} and set(late) == {1, 4}


def test_empty_tables(spark, blocks):
    q = [(1, "gate", None)]
    assert asked(spark, blocks.limit(0), q) == {}
    assert asked(spark, blocks, []) == {}
    assert set(asked(spark, blocks, q, aliases=[])[1]) == {1, 2, 3, 4, 5, 6}


def brute_contexts(hits, texts, radius, most):
    out, kept = {}, []
    for rank, doc, chapter, idx in sorted(hits):
        if any((d, c) == (doc, chapter) and abs(i - idx) <= radius for d, c, i in kept):
            continue
        kept.append((doc, chapter, idx))
        parts, total = [], 0
        for i in range(idx - radius, idx + radius + 1):
            t = (texts.get((doc, chapter, i)) or "").strip(" ")
            if not t:
                continue
            if total and total + len(t) > most:
                if most - total > an.LEAST_REST:
                    parts.append(t[: most - total] + "…")
                break
            parts.append(t)
            total += len(t)
        if parts:
            out[rank] = "\n".join(parts)
    return out


def test_contexts_equal_a_fold(spark):
    import random

    r = random.Random(5)
    texts = {(d, c, i): r.choice([None, "", "  ", "x" * r.randrange(1, 400), "word " * r.randrange(1, 60)]) for d in range(2) for c in range(2) for i in range(12)}
    parents = spark.createDataFrame([(*k, v) for k, v in texts.items()], "doc_id int, chapter_idx int, idx int, text string")
    asked_ = {q: [(n + 1, r.randrange(2), r.randrange(2), r.randrange(12)) for n in range(8)] for q in range(12)}
    hits = spark.createDataFrame([(q, *h) for q, hs in asked_.items() for h in hs], "query_id int, rank int, doc_id int, chapter_idx int, idx int")
    for radius, most in ((1, 500), (2, 300), (0, 100)):
        got = {}
        for x in an.contexts(hits, parents, radius, most).collect():
            got.setdefault(x.query_id, {})[x.rank] = x.text
        assert got == {q: b for q, hs in asked_.items() if (b := brute_contexts(hs, texts, radius, most))}
