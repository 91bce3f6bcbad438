"""Samples of speech and evidence for role-play."""

from taleweave.operators import roleplay as rp


def test_samples_the_card_lacks(spark):
    turns = [
        (1, 1, "Ann", "I will go home now"), (1, 2, "Bob", "Stay a while with us"), (1, 3, "Ann", "I will go home now!"), (1, 4, "Ann", "  "), (1, 5, None, "who spoke"),
        (2, 1, "Ann", "The sea is green today"), (2, 2, "Ann", "Never ask me that"), (3, 1, "Bob", "Only Bob is here"),
    ]
    turns = spark.createDataFrame(turns, "block int, pos int, speaker string, content string")
    asked = spark.createDataFrame([("q1", "Ann"), ("q2", "Ann"), ("q3", "Cid"), ("q4", "Ann")], "query_id string, character string")
    hits = spark.createDataFrame([("q1", 1, 2), ("q1", 2, 1), ("q2", 1, 1), ("q3", 1, 3), ("q4", 1, 9)], "query_id string, rank int, block int")
    known = spark.createDataFrame([("Ann", ["never ask me THAT."]), ("Ann", None)], "character string, samples array<string>").where("samples IS NOT NULL")
    got = {}
    for r in rp.style_samples(asked, hits, turns, known).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.speaker, r.content, r.relaxed))
    # q1 has two sayings of Ann that are no copies and not on the card; q2 only one, so the others follow
    assert got["q1"] == [("Ann", "The sea is green today", False), ("Ann", "I will go home now", False)]
    assert got["q2"] == [("Ann", "I will go home now", False), ("Bob", "Stay a while with us", True), (None, "who spoke", True)]
    assert got["q3"] == [("Bob", "Only Bob is here", True)] and "q4" not in got
    assert rp.style_samples(asked, hits.limit(0), turns, known).collect() == []


def test_evidence_of_several_kinds(spark):
    schema = "query_id string, place int, id string, text string"
    asked = spark.createDataFrame([("q", "Ann")], "query_id string, character string")
    facts = spark.createDataFrame([("q", 1, "a", "A"), ("q", 2, "b", "B"), ("q", 3, "c", "C"), ("x", 1, "a", "A")], schema)
    told = spark.createDataFrame([("q", 1, "b", "B"), ("q", 2, "d", "D"), ("q", 3, "e", ""), ("q", 4, "c", "C")], schema)
    got = rp.evidence(asked, {"fact": (facts, 2), "told": (told, 2)}).orderBy("kind", "rank").collect()
    # c was a fact first, though beyond the limit there, so it isn't told again
    assert [(r.kind, r.rank, r.id) for r in got] == [("fact", 1, "a"), ("fact", 2, "b"), ("told", 1, "d")]
    relations = [("r1", "Ann", "Bob", "old", "d1", 1), ("r2", "Bob", "Ann", "new", "d1", 5), ("r3", "Ann", "Cid", "x", "d0", 9), ("r4", "Ann", "Ann", "self", "d9", 9)]
    relations = spark.createDataFrame(relations, "id string, source string, target string, text string, doc_id string, chapter_order int")
    assert [(r.place, r.id) for r in rp.relation_hits(asked, relations).orderBy("place").collect()] == [(1, "r2"), (2, "r3")]


def test_sayings_like_a_cards_are_those_of_all_pairs(spark):
    import random

    r = random.Random(5)
    sets = [list(t) for t in sorted({tuple(sorted(r.sample("abcdefghij", r.randrange(1, 10)))) for _ in range(150)})]
    r.shuffle(sets)
    sets.append([])
    said, known = sets[:100] + [[]], sets[60:]
    frame = lambda rows: spark.createDataFrame([("".join(w), w) for w in rows], "key string, words array<string>")
    want = {("".join(a), "".join(b)) for a in said for b in known if len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    got = rp.like_known(frame(said), frame(known))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 50 and got.count() == len(want)
