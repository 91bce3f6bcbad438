"""Mentions, names and speech, against plain Python."""

import random

from pyspark.sql import functions as F

from taleweave.functions import speech
from taleweave.operators import asking, entities, structure, turns


def brute_mentions(text, names):
    taken, found = [False] * len(text), []
    for n in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        at = 0
        while (at := text.find(n, at)) >= 0:
            if any(taken[at : at + len(n)]):
                at += 1
                continue
            taken[at : at + len(n)] = [True] * len(n)
            found.append((at, at + len(n), n))
            at += len(n)
    return sorted(found)


def test_mentions_take_long_names_first(spark):
    r = random.Random(3)
    names = ["ab", "abc", "bcd", "d", "dab", "", "转生", "转生之", "a.b"]
    texts = [(k, "".join(r.choice(["a", "b", "c", "d", "转", "生", "之", ".", " "]) for _ in range(40))) for k in range(40)] + [(99, ""), (100, None)]
    got = asking.mentions(spark.createDataFrame(texts, "id int, text string"), F.array(*[F.lit(n) for n in names])).collect()
    for k, t in texts:
        assert sorted((x.start, x.end, x.name) for x in got if x.id == k) == brute_mentions(t or "", names)


def test_near_pairs_of_any_first_character(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abéс") for _ in range(r.randrange(1, 8))) for _ in range(120)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for most in (1, 2):
        want = {(a, b, edits(a, b)) for i, a in enumerate(names) for b in names[i + 1 :] if edits(a, b) <= most}
        got = entities.near_pairs_exact(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), most).collect()
        assert {(min(x.a, x.b), max(x.a, x.b), x.edits) for x in got} == want


def test_windows_of_a_long_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(10_001)) + "😀" * 7
    for width, stride in ((3500, 2000), (400, 400), (350, 200), (1000, 300)):
        got = structure.sliding_windows(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id int, text string"), 600, width, stride).collect()
        assert all(x.text == text[x.start : x.end] for x in got if x.doc_id == 1)
        starts = [x.start for x in sorted(got, key=lambda x: x.window) if x.doc_id == 1]
        assert starts == list(range(0, starts[-1] + 1, stride)) and starts[-1] + width >= len(text) > starts[-1] + width - stride
        assert [(x.start, x.end, x.text) for x in got if x.doc_id == 2] == [(0, 5, "short")]


def test_spaced_and_reliable(spark):
    rows = [("a", p) for p in (5, 6, 11, 30, 35, 36)] + [("b", 1)]
    got = turns.spaced(spark.createDataFrame(rows, "g string, p long"), "g", "p", 6).collect()
    assert sorted(map(tuple, got)) == [("a", 5), ("a", 11), ("a", 30), ("a", 36), ("b", 1)]


def test_speech(spark):
    rows = spark.createDataFrame([("「张三说道：",), (" Bob: ",), (None,)], "s string").select(speech.clean_speaker(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == ["张三", "Bob", ""]
    got = spark.range(1).select(speech.numbered(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("n"), speech.mood(F.lit("He laughed")).alias("m"), speech.is_question(F.lit("where to")).alias("q")).first()
    assert tuple(got) == ("1. a\n2. b", "happy", True)
