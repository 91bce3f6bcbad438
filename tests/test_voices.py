"""Attribution of quotes: windows, proposals and verdicts."""

import pytest

from taleweave.operators import attribution as at

SPANS = "id int, start long, end long, content string, hint string, confidence double"
PART = 'Anna opened the door. "A" Bob: "B" It was cold. "C" "D" said nobody. Anna smiled at that. "E" '


@pytest.fixture(scope="module")
def story(spark):
    """Quotes A to E; then, far behind, one more, and texts with a single quote."""
    text = PART + "." * 600 + ' "F" and Bob left.'
    places = {c: text.index(f'"{c}"') for c in "ABCDEF"}
    hints = {"B": ("Bob", 0.9), "C": ("Anna", 0.3)}
    rows = [(1, p, p + 3, c, *hints.get(c, (None, 0.0))) for c, p in places.items()]
    rows += [(2, 0, 3, "x", None, None), (3, 0, 3, "x", "Eve", 0.2), (4, 0, 3, "y", "Kim", 0.8), (5, 0, 3, "z", None, None)]
    texts = spark.createDataFrame([(1, text), (2, '"x" nobody'), (3, '"x" and then Eve'), (4, '"y"'), (5, None)], "id int, text string")
    return texts, spark.createDataFrame(rows, SPANS).repartition(2), places


def test_windows(story):
    texts, spans, places = story
    got = {(r.id, r.window): r for r in at.windows(texts, spans).collect()}
    p = places
    assert {k: [*r.targets] for k, r in got.items() if k[0] == 1} == {(1, 1): [p["A"], p["C"]], (1, 2): [p["C"], p["D"]], (1, 3): [p["D"], p["E"]], (1, 4): [p["F"]]}
    assert [got[1, k].neighbours for k in (1, 2, 3, 4)] == [[], ["Bob"], ["Bob"], ["Bob"]]
    assert got[1, 2].candidates == ["Bob", "Anna"] and got[1, 2].before.endswith("It was cold.") and got[1, 3].after.startswith(".")
    assert got[2, 1].candidates == [] and got[3, 1].candidates == ["Eve"] and (4, 1) not in got and (5, 1) not in got


def test_verdicts(story):
    texts, spans, places = story
    found = at.windows(texts, spans)
    got = {(r.id, r.content): r for r in at.attributed(spans, found, at.proposed(found)).collect()}
    assert len(got) == spans.count()
    said = {k: (r.speaker, r.confidence, r.source, r.reason) for k, r in got.items()}
    assert said[1, "B"] == ("Bob", 0.9, "rule", None) and said[4, "y"] == ("Kim", 0.8, "rule", None)
    assert said[1, "A"] == ("Anna", 0.6, "window", None)
    assert said[1, "E"][0] in ("Anna", "Bob") and said[1, "E"][2] == "window"
    assert said[1, "F"] == ("Bob", 0.55, "window", None)
    assert said[2, "x"] == (None, 0.0, "unresolved", "no_candidate") and said[3, "x"] == ("Eve", 0.55, "window", None)
    assert said[5, "z"] == (None, 0.0, "unresolved", "no_window")


def test_the_surest_proposal_of_a_candidate_counts(spark, story):
    texts, spans, places = story
    found, p = at.windows(texts, spans), places
    rows = [(1, p["D"], 2, "Bob", 0.7, "model"), (1, p["D"], 3, "Anna", 0.7, "before"), (1, p["D"], 2, "Zoe", 0.99, "model"), (1, p["C"], 1, "Bob", 0.2, "turn")]
    proposals = spark.createDataFrame(rows, "id int, start long, window int, speaker string, confidence double, source string")
    said = {r.content: (r.speaker, r.source, r.reason) for r in at.attributed(spans.where("id = 1"), found, proposals).collect()}
    assert said["D"] == ("Anna", "window", None), "Zoe is no candidate; of equals the earlier source counts"
    assert said["C"] == ("Bob", "low_confidence", None) and said["A"] == (None, "unresolved", "no_proposal")


def test_wider_windows_with_steps(spark):
    spans = spark.createDataFrame([(1, 10 * k, 10 * k + 3, "q", None, None) for k in range(7)], SPANS)
    texts = spark.createDataFrame([(1, "." * 80)], "id int, text string")
    got = at.windows(texts, spans, width=3, step=2).orderBy("window").collect()
    assert [[t // 10 for t in r.targets] for r in got] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    even = at.windows(texts, spans.where("start < 60"), width=3, step=2).orderBy("window").collect()
    assert [[t // 10 for t in r.targets] for r in even] == [[0, 1, 2], [2, 3, 4], [4, 5]]
    assert at.windows(texts, spans.limit(0)).collect() == []
