"""Names in texts, structure specs and syllables against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from taleweave.operators import allocation, inventory, portraits, sounds, specs


def brute_places(text, names):
    """One name after another, long ones first; each looked for behind its last place, what overlaps a taken one left out."""
    taken, out = [], []
    for name in sorted({n for n in names if n and len(n) >= 2}, key=lambda n: (-len(n), n)):
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if all(end <= a or b <= at for a, b in taken):
                taken.append((at, end))
                out.append((at, end, name))
            at = text.find(name, end)
    return sorted(out)


@pytest.fixture(scope="module")
def cast(spark):
    r = random.Random(8)
    names = ["aa", "ab", "aab", "ba", "abab", "八奈见", "八奈见杏菜", "奈见", "x", "", None, "b😀", "aaaa"] + ["".join(r.choice("abc") for _ in range(r.randrange(2, 6))) for _ in range(30)]
    texts = ["".join(r.choice(["a", "b", "c", "八奈见", "杏菜", "😀", " "]) for _ in range(r.randrange(0, 60))) for _ in range(150)] + [None, "", "aaaaaaa", "八奈见杏菜八奈见", "ab" * 3000]
    return names, texts


@pytest.mark.parametrize("most", [1_000_000, 12])
def test_names_are_located(spark, cast, most):
    names, texts = cast
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = inventory.located(t, spark.createDataFrame([(n,) for n in names], "name string"), most_names=most).collect()
    want = sorted((k, *p) for k, x in enumerate(texts) if x for p in brute_places(x, names))
    assert sorted(map(tuple, got)) == want and len(want) > 500
    held = sorted((k, n) for k, x in enumerate(texts) for n in set(names) if x and n and len(n) >= 2 and n in x)
    assert sorted(map(tuple, inventory.present(t, spark.createDataFrame([(n,) for n in names], "name string"), most).collect())) == held


def test_no_names_and_no_texts(spark):
    t = spark.createDataFrame([(1, "a text"), (2, None)], "id int, text string")
    names = spark.createDataFrame([("text",), ("x",)], "name string")
    assert inventory.located(t, names.limit(0)).collect() == [] and inventory.located(t.limit(0), names).collect() == []
    assert [tuple(r) for r in inventory.inventory(t, names).collect()] == [(1, "text", 1, 2)]


def test_inventory_by_length_and_clusters(spark):
    long = "Ann " * 3 + "Bob " + "." * 3000
    t = spark.createDataFrame([(1, long), (2, "Bob met Ann, Anne met Bob")], "id int, text string")
    names = spark.createDataFrame([("Ann",), ("Anne",), ("Bob",)], "name string")
    found = inventory.inventory(t, names)
    assert sorted((r.id, r.name, r.mentions, r.first) for r in found.collect()) == [(1, "Ann", 3, 0), (2, "Ann", 1, 8), (2, "Anne", 1, 13), (2, "Bob", 2, 0)]
    links = spark.createDataFrame([("Ann", "Anne")], "a string, b string")
    assert sorted((r.id, r.name, r.mentions, r.aliases) for r in inventory.clustered(found, links).collect()) == [(1, "Ann", 3, []), (2, "Ann", 2, ["Anne"]), (2, "Bob", 2, [])]


RULES = (("mark", 0.95, r"^# .+"), ("part", 0.9, r"^Part \d+"), ("weak", 0.5, r"^\* .+"))


def test_structure_specs(spark):
    body = "x" * 200 + "\n"
    texts = {
        "marks": "# one\n" + body + "# two\n" + body + "Part 1\n",
        "parts": body + "Part 1\n" + body,
        "weak": "* one\n" + body,
        "none": body,
        "narrow": "# a\n# b\n" + body * 60 + "Part 1\n",
        "many": "# h\n" * 501,
        "most": "# h\n" * 500,
        "blank": "",
    }
    docs = spark.createDataFrame([*texts.items(), ("null", None)], "doc_id string, text string").repartition(2)
    found = specs.structure_specs(docs, rules=RULES)
    got = {r.doc_id: (r.rule, r.hits, r.refused) for r in found.collect()}
    assert got == {"marks": ("mark", 2, ""), "parts": ("part", 1, ""), "weak": ("default", 0, "weak:low_confidence"), "none": ("default", 0, ""), "narrow": ("part", 1, "mark:narrow"), "many": ("default", 0, "mark:too_many_hits"), "most": ("mark", 500, ""), "blank": ("default", 0, "")}
    cut = {}
    for r in specs.chapters_by_spec(docs, found, rules=RULES).orderBy("doc_id", "chapter_idx").collect():
        cut.setdefault(r.doc_id, []).append((r.title, r.text))
    assert [t for t, _ in cut["marks"]] == ["one", "two"] and "Part 1" in cut["marks"][1][1]
    assert [t for t, _ in cut["parts"]] == ["", "Part 1"] and cut["none"] == [("", texts["none"])]
    assert "blank" not in cut and "null" not in cut and len(cut["most"]) == 500


def test_spans_are_measured_in_characters(spark):
    text = "é" * 10 + "\n# a\n" + "😀" * 50 + "\n# b\n"
    got = specs.structure_specs(spark.createDataFrame([(1, text)], "doc_id int, text string"), rules=RULES).first()
    at = [m.start() for m in re.finditer("(?m)^# ", text)]
    assert got.span == pytest.approx(round((at[1] - at[0]) / len(text), 6))


def test_sounds(spark):
    r = random.Random(2)
    read = {c: s for c, s in zip("利姆露路鲁度朱菜才", "li mu lu lu lu du zhu cai cai".split(), strict=True)}
    names = sorted({"".join(r.choice(list(read)) for _ in range(r.randrange(1, 5))) for _ in range(120)} | {"利Q露", ""})
    readings = spark.createDataFrame(list(read.items()), "char string, syllable string")
    spoken = sounds.with_syllables(spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string"), readings)
    said = {x.name: x.syllables for x in spoken.collect()}
    assert said == {n: [read.get(c, c) for c in n] for n in names if n}

    def alike(a, b):
        a, b = said[a], said[b]
        differ = sum(x != y for x, y in zip(a, b, strict=False))
        return 0 if len(a) != len(b) else 1.0 if differ == 0 else round(1 - 1 / len(a), 6) if differ == 1 and len(a) > 1 else 0

    want = {(a, b): alike(a, b) for a in said for b in said if a < b and alike(a, b)}
    got = sounds.sounding_alike(spoken).collect()
    assert {(x.a, x.b): x.likeness for x in got} == want and len(got) == len(want)
    both = spark.createDataFrame([(said[a], said[b]) for a, b in want], "a array<string>, b array<string>")
    assert sorted(round(x[0], 6) for x in both.select(sounds.sound_likeness(F.col("a"), F.col("b"))).collect()) == sorted(want.values())


def test_calls_go_on_to_the_next_window(spark):
    r = random.Random(4)
    windows = [(v, c, w, r.randrange(5)) for v in "ab" for c in range(6) for w in range(r.randrange(1, 6))]
    yields = [(v, c, w, n, r.randrange(0, 4)) for v, c, w, _ in windows for n in ("A", "B", "C") if r.random() < 0.6]
    quota, calls = {"A": 5, "B": 9}, 8
    want = {}
    for v in "ab":
        mine = sorted({(c, w, a) for x, c, w, a in windows if x == v})
        order = sorted(((i, -a, c, w) for c in range(6) for i, (_, w, a) in enumerate(m for m in mine if m[0] == c)), key=lambda x: x)
        have, made, place = {}, 0, 0
        for i, _, c, w in order:
            if i >= 3:
                want[v, c, w] = (None, None, "chapter_cap")
                continue
            place += 1
            given = {n: t for x, d, y, n, t in yields if (x, d, y) == (v, c, w) and t > 0}
            if not given:
                want[v, c, w] = (place, None, "no_names")
            elif all(have.get(n, 0) >= quota.get(n, 0) for n in given):
                want[v, c, w] = (place, None, "met")
            elif made == calls:
                want[v, c, w] = (place, None, "budget")
            else:
                made += 1
                want[v, c, w] = (place, made, None)
                for n, t in given.items():
                    have[n] = have.get(n, 0) + t
    w = spark.createDataFrame(windows, "v string, chapter int, window int, activity int")
    y = spark.createDataFrame(yields, "v string, chapter int, window int, name string, turns int")
    got = allocation.planned_calls(w, y, spark.createDataFrame(list(quota.items()), "name string, quota int"), "v", calls).collect()
    assert {(x.v, x.chapter, x.window): (x.place, x.call, x.reason) for x in got} == want and len(got) == len(want)


def test_portraits(spark):
    turns = spark.createDataFrame([(1, 1, "Ann", "hi", "happy"), (1, 2, "Bob", "yes", ""), (1, 3, "Annie", "hi", "sad"), (2, 1, "Ann", "go", "happy"), (2, 2, None, "x", "sad"), (2, 3, "", "x", None)], "block int, pos int, speaker string, content string, mood string")
    sentences = spark.createDataFrame([(1, "Annie met Bob"), (2, "Bob left"), (3, "nobody"), (4, None)], "id int, text string")
    aliases = spark.createDataFrame([("Annie", "Ann")], "alias string, canonical string")
    counts = portraits.counters(turns, sentences, aliases)
    got = {(x.name, x.counter, x.key): x.n for x in counts.collect()}
    # Ann stands in "Annie met Bob" under both her names
    assert got == {("Ann", "appearance", ""): 5, ("Ann", "dialogue", ""): 3, ("Bob", "appearance", ""): 3, ("Bob", "dialogue", ""): 1, ("Ann", "mood", "happy"): 2, ("Ann", "mood", "sad"): 1, ("Ann", "with", "Bob"): 4, ("Bob", "with", "Ann"): 4}
    stats = portraits.statistics(counts)
    assert {x.name: (x.appearance, x.dialogue, x.moods, x.company) for x in stats.collect()} == {"Ann": (5, 3, "happy=2,sad=1", "Bob=4"), "Bob": (3, 1, "", "Ann=4")}
    card = {x.name: x for x in portraits.cards(stats, turns, sentences, aliases).collect()}
    assert card["Ann"].samples == ["hi", "go"] and card["Ann"].aliases == ["Annie"] and card["Bob"].snippets == ["Annie met Bob", "Bob left"]
    assert card["Ann"].card == "Ann\nalso: Annie\nmoods: happy=2,sad=1\nwith: Bob=4\nsays: hi / go\ntold: Annie met Bob"
    assert portraits.statistics(portraits.counters(turns.limit(0), sentences, aliases)).collect() == []
