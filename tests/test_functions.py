"""Expressions and operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from taleweave.functions import jsonx, names, text, vectors
from taleweave.operators import entities, graphs, keyword, nearest, operations, ranking, scope, story, structure, turns


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(("value", "want"), [("", []), ("一", []), ("一二", ["一二"]), ("a😀b", ["a😀", "😀b"])])
def test_bigrams(spark, value, want):
    assert one(spark, text.char_ngrams(F.lit(value))) == want


@pytest.mark.parametrize(("value", "want"), [("十二", 12), ("二十", 20), ("九十九", 99), ("十", 10), ("七", 7), ("15", 15), ("百", None), ("", None)])
def test_numerals(spark, value, want):
    assert one(spark, text.numeral(F.lit(value))) == want


def test_hints_and_ids(spark):
    assert one(spark, text.volume_hint(F.lit("第三卷的事"))) == 3 and one(spark, text.section_hint(F.lit("chapter 12"))) == 12
    assert one(spark, text.series_of(F.lit("A__vol01"))) == "A" and one(spark, text.volume_of(F.lit("A__vol07"))) == 7 and one(spark, text.make_doc_id(F.lit("A"), F.lit(3))) == "A__vol03"


def test_cleaning(spark):
    assert one(spark, text.clean_lines(F.lit("good line\nwww.spam.com\n!!!!!!!!!!!!\n12, 34\nx\n"))) == "good line\nx\n"
    assert one(spark, text.normalize_text(F.lit("ＡＢＣ１　x\n\n\n\ny"))) == "ABC1 x\n\ny"
    assert one(spark, text.strip_markdown(F.lit("# Head\n**b** [l](u) `c`\n- item"))) == "Head\nb l c\nitem"
    assert one(spark, text.sentences(F.lit("One. Two! 三。"))) == ["One.", " Two!", " 三。"]
    assert one(spark, structure.repair_paragraphs(F.lit("a broken\nline here\n\n# Head\nnext. \nand on"))).split("\n") == ["a broken line here", "", "# Head next.", "and on"]


def test_names(spark):
    assert one(spark, names.strip_honorific(F.lit("利姆露大人"))) == "利姆露"
    assert [one(spark, names.is_noise_name(F.lit(n))) for n in ("利姆露", "他说", "来", None)] == [False, True, True, True]
    assert one(spark, names.relaxed_names(F.array(F.lit("利姆露"), F.lit("维鲁多拉")))) == ["利姆露", "利姆", "维鲁多拉", "维鲁", "多拉"]
    assert one(spark, names.matched_names(F.lit("露伊莎走了"), ["露伊", "露伊莎", "莎"])) == ["露伊莎"]


def test_json(spark):
    assert one(spark, jsonx.tolerant(F.lit('sure: ```json\n{"a": 1}\n```'), "a int")).a == 1
    assert one(spark, jsonx.looks_cut(F.lit('{"a": [1, 2'))) and not one(spark, jsonx.looks_cut(F.lit("{}")))


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.norm(v)) == 5 and one(spark, vectors.cosine(v, v)) == pytest.approx(1) and one(spark, vectors.sanitized(F.array(F.lit(float("nan")), F.lit(1.0)))) == [0, 1]
    with pytest.raises(Exception, match="expected 3"):
        one(spark, vectors.sanitized(v, 3))


def test_cost(spark):
    cost = lambda p, c, k=0: one(spark, operations.cost(F.lit("deepseek-chat"), F.lit(p), F.lit(c), F.lit(k)))
    m = 1_000_000
    assert [cost(m, m), cost(m, 0, m), cost(m, m, m // 2), cost(m, 0, 2 * m)] == [0.42, 0.035, 0.3675, 0.035]


def test_scope(spark):
    rows = spark.createDataFrame([("A__vol01", ["x"], None, None, "c", "child"), ("A__vol02", ["y"], ["x"], None, "c", "parent"), ("B__vol01", ["x"], None, None, "c", None), ("AB", [], None, "O'Brien", "d", None)], "doc_id string, characters array<string>, all_person array<string>, character_name string, chapter_title string, granularity string")
    ids = lambda s: [r.doc_id for r in rows.where(s.condition()).collect()]
    assert ids(scope.Scope(series="A")) == ["A__vol01", "A__vol02"] and ids(scope.Scope(series="AB")) == ["AB"]
    assert ids(scope.Scope(names=("x", "O'Brien"))) == ["A__vol01", "A__vol02", "B__vol01", "AB"]
    assert ids(scope.Scope(doc_ids=("A__vol01",), granularity="child")) == ["A__vol01"] and ids(scope.Scope(chapter_has=("d",))) == ["AB"]


def test_keyword_search_edges(spark):
    blocks = spark.createDataFrame([(1, "hot springs town", "a"), (2, None, "b"), (3, "", "a"), (4, "springs", "b")], "id long, text string, chapter string")
    queries = spark.createDataFrame([(1, "springs"), (2, "x"), (3, "a")], "query_id long, query string")
    hits = keyword.bm25(blocks, queries, 5).collect()
    assert [(h.query_id, h.id) for h in hits] == [(1, 4), (1, 1)]
    named = keyword.bm25(blocks, queries.where("query_id = 3"), 5, exact=["chapter"], names=["a"]).collect()
    assert [(h.id, h.score >= 3) for h in named] == [(1, True), (3, True)]


def test_fusion_keeps_first_order(spark):
    a = spark.createDataFrame([(1, 10, 1, 0.9), (1, 20, 2, 0.8)], "query_id long, id long, rank int, similarity double")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, id long, rank int")
    assert [(x.id, x.n_lists) for x in ranking.fuse_ranks([a, b]).orderBy("rank").collect()] == [(20, 2), (10, 1), (30, 1)]


def test_nearest(spark):
    b = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, None, 1)], "id long, vector array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [x.id for x in nearest.search(b, q, 2).orderBy("rank").collect()] == [2, 3]
    assert nearest.search(b.where("false"), q, 2).count() == 0


def test_turns(spark):
    rows = [("c", 1, "unknown", "「你好」", 0.4), ("c", 2, "A", "你好", 0.3), ("c", 3, "B", "你 好", 0.9), ("c", 4, "A", "……", 0.9), ("c", 5, "A", "bye", 0.5)]
    got = turns.dedupe_turns(spark.createDataFrame(rows, "conv string, pos int, who string, said string, f double"), "conv", "pos", "who", "said", "f", unknown="unknown").orderBy("position").collect()
    assert [(g.position, g.speaker, g.confidence) for g in got] == [(1, "B", 0.9), (5, "A", 0.5)]
    ints = spark.createDataFrame([("g", i) for i in range(7)], "g string, i int")
    assert [r.i for r in turns.interleaved(ints, "g", "i").orderBy("position").collect()] == [0, 3, 5, 1, 4, 6, 2]


def test_importance_and_decay(spark):
    rows = spark.createDataFrame([("史莱姆", 999, 0)] + [(f"n{i:02}", 100 - i, 1) for i in range(30)], "name string, m int, c int")
    got = {r.name: r.importance for r in turns.tiers(rows, "m", "c", "name", blacklist=("史莱姆",)).collect()}
    assert got["史莱姆"] == "extra" and sum(v == "main" for v in got.values()) == 5 and sum(v == "supporting" for v in got.values()) == 20
    old, new = (spark.createDataFrame([("利姆露", n, a)], "name string, n int, a array<string>") for n, a in ((100, ["x"]), (5, ["y"])))
    assert tuple(entities.decayed_merge(old, new, "name", "n", "a").first()) == ("利姆露", 85, ["x", "y"])


def test_near_names(spark):
    n = spark.createDataFrame([("利姆路",), ("利姆露",), ("温水",), ("温水佳树",)], "name string")
    assert [(r.a, r.b) for r in entities.near_pairs(n, 1).collect()] == [("利姆路", "利姆露")]


def test_communities(spark):
    e = [("s", "利姆露", "维鲁多拉", 5.0), ("s", "利姆露", "朱菜", 4.0), ("s", "朱菜", "兰加", 3.0), ("s", "温水和彦", "八奈见杏菜", 5.0), ("s", "温水和彦", "烧盐柠檬", 4.0)]
    got = graphs.communities(spark.createDataFrame(e, "s string, a string, b string, weight double"), "s")
    assert got.select("community").distinct().count() == 2
    assert graphs.greedy_modularity([("a", "b", 1.0)], ["a", "b", "c", "d"]) == [["a", "b"], ["c"], ["d"]] and graphs.greedy_modularity([], []) == []


def test_paths_and_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (8, 9)], "a long, b long")
    p = {r.node: r.path for r in graphs.shortest_paths(links, spark.createDataFrame([(1,)], "source long"), 5).collect()}
    assert p == {1: [1], 2: [1, 2], 4: [1, 4], 3: [1, 2, 3]}
    assert {(r.node, r.root) for r in graphs.connected(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_story(spark):
    e = spark.createDataFrame([("s", "e1", "talk", None, "建国", "d", 2), ("s", "e2", "plot", 1, "", "d", 9), ("s", "e3", "talk", None, "", "d", 0), ("s", "e4", "talk", None, "转生前", "d", 5)], "s string, event_id string, event_type string, year int, period string, doc_id string, chapter_order int")
    got = story.chronicle(e, "s").orderBy("seq").collect()
    assert [(r.event_id, r.key_event) for r in got] == [("e2", True), ("e4", False), ("e1", False), ("e3", False)]
    t = lambda era, a, b, ask, year: one(spark, story.time_matches(F.lit(era), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(ask), F.lit(year).cast("int")))
    assert [t("建国", None, None, "建国", None), t("建国", None, None, "大战", None), t("其他", None, None, "大战", None), t("", 3, 5, "", 4), t("", 3, 5, "", 9), t("", None, None, "", None)] == [True, False, True, True, False, True]


def test_chunks_lose_nothing(spark):
    doc = "\n".join(f"paragraph {i} " + "x" * (i * 37 % 200) for i in range(40))
    rows = spark.createDataFrame([("d", doc), ("e", "short"), ("f", None)], "doc_id string, text string")
    flat = structure.flat_chunks(rows).collect()
    assert {p for c in flat if c.doc_id == "d" for p in c.text.split("\n")} == set(doc.split("\n")) and [c.text for c in flat if c.doc_id == "e"] == ["short"]
    both = structure.parent_child_chunks(structure.chapters(rows.where("text IS NOT NULL"), 0.9)).collect()
    parents = {c.global_id: c.text for c in both if c.granularity == "parent"}
    for g, t in parents.items():
        children = sorted((c for c in both if c.parent_id == g), key=lambda c: c.child_idx)
        assert "".join(c.text for c in children).strip() == t.strip() and children[0].prev_id is None and children[-1].next_id is None
    spans = structure.quote_spans(spark.createDataFrame([("q", 'He said “go 😀 now” and "left" it')], "doc_id string, text string")).orderBy("start").collect()
    assert [(s.start, s.end, s.content) for s in spans] == [(8, 18, "“go 😀 now”"), (23, 29, '"left"')]


def test_windows_cover_the_text(spark):
    w = structure.sliding_windows(spark.createDataFrame([("d", "abcdefghij" * 100)], "doc_id string, text string"), 600, 350, 200).orderBy("start").collect()
    assert w[0].start == 0 and w[-1].end == 1000 and all(b.start < a.end for a, b in zip(w, w[1:], strict=False))


def test_token_bucket(spark):
    rows = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 0, 0, 10, 10, 100])], "k string, i int, t double")
    got = operations.token_bucket(rows, "k", "t", 0.1, 2.0, "i").orderBy("i").collect()
    assert [g.allowed for g in got] == [True, True, False, True, False, True]


def test_intent(spark):
    from taleweave.functions.intent import intent, variants

    asked = {"整本书的主线": "global", "speak like Rimuru": "imitate", "A和B是什么关系?": "relation", "who is he": "character", "what happened then": "narrative", "where?": "question", "hot springs": "default"}
    assert {q: one(spark, intent(F.lit(q))).intent for q in asked} == asked
    assert one(spark, variants(F.lit('<think>x</think>\n1. first\n- "second"\nfirst\nq'), F.lit("q"))) == ["q", "first", "second"]
    assert one(spark, variants(F.lit(None).cast("string"), F.lit("q"))) == ["q"]
