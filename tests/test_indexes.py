"""Indexes: cells and codes of vectors, analyses brought up to date, tables that change as one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleweave.operators import ann, incremental, nearest
from taleweave.sources.versions import Versions, replaced


@pytest.fixture(scope="module")
def vectors(spark):
    """Noisy groups, one of which is a third of all rows, copies, and vectors without a direction."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 24))
    group = [0 if k % 3 == 0 else k % 30 for k in range(1500)]
    rows = [(k, (centres[g] + 0.3 * r.normal(size=24)).tolist()) for k, g in enumerate(group)]
    rows += [(1500 + k, rows[7][1]) for k in range(20)]
    odd = [None, [0.0] * 24, [math.nan] * 24, [None, *[1.0] * 23], [math.inf] * 24]
    return spark.createDataFrame(rows + [(9000 + k, v) for k, v in enumerate(odd)], "id long, vector array<double>").repartition(4)


def test_index_finds_the_exact_hits(spark, vectors, tmp_path):
    assert ann.build(vectors, str(tmp_path / "i")) == "built"
    q, rows = ann.load(spark, str(tmp_path / "i"))
    held = [r.id for r in rows.select("id").collect()]
    assert sorted(held) == list(range(1520)) and q.centres.shape == (15, 24) and 1 <= q.probes <= 15
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    want = {(r.query_id, r.id) for r in nearest.search(vectors.where("id < 9000"), asked.where("query_id < 9000"), 10).collect()}
    got = ann.search(rows, q, asked, vectors, 10).collect()
    assert len({(r.query_id, r.id) for r in got} & want) >= 0.9 * len(want)
    assert all(r.query_id != r.id and r.query_id < 9000 for r in got) and max(r.rank for r in got) == 10
    # blocks of a few rows and queries give the same as whole cells
    again = ann.search(rows, q, asked, vectors, 10, block_rows=40, block_queries=7).collect()
    assert {(r.query_id, r.rank, r.id) for r in again} == {(r.query_id, r.rank, r.id) for r in got}


def test_index_is_kept_or_rebuilt(spark, vectors, tmp_path):
    path = str(tmp_path / "i")
    assert ann.build(vectors.where("id < 100"), path) == "skipped" and ann.load(spark, path) is None
    assert ann.build(vectors.where("id < 1000"), path) == "built"
    assert ann.build(vectors.where("id < 1000"), path) == "kept" and ann.build(vectors.where("id < 500"), path) == "kept"
    assert ann.build(vectors, path) == "rebuilt" and ann.load(spark, path)[1].count() == 1520


def test_scores_of_codes_come_near(vectors):
    q = ann.train(vectors, sub_vectors=12)
    m = np.array([r.vector for r in vectors.where("id < 300").orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cells = q.cells(m)[:, 0]
    codes = q.codes(m, cells)
    for c in set(cells.tolist()):
        assert np.abs(q.scores(m[:5], c, codes[cells == c]) - m[:5] @ m[cells == c].T).max() < 0.35


def test_versions_change_as_one(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.number() == 0 and store.read("a") is None
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    assert store.publish({"a": one, "b": one}) == 1
    broken = one.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.publish({"a": one.withColumn("v", F.lit("new")), "b": broken})
    # the first table of the failed version is written, but readers see the version before
    assert store.number() == 1 and store.read("a").collect() == store.read("b").collect() == one.collect()
    assert store.publish({"b": one.withColumn("v", F.lit("y"))}) == 2
    assert store.read("a").first().v == "x" and store.read("b").first().v == "y"
    other = Versions(spark, store.path)
    other.number = lambda: 1
    with pytest.raises(Exception, match="(?i)exists"):
        other.publish({"b": one})


def test_replaced_groups(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "g string, x int")
    new = spark.createDataFrame([("a", 9)], "g string, x int")
    keys = spark.createDataFrame([("a",), ("b",)], "g string")
    assert sorted(map(tuple, replaced(old, new, "g", keys).collect())) == [("a", 9), ("c", 4)]
    assert replaced(None, new, "g", keys).collect() == new.collect()
    placed = incremental.merged_partitions(old, new, "g", keys, ["x"]).collect()
    assert sorted((r.g, r.x, r.pos) for r in placed) == [("a", 9, 1), ("c", 4, 1)]


def test_analysis_brought_up_to_date(spark, tmp_path):
    r = random.Random(1)
    rows = [(v, k, "word " * r.randrange(5)) for v in "abcde" for k in range(4)]
    schema = "vol string, id int, text string"
    store, seen = Versions(spark, str(tmp_path / "z")), []

    def run(rows, version="1"):
        docs = spark.createDataFrame(rows, schema)

        def analyse(todo):
            seen.append(sorted(x.vol for x in todo.collect()))
            return docs.join(todo, "vol", "left_semi").where("text <> ''").select("vol", "id", F.length("text").alias("n"))

        catalog = docs.select("vol", "id", F.length("text").alias("n_chars"))
        states = {x.vol: x.state for x in incremental.refresh(store, catalog, "vol", ["id", "n_chars"], analyse, version).collect()}
        got = sorted((x.vol, x.id, x.n) for x in incremental.claims(store, "vol").collect())
        assert got == sorted((v, k, len(t)) for v, k, t in rows if t)
        return states

    assert set(run(rows).values()) == {"new"}
    assert set(run(list(reversed(rows))).values()) == {"kept"} and len(seen) == 1
    changed = [(v, k, t + "x" if (v, k) == ("b", 2) else "" if v == "c" else t) for v, k, t in rows if v != "e"] + [("f", 1, "new")]
    assert run(changed) == {"a": "kept", "b": "changed", "c": "changed", "d": "kept", "e": "gone", "f": "new"} and seen[1] == ["b", "c", "f"]
    assert run([x for x in changed if x[0] != "a"])["a"] == "gone" and len(seen) == 2
    assert set(run([x for x in changed if x[0] != "a"], "2").values()) == {"changed"} and len(seen) == 3


def test_unchanged_input_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "some text")], "vol string, id int, text string")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    store = Versions(spark, str(tmp_path / "z"))
    incremental.refresh(store, docs, "vol", ["id"], lambda v: docs.join(v, "vol", "left_semi"))
    prints = incremental.fingerprints(docs, "vol", ["id"], "1")
    scans = [line for line in prints._jdf.queryExecution().toString().splitlines() if "ReadSchema" in line]
    assert scans and all("text" not in s for s in scans)

    def never(v):
        raise AssertionError("analysed again")

    assert incremental.refresh(store, docs, "vol", ["id"], never).first().state == "kept"


def test_published_story(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"))
    blocks = [("s", 1, "narrative"), ("s", 2, "relation"), ("s", 3, "event"), ("t", 4, "event")]
    schema = "series string, id int, kind string"
    cards = spark.createDataFrame([("s", "A", False), ("s", "B", True), ("t", "C", False)], "series string, name string, stale boolean")
    store.publish({"blocks": spark.createDataFrame(blocks, schema), "cards": cards})
    found = spark.createDataFrame([("s", 8, "event"), ("s", 9, "narrative"), ("t", 7, "event")], schema)
    series = spark.createDataFrame([("s",), ("u",)], "series string")
    counts = {r.series: tuple(r)[1:] for r in incremental.publish_story(store, found, series).collect()}
    assert counts == {"s": (3, 2, 1, 2, 1), "u": (0, 0, 0, 0, 0)}
    assert sorted(map(tuple, store.read("blocks").collect())) == [("s", 1, "narrative"), ("s", 8, "event"), ("t", 4, "event")]
    assert sorted(map(tuple, store.read("cards").collect())) == [("s", "A", True), ("s", "B", True), ("t", "C", False)]
