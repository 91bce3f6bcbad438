"""The pipeline, stage by stage, on a table with planted cases."""

import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taleweave.llm import common, linededup, mixing, neardup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(11)
    words = {lang: ["".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(400)] for lang, s in {"en": ["th", "er", "on", "ing"], "de": ["sch", "ung", "ein", "ü"]}.items()}
    text = lambda lang, n: "\n".join(" ".join(r.choice(words[lang]) for _ in range(r.randrange(8, 40))) for _ in range(n))
    docs = [(i, text(lang, r.randrange(2, 6)), lang, f"s{i % 4}") for i in range(120) for lang in [r.choice(["en", "de"])]]
    passage = " ".join(r.choice(words["en"]) for _ in range(60))
    docs += [(200 + k, text("en", 2) + "\n" + passage + "\n" + text("en", 1), "en", "s1") for k in range(6)]
    docs += [(300 + k, docs[5][1], "en", "s0") for k in range(8)]
    item = " ".join(r.choice(words["en"]) for _ in range(25))
    docs += [(400, text("en", 3) + "\n" + item, "en", "s2"), (401, None, None, None), (402, "", "en", "s1"), (403, "123 456", "de", "s1"), (None, text("de", 3), "de", None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], SCHEMA).withColumn("extra", F.lit("e")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), passage, item


def test_stages(spark, sf_dir, tmp_path):
    d, passage, item = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], d).write.parquet(f"{tmp_path}/{n}")
        seen.append(spark.read.parquet(f"{tmp_path}/{n}"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    ids = [{x.doc_id for x in s.select("doc_id").collect()} for s in seen]
    assert ids[0] - ids[1] == {401, 402, 403}
    assert ids[1] - ids[2] == set(range(300, 308))
    assert seen[2].where(F.contains("text", F.lit(passage))).count() == 1
    assert ids[3] == ids[2] and ids[3] - ids[4] == {400}
    assert {x.copies for x in seen[5].collect()} <= {1, 2}
    assert seen[2].where("n_chars <> length(text)").count() == 0


def test_run_agrees_with_stages(spark, sf_dir):
    d, *_ = sf_dir
    got = corpus_pipeline.run(spark, d)
    assert set(got.columns) >= {"doc_id", "text", "copies", "taken"} and got.count() > 50


def test_copies_of_one_document(spark):
    docs = spark.createDataFrame([(i, "one and the same text of some words here", "en", "s", 1) for i in range(30)], SCHEMA)
    kept = corpus_pipeline.dedup_near(spark, docs, "")
    assert [x.doc_id for x in kept.collect()] == [0]


def test_short_lines_stay_when_a_shared_line_goes(spark):
    shared = "one line of boilerplate that every one of them holds"
    texts = [f"{shared}\nroses are red {i}\nviolets blue {i}" for i in range(4)] + [f"{shared}\n \t\n", f"生まれ変わった{'物語' * 30}\n{shared}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    want = {i: t if i == 0 else t.replace(f"{shared}\n", "").replace(f"\n{shared}", "") for i, t in enumerate(texts) if i != 4}
    assert kept == {i: (t, len(t)) for i, t in want.items()}


def test_near_copies_go(spark):
    """Brute force over all pairs; chains, a group around one text, null and equal ids, texts below five words."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(r.choice([60, 100, 300]))] for _ in range(15)]
    texts = [list(b) for b in base]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randrange(1, 5)):
                c[r.randrange(len(c))] = word()
            texts.append(c)
    texts += [["a", "b"], ["A", "b"], ["a", "c"]]
    rows = [(None if i % 11 == 0 else i // 2, " ".join(w)) for i, w in enumerate(texts)]
    sets = [set(zip(*(w[k:] for k in range(5)))) or {tuple(w)} for w in (t.lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    of = {}
    for row, c in zip(rows, root, strict=True):
        of.setdefault(c, []).append(row)
    assert len(kept) == len(of) < len(rows) / 2
    for group in of.values():
        least = min((i for i, _ in group if i is not None), default=None)
        assert len(kept & set(group)) == 1 and (kept & set(group)).pop()[0] == least


def test_simhash_comes_first(spark, monkeypatch):
    """Without bands the SimHash components remain, but for texts that only their fingerprints have in common."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(400)] for _ in range(30)]
    texts += [[*t[:200], word(), *t[201:]] for t in texts]
    texts += [["spam", "eggs", "ham"] * 300 + [word() for _ in range(40)] for _ in range(3)]
    texts = [" ".join(w) for w in texts]
    bits = [simhash.fingerprint(t) for t in texts]
    apart = lambda i, j: (bits[i] ^ bits[j]).bit_count()
    near = {30 + i for i in range(30) if apart(i, 30 + i) <= 3}
    assert len(near) > 5 and all(apart(i, j) <= 3 for i in range(60, 63) for j in range(60, 63))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = lambda: {x.doc_id for x in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert kept() == set(range(30)) | {60, 61, 62}
    banded = neardup.banded
    monkeypatch.setattr(neardup, "banded", lambda *a: banded(*a).withColumn("bands", F.expr("array_repeat(0L, 0)")))
    assert kept() == set(range(63)) - near


def test_texts_that_share_boilerplate_meet_no_one(spark):
    """A bucket of unlike texts gives no pairs, and the near copies among them are found all the same."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(300)]
    texts = [shared + [word() for _ in range(100)] for _ in range(400)]
    copies = [t[:350] + [word()] + t[351:] for t in texts[:20]]
    keyed = spark.createDataFrame([(i, i, " ".join(w)) for i, w in enumerate(texts + copies)], "__hash long, root long, text string")
    pairs = neardup.candidates(keyed.select(F.col("__hash").alias("node"), "root"), keyed.drop("root"), "text", 5, 0.8).collect()
    assert {(x.u, x.v) for x in pairs} == {(i, 400 + i) for i in range(20)}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_prefix_join_loses_no_pair(spark, threshold):
    r = random.Random(9)
    pool = [[f"w{r.randrange(40)}" for _ in range(r.randrange(1, 25))] for _ in range(12)]
    texts = [sum((r.choice(pool) for _ in range(r.randrange(1, 6))), []) for _ in range(150)] + [[], ["a"], ["a", "b"], ["b", "a"]]
    sets = [neardup.shingles(" ".join(w), 5) for w in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if i % 50 != j % 50 and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    keyed = spark.createDataFrame([(i, i % 50, " ".join(w)) for i, w in enumerate(texts)], "__hash long, root long, text string")
    pairs = {(x.u, x.v) for x in neardup.candidates(keyed.select(F.col("__hash").alias("node"), "root"), keyed.drop("root"), "text", 5, threshold).collect()}
    assert near <= pairs and len(near) > 5
    assert all(u < v and u % 50 != v % 50 for u, v in pairs)


def test_workers_get_texts_once_and_no_pandas(spark, sf_dir):
    d, *_ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    language = plan(corpus_pipeline.identify_language(spark, docs, d))
    sent = next(x for x in language.splitlines() if "MapInArrow" in x).split("run(")[1].split(")")[0]
    assert sent.count("text") == 1
    links = simhash.search_nodes(spark.createDataFrame([(1, 1, 5), (1, 1, 7)], "mask long, bits long, fp long"), 3)
    cells = mixing.rounded(spark.createDataFrame([("a", 5, 3, 15, 20.0, 1.5)], "__source string, __size long, n long, source_size long, target double, rate double"), 2)
    assert [sorted(x) for x in links.collect()] == [[5, 7]]
    assert [x.m for x in cells.collect()] == [5]
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "__hash long, text string")
    same = neardup.verified(spark.createDataFrame([(1, 2)], "u long, v long"), texts, "text", 5, 0.6)
    assert [tuple(x) for x in same.collect()] == [(1, 2)]
    assert not any("InPandas" in plan(x) for x in (links, cells, same))
    modules = "taleweave.llm.neardup", "taleweave.llm.mixing", "taleweave.llm.langid", "taleweave.llm.decontaminate"
    code = f"import sys; import {', '.join(modules)}; sys.exit('pandas' in sys.modules)"
    assert not subprocess.run([sys.executable, "-c", code], check=False).returncode


def test_slices_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "t": ["aaaa", None, "bb", "c" * 50, "d"]})
    parts = list(common.sliced(batch, 1, limit=7))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert not list(common.sliced(batch.slice(5), 1))


def test_line_order_reaches_the_driver_as_one_string(spark, sf_dir):
    d, *_ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    rarity = linededup.Rarity(docs, 4096)
    buckets = 1 << linededup.BUCKET_BITS
    levels = [int(x) for x in rarity.levels.split(",")]
    words = docs.select(F.explode(linededup.lines_of(F.col("text"))).alias("t")).select(F.explode(linededup.tokens(F.col("t"))).alias("w"))
    counts = {x.b: x["count"] for x in words.groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b")).count().collect()}
    assert levels == [rarity.level(counts.get(b, 0)) for b in range(buckets)]


def test_parity_bits_fold_the_words_at_most_twice(spark, tmp_path):
    """All bits in one go; of long lines a second one, whose bits the first ones leave out."""
    rows = [(1, " ".join(f"w{k}" for k in range(90))), (2, "a b c d e f"), (3, "a b")]
    docs = spark.createDataFrame(rows, "id long, text string")
    first = linededup.first_lines(docs, linededup.Rarity(docs, 4096), 0.8, 5)
    assert first._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    for x in first.collect():
        words = spark.createDataFrame([(w,) for w in rows[x.id - 1][1].split()], "w string").select(F.xxhash64("w").alias("h"))
        bits = [0, 0]
        for w in words.collect():
            h = w.h % (1 << 64)
            bits[x.n >= linededup.LONG and h >> 57 & 1] ^= 1 << (h >> 58)
        assert [x.bits % (1 << 64), x.more % (1 << 64)] == bits


def test_lines_without_neighbours_are_not_compared(spark):
    """Lists of neighbours are made after the lines that have none are gone."""
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} d e f g") for k in range(5)] + [(9 + k, "a9 b9 c9 d e f g" + " " * k) for k in range(6)], "id long, text string")
    firsts = linededup.first_lines(docs, linededup.Rarity(docs, 4096), 0.8, 5)
    found = linededup.neighbours(firsts, 0.8)
    pairs = found.collect()
    assert all(9 <= x.yid < x.xid for x in pairs) and len({x.xid for x in pairs}) >= 6 - linededup.SALTS
    assert "isnotnull(y1" in found._jdf.queryExecution().optimizedPlan().toString()
