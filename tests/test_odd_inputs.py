"""Registered queries on odd tables, against their SQL."""

import duckdb

from taleweave import plans

plans.load()


def agrees(spark, folder, name, **tables):
    """Whether a query gives what its SQL gives on ``tables`` of (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(folder)).select(*want.columns)
    plain = lambda rows: sorted([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in rows)
    assert plain(got.collect()) == plain(want.fetchall())
    return len(want.fetchall())


def talk(texts):
    return "conv_id long, turn int, role string, text string", [(k // 3, k % 3, ("user", "assistant", "system")[k % 3], t) for k, t in enumerate(texts)]


def test_speech_features(spark, tmp_path):
    texts = ["Doesó y raieñ.", "a?\n", "a? ", "a?\u00a0", "\u3000Who is", "\tWho", "whoé", "who_", "Iſ x", "Iſx", "iſ", "ſob", "什么", "他哭", "怒", "WHY", "what？", "", None, "\u2007is it", "can't", "a?\r\n", "ªwho", "Ångry ANGRY"]
    assert agrees(spark, tmp_path, "speech_features", conversations=talk(texts)) == len(texts)


ITEMS = ("item_id long, text string", [(1, "the Old lighthouse\nkeeper xu at 转生 之后 ab"), (2, "a aa aaa a\t b  keeper"), (3, "pp " + "q" * 70 + " end."), (4, ""), (5, "of the a keeper"), (6, "a keeper old"), (7, "a"), (8, "the a"), (9, "a b"), (10, "a of")])
TEXTS = ["the older lighthousekeepers meet xu.", "aaaa\tb", "转生之后", "x" + "q" * 200 + "END. pp", "", "a", "A KEEPER of the lighthouse\nkeeper", "  ", "ppp p p " * 50]


def test_names_inside_words(spark, tmp_path):
    assert agrees(spark, tmp_path, "containment_join_all", conversations=talk(TEXTS), benchmark=ITEMS) == 16


def test_substrings_are_those_of_words(spark):
    """A text's substrings grow with its different words, not with its length, and none spans a space."""
    from pyspark.sql import functions as F

    from taleweave.operators.entities import contained, substrings

    words = ["abc", "de", "abc", "f", "g" * 70]
    want = {w[i : i + n] for w in words for n in (2, 3) for i in range(len(w) - n + 1)}
    rows = spark.createDataFrame([(words * 100,)], "w array<string>").select(substrings(F.col("w"), [2, 3]).alias("s"))
    found = rows.first().s
    assert set(found) == want and len(found) == len(want)
    texts, names = spark.createDataFrame([(1, "ab cd " * 200), (2, "b c")], "id int, text string"), spark.createDataFrame([("b",), ("b c",), ("abcd",), ("d ",)], "name string")
    assert sorted(map(tuple, contained(texts, names).collect())) == [(1, "b"), (1, "b c"), (1, "d "), (2, "b"), (2, "b c")]


def test_entities_inside_words(spark, tmp_path):
    assert agrees(spark, tmp_path, "entity_resolution", conversations=talk([t for t in TEXTS if t]), benchmark=ITEMS) == 6


def test_lore_of_common_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from taleweave.operators import story

    assert agrees(spark, tmp_path, "lorebook_activation_all", conversations=talk(TEXTS), benchmark=ITEMS) == 26
    keys = spark.createDataFrame([("a", p, e, e % 3, 0) for e in range(100) for p in (2, 1)] + [("b", 0, 7, 1, 0)], "name string, p int, entry_id int, priority int, seq_from int")
    # of a hundred entries with one key six can be among a text's best
    got = story.first_of_keys(keys, [F.desc("priority"), "seq_from", "entry_id"], 6).collect()
    assert sorted((x.name, x.entry_id, x.p) for x in got) == [("a", e, 1) for e in (2, 5, 8, 11, 14, 17)] + [("b", 7, 0)]
