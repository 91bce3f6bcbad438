"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from taleweave import plans

SF = "/root/testdata/sf0.001"
plans.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLES:
        assert rows
        return
    want = sql.sql(plans.ORACLES[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in rows) == sorted([plain(r[k]) for k in at] for r in want.fetchall())


def test_names_of_every_length_are_found(spark):
    from taleweave.operators import entities, story

    texts = [(1, "the old lighthouse keeper met xu at Li's inn"), (2, "xu"), (3, ""), (4, None), (5, "转生之后 Bo")]
    names = ["xu", "old", "lighthouse keeper", "inn", "nn", "转生", "转生之后", "z", "B", "", None]
    want = sorted((i, n) for i, t in texts for n in names if n and n in (t or ""))
    t = spark.createDataFrame(texts, "id int, text string")
    assert sorted(map(tuple, entities.contained(t, spark.createDataFrame([(n,) for n in names], "name string")).collect())) == want
    entries = spark.createDataFrame([(1, ["q", "xu", "inn"], 1, 0), (2, ["lighthouse keeper"], 2, 0), (3, ["Bo"], 0, 0)], "entry_id int, keys array<string>, priority int, seq_from int")
    got = sorted((x.id, x.rank, x.entry_id, x.key) for x in story.activated(t, entries).collect())
    assert got == [(1, 1, 2, "lighthouse keeper"), (1, 2, 1, "xu"), (2, 1, 1, "xu"), (5, 1, 3, "Bo")]
