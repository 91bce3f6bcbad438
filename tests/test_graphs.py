"""Search over communities against every pair scored by itself."""

import random

from taleweave.operators import graphs


def brute(queries, communities, k):
    out = set()
    for q, text in queries:
        text = text or ""
        grams = {text[i : i + 2] for i in range(len(text) - 1)}
        scored = []
        for c, members, summary in communities:
            share = sum(g in (summary or "") for g in grams) / len(grams) if grams else 0
            score = round(2.0 * sum(bool(m) and m in text for m in members or []) + share + min(1, len(members or []) / 8), 6)
            if score > 0:
                scored.append((-score, c))
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def test_global_search_equals_all_pairs(spark):
    r = random.Random(4)
    names = ["".join(r.choice("abcde") for _ in range(r.randrange(2, 5))) for _ in range(12)] + [""]
    communities = [(c, r.sample(names, r.randrange(0, 10)), r.choice([None, "", "".join(r.choice("abcdexyz ") for _ in range(r.randrange(1, 25)))])) for c in range(30)]
    queries = [(q, "".join(r.choice("abcdewv ") for _ in range(r.randrange(0, 16)))) for q in range(40)] + [(50, None), (51, ""), (52, "q"), (53, "zzzzqqq")]
    for k in (1, 3):
        got = graphs.global_search(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(communities, "community int, members array<string>, summary string"), k).collect()
        assert {tuple(x) for x in got} == brute(queries, communities, k)


def test_shared_groups_make_no_row_a_group_where_pairs_share_many(spark):
    r = random.Random(7)
    dense = [(g, n) for g in range(70) for n in range(40) if r.random() < 0.6]
    sparse = [(g, n) for g in range(3000) for n in r.sample(range(900), 2)] + [(None, 3), (4, None)]
    for rows, block in ((dense, 8), (sparse, 8), ([], 8)):
        groups = {}
        for g, n in rows:
            if g is not None and n is not None:
                groups.setdefault(g, set()).add(n)
        want = {}
        for m in groups.values():
            for a in m:
                for b in m:
                    if a < b:
                        want[a, b] = want.get((a, b), 0) + 1
        found = graphs.shared_groups(spark.createDataFrame(rows + rows[:5], "g int, n int"), "g", "n", block)
        assert {(x.a, x.b): x.n_shared for x in found.collect()} == want and found.count() == len(want)
        # pairs that share dozens of groups are counted where they are made: nothing is aggregated by pair
        assert ("keys=[a#" in found._jdf.queryExecution().executedPlan().toString()) == (rows is not dense)


def test_members_of_pairs(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, None), (3, 7)], "g int, n int")
    assert sorted(map(tuple, graphs.members_within(rows, "g", "n").collect())) == [(2, 5), (2, 6)]


def test_links_are_read_once(spark):
    """Hops read a table: what makes the links runs once, however many hops there are."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long").mapInArrow(run, "a long, b long")
    got = graphs.shortest_paths(links, spark.range(1).select(F.col("id").alias("source")), 5).collect()
    assert sorted((x.node, x.hops) for x in got) == [(k, k) for k in range(6)]
    assert seen.value == 16  # once for either direction
