"""Graphs of entities: roll-ups, neighbourhoods, paths, components, communities."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .entities import mode_first




def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; ours only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if not current.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="taleweave-")
        spark.sparkContext.setCheckpointDir(folder) if not current.isDefined() else None
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/taleweave-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def pairs_within(rows: DataFrame, group: str, member: str, carry: list[str] | None = None) -> DataFrame:
    """``a``, ``b`` (a < b) for each two different members of a group, with the columns to ``carry`` from the group.

    A group's members are gathered as a set first, so repeats cost nothing, and pairs are made where the set
    is, without a shuffle of pairs.
    """
    keep = carry or []
    sets = rows.groupBy(group, *keep).agg(F.array_sort(F.collect_set(member)).alias("m"))
    return sets.select(group, *keep, "m", F.posexplode("m").alias("p", "a")).select(group, *keep, "a", F.explode(F.slice("m", F.col("p") + 2, F.size("m"))).alias("b"))


def classified(relation: Column, polarity: Column, categories: dict[str, str], by_polarity: dict[str, str], other: str = "other") -> Column:
    """The first of ``categories`` (name to pattern, in order) whose pattern a relation's type has, else that of its polarity, else ``other``."""
    out = F.lit(other)
    for value, name in reversed(by_polarity.items()):
        out = F.when(polarity == value, name).otherwise(out)
    for name, pattern in reversed(categories.items()):
        out = F.when(relation.rlike(pattern), name).otherwise(out)
    return out


def members_within(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``group``, ``node``: the members of groups that have two different ones or more, each once; what ``pairs_within`` has as ``a`` or ``b``, without the pairs."""
    sets = rows.groupBy(group).agg(F.collect_set(member).alias("m")).where(F.size("m") > 1)
    return sets.select(group, F.explode("m").alias("node"))


#: Groups in a mask, masks a node, nodes in a block of the dense form of ``shared_groups``, and parts of a block whose pairs with another block are in memory at once.
MASK_BITS, MOST_MASKS, BLOCK_NODES, PARTS = 64, 16, 2048, 64


def shared_groups(members: DataFrame, group: str, node: str, block: int = BLOCK_NODES) -> DataFrame:
    """``a``, ``b``, ``n_shared``: in how many groups (chapters) two nodes both are.

    Where a pair's groups are many, a row for each would be shuffled to be counted; there each node has its groups as
    the bits of a few masks, blocks of nodes meet blocks, and a pair is counted where it is made, which nothing follows.
    Elsewhere pairs are made group by group. The sums that decide reach the driver as one row.
    """
    once = written(members.where(F.col(node).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(node).alias("node")).distinct(), "members")
    sizes = once.groupBy("group").agg(F.count("*").alias("n"))
    n = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1.0) / 2), F.lit(0.0)).alias("met")).crossJoin(once.agg(F.count_distinct("node").alias("nodes"))).first()
    masks, blocks = -(-n.groups // MASK_BITS), max(-(-n.nodes // block), 1)
    if not masks or masks > MOST_MASKS or masks * n.nodes * (n.nodes - 1) / 2 > 8 * n.met:
        return pairs_within(once, "group", "node").groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    numbered = sizes.select("group", (F.row_number().over(Window.orderBy("group")) - 1).alias("k"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") % MASK_BITS)
    of_mask = [F.coalesce(F.bit_or(F.when(F.floor(F.col("k") / MASK_BITS) == m, bit)), F.lit(0).cast("long")).alias(f"m{m}") for m in range(masks)]
    at = F.pmod(F.xxhash64("node"), F.lit(blocks * PARTS)).cast("int")
    nodes = once.join(F.broadcast(numbered), "group").groupBy("node").agg(*of_mask).withColumns({"block": F.floor(at / PARTS).cast("int"), "part": at})
    # a table, as both sides of the join read it
    dealt = written(nodes.groupBy("block", "part").agg(F.collect_list(F.struct("node", *[f"m{m}" for m in range(masks)])).alias("nodes")), "blocks")
    tasks = min(max(blocks * (blocks + 1) // 8, 1), 4000)
    left = dealt.select(F.col("block").alias("x"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("y"), F.col("nodes").alias("xs")).repartition(tasks, "x", "y")
    whole = dealt.groupBy("block").agg(F.flatten(F.collect_list("nodes")).alias("ys"))
    right = whole.select(F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"), "ys").repartition(tasks, "x", "y")
    names = lambda side: [f"{side}{c}" for c in ("node", *[f"m{m}" for m in range(masks)])]
    met = left.join(right, ["x", "y"]).select("x", "y", "ys", F.inline("xs").alias(*names("a"))).select("x", "y", *names("a"), F.inline("ys").alias(*names("b"))).where("x < y OR anode < bnode")
    shared = sum((F.bit_count(F.col(f"am{m}").bitwiseAND(F.col(f"bm{m}"))) for m in range(masks)), F.lit(0)).cast("long")
    return met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"), shared.alias("n_shared")).where("n_shared > 0")


def relation_graph(relations: DataFrame, category: Column, least_weight: int = 1, least_confidence: float = 0.0) -> DataFrame:
    """One edge for each unordered pair of ``relations(source, target, relation_type, polarity, confidence, chapter_order, pos)``.

    Weight is the number of records; category the most frequent one (of equals the first seen); polarity that
    of the surest record (of equals the first); with the distinct types and the first and last order.
    """
    ok = (F.col("source") != F.col("target")) & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    r = relations.where(ok).withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target"), "category": category})
    edges = r.groupBy("a", "b").agg(
        F.count("*").alias("weight"), F.max_by("polarity", F.struct("confidence", (-F.col("pos")).alias("p"))).alias("polarity"), F.round(F.max("confidence"), 3).alias("confidence"),
        F.array_sort(F.collect_set("relation_type")).alias("relation_types"), F.min("chapter_order").alias("first_order"), F.max("chapter_order").alias("last_order"),
    )
    return edges.where(F.col("weight") >= least_weight).join(mode_first(r, ["a", "b"], "category", "pos"), ["a", "b"])


def degrees(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``node``, ``degree``, ``total`` weight over ``edges(a, b, weight)``."""
    ends = edges.select(F.col("a").alias("node"), weight).unionAll(edges.select(F.col("b").alias("node"), weight))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum(weight).alias("total"))


def symmetric(edges: DataFrame, carry: list[str]) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *carry).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *carry))


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """``node``, ``rank``, ``other``, ``weight``: the ``k`` strongest neighbours of each node over parallel ``edges(a, b, weight)``."""
    # links are summed before they are seen from both ends, so half as many rows are shuffled
    over = F.col("a") > F.col("b")
    links = edges.select(F.when(over, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(over, F.col("a")).otherwise(F.col("b")).alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    end = lambda x, y, w: F.struct(F.col(x).alias("node"), F.col(y).alias("other"), w.alias("weight"))
    both = F.when(F.col("a") == F.col("b"), F.array(end("a", "b", F.col("weight") * 2))).otherwise(F.array(end("a", "b", F.col("weight")), end("b", "a", F.col("weight"))))
    summed = links.select(F.inline(both))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other"))).where(F.col("rank") <= k)


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``source``, ``node``, ``hops``, ``path`` from each of ``sources(source)`` to all nodes within ``most`` hops; of equal paths the smallest.

    Breadth first, one join a hop from the last frontier only; a node is settled the first time it is met.
    """
    hop = written(symmetric(edges, []).distinct(), "hops")
    settled = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path"))
    frontier = settled
    for n in range(1, most + 1):
        reached = frontier.join(hop, "node").select("source", F.col("other").alias("node"), F.lit(n).alias("hops"), F.array_append("path", F.col("other")).alias("path"))
        best = reached.groupBy("source", "node").agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
        frontier = written(best.join(settled.select("source", "node"), ["source", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        settled = settled.unionByName(frontier)
    return settled


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``links(a, b)`` is connected with.

    Roots are passed along links, then replaced by their own root, until none changes.
    """
    hop = written(symmetric(links, []).distinct(), "hops")
    roots = written(hop.select("node").distinct().select("node", F.col("node").alias("root")), "roots")
    for _ in range(most_rounds):
        near = hop.join(roots.select(F.col("node").alias("other"), F.col("root").alias("there")), "other").groupBy("node").agg(F.min("there").alias("there"))
        closer = roots.join(near, "node").select("node", F.least("root", "there").alias("root"), F.col("root").alias("old"))
        jumped = closer.join(closer.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.least("root", "up").alias("new"), "old")
        state = written(jumped, "roots")
        roots = state.select("node", F.col("new").alias("root"))
        if state.where("new <> old").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def greedy_modularity(edges: list[tuple[str, str, float]], nodes: list[str]) -> list[list[str]]:
    """Communities by greedy gains of weighted modularity; a node without an edge is alone. Of equal gains the pair with the smallest names merges."""
    weight: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        if a != b:
            weight[a][b] = weight[a].get(b, 0.0) + w
            weight[b][a] = weight[b].get(a, 0.0) + w
    total = sum(sum(x.values()) for x in weight.values())
    share = {n: sum(x.values()) / total for n, x in weight.items()} if total else {}
    members = {n: [n] for n in nodes}
    while total:
        gain, a, b = max(((2 * (w / total - share[a] * share[b]), a, b) for a, x in weight.items() for b, w in x.items() if a < b), key=lambda g: (round(g[0], 12), [-ord(c) for c in g[1]], [-ord(c) for c in g[2]]), default=(0.0, "", ""))
        if gain <= 0:
            break
        members[a] += members.pop(b)
        share[a] += share.pop(b)
        for c, w in weight.pop(b).items():
            weight[c].pop(b)
            if c != a:
                weight[a][c] = weight[c][a] = weight[a].get(c, 0.0) + w
    return sorted((sorted(m) for m in members.values()), key=lambda m: (-len(m), m))


def communities(edges: DataFrame, group: str) -> DataFrame:
    """``group``, ``community``, ``node`` of ``edges(group, a, b, weight)``: one graph a group, all groups at once.

    A group's graph has one row an edge, summed before, and is small (the characters of a series).
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        edges_ = list(zip(frame["a"], frame["b"], frame["weight"], strict=True))
        found = greedy_modularity(edges_, sorted({*frame["a"], *frame["b"]}))
        return pd.DataFrame([(key[0], n, m) for n, c in enumerate(found) for m in c], columns=[group, "community", "node"])

    summed = edges.groupBy(group, "a", "b").agg(F.sum("weight").cast("double").alias("weight"))
    return summed.groupBy(group).applyInPandas(run, f"{group} {edges.schema[group].dataType.simpleString()}, community int, node string")


def global_search(queries: DataFrame, communities_: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``community``, ``score``: the ``k`` best of ``communities(community, members, summary)`` for each of ``queries(query_id, query)``.

    2 for each member a query names (empty names don't count), the share of its bigrams that the summary holds,
    and an eighth of a member at most 1. Joins by equality only. The last two parts are 2 at most and a named
    community has more, so a query that names ``k`` communities needs no other. For the rest, communities meet over
    shared bigrams; one that shares nothing can only be among the ``k`` largest, so those ``k`` rows are offered to each.
    A query or summary that is null counts as empty.
    """
    from ..functions.text import char_ngrams, empty_if_null
    from .entities import contained

    asked = queries.select("query_id", empty_if_null(F.col("query")).alias("query"))
    grams = asked.select("query_id", F.array_distinct(char_ngrams(F.col("query"), 2)).alias("grams"))
    each = grams.select("query_id", F.explode("grams").alias("gram"))
    held = communities_.select("community", F.array_distinct(char_ngrams(empty_if_null(F.col("summary")), 2)).alias("grams")).select("community", F.explode("grams").alias("gram"))
    members = communities_.select("community", F.explode("members").alias("name"))
    found = contained(asked.select(F.col("query_id").alias("id"), F.col("query").alias("text")), members.select("name"))
    named = found.join(members, "name").groupBy(F.col("id").alias("query_id"), "community").agg(F.count("*").alias("named"))
    settled = named.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    open_ = asked.select("query_id").join(settled, "query_id", "left_anti")
    size = F.least(F.lit(1.0), F.size("members") / 8)
    largest = communities_.orderBy(F.desc(size), "community").limit(k).select("community")
    none, pair = F.lit(0).cast("long"), ["query_id", "community"]
    by_gram = each.join(open_, "query_id", "left_semi").join(held, "gram").groupBy(*pair).agg(F.count("*").alias("shared"))
    by_name = named.join(settled, "query_id", "left_semi").select(*pair).join(each, "query_id").join(held, ["community", "gram"]).groupBy(*pair).agg(F.count("*").alias("shared"))
    parts = named.select(*pair, "named", none.alias("shared"))
    for shared in (by_gram, by_name):
        parts = parts.unionByName(shared.select(*pair, none.alias("named"), "shared"))
    parts = parts.unionByName(open_.join(F.broadcast(largest), how="cross").select(*pair, none.alias("named"), none.alias("shared")))
    summed = parts.groupBy(*pair).agg(F.sum("named").alias("named"), F.sum("shared").alias("shared"))
    sized = summed.join(communities_.select("community", size.alias("size")), "community").join(grams.select("query_id", F.size("grams").alias("n")), "query_id")
    share = F.when(F.col("n") > 0, F.col("shared") / F.col("n")).otherwise(0.0)
    scored = sized.withColumn("score", F.round(2.0 * F.col("named") + share + F.col("size"), 6)).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "community"))).where(F.col("rank") <= k).select("query_id", "rank", "community", "score")
