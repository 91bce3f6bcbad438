"""Queries of the operational engine. ``events`` are traces, calls and jobs: ``event_type`` the kind, ``user_id`` the session, ``value`` tokens or time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nearest
from ..operators import operations as op
from . import query, retrieval, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor("value").cast("long")
    return events(spark, sf_dir).select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("session_id"), (F.col("value") < 10).alias("zero_hit"), (F.col("event_type") != "view").alias("scoped"), (ms % 6).alias("n_hits"), ms.alias("elapsed_ms"), F.col("props").alias("query"))


TRACES = "t AS (SELECT event_id, event_type AS kind, user_id AS session_id, value < 10 AS zero_hit, event_type <> 'view' AS scoped, floor(value)::BIGINT % 6 AS n_hits, floor(value)::BIGINT AS elapsed_ms, props AS query FROM events)"


@query(f"WITH {TRACES} SELECT count(*) AS n, round(avg(zero_hit::INT::DOUBLE), 3) AS zero_hit_rate, round(avg(scoped::INT::DOUBLE), 3) AS scoped_rate, round(avg(n_hits), 2) AS avg_hits, round(avg(nullif(elapsed_ms, 0)), 1) AS avg_ms FROM t")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.trace_summary(traces(spark, sf_dir))


@query("SELECT event_type AS kind, user_id % 10 AS channel, count(*) AS n FROM events GROUP BY ALL")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("channel")).agg(F.count("*").alias("n"))


@query(f"WITH {TRACES}, s AS (SELECT session_id, max(event_id) AS last FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT event_id, kind, session_id FROM t WHERE kind = 'error' AND contains(lower(query), '1') AND session_id IN (SELECT session_id FROM s)")
def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir)
    active = op.newest_sessions(t, "session_id", "event_id", 50)
    return op.trace_filter(t, kind="error", contains="1", sessions=active).select("event_id", "kind", "session_id")


@query("""WITH u AS (SELECT event_id, user_id, ts, floor(value)::BIGINT AS tokens FROM events WHERE value IS NOT NULL), w AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM u)
SELECT event_id, user_id, used, used - tokens < 300 AS allowed FROM w""")
def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).where("value IS NOT NULL").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("tokens"))
    return op.budget(u, "user_id", ["ts", "event_id"], "tokens", 300).select("event_id", "user_id", "used", "allowed")


@query("""WITH u AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'deepseek-chat' WHEN 'view' THEN 'deepseek-reasoner' ELSE 'other' END AS model, floor(value * 1000)::BIGINT AS p, floor(value * 100)::BIGINT AS c, floor(value * 1500)::BIGINT % 100000 AS k FROM events WHERE value IS NOT NULL),
r AS (SELECT *, CASE model WHEN 'deepseek-chat' THEN 0.14 WHEN 'deepseek-reasoner' THEN 0.55 ELSE 0.5 END::DECIMAL(8,4) AS pp, CASE model WHEN 'deepseek-chat' THEN 0.28 WHEN 'deepseek-reasoner' THEN 2.19 ELSE 1.5 END::DECIMAL(8,4) AS pc, least(k, p) AS hit FROM u)
SELECT event_id, model, round((p - hit)::DECIMAL(18,0) * pp + hit::DECIMAL(18,0) * (pp * 0.25)::DECIMAL(8,4) + c::DECIMAL(18,0) * pc, 0)::DOUBLE / 1e6 AS usd FROM r""")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("event_type") == "click", "deepseek-chat").when(F.col("event_type") == "view", "deepseek-reasoner").otherwise("other")
    whole = lambda c: F.floor(c).cast("long")
    return events(spark, sf_dir).where("value IS NOT NULL").select("event_id", model.alias("model"), op.cost(model, whole(F.col("value") * 1000), whole(F.col("value") * 100), whole(F.col("value") * 1500) % 100000).alias("usd"))


JOBS = """j AS (SELECT event_id AS job_id, user_id AS owner, ts AS created_at, ts + INTERVAL 2 HOUR AS updated_at, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS state,
 ts + INTERVAL 30 MINUTE AS lease_until, CASE WHEN value < 5 THEN NULL ELSE 'w' || user_id END AS lease_owner FROM events), n AS (SELECT max(ts) AS now FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    e = events(spark, sf_dir)
    state = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    j = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("updated_at"), state.alias("state"), (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("lease_until"), F.when(F.col("value") < 5, None).otherwise(F.concat(F.lit("w"), F.col("user_id"))).alias("lease_owner"))
    return j, e.agg(F.max("ts")).scalar()


@query(f"WITH {JOBS}, s AS (SELECT job_id, owner, created_at, CASE WHEN state = 'running' AND lease_until < now THEN 'pending' ELSE state END AS state FROM j, n) SELECT job_id, owner, row_number() OVER (PARTITION BY owner ORDER BY created_at, job_id)::INTEGER AS place FROM s WHERE state = 'pending'")
def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, now = jobs(spark, sf_dir)
    return op.claim_order(op.job_states(j, now), "owner").select("job_id", "owner", "place")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN state = 'running' AND lease_owner IS NULL THEN 'failed' WHEN state = 'running' AND lease_until < now THEN 'pending' ELSE state END AS state, CASE WHEN state = 'running' AND lease_until < now THEN NULL ELSE lease_owner END AS lease_owner FROM j, n")
def lease_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, now = jobs(spark, sf_dir)
    return op.job_states(j, now, orphans=True).select("job_id", "state", "lease_owner")


@query(f"WITH {JOBS} SELECT job_id, state FROM j, n WHERE state IN ('done', 'failed') AND updated_at < now - INTERVAL 48 HOUR")
def job_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, now = jobs(spark, sf_dir)
    return op.expired(j, now, 48).select("job_id", "state")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 100")
def session_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.newest_sessions(events(spark, sf_dir), "user_id", "ts", 100)


@query()
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("seconds", F.col("us") / 1e6)
    return op.token_bucket(e, "event_type", "seconds", 0.002, 5.0, "event_id")


@query(f"""WITH {retrieval.COSINE}, h AS ({retrieval.ranked('s', 'query_id', 10, 'query_id, query_label, id, label', 'similarity DESC, id')}),
g AS (SELECT q.id AS query_id, c.id, CASE WHEN q.label = c.label THEN 3 WHEN abs(q.label - c.label) = 1 THEN 1 ELSE 0 END AS gain FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id),
d AS (SELECT query_id, sum((2.0::DOUBLE ^ gain - 1) / log2(rank + 1)) AS dcg FROM h JOIN g USING (query_id, id) WHERE rank <= 5 AND gain > 0 GROUP BY 1),
i AS (SELECT query_id, sum((2.0::DOUBLE ^ gain - 1) / log2(r + 1)) AS best FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS r FROM g WHERE gain > 0 QUALIFY r <= 5) GROUP BY 1)
SELECT DISTINCT h.query_id, dcg IS NOT NULL AS hit, round(coalesce(dcg / best, 0), 6) AS ndcg FROM h LEFT JOIN d USING (query_id) LEFT JOIN i USING (query_id)""")
def ndcg_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit of the question's own label gains 3, of a neighbouring one 1."""
    b, q = retrieval.blocks(spark, sf_dir), retrieval.asked(spark, sf_dir)
    hits = nearest.search(b, q, 10)
    # each gain belongs to a question and a label, so labels meet, not all pairs of vectors
    gain = F.when(F.col("query_label") == F.col("label"), 3).otherwise(1)
    near = q.select("query_id", "query_label", F.explode(F.array(F.col("query_label") - 1, F.col("query_label"), F.col("query_label") + 1)).alias("label"))
    gains = near.join(b.select("id", "label"), "label").where("query_id <> id").select("query_id", "id", gain.alias("gain"))
    return op.ranking_metrics(hits, gains, 5)


@query(f"""WITH {retrieval.COSINE}, h AS ({retrieval.ranked('s', 'query_id', 10, 'query_id, query_label, id, label', 'similarity DESC, id')})
SELECT count(DISTINCT query_id) AS n_queries, round(avg(hit), 6) AS hit_at_5, round(avg(first), 6) AS hit_at_1 FROM (SELECT query_id, max((label = query_label AND rank <= 5)::INT) AS hit, max((label = query_label AND rank = 1)::INT) AS first FROM h GROUP BY 1)""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = retrieval.blocks(spark, sf_dir), retrieval.asked(spark, sf_dir)
    hits = nearest.search(b, q, 10).join(b.select("id", "label"), "id").join(q.select("query_id", "query_label"), "query_id")
    each = hits.groupBy("query_id").agg(F.max(((F.col("label") == F.col("query_label")) & (F.col("rank") <= 5)).cast("int")).alias("hit"), F.max(((F.col("label") == F.col("query_label")) & (F.col("rank") == 1)).cast("int")).alias("first"))
    return each.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("hit_at_5"), F.round(F.avg("first"), 6).alias("hit_at_1"))


@query("WITH b AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0])::DOUBLE AS le) SELECT event_type AS kind, le, count(*) FILTER (value <= le) AS n FROM events, b GROUP BY ALL")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(events(spark, sf_dir).withColumnRenamed("event_type", "kind"), ["kind"], "value", [10, 25, 50, 100, 250])


@query("SELECT event_type AS kind, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY ALL")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("sessions"))
