"""Operational logs: traces, budgets, costs, jobs, limits, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices in USD a million tokens (prompt, completion) by a part of the model's name; fixed values.
PRICES = {"deepseek-v4-flash": (0.14, 0.28), "deepseek-v4-pro": (0.42, 0.84), "deepseek-chat": (0.14, 0.28), "deepseek-reasoner": (0.55, 2.19)}
DEFAULT_PRICE = (0.5, 1.5)
CACHE_RATIO = 0.25


def trace_summary(traces: DataFrame) -> DataFrame:
    """One row over ``traces(kind, zero_hit, scoped, n_hits, elapsed_ms)``: counts, rates, means; times of 0 don't count."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 3)
    return traces.agg(F.count("*").alias("n"), rate(F.col("zero_hit")).alias("zero_hit_rate"), rate(F.col("scoped")).alias("scoped_rate"), F.round(F.avg("n_hits"), 2).alias("avg_hits"), F.round(F.avg(F.nullif("elapsed_ms", F.lit(0))), 1).alias("avg_ms"))


def trace_filter(traces: DataFrame, *, kind: str | None = None, contains: str | None = None, zero_only: bool = False, sessions: DataFrame | None = None) -> DataFrame:
    if kind is not None:
        traces = traces.where(F.col("kind") == kind)
    if contains is not None:
        traces = traces.where(F.contains(F.lower("query"), F.lit(contains.lower())))
    if zero_only:
        traces = traces.where("zero_hit")
    return traces if sessions is None else traces.join(sessions.select("session_id"), "session_id", "left_semi")


def model_price(model: Column, prices: dict[str, tuple[float, float]] = PRICES, default: tuple[float, float] = DEFAULT_PRICE) -> Column:
    """(prompt, completion) of the first entry whose name the model's name holds."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("prompt"), F.lit(p[1]).alias("completion"))
    out = pair(default)
    for name, price in reversed(prices.items()):
        out = F.when(F.contains(F.lower(model), F.lit(name)), pair(price)).otherwise(out)
    return out


def cost(model: Column, prompt: Column, completion: Column, cached: Column, ratio: float = CACHE_RATIO) -> Column:
    """USD of a call; cached tokens are part of the prompt and cost ``ratio`` of its price."""
    price = model_price(model)
    at_least_0 = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    p, c = at_least_0(prompt), at_least_0(completion)
    hit = F.least(at_least_0(cached), p)
    exact = lambda x, kind: x.cast(f"decimal({kind})")  # noqa: E731  so that halves round alike everywhere
    full, part, out = exact(p - hit, "18,0") * exact(price["prompt"], "8,4"), exact(hit, "18,0") * exact(price["prompt"] * ratio, "8,4"), exact(c, "18,0") * exact(price["completion"], "8,4")
    return F.round(full + part + out, 0).cast("double") / 1e6


def budget(usage: DataFrame, by: str, order: list[str], tokens: str, limit: float) -> DataFrame:
    """``usage`` with ``used`` before and with each row, and whether it is allowed: rows are refused once the limit is reached."""
    w = Window.partitionBy(by).orderBy(*order)
    used = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return usage.withColumn("used", used).withColumn("allowed", F.col("used") - F.col(tokens) < limit)


def job_states(jobs: DataFrame, now: Column, orphans: bool = False) -> DataFrame:
    """``jobs`` with ``state`` as it stands at ``now``: an expired lease makes a running job pending, a restart makes one without a lease failed."""
    expired = (F.col("state") == "running") & (F.col("lease_until") < now)
    lost = F.lit(orphans) & (F.col("state") == "running") & F.col("lease_owner").isNull()
    return jobs.withColumns({"state": F.when(lost, "failed").when(expired, "pending").otherwise(F.col("state")), "lease_owner": F.when(expired, None).otherwise(F.col("lease_owner"))})


def claim_order(jobs: DataFrame, by: str) -> DataFrame:
    """Pending jobs with ``place``: the oldest is claimed first."""
    return jobs.where("state = 'pending'").withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("created_at", "job_id")))


def expired(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Ended jobs older than ``hours``."""
    return jobs.where(F.col("state").isin("done", "failed") & (F.col("updated_at") < now - F.make_interval(hours=F.lit(hours))))


def newest_sessions(rows: DataFrame, session: str, ts: str, keep: int) -> DataFrame:
    """``session``, ``last``: the ``keep`` most recently used."""
    last = rows.groupBy(session).agg(F.max(ts).alias("last"))
    return last.orderBy(F.desc("last"), session).limit(keep)


def token_bucket(rows: DataFrame, by: str, seconds: str, rate: float, burst: float, order: str) -> DataFrame:
    """``by``, ``order``, ``allowed``: a bucket that fills with ``rate`` a second up to ``burst``; each allowed row takes one.

    The level depends on what was allowed before, so rows of a key are read in order, one number of state a key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, level, last = object(), burst, 0.0
        for frame in frames:
            out = []
            for k, t in zip(frame[by], frame[seconds], strict=True):
                if k != key:
                    key, level, last = k, burst, t
                level, last = min(burst, level + (t - last) * rate), t
                out.append(level >= 1)
                level -= level >= 1
            yield frame[[by, order]].assign(allowed=out)

    t = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(by, order, seconds).repartition(by).sortWithinPartitions(by, seconds, order).mapInPandas(run, f"{by} {t[by]}, {order} {t[order]}, allowed boolean")


def ranking_metrics(hits: DataFrame, gains: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``hit`` and ``ndcg`` at ``k`` of ``hits(query_id, rank, id)`` under ``gains(query_id, id, gain)``."""
    part = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1)
    got = hits.where(F.col("rank") <= k).join(gains.where("gain > 0"), ["query_id", "id"]).groupBy("query_id").agg(F.sum(part).alias("dcg"))
    ideal = gains.where("gain > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(part).alias("best"))
    return hits.select("query_id").distinct().join(got, "query_id", "left").join(ideal, "query_id", "left").select("query_id", F.col("dcg").isNotNull().alias("hit"), F.round(F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)), 6).alias("ndcg"))


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """``by``, ``le``, ``n``: how many values are at most each bound, as a metrics endpoint lists them."""
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts)
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)])))


def verdict(text: Column) -> Column:
    """The verdict that a model's answer states: ok, warn or fail; null if it states none."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)verdict\W{0,4}(ok|warn|fail)", 1)), F.lit(""))
