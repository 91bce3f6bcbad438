"""Structured Streaming forms of the operational queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each kind and tumbling window; what comes later than ``late`` is dropped and old windows leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_budget(usage: DataFrame, by: str, tokens: str, limit: int) -> DataFrame:
    """``by``, ``used``, ``over``: the tokens of each key so far; state is one number a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for frame in frames:
            used += int(frame[tokens].sum())
        state.update((used,))
        yield pd.DataFrame({by: [key[0]], "used": [used], "over": [used >= limit]})

    t = usage.schema[by].dataType.simpleString()
    return usage.groupBy(by).applyInPandasWithState(step, f"{by} {t}, used long, over boolean", "used long", "update", "NoTimeout")


def deduplicated(events: DataFrame, id: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each id once, with state for ``late`` only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])
