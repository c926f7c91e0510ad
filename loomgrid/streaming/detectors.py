"""The step-wise detectors and event-time windows on streams.

State is a few numbers a key; rows of a key in a batch are taken in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORES = "key string, ts timestamp, x double, score double, triggered boolean"


def cusum(stream: DataFrame, mean: float, drift: float, limit: float) -> DataFrame:
    """(key, ts, x, score, triggered) of rows (key, ts, x): both sums are kept a key and start again after a trigger."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        scores, hits = [], []
        for v in rows["x"]:
            up, down = max(0.0, up + (v - mean) - drift), max(0.0, down - (v - mean) - drift)
            scores.append(max(up, down))
            hits.append(scores[-1] > limit)
            if hits[-1]:
                up = down = 0.0
        state.update((up, down))
        yield rows.assign(key=key[0], score=scores, triggered=hits)[["key", "ts", "x", "score", "triggered"]]

    return stream.groupBy("key").applyInPandasWithState(step, SCORES, "up double, down double", "append", GroupStateTimeout.NoTimeout)


def page_hinkley(stream: DataFrame, delta: float, limit: float) -> DataFrame:
    """As ``cusum``, by the excess over the running mean above its minimum."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, cum, low = state.get if state.exists else (0.0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        scores, hits = [], []
        for v in rows["x"]:
            n += 1
            mean += (v - mean) / n
            cum += v - mean - delta
            low = min(low, cum)
            scores.append(cum - low)
            hits.append(scores[-1] > limit)
            if hits[-1]:
                n, mean, cum, low = 0.0, 0.0, 0.0, 0.0
        state.update((n, mean, cum, low))
        yield rows.assign(key=key[0], score=scores, triggered=hits)[["key", "ts", "x", "score", "triggered"]]

    return stream.groupBy("key").applyInPandasWithState(step, SCORES, "n double, mean double, cum double, low double", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, ts: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """(start, key, n, total) of event-time windows; rows later than ``late`` behind the watermark are dropped."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), F.col(key).alias("key"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")
