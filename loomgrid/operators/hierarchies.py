"""Coherent forecasts over a hierarchy: (node, leaf) closure rows and one value a node and key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 2000


def bottom_up(closure: DataFrame, leaves: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """(node, keys, value): sums of the leaves' values."""
    return closure.join(leaves.withColumnRenamed("node", "leaf"), "leaf").groupBy("node", *keys).agg(F.sum(value).alias(value))


def top_down(closure: DataFrame, root: str, totals: DataFrame, history: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """The root's values by the leaves' shares of the history (node, total), which must be positive, then bottom-up."""
    leaves = closure.where(F.col("node") == root).select("leaf")
    h = history.join(leaves, F.col("node") == F.col("leaf"))
    share = h.crossJoin(F.broadcast(h.agg(F.sum("total").alias("__t")))).select("leaf", (F.col("total") / F.col("__t")).alias("__p"))
    rows = totals.where(F.col("node") == root).drop("node").crossJoin(share)
    return bottom_up(closure, rows.select(F.col("leaf").alias("node"), *keys, (F.col(value) * F.col("__p")).alias(value)), keys, value)


def middle_out(closure: DataFrame, level: list[str], forecasts: DataFrame, history: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Top-down from each node of a level, and bottom-up above it."""
    under = closure.where(F.col("node").isin(level)).select(F.col("node").alias("__m"), "leaf")
    h = under.join(history.withColumnRenamed("node", "leaf"), "leaf")
    sums = h.groupBy("__m").agg(F.sum("total").alias("__t"))
    share = h.join(sums, "__m").select("__m", "leaf", (F.col("total") / F.col("__t")).alias("__p"))
    rows = forecasts.join(share, F.col("node") == F.col("__m")).select(F.col("leaf").alias("node"), *keys, (F.col(value) * F.col("__p")).alias(value))
    return bottom_up(closure, rows, keys, value)


def proportional(closure: DataFrame, root: str, forecasts: DataFrame, keys: list[str], gamma: float = 1.0, value: str = "mean") -> DataFrame:
    """Leaf forecasts scaled towards the root's: by (root / leaf sum)^gamma, then bottom-up."""
    leaves = forecasts.join(closure.where(F.col("node") == root).select(F.col("leaf").alias("node")), "node", "left_semi")
    sums = leaves.groupBy(*keys).agg(F.sum(value).alias("__s"))
    top = forecasts.where(F.col("node") == root).select(*keys, F.col(value).alias("__r"))
    factor = F.when(F.col("__s") != 0, F.pow(F.col("__r") / F.col("__s"), F.lit(float(gamma)))).otherwise(1.0)
    scaled = leaves.join(sums, keys).join(top, keys).select("node", *keys, (F.col(value) * factor).alias(value))
    return bottom_up(closure, scaled, keys, value)


def projection(closure: DataFrame, weights: dict[str, float] | None = None, residuals: dict[str, list[float]] | None = None) -> tuple[list[str], np.ndarray]:
    """(nodes, P): the matrix that maps all nodes' forecasts to coherent ones.

    Least squares (OLS), by node variances (WLS), or by the shrunken covariance of residuals (MinT).  The
    hierarchy's nodes, not the series' rows, are what is solved here.
    """
    if closure.select("node").distinct().limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    pairs = closure.select("node", "leaf").distinct().collect()  # a leaf has as many as its depth
    nodes, leaves = sorted({r.node for r in pairs}), sorted({r.leaf for r in pairs})
    s = np.zeros((len(nodes), len(leaves)))
    at, of = {n: i for i, n in enumerate(nodes)}, {n: i for i, n in enumerate(leaves)}
    for r in pairs:
        s[at[r.node], of[r.leaf]] = 1.0
    if residuals is not None:
        e = np.array([residuals[n] for n in nodes], dtype=float)
        cov = e @ e.T / e.shape[1]
        d = np.sqrt(np.diag(cov))
        corr = cov / np.outer(d, d)
        x = e / d[:, None]
        off = ~np.eye(len(nodes), dtype=bool)
        var = ((x[:, None] * x[None] - corr[..., None]) ** 2).sum(-1) / (e.shape[1] * (e.shape[1] - 1))
        lam = float(np.clip(var[off].sum() / max((corr[off] ** 2).sum(), 1e-12), 0, 1))
        w = np.where(off, (1 - lam) * cov, cov)
    else:
        w = np.diag([1.0 if weights is None else weights[n] for n in nodes])
    inv = np.linalg.inv(w)
    return nodes, s @ np.linalg.solve(s.T @ inv @ s, s.T @ inv)


def reconcile(closure: DataFrame, forecasts: DataFrame, keys: list[str], value: str = "mean", **kw) -> DataFrame:
    """``projection`` applied to every key by one join with its non-zero entries."""
    nodes, p = projection(closure, **kw)
    rows = [(a, b, float(p[i, j])) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if abs(p[i, j]) > 1e-15]
    m = forecasts.sparkSession.createDataFrame(rows, "to string, node string, p double")
    return forecasts.join(F.broadcast(m), "node").groupBy(F.col("to").alias("node"), *keys).agg(F.sum(F.col("p") * F.col(value)).alias(value))


def incoherent(closure: DataFrame, values: DataFrame, keys: list[str], value: str = "mean", tolerance: float = 1e-6) -> DataFrame:
    """Nodes whose value differs from their leaves' sum."""
    leaves = values.join(closure.where("node = leaf").select("node"), "node", "left_semi")
    sums = bottom_up(closure, leaves, keys, value).withColumnRenamed(value, "__s")
    return values.join(sums, ["node", *keys]).where(F.abs(F.col(value) - F.col("__s")) > tolerance).drop("__s")
