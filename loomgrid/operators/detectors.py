"""Change detectors and filters over each series, in time order.

One group is one series; its rows are sorted inside the group and the recurrence runs once over them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgrid.operators import recurrences as R
from loomgrid.operators.panel import Panel


def over_series(df: DataFrame, p: Panel, columns: dict[str, str], f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """(series, ts, y, columns...): f maps a series' values in time order to the new columns' values."""
    rows = df.select(p.series, p.ts, p.y)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items()]])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(p.ts)
        return part.assign(**f(part[p.y].to_numpy(dtype=float)))[list(schema.fieldNames())]

    return rows.groupBy(p.series).applyInPandas(run, schema)


def _pairs(found: list[tuple[float, bool]]) -> dict[str, np.ndarray]:
    return {"score": np.array([s for s, _ in found], float), "triggered": np.array([t for _, t in found], bool)}


SCORED = {"score": "double", "triggered": "boolean"}


def cusum(df: DataFrame, p: Panel, mean: float, drift: float, limit: float) -> DataFrame:
    return over_series(df, p, SCORED, lambda y: _pairs(R.cusum(y, mean, drift, limit)))


def page_hinkley(df: DataFrame, p: Panel, delta: float, limit: float) -> DataFrame:
    return over_series(df, p, SCORED, lambda y: _pairs(R.page_hinkley(y, delta, limit)))


def ewma_volatility(df: DataFrame, p: Panel, alpha: float) -> DataFrame:
    return over_series(df, p, {"volatility": "double"}, lambda y: {"volatility": R.ewma_volatility(y, alpha)})


def regime_width(df: DataFrame, p: Panel, mean: float, drift: float, limit: float, alpha: float, window: int, mult: float) -> DataFrame:
    """Interval widening after CUSUM triggers."""

    def f(y: np.ndarray) -> dict[str, np.ndarray]:
        found = _pairs(R.cusum(y, mean, drift, limit))
        return found | {"extra": R.regime_width(found["triggered"], found["score"], R.ewma_volatility(y - mean, alpha), window, mult)}

    return over_series(df, p, SCORED | {"extra": "double"}, f)


def kalman_level(df: DataFrame, p: Panel, process: float, noise: float) -> DataFrame:
    def f(y: np.ndarray) -> dict[str, np.ndarray]:
        levels, variances, _ = R.kalman_level(y, process, noise)
        return {"level": levels, "variance": variances, "smoothed": R.smooth_level(levels, variances, process)}

    return over_series(df, p, {"level": "double", "variance": "double", "smoothed": "double"}, f)


def correct_residuals(df: DataFrame, p: Panel, structural: str, process: float, noise: float) -> DataFrame:
    """(series, ts, y, structural, corrected): the structural prediction plus the key's filtered residual mean before
    the row; a missing observation only widens the state."""
    rows = df.select(p.series, p.ts, p.y, structural)
    schema = T.StructType([*rows.schema.fields, T.StructField("corrected", T.DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(p.ts)
        mean, var, out = 0.0, noise, []
        for y, s in zip(part[p.y], part[structural], strict=True):
            out.append(s + mean)
            prior = var + process
            var = prior
            if not np.isnan(y):
                gain = prior / (prior + noise)
                mean += gain * (y - s - mean)
                var = (1 - gain) ** 2 * prior + gain**2 * noise
        return part.assign(corrected=out)

    return rows.groupBy(p.series).applyInPandas(run, schema)


def decompose(df: DataFrame, p: Panel, season: int) -> DataFrame:
    """Trend, seasonal and remainder of series with at least two cycles; others have their mean, 0 and the rest."""

    def f(y: np.ndarray) -> dict[str, np.ndarray]:
        if len(y) < 2 * season:
            return {"trend": np.full(len(y), y.mean()), "seasonal": np.zeros(len(y)), "remainder": y - y.mean()}
        return dict(zip(("trend", "seasonal", "remainder"), R.stl(y, season), strict=True))

    return over_series(df, p, {"trend": "double", "seasonal": "double", "remainder": "double"}, f)


def decompose_multiple(df: DataFrame, p: Panel, seasons: list[int]) -> DataFrame:
    names = [f"seasonal_{m}" for m in sorted(seasons)]

    def f(y: np.ndarray) -> dict[str, np.ndarray]:
        usable = [m for m in seasons if len(y) >= 2 * m]
        trend, parts, rest = R.mstl(y, usable) if usable else (np.full(len(y), y.mean()), {}, y - y.mean())
        return {"trend": trend, "remainder": rest} | {f"seasonal_{m}": parts.get(m, np.zeros(len(y))) for m in seasons}

    return over_series(df, p, {"trend": "double", **dict.fromkeys(names, "double"), "remainder": "double"}, f)


def match_reference(df: DataFrame, p: Panel, signal: list[float], noise: float, step: float) -> DataFrame:
    """(series, ts, y, state): each series' likeliest path through the reference signal's states."""
    ref = np.array(signal, float)
    return over_series(df, p, {"state": "long"}, lambda y: {"state": R.viterbi(y, ref, noise, step)})


def reference_mean(df: DataFrame, p: Panel, axis: list[float], signal: list[float], noise: float, step: float) -> DataFrame:
    """(series, ts, y, axis, signal): the mean position and signal over all paths through the reference's states."""
    at, ref = np.array(axis, float), np.array(signal, float)
    return over_series(df, p, {"axis": "double", "signal": "double"}, lambda y: dict(zip(("axis", "signal"), R.posterior_mean(y, at, ref, noise, step), strict=True)))


def locate(df: DataFrame, p: Panel, grid: list[float], signal: list[float], start: tuple[float, float], noise: float, unscented: bool = False) -> DataFrame:
    """(series, ts, y, axis): each series' axis position along the reference signal, a row a step: by an extended filter
    smoothed backwards, or an unscented one."""
    g, s = np.array(grid, float), np.array(signal, float)
    f = R.unscented_filter if unscented else R.sequence_filter
    return over_series(df, p, {"axis": "double"}, lambda y: {"axis": f(np.arange(len(y), dtype=float), y, g, s, start, noise)})
