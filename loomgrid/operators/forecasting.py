"""Forecasts: every model gives (series_id, ts, horizon, model, mean) rows.

Models of a closed form are DataFrame plans; recurrences run once a series inside ``applyInPandas``, with the
series' rows sorted there.  Parameter grids are tried on a holdout of the same group, so a series is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.operators import recurrences as R
from loomgrid.operators.panel import Panel, advance, future_index, observed


def _steps(df: DataFrame, p: Panel, horizon: int) -> DataFrame:
    return future_index(df, p, horizon)


def _rows(df: DataFrame, p: Panel, model: str, mean: Column) -> DataFrame:
    return df.select(p.series, p.ts, "horizon", F.lit(model).alias("model"), mean.alias("mean"))


def _backward(df: DataFrame, p: Panel) -> DataFrame:
    """Observed rows numbered back from 1."""
    return observed(df, p).select(p.series, F.col(p.y).alias("__y"), F.row_number().over(W.partitionBy(p.series).orderBy(F.desc(p.ts))).alias("__back"))


def naive(df: DataFrame, p: Panel, horizon: int) -> DataFrame:
    """The last observed value; steps count from the frame's last time."""
    last = observed(df, p).groupBy(p.series).agg(F.max_by(p.y, p.ts).alias("__y"))
    return _rows(_steps(df, p, horizon).join(last, p.series), p, "naive", F.col("__y"))


def seasonal_naive(df: DataFrame, p: Panel, horizon: int, season: int) -> DataFrame:
    """The value at the same phase of the last cycle; series shorter than a cycle have no rows."""
    back = _backward(df, p).where(F.col("__back") <= season)
    whole = back.groupBy(p.series).count().where(F.col("count") == season).drop("count")
    steps = _steps(df, p, horizon).withColumn("__back", season - (F.col("horizon") - 1) % season)
    return _rows(steps.join(back, [p.series, "__back"]).join(whole, p.series, "left_semi"), p, "seasonal_naive", F.col("__y"))


def window_average(df: DataFrame, p: Panel, horizon: int, size: int) -> DataFrame:
    mean = _backward(df, p).where(F.col("__back") <= size).groupBy(p.series).agg(F.avg("__y").alias("__m"))
    return _rows(_steps(df, p, horizon).join(mean, p.series), p, "window_average", F.col("__m"))


def seasonal_window_average(df: DataFrame, p: Panel, horizon: int, season: int, cycles: int) -> DataFrame:
    """The mean over the last cycles at the same phase."""
    back = _backward(df, p).where(F.col("__back") <= season * cycles)
    mean = back.groupBy(p.series, ((F.col("__back") - 1) % season).alias("__phase")).agg(F.avg("__y").alias("__m"))
    steps = _steps(df, p, horizon).withColumn("__phase", season - 1 - (F.col("horizon") - 1) % season)
    return _rows(steps.join(mean, [p.series, "__phase"]), p, "seasonal_window_average", F.col("__m"))


def per_series(df: DataFrame, p: Panel, model: str, horizon: int, f: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """Applies f(values in time order, horizon) to each series' observed values."""
    schema = T.StructType([T.StructField(p.series, T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("mean", T.DoubleType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(p.ts)[p.y].to_numpy(dtype=float)
        return pd.DataFrame({p.series: key[0], "horizon": np.arange(1, horizon + 1, dtype=np.int32), "mean": np.asarray(f(y, horizon), dtype=float)})

    made = observed(df, p).select(p.series, p.ts, p.y).groupBy(p.series).applyInPandas(run, schema)
    last = df.groupBy(p.series).agg(F.max(p.ts).alias("__last"))
    made = made.join(last, p.series).withColumn(p.ts, advance(F.col("__last"), p.freq, F.col("horizon")))
    return _rows(made, p, model, F.col("mean"))


def _flat(f: Callable[..., float], **kw) -> Callable[[np.ndarray, int], np.ndarray]:
    return lambda y, h: np.full(h, f(y, **kw))


def theta(df, p, horizon, **kw) -> DataFrame:
    return per_series(df, p, "theta", horizon, lambda y, h: R.theta(y, h, **kw))


def ets(df, p, horizon, **kw) -> DataFrame:
    return per_series(df, p, "ets", horizon, lambda y, h: R.ets(y, h, **kw))


def arima(df, p, horizon, order=(1, 0, 0)) -> DataFrame:
    return per_series(df, p, "arima", horizon, lambda y, h: R.arima(y, h, *order))


def croston(df, p, horizon, alpha=0.1) -> DataFrame:
    return per_series(df, p, "croston", horizon, _flat(R.croston, alpha=alpha))


def sba(df, p, horizon, alpha=0.1) -> DataFrame:
    return per_series(df, p, "sba", horizon, _flat(R.sba, alpha=alpha))


def tsb(df, p, horizon, alpha=0.1, beta=0.1) -> DataFrame:
    return per_series(df, p, "tsb", horizon, _flat(R.tsb, alpha=alpha, beta=beta))


def adida(df, p, horizon, bucket=7, alpha=0.1) -> DataFrame:
    return per_series(df, p, "adida", horizon, _flat(R.adida, bucket=bucket, alpha=alpha))


def kalman(df, p, horizon, process=0.1, noise=1.0) -> DataFrame:
    return per_series(df, p, "local_level_kalman", horizon, lambda y, h: np.full(h, R.kalman_level(y, process, noise)[0][-1]))


def kalman_trend(df, p, horizon, **kw) -> DataFrame:
    def f(y: np.ndarray, h: int) -> np.ndarray:
        level, trend = R.kalman_trend(y, **kw)
        return level + trend * np.arange(1, h + 1)

    return per_series(df, p, "kalman", horizon, f)


def piecewise(df, p, horizon, **kw) -> DataFrame:
    return per_series(df, p, "piecewise_linear_seasonal", horizon, lambda y, h: R.piecewise(y, h, **kw))


def piecewise_regressors(df: DataFrame, future: DataFrame, p: Panel, regressors: list[str], strength: float = 1.0, **kw) -> DataFrame:
    """The piecewise model with known regressors and event indicators; ``future`` is (series, horizon, ts, regressors).

    A series' history and its few steps ahead meet in one group.
    """
    if missing := [c for c in regressors if c not in future.columns or c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    past = observed(df, p).select(p.series, p.ts, F.lit(None).cast("int").alias("horizon"), F.col(p.y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in regressors])
    ahead = future.select(p.series, p.ts, F.col("horizon").cast("int").alias("horizon"), F.lit(None).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in regressors])
    schema = T.StructType([T.StructField(p.series, T.StringType()), past.schema[p.ts], T.StructField("horizon", T.IntegerType()), T.StructField("mean", T.DoubleType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(p.ts)
        old, new = rows[rows["horizon"].isna()], rows[rows["horizon"].notna()]
        if old.empty or new.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        made = R.piecewise(old["__y"].to_numpy(float), int(new["horizon"].max()), extra=(old[regressors].to_numpy(float), new.sort_values("horizon")[regressors].to_numpy(float)), extra_ridge=strength, **kw)
        return pd.DataFrame({p.series: key[0], p.ts: new[p.ts], "horizon": new["horizon"].astype("int32"), "mean": made[new["horizon"].astype(int).to_numpy() - 1]})

    out = past.unionByName(ahead).groupBy(p.series).applyInPandas(run, schema)
    return _rows(out, p, "piecewise_regressors", F.col("mean"))


def stl_forecast(df, p, horizon, season=7) -> DataFrame:
    """The last season repeated on an ETS forecast of the rest."""

    def f(y: np.ndarray, h: int) -> np.ndarray:
        if len(y) < 2 * season:
            return R.ets(y, h)
        _, seasonal, _ = R.stl(y, season)
        return R.ets(y - seasonal, h) + seasonal[-season:][np.arange(h) % season]

    return per_series(df, p, "stl", horizon, f)


#: Candidate parameters, fixed values.
ETS_GRID = [{"alpha": a, "beta": b, "phi": f} for a, b, f in product((0.1, 0.2, 0.3, 0.5, 0.8, 0.95), (0.0, 0.05, 0.1, 0.2, 0.4), (0.8, 0.9, 0.95, 0.98, 1.0))]
THETA_GRID = [{"theta_": t, "alpha": a} for t, a in product((1.0, 1.5, 2.0, 3.0), (0.1, 0.2, 0.3, 0.5, 0.8))]
ARIMA_GRID = [{"p": a, "d": b, "q": c} for a, b, c in product(range(3), range(2), range(2)) if a + c]


def _chosen(y: np.ndarray, f: Callable, grid: list[dict]) -> dict:
    """The grid's first least squared error on the holdout."""
    h = R.holdout(len(y))
    if len(y) <= h + 2:
        return grid[0]
    losses = [float(np.mean((f(y[:-h], h, **g) - y[-h:]) ** 2)) for g in grid]
    return grid[int(np.argmin(np.nan_to_num(losses, nan=np.inf)))]


def _auto(model: str, f: Callable, grid: list[dict]) -> Callable:
    def run(df: DataFrame, p: Panel, horizon: int) -> DataFrame:
        return per_series(df, p, model, horizon, lambda y, h: f(y, h, **_chosen(y, f, grid)))

    return run


auto_ets = _auto("auto_ets", R.ets, ETS_GRID)
optimized_theta = _auto("optimized_theta", R.theta, THETA_GRID)
auto_arima = _auto("auto_arima", R.arima, ARIMA_GRID)


def intermittent(df: DataFrame, p: Panel, horizon: int) -> DataFrame:
    """Zero, TSB, SBA, Croston or ADIDA, whichever loses least on the holdout (first of equal ones)."""
    def f(y: np.ndarray, h: int) -> np.ndarray:
        return np.full(h, R.intermittent(y))

    return per_series(df, p, "intermittent_demand", horizon, f)


MODELS: dict[str, Callable[..., DataFrame]] = {
    "naive": naive, "seasonal_naive": seasonal_naive, "window_average": window_average, "seasonal_window_average": seasonal_window_average,
    "theta": theta, "optimized_theta": optimized_theta, "ets": ets, "auto_ets": auto_ets, "arima": arima, "auto_arima": auto_arima,
    "local_level_kalman": kalman, "kalman": kalman_trend, "croston": croston, "sba": sba, "tsb": tsb, "adida": adida,
    "intermittent_demand": intermittent, "piecewise_linear_seasonal": piecewise, "stl": stl_forecast,
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Adds a model (df, panel, horizon, ...) by name."""
    if name in MODELS:
        raise ValueError(f"{name} is registered")
    MODELS[name] = f


def log1p(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The model on log(1 + y), its means mapped back."""

    def run(df: DataFrame, p: Panel, horizon: int, **kw) -> DataFrame:
        made = f(df.withColumn(p.y, F.log1p(p.y)), p, horizon, **kw)
        return made.withColumn("mean", F.expm1("mean")).withColumn("model", F.concat(F.lit("log1p_"), F.col("model")))

    return run


def ensemble(members: list[DataFrame], weights: list[float], keys: tuple[str, ...] = ("series_id", "ts", "horizon")) -> DataFrame:
    """The members' weighted mean a key; keys that a member lacks have null, for the caller to reject."""
    share = [w / sum(weights) for w in weights]
    parts = [m.select(*keys, (F.col("mean") * s).alias("mean")) for m, s in zip(members, share, strict=True)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == len(members), F.sum("mean")).alias("mean"))


def validation_weights(scores: DataFrame, by: list[str], score: str = "score", model: str = "model", top: int = 4) -> DataFrame:
    """(by, model, weight): the best ``top`` models, weight as (best / score)^2; all on exact zeros."""
    w = W.partitionBy(*by)  # a group has a row a model
    rows = scores.withColumn("__k", F.row_number().over(w.orderBy(score, model))).where(F.col("__k") <= top).withColumn("__best", F.min(score).over(w))
    raw = F.when(F.col("__best") == 0, F.when(F.col(score) == 0, 1.0).otherwise(0.0)).otherwise(F.pow(F.col("__best") / F.col(score), F.lit(2.0)))
    rows = rows.withColumn("__w", raw)
    return rows.select(*by, model, (F.col("__w") / F.sum("__w").over(w)).alias("weight"))


def robust_pick(scores: DataFrame, by: list[str], complexity: str, score: str = "score", slack: float = 0.05) -> DataFrame:
    """The least complex model within ``slack`` of the best score."""
    best = scores.groupBy(*by).agg(F.min(score).alias("__best"))
    near = scores.join(best, by).where(F.col(score) <= F.col("__best") * (1 + slack))
    return near.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(complexity, score))).where("__k = 1").drop("__k", "__best")


def backtest(df: DataFrame, p: Panel, folds: DataFrame, f: Callable[..., DataFrame], horizon: int, **kw) -> DataFrame:
    """(fold_id, series, ts, horizon, model, mean, y): the model on each fold's training rows, met with its test rows.

    ``folds`` has (fold_id, ts, role).  All folds run in one job: the fold is part of the series' key.
    """
    rows = df.join(F.broadcast(folds), p.ts).withColumn("__key", F.concat_ws("\x1f", "fold_id", p.series))
    q = Panel(series="__key", ts=p.ts, y=p.y, freq=p.freq, allow_irregular=True)
    made = f(rows.where("role = 'train'").select("__key", p.ts, p.y), q, horizon, **kw)
    test = rows.where("role = 'test'").select("__key", p.ts, p.y, p.series, "fold_id")
    return made.join(test, ["__key", p.ts]).drop("__key")


def gate(scores: DataFrame, by: list[str], baseline: str, displacement: float = 0.05, winner: float = 0.1, top: int = 3, low: float = 0.05, high: float = 0.8, score: str = "score", model: str = "model") -> DataFrame:
    """(by, model, weight): the baseline alone unless the best gains ``displacement`` on it; the best alone where it
    beats the second by ``winner``; else the top ones by inverse score, projected on weights within low..high."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([score, model])
        names, s = part[model].tolist(), part[score].to_numpy(float)
        base = s[names.index(baseline)] if baseline in names else np.inf
        if base < np.inf and s[0] > base * (1 - displacement):
            chosen = {baseline: 1.0}
        elif len(s) == 1 or s[0] <= s[1] * (1 - winner):
            chosen = {names[0]: 1.0}
        else:
            raw = 1 / np.maximum(s[:top], 1e-9)
            chosen = dict(zip(names[:top], bounded_simplex(raw / raw.sum(), low, high), strict=True))
        return pd.DataFrame([(*key, n, float(w)) for n, w in chosen.items()], columns=[*by, model, "weight"])

    kinds = [scores.schema[c] for c in (*by, model)]
    return scores.groupBy(*by).applyInPandas(run, T.StructType([*kinds, T.StructField("weight", T.DoubleType())]))


def bounded_simplex(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest weights that sum to 1 within low..high, by bisection of the shift."""
    low, high = min(low, 1 / len(w)), max(high, 1 / len(w))
    a, b = (w - high).min() - 1, (w - low).max() + 1
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if np.clip(w - mid, low, high).sum() > 1 else (a, mid)
    return np.clip(w - (a + b) / 2, low, high)


def _seasonal_tail(y: np.ndarray, h: int, season: int, cycles: int = 1) -> np.ndarray:
    """Means at the same phase over the last cycles; the last value for series shorter than a cycle."""
    if len(y) < season:
        return np.full(h, y[-1])
    tail = y[-season * cycles :][::-1]
    phase = np.array([tail[k::season].mean() for k in range(season)])[::-1]
    return phase[np.arange(h) % season]


#: Every model as a function of one series' values in time order, for passes that try many of them at once.
ARRAYS: dict[str, Callable[..., np.ndarray]] = {
    "naive": lambda y, h: np.full(h, y[-1]), "seasonal_naive": lambda y, h, season=7: _seasonal_tail(y, h, season),
    "window_average": lambda y, h, size=7: np.full(h, y[-size:].mean()), "seasonal_window_average": lambda y, h, season=7, cycles=3: _seasonal_tail(y, h, season, cycles),
    "theta": R.theta, "optimized_theta": lambda y, h: R.theta(y, h, **_chosen(y, R.theta, THETA_GRID)), "ets": R.ets, "auto_ets": lambda y, h: R.ets(y, h, **_chosen(y, R.ets, ETS_GRID)),
    "arima": lambda y, h, order=(1, 0, 0): R.arima(y, h, *order), "auto_arima": lambda y, h: R.arima(y, h, **_chosen(y, R.arima, ARIMA_GRID)),
    "local_level_kalman": lambda y, h, process=0.1, noise=1.0: np.full(h, R.kalman_level(y, process, noise)[0][-1]),
    "kalman": lambda y, h, **kw: (lambda s: s[0] + s[1] * np.arange(1, h + 1))(R.kalman_trend(y, **kw)),
    "croston": lambda y, h, alpha=0.1: np.full(h, R.croston(y, alpha)), "sba": lambda y, h, alpha=0.1: np.full(h, R.sba(y, alpha)),
    "tsb": lambda y, h, alpha=0.1, beta=0.1: np.full(h, R.tsb(y, alpha, beta)), "adida": lambda y, h, bucket=7, alpha=0.1: np.full(h, R.adida(y, bucket, alpha)),
    "intermittent_demand": lambda y, h: np.full(h, R.intermittent(y)), "piecewise_linear_seasonal": R.piecewise,
}

#: The candidates of ``auto_forecast``: name and parameters, fixed values.
CANDIDATES = [
    ("naive", {}), ("seasonal_naive", {"season": 7}), ("window_average", {"size": 7}), ("seasonal_window_average", {"season": 7, "cycles": 3}), ("theta", {}), ("ets", {}),
    ("auto_ets", {}), ("arima", {}), ("local_level_kalman", {}), ("croston", {}), ("tsb", {}), ("piecewise_linear_seasonal", {}), ("intermittent_demand", {}),
]


def run_all(df: DataFrame, p: Panel, horizon: int, candidates: list[tuple[str, dict]], key: str | None = None) -> DataFrame:
    """(key, ts, horizon, model, mean) of all candidates, tried in one pass over each series' group."""
    key = key or p.series
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("model", T.StringType()), T.StructField("mean", T.DoubleType())])

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(p.ts)[p.y].to_numpy(dtype=float)
        parts = [pd.DataFrame({key: k[0], "horizon": np.arange(1, horizon + 1, dtype=np.int32), "model": name, "mean": np.asarray(ARRAYS[name](y, horizon, **kw), float)}) for name, kw in candidates]
        return pd.concat(parts)

    rows = df.where(F.col(p.y).isNotNull() & ~F.isnan(p.y))
    made = rows.select(key, p.ts, p.y).groupBy(key).applyInPandas(run, schema)
    last = df.groupBy(key).agg(F.max(p.ts).alias("__last"))
    return made.join(last, key).select(key, advance(F.col("__last"), p.freq, F.col("horizon")).alias(p.ts), "horizon", "model", "mean")


def backtest_all(df: DataFrame, p: Panel, folds: DataFrame, horizon: int, candidates: list[tuple[str, dict]]) -> DataFrame:
    """(fold_id, series, ts, horizon, model, mean, y): all candidates on each fold's training rows, in one shuffle."""
    rows = df.join(F.broadcast(folds), p.ts).withColumn("__key", F.concat_ws("\x1f", "fold_id", p.series))
    made = run_all(rows.where("role = 'train'"), p, horizon, candidates, "__key")
    test = rows.where("role = 'test'").select("__key", p.ts, p.y, p.series, "fold_id")
    return made.join(test, ["__key", p.ts]).drop("__key")


def auto_forecast(df: DataFrame, p: Panel, horizon: int, folds: DataFrame, candidates: list[tuple[str, dict]] | None = None, top: int = 2) -> DataFrame:
    """The best candidates of a rolling-origin backtest by the mean of relative RMSE and WAPE, blended by their
    validation weights within 0.15..0.85, and not below 0 where the history isn't."""
    from loomgrid.operators.metrics import forecast_metrics

    scored = backtest_all(df, p, folds, horizon, candidates or CANDIDATES)
    m = forecast_metrics(scored, ["model", "fold_id"]).groupBy("model").agg(F.avg("rmse").alias("r"), F.avg("wape").alias("w"))
    best = m.agg(F.min("r").alias("br"), F.min("w").alias("bw"))
    m = m.crossJoin(best).select("model", (F.col("r") / F.greatest("br", F.lit(1e-12)) + F.col("w") / F.greatest("bw", F.lit(1e-12))).alias("score"))
    weights = {r.model: r.weight for r in validation_weights(m, [], top=top).collect()}  # a row a candidate
    share = bounded_simplex(np.array(list(weights.values())), 0.15, 0.85) if len(weights) > 1 else np.ones(1)
    params = dict(candidates or CANDIDATES)
    made = run_all(df, p, horizon, [(n, params[n]) for n in weights])
    by_model = dict(zip(weights, map(float, share), strict=True))
    w = F.create_map(*[F.lit(x) for kv in by_model.items() for x in kv])
    out = made.groupBy(p.series, p.ts, "horizon").agg(F.sum(F.col("mean") * w[F.col("model")]).alias("mean"))
    low = df.groupBy(p.series).agg(F.min(p.y).alias("__low"))
    mean = F.when(F.col("__low") >= 0, F.greatest("mean", F.lit(0.0))).otherwise(F.col("mean"))
    return out.join(low, p.series).select(p.series, p.ts, "horizon", F.lit("auto_forecaster").alias("model"), mean.alias("mean"))


def split_last(df: DataFrame, p: Panel, window: int) -> tuple[DataFrame, DataFrame]:
    """(training, validation): each series' rows but its last ``window``, and those; an error for shorter series."""
    back = F.row_number().over(W.partitionBy(p.series).orderBy(F.desc(p.ts)))
    rows = observed(df, p).drop("anchor").withColumn("__back", back)
    if df.groupBy(p.series).count().where(F.col("count") <= window).take(1):
        raise ValueError("a series is too short for its validation rows")
    return rows.where(F.col("__back") > window).drop("__back"), rows.where(F.col("__back") <= window).drop("__back")


#: The experts of the classical bank, fixed values.
EXPERTS = [
    ("naive", {}), ("seasonal_naive", {"season": 7}), ("window_average", {"size": 7}), ("seasonal_window_average", {"season": 7, "cycles": 3}), ("theta", {}), ("optimized_theta", {}),
    ("ets", {}), ("auto_ets", {}), ("auto_arima", {}), ("local_level_kalman", {}), ("kalman", {}),
]


def bank_scores(df: DataFrame, p: Panel, window: int, experts: list[tuple[str, dict]] | None = None, objective: str = "mse", season: int = 7) -> DataFrame:
    """(model, loss, n) over all series' last ``window`` rows: the mean squared error, or the mean of sMAPE and MASE."""
    from loomgrid.operators.metrics import forecast_metrics, naive_scale

    train, test = split_last(df, p, window)
    rows = run_all(train, p, window, experts or EXPERTS).join(test.select(p.series, p.ts, F.col(p.y).alias("y")), [p.series, p.ts])
    if objective == "mse":
        return rows.groupBy("model").agg(F.avg(F.pow(F.col("mean") - F.col("y"), F.lit(2.0))).alias("loss"), F.count(F.lit(1)).alias("n"))
    m = forecast_metrics(rows, ["model", p.series], naive=None).join(naive_scale(train, p.series, p.ts, p.y, season, [p.series]), p.series)
    mase = F.when(F.col("naive_mae") != 0, F.col("mae") / F.col("naive_mae"))
    return m.groupBy("model").agg(F.avg((F.col("smape") + F.coalesce(mase, F.lit(0.0))) / 2).alias("loss"), F.count(F.lit(1)).alias("n"))


def expert_bank(df: DataFrame, p: Panel, horizon: int, window: int, experts: list[tuple[str, dict]] | None = None, objective: str = "mse") -> DataFrame:
    """The forecast of the expert of least validation loss over all series, the first listed of equal ones."""
    experts = experts or EXPERTS
    order = {n: k for k, (n, _) in enumerate(experts)}
    losses = {r.model: round(r.loss, 9) for r in bank_scores(df, p, window, experts, objective).collect()}  # a row an expert
    best = min(losses, key=lambda n: (losses[n], order[n]))
    return run_all(df, p, horizon, [(best, dict(experts)[best])])


def lag_plus(df: DataFrame, p: Panel, horizon: int, base: tuple[str, dict], window: int, period: int | None = None, strength: float = 5.0) -> DataFrame:
    """The base model's forecast plus corrections from the last ``window`` rows: mean residuals by step, then by phase of
    the day number modulo ``period``, then by series, each shrunk by n / (n + strength).  They are left out where they
    don't lower the RMSE there."""
    train, test = split_last(df, p, window)
    rows = run_all(train, p, window, [base]).join(test.select(p.series, p.ts, F.col(p.y).alias("y")), [p.series, p.ts])
    phase = F.pmod(F.datediff(p.ts, F.lit("1970-01-01")), F.lit(period or 1))
    rows = rows.withColumn("__r", F.col("y") - F.col("mean")).withColumn("__phase", phase)
    shrunk = lambda name: (F.avg("__r") * F.count(F.lit(1)) / (F.count(F.lit(1)) + strength)).alias(name)
    left = rows
    tables = []
    for by, name in (("horizon", "__ch"), *([("__phase", "__cp")] if period else []), (p.series, "__cs")):
        table = left.groupBy(by).agg(shrunk(name))
        tables.append((by, name, table))
        left = left.join(table, by).withColumn("__r", F.col("__r") - F.col(name))
    before, after = left.agg(F.avg(F.pow(F.col("y") - F.col("mean"), F.lit(2.0))), F.avg(F.pow("__r", F.lit(2.0)))).first()
    out = run_all(df, p, horizon, [base]).withColumn("__phase", phase)
    total = F.lit(0.0)
    if after is not None and after <= before:
        for by, name, table in tables:
            out = out.join(table, by, "left")
            total = total + F.coalesce(name, F.lit(0.0))
    return out.select(p.series, p.ts, "horizon", F.lit("lag_plus").alias("model"), (F.col("mean") + total).alias("mean"))


def scaled(f: Callable[..., DataFrame], least: float = 1e-6) -> Callable[..., DataFrame]:
    """The model on each series less its mean and over its population deviation (at least ``least``), mapped back."""

    def run(df: DataFrame, p: Panel, horizon: int, **kw) -> DataFrame:
        stats = observed(df, p).groupBy(p.series).agg(F.avg(p.y).alias("__m"), F.greatest(F.stddev_pop(p.y), F.lit(least)).alias("__s"))
        made = f(df.join(stats, p.series).withColumn(p.y, (F.col(p.y) - F.col("__m")) / F.col("__s")).drop("__m", "__s"), p, horizon, **kw)
        return made.join(stats, p.series).select(p.series, p.ts, "horizon", F.concat(F.lit("scaled_"), "model").alias("model"), (F.col("mean") * F.col("__s") + F.col("__m")).alias("mean"))

    return run


#: Variances tried by the automatic filters, fixed values.
KALMAN_GRID = [{"level_noise": a, "trend_noise": b, "noise": c} for a, b, c in product((0.01, 0.1, 1.0), (0.001, 0.01, 0.1), (0.1, 1.0, 10.0))]
LEVEL_GRID = [{"process": a, "noise": c} for a, c in product((0.01, 0.1, 1.0), (0.1, 1.0, 10.0))]


def _auto_filter(df: DataFrame, p: Panel, grid: list[dict], window: int, score: Callable[[np.ndarray, np.ndarray, dict], tuple[float, float]]) -> dict:
    """The grid's member of least summed predictive negative log-likelihood (then squared error) over all series' last rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(p.ts)[p.y].to_numpy(dtype=float)
        k = min(window, max(0, len(y) - 2))
        found = [score(y[: len(y) - k], y[len(y) - k :], g) for g in grid]
        return pd.DataFrame({"g": range(len(grid)), "nll": [x for x, _ in found], "sse": [x for _, x in found]})

    sums = observed(df, p).select(p.series, p.ts, p.y).groupBy(p.series).applyInPandas(run, "g int, nll double, sse double").groupBy("g").agg(F.sum("nll").alias("nll"), F.sum("sse").alias("sse")).collect()
    return grid[min(sums, key=lambda r: (round(r.nll, 9), round(r.sse, 9), r.g)).g]


def _normal_nll(errors: np.ndarray, variances: np.ndarray) -> float:
    return float(0.5 * (np.log(2 * np.pi * variances) + errors * errors / variances).sum())


def auto_kalman_level(df: DataFrame, p: Panel, horizon: int, window: int = 5, grid: list[dict] | None = None) -> DataFrame:
    def score(a: np.ndarray, b: np.ndarray, g: dict) -> tuple[float, float]:
        levels, variances, _ = R.kalman_level(a, **g)
        err = b - levels[-1]
        return _normal_nll(err, variances[-1] + g["process"] * np.arange(1, len(b) + 1) + g["noise"]), float((err * err).sum())

    best = _auto_filter(df, p, grid or LEVEL_GRID, window, score)
    return kalman(df, p, horizon, **best).withColumn("model", F.lit("auto_local_level_kalman"))


def auto_kalman_trend(df: DataFrame, p: Panel, horizon: int, window: int = 5, grid: list[dict] | None = None) -> DataFrame:
    def score(a: np.ndarray, b: np.ndarray, g: dict) -> tuple[float, float]:
        means, variances = R.trend_distribution(a, len(b), **g)
        err = b - means
        return _normal_nll(err, variances), float((err * err).sum())

    best = _auto_filter(df, p, grid or KALMAN_GRID, window, score)
    return kalman_trend(df, p, horizon, **best).withColumn("model", F.lit("auto_kalman"))


def decomposed(df: DataFrame, p: Panel, horizon: int, seasons: list[int], rest: Callable[..., DataFrame], **kw) -> DataFrame:
    """The seasonal parts' last cycles repeated on a forecast of what they leave, by any model: with one season by STL,
    with several by MSTL.  Seasons longer than half a series have no part in it."""
    from loomgrid.operators.detectors import decompose, decompose_multiple

    parts = decompose(observed(df, p).drop("anchor"), p, seasons[0]).withColumnRenamed("seasonal", f"seasonal_{seasons[0]}") if len(seasons) == 1 else decompose_multiple(observed(df, p).drop("anchor"), p, seasons)
    names = [f"seasonal_{m}" for m in seasons]
    plain = parts.select(p.series, p.ts, (F.col("trend") + F.col("remainder")).alias(p.y))
    out = rest(plain, p, horizon, **kw)
    back = parts.withColumn("__back", F.row_number().over(W.partitionBy(p.series).orderBy(F.desc(p.ts))))
    mean = F.col("mean")
    for m, name in zip(seasons, names, strict=True):
        cycle = back.where(F.col("__back") <= m).select(p.series, F.col("__back").alias(f"__at{m}"), F.col(name).alias(f"__s{m}"))
        out = out.withColumn(f"__at{m}", m - (F.col("horizon") - 1) % m).join(cycle, [p.series, f"__at{m}"], "left")
        mean = mean + F.coalesce(f"__s{m}", F.lit(0.0))
    kind = "stl_" if len(seasons) == 1 else "mstl_"
    return out.select(p.series, p.ts, "horizon", F.concat(F.lit(kind), "model").alias("model"), mean.alias("mean"))


def kriged(df: DataFrame, p: Panel, horizon: int, places: DataFrame, k: int, radius: float, kind: str = "exponential", scale: float = 1.0, sill: float = 1.0, nugget: float = 0.1, window: int = 5, base: tuple[str, dict] = ("naive", {})) -> DataFrame:
    """The base model's forecast plus its mean residual over each series' last ``window`` rows, kriged from the k nearest
    series' residuals; ``places`` is (series, x, y).  A series without a neighbour within the radius keeps the base."""
    from loomgrid.operators.joins import nearest
    from loomgrid.operators.spatial import krige

    train, test = split_last(df, p, window)
    rows = run_all(train, p, window, [base]).join(test.select(p.series, p.ts, F.col(p.y).alias("__y")), [p.series, p.ts])
    level = rows.groupBy(p.series).agg(F.avg(F.col("__y") - F.col("mean")).alias("level"))
    at = places.join(level, p.series)
    made = krige(nearest(at, at, p.series, k, radius), p.series, "level", kind, scale, sill, nugget).select(p.series, F.col("mean").alias("__c"))
    out = run_all(df, p, horizon, [base]).join(made, p.series, "left")
    name = "kriging" if base[0] == "naive" else f"spatial_{base[0]}"
    return out.select(p.series, p.ts, "horizon", F.lit(name).alias("model"), (F.col("mean") + F.coalesce("__c", F.lit(0.0))).alias("mean"))


def _lag_matrix(y: np.ndarray, lags: list[int], windows: list[int]) -> list[float]:
    return [y[-k] for k in lags] + [y[-w:].mean() for w in windows]


def lag_names(lags: list[int], windows: list[int]) -> list[str]:
    return [f"target_lag_{k}" for k in lags] + [f"target_roll_mean_{w}" for w in windows]


def boosted_lags(df: DataFrame, p: Panel, horizon: int, lags=(1, 7), windows=(7,), keep=None, **spec) -> DataFrame:
    """One booster over all series' lag features, applied step by step on its own forecasts inside each series' group."""
    from loomgrid.operators import boosting as B
    from loomgrid.operators.windows import lag_features

    lags, windows = list(lags), list(windows)
    names = lag_names(lags, windows)
    rows = lag_features(observed(df, p).drop("anchor"), p, lags=lags, means=windows)
    model = B.fit(rows, B.Spec(names, p.y, **spec), keep)
    need = max([*lags, *windows])

    def value(x: dict) -> float:
        return model.init + sum(B.tree_score(t, x) for t in model.trees)

    def f(y: np.ndarray, h: int) -> np.ndarray:
        if len(y) < need:
            return np.full(h, y[-1])
        hist = list(y)
        for _ in range(h):
            hist.append(value(dict(zip(names, _lag_matrix(np.array(hist[-need:]), lags, windows), strict=True))))
        return np.array(hist[len(y) :])

    return per_series(df, p, "boosted_lag", horizon, f)


def boosted_direct(df: DataFrame, p: Panel, horizon: int, lags=(1, 7), windows=(7,), keep=None, **spec) -> DataFrame:
    """One booster a step ahead: features of the last observed row, targets led by the step."""
    from loomgrid.operators import boosting as B
    from loomgrid.operators.windows import lag_features

    names = lag_names(list(lags), list(windows))
    base = observed(df, p).drop("anchor")
    ahead = future_index(df, p, 1).select(p.series, p.ts, F.lit(None).cast("double").alias(p.y))  # a row after the last
    rows = lag_features(base.select(p.series, p.ts, p.y).unionByName(ahead), p, lags=list(lags), means=list(windows))
    now = rows.where(F.col(p.y).isNull())
    out = None
    for step in range(1, horizon + 1):
        train = rows.withColumn("__t", F.lead(p.y, step - 1).over(p.window())).where("__t IS NOT NULL")
        model = B.fit(train, B.Spec(names, "__t", **spec), keep)
        part = now.select(p.series, advance(F.col(p.ts), p.freq, F.lit(step - 1)).alias(p.ts), F.lit(step).alias("horizon"), F.lit("boosted_direct").alias("model"), B.margin(model).alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


def rectified_lags(df: DataFrame, p: Panel, horizon: int, lags=(1, 7), windows=(7,), keep=None, **spec) -> DataFrame:
    """Recursive boosted forecasts, each step corrected by a booster of its own: it learns, from the lag features at an
    origin, how far the recursion from that origin was off at that step."""
    from loomgrid.operators import boosting as B
    from loomgrid.operators.windows import lag_features

    lags, windows = list(lags), list(windows)
    names, need = lag_names(lags, windows), max([*lags, *windows])
    seen = observed(df, p).drop("anchor").select(p.series, p.ts, p.y)
    model = B.fit(lag_features(seen, p, lags=lags, means=windows), B.Spec(names, p.y, **spec), keep)
    value = lambda x: model.init + sum(B.tree_score(t, x) for t in model.trees)
    fields = [T.StructField(p.series, T.StringType()), T.StructField("origin", T.IntegerType()), T.StructField("step", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("made", T.DoubleType()), T.StructField("off", T.DoubleType())]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(p.ts)[p.y].to_numpy(dtype=float)
        out = []
        for origin in range(min(need, len(y)), len(y) + 1):
            if origin < need:
                out += [(key[0], origin, s, *[float("nan")] * len(names), y[-1], float("nan")) for s in range(1, horizon + 1)]
                continue
            hist = list(y[origin - need : origin])
            first = _lag_matrix(np.array(hist), lags, windows)
            for s in range(1, horizon + 1):
                hist.append(value(dict(zip(names, _lag_matrix(np.array(hist[-need:]), lags, windows), strict=True))))
                there = origin + s - 1
                out.append((key[0], origin, s, *first, hist[-1], y[there] - hist[-1] if there < len(y) else float("nan")))
        return pd.DataFrame(out, columns=[f.name for f in fields])

    from loomgrid.sources.shared import Tables

    tables = Tables(df.sparkSession, "rectified")
    rows = tables.save(seen.groupBy(p.series).applyInPandas(run, T.StructType(fields)))
    ends = seen.groupBy(p.series).agg(F.count(F.lit(1)).cast("int").alias("origin"), F.max(p.ts).alias("__last"))
    now = rows.join(ends, [p.series, "origin"])
    out = None
    for step in range(1, horizon + 1):
        fix = B.fit(rows.where((F.col("step") == step) & ~F.isnan("off")), B.Spec(names, "off", **spec), keep)
        mean = F.when(F.isnan(names[0]), F.col("made")).otherwise(F.col("made") + B.margin(fix))
        part = now.where(F.col("step") == step).select(p.series, advance(F.col("__last"), p.freq, F.lit(step)).alias(p.ts), F.lit(step).alias("horizon"), F.lit("rectified_recursive").alias("model"), mean.alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


MODELS |= {"boosted_lag": boosted_lags, "boosted_direct": boosted_direct, "rectified_recursive": rectified_lags, "auto_local_level_kalman": auto_kalman_level, "auto_kalman": auto_kalman_trend}
