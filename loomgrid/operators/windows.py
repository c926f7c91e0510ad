"""Lag, rolling and ranking features.

Lag features use rows strictly before the current one; a row without enough history for every requested
feature is dropped, not filled.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import Panel


def lag_features(df: DataFrame, p: Panel, lags=(), means=(), partial_means=(), stds=(), mins=(), maxs=(), ewm_percent=(), deltas=(), trends=(), phases=()) -> DataFrame:
    """``df`` with the features named by kind and size.

    target_lag_k, target_roll_mean_w, target_partial_roll_mean_w, target_roll_std_w (population),
    target_roll_min_w, target_roll_max_w, target_ewm_alpha_AAA (AAA per cent), target_delta_lag_k
    (row before minus k rows earlier), target_roll_trend_w (slope between the window's ends),
    calendar_elapsed_index and calendar_elapsed_phase_p.
    """
    w, y = p.window(), F.col(p.y)
    back = lambda n: w.rowsBetween(-n, -1)
    out: dict[str, Column] = {f"target_lag_{k}": F.lag(y, k).over(w) for k in lags}
    out |= {f"target_roll_mean_{n}": F.avg(y).over(back(n)) for n in means}
    out |= {f"target_partial_roll_mean_{n}": F.avg(y).over(back(n)) for n in partial_means}
    out |= {f"target_roll_std_{n}": F.stddev_pop(y).over(back(n)) for n in stds}
    out |= {f"target_roll_min_{n}": F.min(y).over(back(n)) for n in mins}
    out |= {f"target_roll_max_{n}": F.max(y).over(back(n)) for n in maxs}
    out |= {f"target_delta_lag_{k}": F.lag(y, 1).over(w) - F.lag(y, k + 1).over(w) for k in deltas}
    out |= {f"target_roll_trend_{n}": (F.lag(y, 1).over(w) - F.lag(y, n).over(w)) / (n - 1) for n in trends}
    index = F.row_number().over(w) - 1
    out["calendar_elapsed_index"] = index
    out |= {f"calendar_elapsed_phase_{n}": index % n for n in phases}
    need = max([0, *lags, *means, *stds, *mins, *maxs, *(k + 1 for k in deltas), *trends, *(1 for _ in (*partial_means, *ewm_percent))])
    df = df.withColumns(out)
    for percent in ewm_percent:
        df = _ewm(df, p, percent / 100, f"target_ewm_alpha_{percent:03d}")
    return df.where(F.col("calendar_elapsed_index") >= need)


def _ewm(df: DataFrame, p: Panel, alpha: float, name: str) -> DataFrame:
    """``df`` (with calendar_elapsed_index) and the smoothed mean of all rows before: e1 = y1; e = alpha y + (1 - alpha) e.

    A running sum in stretches short enough that no power of 1 - alpha leaves the range of doubles; the stretches' ends,
    a row each, pass on what they carry to the next ones, as far as it counts.  So the work grows with the rows only.
    """
    q = 1 - alpha
    if q <= 0:
        return df.withColumn(name, F.lag(p.y, 1).over(p.window()))
    size = max(1, int(14 / -log(q)))  # q ** size is about 1e-6
    i = F.col("calendar_elapsed_index")
    at, place = F.floor(i / size), i % size
    # The first row's weight is q^k instead of alpha q^k.
    z = F.when(i == 0, F.col(p.y)).otherwise(F.col(p.y) * alpha)
    rows = df.withColumns({"__at": at, "__place": place})
    inside = F.sum(z * F.pow(F.lit(q), -F.col("__place"))).over(W.partitionBy(p.series, "__at").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__local", inside * F.pow(F.lit(q), F.col("__place")))
    ends = rows.groupBy(F.col(p.series).alias("__s"), F.col("__at").alias("__c")).agg(F.max_by("__local", "__place").alias("__e"))
    w = W.partitionBy("__s").orderBy("__c")
    carried = F.lit(0.0)
    for k in range(1, 8):
        carried = carried + F.coalesce(F.lag("__e", k).over(w), F.lit(0.0)) * q ** (size * (k - 1))
    ends = ends.select("__s", "__c", carried.alias("__carried"))
    rows = rows.join(ends, F.col(p.series).eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__c")))
    rows = rows.withColumn("__whole", F.col("__local") + F.col("__carried") * F.pow(F.lit(q), F.col("__place") + 1))
    return rows.withColumn(name, F.lag("__whole", 1).over(p.window())).drop("__at", "__place", "__local", "__s", "__c", "__carried", "__whole")


def indicators(covariate: str, values: list[float]) -> dict[str, Column]:
    """covariate_x_is_v: whether the covariate equals v within 1e-12; '-' is written neg and '.' p."""
    text = lambda v: f"{v:g}".replace("-", "neg").replace(".", "p")
    return {f"covariate_{covariate}_is_{text(v)}": (F.abs(F.col(covariate) - v) <= 1e-12).cast("double") for v in values}


def interactions(features: dict[str, Column], calendar: dict[str, Column]) -> dict[str, Column]:
    """Products of every feature with every calendar value."""
    return {f"{a}_x_{b}": x * y for a, x in features.items() for b, y in calendar.items()}


def rolling_median(df: DataFrame, p: Panel, size: int) -> DataFrame:
    """``df`` with the median and the median absolute deviation of the trailing window, current row included."""
    held = F.array_sort(F.collect_list(p.y).over(p.window().rowsBetween(1 - size, 0)))

    def middle(a: Column) -> Column:
        n = F.size(a)
        return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2

    df = df.withColumn("__held", held).withColumn("rolling_median", middle(F.col("__held")))
    return df.withColumn("rolling_mad", middle(F.array_sort(F.transform("__held", lambda x: F.abs(x - F.col("rolling_median")))))).drop("__held")


def rank_buckets(df: DataFrame, value: str, ident: str, buckets: int, by: str) -> DataFrame:
    """Ascending ranks (ties by id) within ``by`` cut into buckets: floor(rank * buckets / n)."""
    w = W.partitionBy(by)
    rank = F.row_number().over(w.orderBy(value, ident)) - 1
    return df.withColumn("bucket", F.least(F.floor(rank * buckets / F.count(F.lit(1)).over(w)), F.lit(buckets - 1)).cast("int"))


def extremes(df: DataFrame, value: str, ident: str, k: int, by: str) -> DataFrame:
    """The k least (side short) and k greatest (side long) rows of each group, ties by id; no row twice."""
    w = W.partitionBy(by)
    rows = df.withColumn("__up", F.row_number().over(w.orderBy(value, ident))).withColumn("__down", F.row_number().over(w.orderBy(F.desc(value), ident)))
    side = F.when(F.col("__down") <= k, "long").when(F.col("__up") <= k, "short")
    return rows.withColumn("side", side).where("side IS NOT NULL").drop("__up", "__down")


def average_rank(value: str, by: str) -> Column:
    """Ranks from 1, tied values sharing their mean."""
    w = W.partitionBy(by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(by, value)) - 1) / 2


def last_rows(df: DataFrame, p: Panel, n: int) -> DataFrame:
    """Each series' last n rows, numbered back from 1."""
    return df.withColumn("back", F.row_number().over(W.partitionBy(p.series).orderBy(F.desc(p.ts)))).where(F.col("back") <= n)
