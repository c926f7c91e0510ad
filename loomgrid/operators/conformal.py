"""Conformal intervals and calibration maps."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.operators.joins import nearest, nearest_any
from loomgrid.operators.metrics import weighted_quantile
from loomgrid.operators.ordered import bucket_of, running
from loomgrid.sources.shared import Tables


def split_radius(calibration: DataFrame, by: list[str], residual: Column, alpha: float, clamp: bool = False) -> DataFrame:
    """(by, n, radius): the ceil((n + 1)(1 - alpha))-th smallest absolute residual; null, or the largest with
    ``clamp``, where there are too few.

    Residuals are counted by value first, so what is ordered are the distinct ones of a group; without groups they are
    ordered in ranges.
    """
    rows = calibration.select(*by, F.abs(residual).alias("__r")).groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    if by:
        w = W.partitionBy(*by)
        rows = rows.withColumn("__upto", F.sum("__n").over(w.orderBy("__r").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("__n").over(w))
    else:
        whole = rows.agg(F.sum("__n").alias("n"))
        rows = running(rows, "__r", {"__upto": F.col("__n")}).crossJoin(F.broadcast(whole))  # one row
    k = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    out = rows.groupBy(*by).agg(F.max("n").alias("n"), F.min(F.when(F.col("__upto") >= k, F.col("__r"))).alias("radius"), F.max("__r").alias("__top"))
    return out.withColumn("radius", F.coalesce("radius", "__top") if clamp else F.col("radius")).drop("__top")


def intervals(test: DataFrame, radius: DataFrame, by: list[str], pred: str) -> DataFrame:
    out = test.join(radius, by) if by else test.crossJoin(F.broadcast(radius))
    return out.withColumn("lower", F.col(pred) - F.col("radius")).withColumn("upper", F.col(pred) + F.col("radius"))


def weighted_radius(calibration: DataFrame, by: list[str], residual: Column, weight: str, alpha: float) -> DataFrame:
    """(by, quantile): the first absolute residual with (1 - alpha) of the weight."""
    return weighted_quantile(calibration.withColumn("__r", F.abs(residual)), by, "__r", weight, 1 - alpha)


def nearest_radius(test: DataFrame, calibration: DataFrame, ident: str, residual: str, k: int, distance: float | None, alpha: float) -> DataFrame:
    """(ident, radius): as ``split_radius``, clamped, over the k nearest calibration points, within a distance or any."""
    near = nearest_any(test, calibration, ident, k) if distance is None else nearest(test, calibration, ident, k, distance)
    return split_radius(near, [ident], F.col(f"r_{residual}"), alpha, clamp=True).select(ident, "radius")


def rolling_radius(df: DataFrame, by: list[str], at: str, residual: Column, alpha: float, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, by, radius): ``split_radius`` over the rows up to each cutoff."""
    rows = df.withColumn("__res", residual).join(F.broadcast(cutoffs), F.col(at) <= F.col("cutoff"))
    return split_radius(rows, ["cutoff", *by], F.col("__res"), alpha, clamp=True).drop("n")


def check_split_order(train_end, cal_start, cal_end, test_start) -> None:
    """0 < train_end <= cal_start < cal_end <= test_start."""
    if not 0 < train_end <= cal_start < cal_end <= test_start:
        raise ValueError("training, calibration and test overlap")


def report(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by, n, coverage, width) of intervals with lower and upper."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"))


def _pool(blocks: list[list[float]]) -> list[list[float]]:
    """Adjacent violators pooled: blocks (largest score, sum, count) with rising means."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            top, s, n = out.pop()
            out[-1] = [top, out[-1][1] + s, out[-1][2] + n]
    return out


def isotonic(df: DataFrame, score: str, y: str, rows_a_range: int = 50_000) -> DataFrame:
    """(upto, rate): the blocks of isotonic regression, each with its largest score and mean, rising.

    Distinct scores are counted, and pooled within ranges of the score; the ranges' blocks are pooled again over twice as
    wide ranges, until one range is left.  Pooling in parts gives the same blocks as pooling at once.  Of noisy labels few
    blocks are left early on; a rate that rises by itself at every score keeps a block a distinct score, and these meet in
    the last range's task.
    """
    rows = df.groupBy(F.col(score).cast("double").alias("upto")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n")).where("upto IS NOT NULL")

    def run(part):
        import pandas as pd

        part = part.sort_values("upto")
        made = _pool(part[["upto", "s", "n"]].values.tolist())
        return pd.DataFrame(made, columns=["upto", "s", "n"]).assign(b=int(part["b"].iloc[0]) // 2)

    ranges = 1 << max(0, (max(1, rows.count()) // rows_a_range).bit_length())
    rows = rows.withColumn("b", bucket_of(rows, "upto", ranges).cast("int") if ranges > 1 else F.lit(0))
    while True:
        rows = rows.groupBy("b").applyInPandas(run, "upto double, s double, n double, b int")
        if ranges == 1:
            return rows.select("upto", (F.col("s") / F.col("n")).alias("rate"))
        ranges //= 2


def platt(df: DataFrame, score: str, y: str, rounds: int = 64) -> tuple[float, float]:
    """(a, b) of sigmoid(a score + b) by Newton steps; every step is one aggregation of five sums."""
    a, b = 0.0, 0.0
    tables = Tables(df.sparkSession, "platt")
    rows = tables.save(df.groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n")))
    try:
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.col("x") * a + b)))
            h = F.col("n") * p * (1 - p)
            g = F.col("s") - F.col("n") * p
            ga, gb, haa, hab, hbb = rows.agg(F.sum(g * F.col("x")), F.sum(g), F.sum(h * F.col("x") * F.col("x")), F.sum(h * F.col("x")), F.sum(h)).first()
            haa, hbb = haa + 1e-9, hbb + 1e-9
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a + da, b + db
            if max(abs(da), abs(db)) < 1e-10:
                break
    finally:
        tables.close()
    return a, b


def temperature(df: DataFrame, logit: str, y: str, rounds: int = 80) -> float:
    """The temperature t of sigmoid(logit / t) with the greatest likelihood, by Newton steps on 1 / t."""
    k = 1.0
    x, t = F.col(logit), F.col(y).cast("double")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-x * k))
        g, h = df.agg(F.sum((t - p) * x), F.sum(p * (1 - p) * x * x)).first()
        step = g / (h + 1e-12)
        k = max(1e-3, k + step)
        if abs(step) < 1e-10:
            break
    return 1 / k


def rank_needed(n: int, alpha: float) -> int:
    """The rank of the residual that ``split_radius`` takes; an error where it exceeds n."""
    k = ceil(round((n + 1) * (1 - alpha), 9))
    if k > n:
        raise ValueError("too few calibration rows")
    return k
