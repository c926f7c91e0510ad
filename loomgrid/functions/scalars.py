"""Links, transforms and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import col, total


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def softmax(scores: list, temperature: float = 1.0) -> list[Column]:
    s = [col(x) / temperature for x in scores]
    top = F.greatest(*s)
    e = [F.exp(x - top) for x in s]
    return [x / total(e) for x in e]


def damped_multiplier(phi: float, h) -> Column:
    """The sum of phi^1..phi^h; h itself for phi = 1."""
    return col(h).cast("double") if phi == 1 else (1 - F.pow(F.lit(phi), col(h))) * (phi / (1 - phi))


def local_scale(df, series: str, y: str, floor: float = 1e-9):
    """``df`` with mean, deviation (population, at least ``floor``) and the scaled value of each series."""
    w = W.partitionBy(series)
    out = df.withColumn("scale_mean", F.avg(y).over(w)).withColumn("scale_std", F.greatest(F.stddev_pop(y).over(w), F.lit(floor)))
    return out.withColumn("scaled", (F.col(y) - F.col("scale_mean")) / F.col("scale_std"))


def unscale(z, mean, std) -> Column:
    return col(z) * col(std) + col(mean)


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def half_even(x, places: int, tolerance: float = 1e-12) -> Column:
    """Rounded half to even; values within the tolerance of a tie, after scaling, are ties."""
    s = col(x) * float(10**places)
    low = F.floor(s)
    tie = F.abs(s - low - 0.5) <= tolerance
    return F.when(tie, low + F.pmod(low, F.lit(2))).otherwise(F.floor(s + 0.5)) / float(10**places)
