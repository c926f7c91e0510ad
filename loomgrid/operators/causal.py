"""Panel effects of treated units: (unit, time, outcome) rows and treated units; times compare as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.geometry import EARTH_KM_CAUSAL, haversine


def _mean(cond: Column, y: str) -> Column:
    return F.avg(F.when(cond, F.col(y)))


def period_means(df: DataFrame, treated: Column, post: Column, y: str) -> DataFrame:
    """One row: mean outcomes of treated and control units before and after."""
    return df.agg(
        _mean(treated & ~post, y).alias("treated_pre"), _mean(treated & post, y).alias("treated_post"),
        _mean(~treated & ~post, y).alias("control_pre"), _mean(~treated & post, y).alias("control_post"),
    )


def did(df: DataFrame, treated: Column, post: Column, y: str) -> DataFrame:
    """The means and the difference in differences."""
    effect = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    return period_means(df, treated, post, y).withColumn("effect", effect)


def matched_weights(df: DataFrame, unit: str, treated: Column, post: Column, y: str) -> DataFrame:
    """(unit, weight): controls by the inverse of the gap of their mean before to the treated one (plus 1e-6)."""
    target = df.agg(_mean(treated & ~post, y).alias("__t"))
    pre = df.where(~treated & ~post).groupBy(unit).agg(F.avg(y).alias("__m")).crossJoin(F.broadcast(target))
    pre = pre.withColumn("__w", 1 / (F.abs(F.col("__m") - F.col("__t")) + 1e-6))
    return pre.crossJoin(F.broadcast(pre.agg(F.sum("__w").alias("__s")))).select(unit, (F.col("__w") / F.col("__s")).alias("weight"))


def matched_did(df: DataFrame, unit: str, treated: Column, post: Column, y: str) -> DataFrame:
    """One row (effect): the treated change less the weighted controls' change."""
    w = matched_weights(df, unit, treated, post, y)
    change = lambda rows, *by: rows.groupBy(*by).agg(_mean(post, y).alias("__post"), _mean(~post, y).alias("__pre"))
    control = change(df.where(~treated), unit).join(w, unit).agg(F.sum((F.col("__post") - F.col("__pre")) * F.col("weight")).alias("c"))
    own = change(df.where(treated)).select((F.col("__post") - F.col("__pre")).alias("t"))
    return own.crossJoin(control).select((F.col("t") - F.col("c")).alias("effect"))


def placebo(df: DataFrame, unit: str, treated: Column, post: Column, y: str, picks: int, seed: str = "placebo") -> DataFrame:
    """(unit, effect): each of ``picks`` controls, by least hash, taken as treated against the other controls."""
    means = df.where(~treated).groupBy(unit).agg(_mean(post, y).alias("post"), _mean(~post, y).alias("pre"), F.count(F.when(post, 1)).alias("n1"), F.count(F.when(~post, 1)).alias("n0"))
    sums = means.agg(*[F.sum(F.col(c) * F.col(n)).alias(f"s_{c}") for c, n in (("post", "n1"), ("pre", "n0"))], F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    picked = means.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(unit).cast("string")))).orderBy("__h").limit(picks)
    rest = lambda c, n, s: (F.col(f"s_{c}") - F.col(c) * F.col(n)) / (F.col(s) - F.col(n))
    effect = (F.col("post") - F.col("pre")) - (rest("post", "n1", "s1") - rest("pre", "n0", "s0"))
    return picked.crossJoin(F.broadcast(sums)).select(unit, effect.alias("effect"))


def detectable_lift(effects: DataFrame, base: float) -> DataFrame:
    """One row: 1.96 standard deviations of placebo effects over the mean before."""
    return effects.agg((F.stddev_pop("effect") * 1.96 / abs(base)).alias("lift"))


def design(df: DataFrame, unit: str, treated: Column, post: Column, y: str, exposure: DataFrame, k: int) -> DataFrame:
    """The k candidate controls of closest mean before, then least exposure, then id; ``exposure`` is (unit, exposure)."""
    target = df.agg(_mean(treated & ~post, y).alias("__t"))
    pre = df.where(~treated & ~post).groupBy(unit).agg(F.avg(y).alias("__m")).crossJoin(F.broadcast(target))
    gap = F.abs(F.col("__m") - F.col("__t"))
    rows = pre.join(exposure, unit, "left").select(unit, F.round(gap, 9).alias("gap"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"))
    best = rows.orderBy("gap", "exposure", unit).limit(k)  # k rows
    return best.withColumn("rank", F.row_number().over(W.orderBy("gap", "exposure", unit)))


def exposures(edges: DataFrame, treated: DataFrame) -> DataFrame:
    """(node, exposure): each untreated node's edge weight to treated ones; ``treated`` has (node)."""
    t = treated.select(F.col("node").alias("__t"))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "w").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "w"))
    rows = both.join(t, F.col("other") == F.col("__t"), "left_semi").join(t, F.col("node") == F.col("__t"), "left_anti")
    return rows.groupBy("node").agg(F.sum("w").alias("exposure"))


def treated_control_distance(units: DataFrame, ident: str, most: int = 10_000) -> DataFrame:
    """One row: least and mean great-circle distance in km of treated and control units (lat, lng, treated).

    The mean is over all pairs of places, each counted as often as it has units, so the work grows with the treated places
    times the control places.  More than ``most`` treated places are not sent to every task, but meet the controls in
    pairs of parts.  Pairs are summed where they are made.
    """
    places = lambda rows, n: rows.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("lat", "lng").agg(F.count(F.lit(1)).cast("double").alias(n))
    t = places(units.where("treated"), "m").withColumnsRenamed({"lat": "a", "lng": "b"})
    u = places(units.where("NOT treated"), "n")
    pairs = u.crossJoin(F.broadcast(t)) if t.limit(most + 1).count() <= most else u.hint("shuffle_replicate_nl").crossJoin(t)
    d = haversine("lat", "lng", "a", "b", EARTH_KM_CAUSAL)
    pairs = pairs.select(d.alias("d"), (F.col("n") * F.col("m")).alias("w"))
    return pairs.agg(F.min("d").alias("min_km"), (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("mean_km"))


def centred(df: DataFrame, region: str, columns: list[str]) -> DataFrame:
    """Columns less their region's mean plus the overall mean."""
    w = df.groupBy(F.col(region).alias("__r")).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    g = df.agg(*[F.avg(c).alias(f"__g_{c}") for c in columns])
    out = df.join(w, F.col(region) == F.col("__r")).crossJoin(F.broadcast(g))
    out = out.withColumns({c: F.col(c) - F.col(f"__{c}") + F.col(f"__g_{c}") for c in columns})
    return out.select(*df.columns)


def representation_report(df: DataFrame, region: str, features: list[str], y: str, heldout: str, ridge: float = 1.0) -> DataFrame:
    """One row (raw_rmse, invariant_rmse, improvement, training_loss, domain_loss, risk_penalty, variation): a ridge regression
    on all regions but one, judged on that one, from the features as they are and less their region's means.

    domain_loss is the mean distance between two regions' mean features, variation the mean absolute step between a row's
    neighbouring features; both of the features less their regions' means.
    """
    moved = centred(df, region, features)
    out = []
    for rows in (df, moved):
        train, test = rows.where(F.col(region) != heldout), rows.where(F.col(region) == heldout)
        beta = ridge_fit(train, features, y, ridge)
        fit = F.lit(beta[0])
        for b, c in zip(beta[1:], features, strict=True):
            fit = fit + F.col(c) * b
        mse = lambda d, fit=fit: float(d.agg(F.avg(F.pow(F.col(y) - fit, F.lit(2.0)))).first()[0] or 0.0)
        out += [mse(test) ** 0.5, mse(train)]
    raw, _, invariant, loss = out
    means = moved.groupBy(region).agg(*[F.avg(c).alias(c) for c in features])  # a row a region
    other = means.select(F.col(region).alias("__r"), *[F.col(c).alias(f"__{c}") for c in features])
    gap = F.sqrt(sum((F.pow(F.col(c) - F.col(f"__{c}"), F.lit(2.0)) for c in features), F.lit(0.0)))
    domain = means.join(other, F.col(region) < F.col("__r")).agg(F.avg(gap)).first()[0] or 0.0
    steps = [F.abs(F.col(b) - F.col(a)) for a, b in zip(features, features[1:], strict=False)]
    variation = moved.agg(F.avg(sum(steps[1:], steps[0]) / len(steps))).first()[0] if steps else 0.0
    row = (raw, invariant, raw - invariant, loss, float(domain), abs(raw - invariant), float(variation))
    return df.sparkSession.createDataFrame([row], "raw_rmse double, invariant_rmse double, improvement double, training_loss double, domain_loss double, risk_penalty double, variation double")


def ridge_fit(df: DataFrame, features: list[str], y: str, ridge: float) -> list[float]:
    """[intercept, coefficients] with a penalty on all but the intercept, from one aggregation."""
    import numpy as np

    from loomgrid.operators.spatial import normal_equations

    xtx, xty, _, _ = normal_equations(df, features, y)
    penalty = np.diag([0.0] + [ridge] * len(features))
    return [float(b) for b in np.linalg.solve(xtx + penalty, xty)]
