"""Forecast, interval, classification, ranking and link metrics by grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.columns import ratio, total
from loomgrid.operators.ordered import dealt, numbered, running


def aligned(forecast: DataFrame, actual: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Forecast and actual rows joined on the keys; an error for repeated, missing or extra keys."""
    left = forecast.withColumn("__f", F.lit(1))
    right = actual.withColumn("__a", F.lit(1))
    both = left.join(right, keys, "full_outer")
    if strict:
        for side in (forecast, actual):
            if side.groupBy(*keys).count().where("count > 1").take(1):
                raise ValueError("a key repeats")
        if both.where("__f IS NULL OR __a IS NULL").take(1):
            raise ValueError("forecast and actual keys differ")
    return both.drop("__f", "__a")


def forecast_metrics(df: DataFrame, by: list[str], pred: str = "mean", actual: str = "y", naive: DataFrame | None = None) -> DataFrame:
    """One row a group: mae, rmse, bias, nrmse, wape, smape, and mase and rmsse where ``naive`` has
    (by, naive_mae, naive_mse) of the training rows."""
    p, a = F.col(pred), F.col(actual)
    e = p - a
    size = F.abs(p) + F.abs(a)
    out = df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(F.abs(a)).alias("__level"), F.sum(F.abs(e)).alias("__e"), F.sum(F.abs(a)).alias("__a"),
        F.avg(F.when(size > 0, F.abs(e) * 2 / size)).alias("smape"), F.avg(e * e).alias("__mse"),
    )
    nrmse = F.when((F.col("__level") == 0) & (F.col("rmse") == 0), 0.0).otherwise(F.col("rmse") / F.greatest("__level", F.lit(1e-12)))
    out = out.withColumns({"nrmse": nrmse, "wape": ratio(F.col("__e"), F.col("__a"), 0.0), "smape": F.coalesce("smape", F.lit(0.0))})
    if naive is not None:
        out = out.join(naive, by) if by else out.crossJoin(F.broadcast(naive))
        out = out.withColumns({"mase": ratio(F.col("mae"), F.col("naive_mae")), "rmsse": F.sqrt(ratio(F.col("__mse"), F.col("naive_mse")))}).drop("naive_mae", "naive_mse")
    return out.drop("__level", "__e", "__a", "__mse")


def naive_scale(df: DataFrame, series: str, ts: str, y: str, season: int, by: list[str]) -> DataFrame:
    """(by, naive_mae, naive_mse): the seasonal difference's mean absolute and squared size over training rows."""
    d = F.col(y) - F.lag(y, season).over(W.partitionBy(series).orderBy(ts))
    return df.withColumn("__d", d).groupBy(*by).agg(F.avg(F.abs("__d")).alias("naive_mae"), F.avg(F.col("__d") * F.col("__d")).alias("naive_mse"))


def intermittent_loss(pred, actual) -> Column:
    """Sum of absolute errors over the actual sum; the predictions' absolute sum where that is 0."""
    return F.when(F.sum(F.abs(actual)) != 0, F.sum(F.abs(F.col(pred) - F.col(actual))) / F.sum(F.abs(actual))).otherwise(F.sum(F.abs(pred)))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.when(y >= q, (y - q) * level).otherwise((q - y) * (1 - level))


def repaired(quantiles: list[str]) -> list[Column]:
    """Quantile columns made non-decreasing by the running maximum from the left."""
    return [F.col(quantiles[0])] + [F.greatest(*quantiles[: k + 1]) for k in range(1, len(quantiles))]


def crossing(quantiles: list[str]) -> Column:
    """Whether any quantile is below the one to its left."""
    out = F.lit(False)
    for a, b in zip(quantiles, quantiles[1:], strict=False):
        out = out | (F.col(b) < F.col(a))
    return out


def interval_metrics(df: DataFrame, by: list[str], y: str, levels: dict[float, str], alpha: float) -> DataFrame:
    """Per group: coverage and width of the central 1 - alpha interval, pinball, CRPS (mean of 2 pinball), WIS and crossing rate.

    ``levels`` maps quantile levels to columns and has alpha/2, 0.5 and 1 - alpha/2.
    """
    t = F.col(y)
    names = [levels[k] for k in sorted(levels)]
    at = lambda q: F.col(levels[min(levels, key=lambda k: abs(k - q))])
    low, high, mid = at(alpha / 2), at(1 - alpha / 2), at(0.5)
    pins = total([pinball(t, F.col(c), k) for k, c in sorted(levels.items())]) / len(levels)
    score = (high - low) + F.greatest(low - t, F.lit(0.0)) * (2 / alpha) + F.greatest(t - high, F.lit(0.0)) * (2 / alpha)
    wis = (F.abs(t - mid) * 0.5 + score * (alpha / 2)) / 1.5
    inside = t.between(low, high).cast("double")
    return df.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(high - low).alias("width"), F.avg(pins).alias("pinball"), F.avg(pins * 2).alias("crps"), F.avg(wis).alias("wis"), F.avg(crossing(names).cast("double")).alias("crossing_rate"))


def pit_level(y: str, levels: dict[float, str]) -> Column:
    """The last level whose quantile the value reaches; 0 where it reaches none."""
    out = F.lit(0.0)
    for k, c in sorted(levels.items()):
        out = F.when(F.col(y) >= F.col(c), float(k)).otherwise(out)
    return out


def rps(probabilities: list[str], outcome: str) -> Column:
    """Ranked probability score of class probabilities against the outcome's index."""
    n, cum, out = len(probabilities), F.lit(0.0), F.lit(0.0)
    for k, c in enumerate(probabilities):
        cum = cum + F.col(c)
        d = cum - F.when(F.col(outcome) <= k, 1.0).otherwise(0.0)
        out = out + d * d
    return out / (n - 1)


def binary_metrics(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """One row: n, positives, log_loss, brier."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    t = F.col(y).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"))


def _by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(p).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row (auc): average-rank AUC; null for a single class.  Ordering is over distinct scores, in buckets."""
    cum = running(_by_score(df, y, p), "score", {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return cum.agg(ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def pr_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row (ap): average precision over distinct scores, from the highest."""
    cum = running(_by_score(df, y, p), "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    return cum.agg(ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("ap"))


def calibration_buckets(df: DataFrame, y: str, p: str, buckets: int) -> DataFrame:
    """(bucket, n, mean_p, rate, gap) of equal-width buckets; p = 1 is in the last."""
    b = F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)).cast("int")
    out = df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def ece(df: DataFrame, y: str, p: str, buckets: int) -> DataFrame:
    return calibration_buckets(df, y, p, buckets).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def _ranked(df: DataFrame, group: str, rel: str, score: str, ident: str) -> DataFrame:
    w = W.partitionBy(group)
    return dealt(df, group).withColumn("pos", F.row_number().over(w.orderBy(F.desc(score), ident))).withColumn("ideal", F.row_number().over(w.orderBy(F.desc(rel), ident)))


def ranking_metrics(df: DataFrame, group: str, rel: str, score: str, ident: str, k: int) -> DataFrame:
    """One row: NDCG@k, MAP and MRR as means over all groups; groups without a relevant row count as 0."""
    rows = _ranked(df, group, rel, score, ident)
    hit = F.col(rel) > 0
    rows = rows.withColumn("hits", F.sum(hit.cast("long")).over(W.partitionBy(group).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    gain = F.pow(F.lit(2.0), F.greatest(F.col(rel), F.lit(0))) - 1
    at = lambda pos: F.when(F.col(pos) <= k, gain / F.log2(F.col(pos) + 1)).otherwise(0.0)
    groups = rows.groupBy(group).agg(F.sum(at("pos")).alias("dcg"), F.sum(at("ideal")).alias("best"), F.coalesce(F.avg(F.when(hit, F.col("hits") / F.col("pos"))), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.min(F.when(hit, F.col("pos"))), F.lit(0.0)).alias("rr"))
    return groups.agg(F.avg(ratio(F.col("dcg"), F.col("best"), 0.0)).alias("ndcg"), F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("groups"))


def link_metrics(df: DataFrame, group: str, positive: str, score: str, ident: str, k: int) -> DataFrame:
    """One row: recall@k, hit@k and MRR as means over the groups that have a positive."""
    rows = dealt(df, group).withColumn("pos", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), ident)))
    hit = F.col(positive) > 0
    groups = rows.groupBy(group).agg(F.sum(hit.cast("long")).alias("n"), F.sum((hit & (F.col("pos") <= k)).cast("long")).alias("top"), F.min(F.when(hit, F.col("pos"))).alias("first")).where("n > 0")
    return groups.agg(F.avg(F.col("top") / F.col("n")).alias("recall"), F.avg((F.col("top") > 0).cast("double")).alias("hit"), F.avg(1 / F.col("first")).alias("mrr"), F.count(F.lit(1)).alias("groups"))


def confusion(df: DataFrame, actual: str, predicted: str, buckets: int) -> DataFrame:
    """(actual, predicted, n, p): counts with a prior of 1 a cell, normalised by row."""
    grid = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(actual)).crossJoin(df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(predicted)))
    counts = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    cells = grid.join(F.broadcast(counts), [actual, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.withColumn("p", (F.col("n") + 1) / F.sum(F.col("n") + 1).over(W.partitionBy(actual)))


def portfolio_summary(df: DataFrame, by: list[str], weight: str, ret: str) -> DataFrame:
    """Counts, exposures and returns of long (positive) and short (negative) weights."""
    w, g = F.col(weight), F.col(weight) * F.col(ret)
    some = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.sum((w > 0).cast("long")).alias("longs"), F.sum((w < 0).cast("long")).alias("shorts"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"),
        some(w > 0, g).alias("long_return"), some(w < 0, g).alias("short_return"), F.sum(g).alias("net_return"),
    )


def fold_means(df: DataFrame, names: list[str]) -> DataFrame:
    """The mean of each metric over folds (not of pooled errors)."""
    return df.agg(*[F.avg(c).alias(c) for c in names])


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, level: float) -> DataFrame:
    """(by, quantile): the least value at which the running weight reaches level of the group's weight."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    cum = sums.withColumn("c", F.sum("w").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("t", F.sum("w").over(W.partitionBy(*by)))
    return cum.where(F.col("c") >= level * F.col("t") - 1e-9).groupBy(*by).agg(F.min(value).alias("quantile"))


def competition(df: DataFrame, by: list[str], metric_cols: tuple[str, str] = ("smape", "mase"), model: str = "model", baseline: str = "naive") -> DataFrame:
    """(by, model, relative values, owa): each metric over the baseline's, and the mean of both."""
    base = df.where(F.col(model) == baseline).select(*by, *[F.col(c).alias(f"__{c}") for c in metric_cols])
    out = df.join(base, by)
    rel = [ratio(F.col(c), F.col(f"__{c}")) for c in metric_cols]
    return out.select(*by, model, *[x.alias(f"relative_{c}") for x, c in zip(rel, metric_cols, strict=True)], (total(rel) / len(rel)).alias("owa"))


def equal_level(df: DataFrame, level: str, score: str, weight: str) -> DataFrame:
    """One row: the mean over levels of the weighted mean score (weights scaled to 1 within a level)."""
    return df.groupBy(level).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("s")).agg(F.avg("s").alias("score"))


def event_labels(df: DataFrame, by: str, at: str, value: str, threshold: float, horizon: int) -> DataFrame:
    """``df`` with ``hit`` (value at least the threshold) and ``within`` (a hit among the next ``horizon`` rows)."""
    w = W.partitionBy(by).orderBy(at)
    hit = (F.col(value) >= threshold).cast("int")
    return df.withColumn("hit", hit).withColumn("within", F.coalesce(F.max(hit).over(w.rowsBetween(1, horizon)), F.lit(0)))


def jitter(df: DataFrame, ident: str, prediction: str) -> DataFrame:
    """One row: the mean over samples of their predictions' population deviation."""
    return df.groupBy(ident).agg(F.stddev_pop(prediction).alias("s")).agg(F.avg("s").alias("volatility"))


def laplacian_penalty(edges: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """One row: half the sum of w (difference)^2 over the stored directed edges."""
    a = values.select(F.col(node).alias("src"), F.col(value).alias("__a"))
    b = values.select(F.col(node).alias("dst"), F.col(value).alias("__b"))
    d = F.col("__a") - F.col("__b")
    return edges.join(a, "src").join(b, "dst").agg((F.sum(F.col("w") * d * d) / 2).alias("penalty"))


def rank_calibration(df: DataFrame, actual: str, predicted: str, buckets: int) -> DataFrame:
    """(predicted, actual, n, p, shrinkage, calibrated): how often each bucket follows a predicted one, with a prior of
    1 a cell, and that drawn towards even chances by rows / (rows + 20 buckets)."""
    counts = df.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))
    if counts.where(~F.col("predicted").between(0, buckets - 1) | ~F.col("actual").between(0, buckets - 1)).take(1):
        raise ValueError("a bucket is out of range")
    one = lambda name: df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(name))
    cells = one("predicted").crossJoin(one("actual")).join(counts, ["predicted", "actual"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # ``cells`` has buckets x buckets rows.
    p = (F.col("n") + 1) / F.sum(F.col("n") + 1).over(W.partitionBy("predicted"))
    support = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__n"))
    rows = cells.withColumn("p", p).crossJoin(F.broadcast(support)).withColumn("shrinkage", F.col("__n") / (F.col("__n") + 20.0 * buckets)).drop("__n")
    return rows.withColumn("calibrated", F.col("shrinkage") * F.col("p") + (1 - F.col("shrinkage")) / buckets)


def hit_rates(df: DataFrame, observed: str, predicted: str, buckets: int) -> DataFrame:
    """One row: rows, shares of exact and neighbouring buckets, and the number and hits of predicted first and last ones."""
    gap = F.abs(F.col(observed) - F.col(predicted))
    extreme = F.col(predicted).isin(0, buckets - 1)
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("assets"), share(gap == 0).alias("exact"), share(gap <= 1).alias("within_one"),
        F.count(F.when(extreme, 1)).alias("extremes"), F.coalesce(F.avg(F.when(extreme, (gap == 0).cast("double"))), F.lit(0.0)).alias("extreme_rate"),
    )


def scored_assets(df: DataFrame, ident: str, actual: str, predicted: str, buckets: int, calibration: DataFrame) -> DataFrame:
    """``df`` with (observed_bucket, predicted_bucket, rps): buckets are ranks (ties by id) cut evenly over all rows, and
    the score is that of the calibrated chances of the predicted bucket.  Ranks are made without a single-task window."""
    n = df.count()
    cut = lambda rows, by, name: numbered(rows, by, (ident,), "__i").withColumn(name, F.least(F.floor(F.col("__i") * buckets / n), F.lit(buckets - 1)).cast("int")).drop("__i")
    rows = cut(cut(df, actual, "observed_bucket"), predicted, "predicted_bucket")
    chances = calibration.groupBy("predicted").agg(F.transform(F.array_sort(F.collect_list(F.struct("actual", "calibrated"))), lambda s: s["calibrated"]).alias("__p"))
    rows = rows.join(F.broadcast(chances), F.col("predicted_bucket") == F.col("predicted")).drop("predicted")  # a row a bucket
    score, cum = F.lit(0.0), F.lit(0.0)
    for k in range(buckets):
        cum = cum + F.col("__p")[k]
        d = cum - F.when(F.col("observed_bucket") <= k, 1.0).otherwise(0.0)
        score = score + d * d
    return rows.withColumn("rps", score / max(1, buckets - 1)).drop("__p")


def portfolio_loss(df: DataFrame, ident: str, actual: str, predicted: str, buckets: int, calibration: DataFrame, tiebreak: float) -> DataFrame:
    """One row (net_return, mean_rps, loss): the fifth of lowest predictions sold and the fifth of highest ones bought, half
    of the money on each side; the loss is the return's negative plus ``tiebreak`` times the mean score."""
    rows = scored_assets(df, ident, actual, predicted, buckets, calibration)
    n = rows.count()
    side = max(1, n // 5)
    placed = numbered(rows, predicted, (ident,), "__i")
    weight = F.when(F.col("__i") < side, -0.5 / side).otherwise(0.0) + F.when(F.col("__i") >= n - side, 0.5 / side).otherwise(0.0)
    out = placed.agg(F.sum(weight * F.col(actual)).alias("net_return"), F.avg("rps").alias("mean_rps"))
    return out.withColumn("loss", -F.col("net_return") + F.col("mean_rps") * tiebreak)


def link_scores(df: DataFrame, positive: str, score: str, ident: str) -> DataFrame:
    """One row (auc, ap) over all rows: ties count half in the AUC; the average precision goes by score, then id.  0 without
    both classes, or without a positive."""
    rows = df.withColumn("__p", (F.col(positive) > 0.5).cast("long"))
    auc = roc_auc(rows, "__p", score)
    ranked = running(rows.select(F.col(score).cast("double").alias("s"), F.col(ident).alias("i"), "__p"), "s", {"tp": F.col("__p"), "at": F.lit(1).cast("long")}, ("i",), descending=True)
    ap = ranked.agg(ratio(F.sum(F.when(F.col("__p") == 1, F.col("tp") / F.col("at"))), F.sum("__p"), 0.0).alias("ap"))
    return auc.crossJoin(ap).select(F.coalesce("auc", F.lit(0.0)).alias("auc"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def spatial_cv_gap(random_scores: DataFrame, spatial_scores: DataFrame, score: str = "score") -> DataFrame:
    """One row (gap): the mean score over random folds less that over spatial ones."""
    return random_scores.agg(F.avg(score).alias("a")).crossJoin(spatial_scores.agg(F.avg(score).alias("b"))).select((F.col("a") - F.col("b")).alias("gap"))


def jitter_around(df: DataFrame, ident: str, prediction: str, baseline: str, weight: str | None = None) -> DataFrame:
    """One row: the (weighted) mean over samples of the root mean square of their predictions' distance to the baseline."""
    w = F.max(weight) if weight else F.lit(1.0)
    d = F.col(prediction) - F.col(baseline)
    rows = df.groupBy(ident).agg(F.sqrt(F.avg(d * d)).alias("s"), w.alias("w"))
    return rows.agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("volatility"))
