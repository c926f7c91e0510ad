"""Fold generators: (fold_id, key, role) rows, with role train or test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.operators.joins import within
from loomgrid.operators.ordered import by_order, numbered


def cutoffs(n: int, horizon: int, step: int, min_train: int, n_splits: int | None = None) -> list[int]:
    """Indexes of each fold's last training time: from min_train - 1 on while the horizon fits; the last n_splits."""
    found = list(range(min_train - 1, n - horizon, step))
    return found[-n_splits:] if n_splits else found


#: Origins tried by validation profile, fixed values; other profiles have 2.
PROFILE_ORIGINS = {None: 3, "rank_portfolio": 3, "classical_competition": 3, "classical_competition_full": 3}


def candidate_cutoffs(n: int, horizon: int, profile: str | None = None) -> list[int]:
    """First test indexes n - k * horizon, rising, for the profile's k, where at least max(horizon, 14) rows are left to train on."""
    if horizon < 1:
        raise ValueError("the horizon is positive")
    found = [n - k * horizon for k in range(PROFILE_ORIGINS.get(profile, 2), 0, -1)]
    return [c for c in found if c >= max(horizon, 14)] if n > horizon + 2 else []


def candidate_folds(df: DataFrame, ts: str, horizon: int, profile: str | None = None) -> DataFrame:
    """(fold_id, ts, role) of the candidate schedule over the panel's distinct times."""
    times = df.select(ts).distinct()
    n = times.count()
    return _fold_rows(times, ts, [(f"fold_{k:04d}", c - 1) for k, c in enumerate(candidate_cutoffs(n, horizon, profile))], horizon, n)


def _fold_rows(times: DataFrame, ts: str, folds: list[tuple[str, int]], horizon: int, width: int) -> DataFrame:
    """Roles by the times' places: training up to the cutoff, at most ``width`` of them, then ``horizon`` tests."""
    spec = times.sparkSession.createDataFrame(folds, "fold_id string, c long")  # a row a fold
    at = times.withColumn("__t", F.col(ts).cast("timestamp").cast("double"))
    rows = numbered(at, "__t").drop("__t").crossJoin(F.broadcast(spec))
    role = F.when((F.col("i") <= F.col("c")) & (F.col("i") > F.col("c") - width), "train").when((F.col("i") > F.col("c")) & (F.col("i") <= F.col("c") + horizon), "test")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("fold_id", ts, "role")


def rolling_origin(df: DataFrame, ts: str, horizon: int, step: int, min_train: int, n_splits: int | None = None, max_train: int | None = None) -> DataFrame:
    """(fold_id, ts, role) over the panel's distinct times; a sliding window keeps the last max_train of them."""
    times = df.select(ts).distinct()
    n = times.count()
    folds = [(f"fold_{k:04d}", c) for k, c in enumerate(cutoffs(n, horizon, step, min_train, n_splits))]
    return _fold_rows(times, ts, folds, horizon, max_train or n)


def panel_rolling_origin(df: DataFrame, series: str, ts: str, horizon: int, step: int, min_train: int) -> DataFrame:
    """(fold_id, series, ts, role) by each series' row order, as far as the shortest series allows."""
    shortest = df.groupBy(series).count().agg(F.min("count")).first()[0]
    folds = [(f"fold_{k:04d}", c) for k, c in enumerate(cutoffs(shortest, horizon, step, min_train))]
    origins = df.sparkSession.createDataFrame(folds, "fold_id string, c long")
    rows = df.select(series, ts, (F.row_number().over(W.partitionBy(series).orderBy(ts)) - 1).alias("i")).crossJoin(F.broadcast(origins))
    role = F.when(F.col("i") <= F.col("c"), "train").when(F.col("i") <= F.col("c") + horizon, "test")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("fold_id", series, ts, "role")


def spatial_blocks(df: DataFrame, ident: str, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """(ident, fold): k contiguous slices of the rows by x, y, id; slice f starts at floor(f n / k)."""
    n = df.count()
    rows = numbered(df.select(ident, x, y), x, (y, ident))
    starts = [f * n // k for f in range(1, k)]
    fold = F.lit(0)
    for s in starts:
        fold = fold + (F.col("i") >= s).cast("int")
    return rows.select(ident, fold.alias("fold"))


def grid_blocks(df: DataFrame, ident: str, k: int, x: str = "x", y: str = "y") -> DataFrame:
    """(ident, fold): cells of a grid of ceil(sqrt k) columns over the bounding box; ordered slices of the wider
    axis where fewer than k cells are occupied."""
    cols = math.ceil(math.sqrt(k))
    rows = math.ceil(k / cols)
    lo_x, hi_x, lo_y, hi_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    at = lambda v, lo, hi, n: F.least(F.floor((F.col(v) - lo) / ((hi - lo) or 1.0) * n), F.lit(n - 1))
    cell = (at(y, lo_y, hi_y, rows) * cols + at(x, lo_x, hi_x, cols)) % k
    out = df.select(ident, cell.cast("int").alias("fold"))
    if out.select("fold").distinct().count() >= k:
        return out
    wide, other = (x, y) if hi_x - lo_x >= hi_y - lo_y else (y, x)
    return spatial_blocks(df, ident, k, wide, other)


def folds_of(assigned: DataFrame, ident: str, k: int) -> DataFrame:
    """(fold_id, ident, role) from (ident, fold): each fold tests its own rows and trains on the others."""
    ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("__f"))
    rows = assigned.crossJoin(F.broadcast(ids))
    return rows.select(F.format_string("fold_%04d", F.col("__f")).alias("fold_id"), ident, F.when(F.col("fold") == F.col("__f"), "test").otherwise("train").alias("role"))


def buffered(df: DataFrame, assigned: DataFrame, ident: str, k: int, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Folds whose training rows within ``radius`` of any test row are dropped."""
    placed = df.select(ident, x, y).join(assigned, ident)
    spots = placed.select("fold", x, y).distinct()
    near = within(spots, spots, radius, x, y).where("fold <> r_fold").select(F.col("r_fold").alias("__r"), F.col("fold").alias("__f"), F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    near = placed.join(near, (F.col("fold") == F.col("__f")) & (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y"))).select(F.format_string("fold_%04d", F.col("__r")).alias("fold_id"), ident).distinct()
    return folds_of(assigned, ident, k).join(near, ["fold_id", ident], "left_anti")


def group_folds(df: DataFrame, ident: str, group: str, k: int) -> DataFrame:
    """(ident, fold): the sorted distinct groups in turn."""
    groups = by_order(df.select(F.col(group).alias("__g")).distinct(), "__g", "__i")
    groups = groups.select("__g", (F.col("__i") % k).cast("int").alias("fold"))
    return df.select(ident, group).join(groups, F.col(group).eqNullSafe(F.col("__g"))).select(ident, "fold")


def balanced_groups(df: DataFrame, ident: str, group: str, k: int, most: int = 1_000_000) -> DataFrame:
    """(ident, fold): the largest group first, each to the fold with fewest rows (ties: group, then fold).

    The choice of a group depends on all larger ones, so the sizes are gone through in one place; more than ``most``
    groups are an error, for which ``group_folds`` is the way.
    """
    sizes = df.groupBy(group).count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} groups")
    load, fold = [0] * k, []
    for g, n in sorted(((r[0], r[1]) for r in sizes), key=lambda s: (-s[1], s[0])):
        f = load.index(min(load))
        load[f] += n
        fold.append((g, f))
    kind = df.schema[group].dataType.simpleString()
    made = df.sparkSession.createDataFrame(fold, f"{group} {kind}, fold int")
    return df.select(ident, group).join(made, group).select(ident, "fold")


def temporal_blocks(df: DataFrame, ident: str, at: str, k: int, gap: int = 0) -> DataFrame:
    """(fold_id, ident, role): contiguous folds in time order (the first n mod k one row longer), without ``gap``
    training rows on each side."""
    n = df.count()
    base, extra = divmod(n, k)
    edges = [0]
    for f in range(k):
        edges.append(edges[-1] + base + (f < extra))
    spec = df.sparkSession.createDataFrame([(f"fold_{f:04d}", edges[f], edges[f + 1]) for f in range(k)], "fold_id string, a long, b long")
    rows = numbered(df.select(ident, at), at, (ident,)).crossJoin(F.broadcast(spec))
    i = F.col("i")
    role = F.when((i >= F.col("a")) & (i < F.col("b")), "test").when((i < F.col("a") - gap) | (i >= F.col("b") + gap), "train")
    return rows.withColumn("role", role).where("role IS NOT NULL").select("fold_id", ident, "role")


def out_of_time(df: DataFrame, ident: str, at: str, fraction: float | None = None, last: int | None = None, gap: int = 0) -> DataFrame:
    """(ident, role): the last ceil(n * fraction), or ``last``, rows in time order are the test."""
    n = df.count()
    size = math.ceil(n * fraction) if fraction is not None else last
    i = F.col("i")
    role = F.when(i >= n - size, "test").when(i < n - size - gap, "train")
    return numbered(df.select(ident, at), at, (ident,)).withColumn("role", role).where("role IS NOT NULL").select(ident, "role")


def spatial_temporal(df: DataFrame, assigned: DataFrame, ident: str, at: str, k: int, min_train: int, horizon: int) -> DataFrame:
    """Folds that train on the earliest rows outside the fold's block and test the next rows inside it."""
    order = numbered(df.select(ident, at), at, (ident,)).select(ident, "i")
    rows = folds_of(assigned, ident, k).join(order, ident)
    keep = ((F.col("role") == "train") & (F.col("i") < min_train)) | ((F.col("role") == "test") & (F.col("i") >= min_train) & (F.col("i") < min_train + horizon))
    return rows.where(keep).select("fold_id", ident, "role")


def manifest(folds: DataFrame, ident: str) -> DataFrame:
    """(fold_id, n_train, n_test, digest): the digest covers the sorted ids by role, independent of row order."""
    one = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(ident).cast("string"), "role"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n = lambda r: F.sum((F.col("role") == r).cast("long"))
    return folds.groupBy("fold_id").agg(n("train").alias("n_train"), n("test").alias("n_test"), F.sum(one).cast("string").alias("digest"))


def environmental(df: DataFrame, ident: str, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """(ident, fold): clusters of the features by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="__v").transform(df.select(ident, *features))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="fold").fit(rows)
    return model.transform(rows).select(ident, "fold")


def environmental_ordered(df: DataFrame, ident: str, features: list[str], k: int) -> DataFrame:
    """(ident, fold): k slices as even as can be of the rows in the order of the feature with the widest range, then id."""
    ends = df.agg(*[x for c in features for x in (F.min(c), F.max(c))]).first()
    wide = max(range(len(features)), key=lambda j: (ends[2 * j + 1] - ends[2 * j], -j))
    n = df.count()
    base, extra = divmod(n, k)
    rows = numbered(df.select(ident, F.col(features[wide]).cast("double").alias("__v")), "__v", (ident,))
    cut = extra * (base + 1)  # the first folds are one row longer
    fold = F.when(F.col("i") < cut, F.floor(F.col("i") / (base + 1))).otherwise(extra + F.floor((F.col("i") - cut) / max(1, base)))
    return rows.select(ident, fold.cast("int").alias("fold"))
