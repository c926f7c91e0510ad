"""Smoothing and penalties over graphs, and relations between rows compiled to edges, features and penalties.

Edges are (src, dst, w) as stored: a pair that acts both ways is there twice.  Values are (node, v).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.operators.metrics import laplacian_penalty
from loomgrid.operators.ordered import bucket_of
from loomgrid.sources.shared import Tables

#: Kinds of relations, fixed values; ``no_smooth_group`` takes no part in edges, features or penalties.
KINDS = (
    "origin_adjacency", "destination_adjacency", "corridor_similarity", "reverse_edge_similarity", "neighbor_zone_similarity",
    "segment_similarity", "entity_similarity", "hierarchy_parent_child", "smooth_group", "no_smooth_group",
)


def smooth(edges: DataFrame, values: DataFrame, strength: float, steps: int) -> DataFrame:
    """(node, v) after ``steps`` of v = (first v + strength * sum w v') / (1 + strength * sum w); nodes without edges keep
    theirs.  One join and one aggregation a step."""
    if strength < 0:
        raise ValueError("the strength isn't negative")
    if strength == 0 or steps == 0:
        return values.select("node", "v")
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("__d"))
    base = values.select("node", F.col("v").alias("__v")).join(degree, "node", "left")
    now = values.select("node", "v")
    for _ in range(steps):
        got = edges.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("__s"))
        fresh = (F.col("__v") + strength * F.coalesce("__s", F.lit(0.0))) / (1 + strength * F.col("__d"))
        now = base.join(got, "node", "left").select("node", F.when(F.col("__d") > 0, fresh).otherwise(F.col("__v")).alias("v"))
    return now


def laplacian_gradient(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, g): the gradient of half the sum of w (difference)^2; every stored edge adds to both its ends."""
    ends = edges.join(values.select(F.col("node").alias("src"), F.col("v").alias("__a")), "src").join(values.select(F.col("node").alias("dst"), F.col("v").alias("__b")), "dst")
    d = F.col("w") * (F.col("__a") - F.col("__b"))
    parts = ends.select(F.explode(F.array(F.struct(F.col("src").alias("node"), d.alias("g")), F.struct(F.col("dst").alias("node"), (-d).alias("g")))).alias("x")).select("x.*")
    return values.select("node").join(parts.groupBy("node").agg(F.sum("g").alias("g")), "node", "left").na.fill(0.0, ["g"])


def adjusted_gain(edges: DataFrame, updates: DataFrame, gain: float, strength: float) -> DataFrame:
    """One row (penalty, adjusted): a split's gain less ``strength`` times the penalty of the updates (node, v) that it makes."""
    penalty = laplacian_penalty(edges, updates, "node", "v")
    return penalty.select((F.coalesce("penalty", F.lit(0.0)) * strength).alias("penalty"), (F.lit(gain) - F.coalesce("penalty", F.lit(0.0)) * strength).alias("adjusted"))


def check(relations: DataFrame) -> None:
    """An error for unknown kinds and weights that are negative or not finite; ``relations`` is (kind, left, right, w)."""
    bad = relations.where(~F.col("kind").isin(*KINDS) | F.col("w").isNull() | (F.col("w") < 0) | F.isnan("w") | (F.col("w") == float("inf")))
    if found := bad.take(1):
        raise ValueError(f"not a relation: {found[0].asDict()}")


def to_edges(relations: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, w): the relations of these kinds (all, if none is named) both ways, summed."""
    rows = relations.where(F.col("kind") != "no_smooth_group")
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    ways = F.array(F.struct(F.col("left").alias("src"), F.col("right").alias("dst")), F.struct(F.col("right").alias("src"), F.col("left").alias("dst")))
    return rows.select(F.explode(ways).alias("x"), "w").groupBy("x.src", "x.dst").agg(F.sum("w").alias("w"))


def relation_penalties(relations: DataFrame, predictions: DataFrame) -> DataFrame:
    """(name, penalty): a kind's sum of w (difference of predictions)^2; ``predictions`` is (node, v)."""
    rows = relations.where(F.col("kind") != "no_smooth_group").join(predictions.select(F.col("node").alias("left"), F.col("v").alias("__a")), "left").join(predictions.select(F.col("node").alias("right"), F.col("v").alias("__b")), "right")
    d = F.col("__a") - F.col("__b")
    return rows.groupBy(F.concat(F.lit("relation_"), "kind").alias("name")).agg(F.sum(F.col("w") * d * d).alias("penalty"))


def relation_features(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree_<kind>..., reverse_edge_count, hierarchy_balance): weights that meet at a node by kind, the number of
    its reverse edges, and its children less its parents."""
    rows = relations.where(F.col("kind") != "no_smooth_group")
    ends = rows.select("kind", "w", F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(1).alias("sign")), F.struct(F.col("right").alias("node"), F.lit(-1).alias("sign")))).alias("x")).select("kind", "w", "x.*")
    some = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    kinds = [k for k in KINDS if k != "no_smooth_group"]
    sums = ends.groupBy("node").agg(*[some(k, F.col("w")).alias(f"degree_{k}") for k in kinds], some("reverse_edge_similarity", F.lit(1.0)).alias("reverse_edge_count"), some("hierarchy_parent_child", F.col("sign").cast("double")).alias("hierarchy_balance"))
    return nodes.select("node").join(sums, "node", "left").na.fill(0.0)


def _inversions(f: np.ndarray, p: np.ndarray, n: np.ndarray) -> float:
    """The sum of n n' (p - p') over pairs with f < f' and p > p', by merging sorted halves."""
    order = np.lexsort((-p, f))  # of equal f the higher p first, so that they make no pair
    f, p, n = f[order], p[order], n[order]
    total, size = 0.0, 1
    while size < len(f):
        for low in range(0, len(f), 2 * size):
            a, b = slice(low, low + size), slice(low + size, low + 2 * size)
            if not len(p[b]):
                continue
            # Equal f on both sides of the cut have no pair: taken off again below.
            at = np.argsort(p[a], kind="stable")
            high = p[a][at]
            count, sums = (np.concatenate([[0.0], np.cumsum(x[at])]) for x in (n[a], n[a] * p[a]))
            place = np.searchsorted(high, p[b], "right")
            total += float((n[b] * ((sums[-1] - sums[place]) - (count[-1] - count[place]) * p[b])).sum())
        size *= 2
    for low, high in zip(*_runs(f), strict=True):
        if high - low > 1:
            c, v = np.cumsum(n[low:high]) - n[low:high], np.cumsum(n[low:high] * p[low:high]) - n[low:high] * p[low:high]
            total -= float((n[low:high] * (v - c * p[low:high])).sum())  # p falls within a run, so every pair of it was counted
    return total


def _runs(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, int)
    return starts, np.append(starts[1:], len(f))


def monotone_penalty(df: DataFrame, feature: str, prediction: str, sign: int, rows_a_bucket: int = 100_000) -> DataFrame:
    """One row (name, penalty): over all pairs of rows with different feature values, how far their predictions stand
    against the order that ``sign`` asks for.

    No pair is made.  Rows are cut into ranges of the feature and of the prediction: pairs of rows that differ in both
    ranges come from sums over the cells of ranges, pairs within a range from a sorted merge in that range's task.  The
    cells' sums run along the prediction within halves of ever smaller spans of the feature's ranges: two ranges are in
    different halves of one span.
    """
    name = F.lit(f"monotone_feature_{feature}").alias("name")
    if sign == 0:
        return df.sparkSession.range(1).select(name, F.lit(0.0).alias("penalty"))
    tables = Tables(df.sparkSession, "penalty")
    rows = df.groupBy((F.col(feature) * float(sign)).alias("f"), F.col(prediction).cast("double").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = tables.save(rows.where("f IS NOT NULL AND p IS NOT NULL"))
    buckets = max(2, -(-rows.count() // rows_a_bucket))
    rows = tables.save(rows.withColumn("fb", bucket_of(rows, "f", buckets)).withColumn("pb", bucket_of(rows, "p", buckets)))
    cells = rows.groupBy("fb", "pb").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("s"))
    last = rows.agg(F.max("fb")).first()[0] or 0
    spans = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last.bit_length()))))
    high = F.expr("shiftright(fb, level) & 1 = 1")
    side = lambda c, of: F.sum(F.when(of, F.col(c)).otherwise(0.0))
    spans = spans.groupBy("level", F.expr("shiftright(fb, level + 1)").alias("span"), "pb").agg(side("n", high).alias("n"), side("s", high).alias("s"), side("n", ~high).alias("m"), side("s", ~high).alias("t"))
    above = W.partitionBy("level", "span").orderBy(F.desc("pb")).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select((F.col("n") * F.sum("t").over(above) - F.col("s") * F.sum("m").over(above)).alias("penalty"))

    def inner(by: str, f: str) -> DataFrame:
        mixed = rows.groupBy(by).agg((F.min(f) < F.max(f)).alias("a"), (F.min("p") < F.max("p")).alias("b")).where("a AND b").select(by)
        return rows.join(F.broadcast(mixed), by, "left_semi").groupBy(by).applyInPandas(lambda g: pd.DataFrame({"penalty": [_inversions(g[f].to_numpy(float), g["p"].to_numpy(), g["n"].to_numpy())]}), "penalty double")  # a row a range

    # Within a range of predictions only pairs from different ranges of the feature are left.
    parts = spans.unionByName(inner("fb", "f")).unionByName(inner("pb", "fb"))
    penalty = float(parts.agg(F.sum("penalty")).first()[0] or 0.0)
    tables.close()
    return df.sparkSession.range(1).select(name, F.lit(penalty).alias("penalty"))


def interaction_penalty(groups: list[list[str]], active: list[str]) -> float:
    """1.0 if the active features share no group, else 0.0."""
    return 0.0 if not active or not groups or any(set(active) <= set(g) for g in groups) else 1.0


def compile_rules(relations: DataFrame, nodes: DataFrame, monotone: dict[str, int], groups: list[list[str]], active: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features (node, ...) and penalties (name, penalty) of relations and constraints; ``nodes`` is (node, v, features...)."""
    check(relations)
    broken = interaction_penalty(groups, active)
    features = relation_features(relations, nodes).withColumn("interaction_violation", F.lit(broken))
    penalties = relation_penalties(relations, nodes)
    for feature, sign in sorted(monotone.items()):
        penalties = penalties.unionByName(monotone_penalty(nodes, feature, "v", sign))
    own = nodes.sparkSession.createDataFrame([("interaction_constraints", broken)], "name string, penalty double")
    return features, penalties.unionByName(own)
