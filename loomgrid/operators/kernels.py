"""The numeric kernels of small networks and graph layers as plans: products, softmax, normalisation and their gradients.

Rows stay rows: dense layers are column expressions inside whole-stage code, sparse ones are a join and an aggregation
over (src, dst, w).  Weights are a model's, so they are literals.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import col, total

ACTIVATIONS = {"linear": lambda x: x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "tanh": F.tanh, "sigmoid": lambda x: 1 / (1 + F.exp(-x))}


def affine(features: list, means: list[float], weights: list[list[float]], intercepts: list[float]) -> list[Column]:
    """One score an output: the features less their means, times the output's weights, plus its intercept."""
    if any(len(w) != len(features) for w in weights) or len(means) != len(features) or len(weights) != len(intercepts):
        raise ValueError("shapes differ")
    return [total([(col(x) - float(m)) * float(a) for x, m, a in zip(features, means, w, strict=True)]) + float(b) for w, b in zip(weights, intercepts, strict=True)]


def dense(features: list, weights, bias, activation: str = "linear") -> list[Column]:
    """activation(x W + b) with W as (inputs, outputs)."""
    weights = np.asarray(weights, float)
    return [ACTIVATIONS[activation](x) for x in affine(features, [0.0] * len(features), weights.T.tolist(), list(bias))]


def mlp(features: list, layers: list[tuple], hidden: str = "tanh") -> list[Column]:
    """Dense layers (W, b) one on another, the last without its activation."""
    out = features
    for k, (w, b) in enumerate(layers):
        out = dense(out, w, b, hidden if k + 1 < len(layers) else "linear")
    return out


def layer_norm(features: list, scale: list[float], shift: list[float], epsilon: float = 1e-5) -> list[Column]:
    """Each row's features less their mean, over their population deviation, scaled and shifted."""
    xs = [col(x) for x in features]
    mean = total(xs) / len(xs)
    deviation = F.sqrt(total([(x - mean) * (x - mean) for x in xs]) / len(xs) + epsilon)
    return [(x - mean) / deviation * float(a) + float(b) for x, a, b in zip(xs, scale, shift, strict=True)]


def pair_scores(pairs: DataFrame, vectors: DataFrame, bias: float = 0.0) -> DataFrame:
    """(a, b, score): the sigmoid of the product of a pair's vectors; ``pairs`` is (a, b), ``vectors`` (node, v array)."""
    left, right = vectors.select(F.col("node").alias("a"), F.col("v").alias("__u")), vectors.select(F.col("node").alias("b"), F.col("v").alias("__v"))
    dot = F.aggregate(F.zip_with("__u", "__v", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", (1 / (1 + F.exp(-(dot + bias)))).alias("score"))


def diffusion(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(node, names): y = W x by channel; nodes without out-edges have 0."""
    got = edges.join(values.select(F.col("node").alias("dst"), *names), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
    return values.select("node").join(got, "node", "left").na.fill(0.0, names)


def diffusion_gradients(edges: DataFrame, values: DataFrame, gradient: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The gradients by x, (node, names), and by the weights, (src, dst, g), from that by y."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    g = gradient.select(F.col("node").alias("src"), *[F.col(c).alias(f"__{c}") for c in names])
    x = values.select(F.col("node").alias("dst"), *names)
    by_weight = edges.join(g, "src").join(x, "dst").select("src", "dst", reduce(lambda a, b: a + b, [F.col(c) * F.col(f"__{c}") for c in names]).alias("g"))
    return diffusion(back, gradient, names), by_weight


def row_softmax(edges: DataFrame, score: str) -> DataFrame:
    """(src, dst, p): softmax of the scores of each source's edges."""
    top = edges.groupBy("src").agg(F.max(score).alias("__m"))
    rows = edges.join(top, "src").select("src", "dst", F.exp(F.col(score) - F.col("__m")).alias("__e"))
    return rows.join(rows.groupBy("src").agg(F.sum("__e").alias("__s")), "src").select("src", "dst", (F.col("__e") / F.col("__s")).alias("p"))


def row_softmax_gradient(softmax: DataFrame, gradient: DataFrame) -> DataFrame:
    """(src, dst, g): p (g - sum p g), from (src, dst, p) and (src, dst, g)."""
    rows = softmax.join(gradient, ["src", "dst"])
    sums = rows.groupBy("src").agg(F.sum(F.col("p") * F.col("g")).alias("__s"))
    return rows.join(sums, "src").select("src", "dst", (F.col("p") * (F.col("g") - F.col("__s"))).alias("g"))


def adamw(parameters: np.ndarray, gradient: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, decay: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A step of Adam with decoupled decay on a model's parameters: (parameters, first, second moments); steps count from 1."""
    first = beta1 * first + (1 - beta1) * gradient
    second = beta2 * second + (1 - beta2) * gradient**2
    move = (first / (1 - beta1**step)) / (np.sqrt(second / (1 - beta2**step)) + epsilon)
    return parameters - rate * (move + decay * parameters), first, second
