"""Queries of network and graph kernels, and of regressors in a piecewise trend."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import forecasting as X
from loomgrid.operators import kernels as K
from loomgrid.operators.panel import future_index
from loomgrid.plans import views as V
from loomgrid.plans.algebra_queries import CHANGES, _design, solve_sql
from loomgrid.plans.catalog import query, r
from loomgrid.plans.relation_queries import _vectors
from loomgrid.plans.series_queries import DI, HZ, P, _daily, _out
from loomgrid.sources.tables import table

UNIT = f"{V.GEO}, u AS (SELECT id, x / 100 AS a, y / 100 AS b FROM geo)"


def _unit(spark, sf_dir):
    return V.geo(spark, sf_dir).select("id", (F.col("x") / 100).alias("a"), (F.col("y") / 100).alias("b"))


W1, B1, W2, B2 = [[0.5, -1.0, 2.0], [1.5, 0.25, -0.5]], [0.1, 0.2, -0.3], [[1.0], [-2.0], [0.5]], [0.05]


@query(f"WITH {UNIT}, h AS (SELECT id, a, b, tanh(0.5 * a + 1.5 * b + 0.1) AS h0, tanh(-a + 0.25 * b + 0.2) AS h1, tanh(2 * a - 0.5 * b - 0.3) AS h2 FROM u) SELECT id, {r('(a - 0.5) * 2 - (b - 0.25) * 3 + 1')} AS affine, {r('greatest(0.5 * a + 1.5 * b + 0.1, 0)')} AS relu, {r('1 / (1 + exp(-(-a + 0.25 * b + 0.2)))')} AS gate, {r('h0 - 2 * h1 + 0.5 * h2 + 0.05')} AS mlp FROM h")
def kernel_dense(spark, sf_dir):
    x = ["a", "b"]
    return _out(_unit(spark, sf_dir).select("id", K.affine(x, [0.5, 0.25], [[2.0, -3.0]], [1.0])[0].alias("affine"), K.dense(x, W1, B1, "relu")[0].alias("relu"), K.dense(x, W1, B1, "sigmoid")[1].alias("gate"), K.mlp(x, [(W1, B1), (W2, B2)])[0].alias("mlp")))


@query(f"WITH {UNIT}, t AS (SELECT id, a, b, 0.5::DOUBLE AS c, (a + b + 0.5) / 3 AS m FROM u), s AS (SELECT *, sqrt(((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) / 3 + 1e-5) AS s FROM t) SELECT id, {r('(a - m) / s * 2 + 1')} AS n0, {r('(b - m) / s')} AS n1, {r('(c - m) / s * 0.5 - 1')} AS n2 FROM s")
def kernel_layer_norm(spark, sf_dir):
    n = K.layer_norm(["a", "b", F.lit(0.5)], [2.0, 1.0, 0.5], [1.0, 0.0, -1.0])
    return _out(_unit(spark, sf_dir).select("id", *[x.alias(f"n{k}") for k, x in enumerate(n)]))


VC = "vc AS (SELECT n_nationkey AS node, n_regionkey::DOUBLE AS a, (n_nationkey % 7)::DOUBLE AS b FROM nation)"


@query(f"WITH {V.FLOWS}, {VC} SELECT src AS a, dst AS b, {r('1 / (1 + exp(-((u.a * v.a + u.b * v.b + 1) - 20)))')} AS score FROM flows JOIN vc u ON u.node = src JOIN vc v ON v.node = dst")
def kernel_pair_scores(spark, sf_dir):
    pairs = V.flows(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return _out(K.pair_scores(pairs, _vectors(spark, sf_dir), -20.0))


def _graph(spark, sf_dir):
    edges = V.flows(spark, sf_dir).withColumn("w", F.col("w") / 1000)
    n = table(spark, sf_dir, "nation")
    return edges, n.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("double").alias("a"), (F.col("n_nationkey") % 7).cast("double").alias("b"))


FW = f"{V.FLOWS}, fw AS (SELECT src, dst, w / 1000 AS w FROM flows), {VC}"


@query(f"WITH {FW} SELECT v.node, {r('coalesce((SELECT sum(w * u.a) FROM fw JOIN vc u ON u.node = dst WHERE src = v.node), 0)')} AS a, {r('coalesce((SELECT sum(w * u.b) FROM fw JOIN vc u ON u.node = dst WHERE src = v.node), 0)')} AS b FROM vc v")
def kernel_diffusion(spark, sf_dir):
    return _out(K.diffusion(*_graph(spark, sf_dir), ["a", "b"]))


@query(f"WITH {FW}, g AS (SELECT node, a + 1 AS a, b - 2 AS b FROM vc) SELECT 'x' AS of, v.node AS i, 0 AS j, {r('coalesce((SELECT sum(w * u.a) FROM fw JOIN g u ON u.node = src WHERE dst = v.node), 0)')} AS g FROM vc v UNION ALL SELECT 'w', src, dst, {r('g.a * v.a + g.b * v.b')} FROM fw JOIN g ON g.node = src JOIN vc v ON v.node = dst")
def kernel_diffusion_gradients(spark, sf_dir):
    edges, values = _graph(spark, sf_dir)
    gradient = values.select("node", (F.col("a") + 1).alias("a"), (F.col("b") - 2).alias("b"))
    by_x, by_w = K.diffusion_gradients(edges, values, gradient, ["a", "b"])
    x = by_x.select(F.lit("x").alias("of"), F.col("node").alias("i"), F.lit(0).alias("j"), F.col("a").alias("g"))
    return _out(x.unionByName(by_w.select(F.lit("w").alias("of"), F.col("src").alias("i"), F.col("dst").alias("j"), "g")))


SM = f"{FW}, e AS (SELECT src, dst, exp(w - max(w) OVER (PARTITION BY src)) AS e FROM fw), p AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY src) AS p FROM e)"


@query(f"WITH {SM} SELECT src, dst, {r('p')} AS p, {r('p * (dst % 3 - sum(p * (dst % 3)) OVER (PARTITION BY src))')} AS g FROM p")
def kernel_row_softmax(spark, sf_dir):
    p = K.row_softmax(_graph(spark, sf_dir)[0], "w")
    g = p.select("src", "dst", (F.col("dst") % 3).cast("double").alias("g"))
    return _out(p.join(K.row_softmax_gradient(p, g), ["src", "dst"]))


@query(f"""WITH RECURSIVE s AS (SELECT 0 AS k, 1.0::DOUBLE AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v UNION ALL SELECT k + 1, x - 0.1 * ((0.9 * m + 0.1 * 2 * x) / (1 - 0.9 ** (k + 1)) / (sqrt((0.999 * v + 0.001 * (2 * x) ** 2) / (1 - 0.999 ** (k + 1))) + 1e-8) + 0.01 * x), 0.9 * m + 0.1 * 2 * x, 0.999 * v + 0.001 * (2 * x) ** 2 FROM s WHERE k < 25)
SELECT k, {r('x')} AS x FROM s""")
def kernel_adamw(spark, sf_dir):
    """The minimum of x squared, step by step."""
    x, m, v, rows = np.ones(1), np.zeros(1), np.zeros(1), [(0, 1.0)]
    for k in range(1, 26):
        x, m, v = K.adamw(x, 2 * x, m, v, k, rate=0.1, decay=0.01)
        rows.append((k, float(x[0])))
    return _out(spark.createDataFrame(rows, "k int, x double"))


def _known(df):
    return df.withColumn("promo", (F.dayofmonth("ts") % 5 == 0).cast("double")).withColumn("heat", F.dayofmonth("ts") / 10.0)


def _with_regressors(t: str, ts: str) -> list[str]:
    return [*_design(t), f"(day({ts}) % 5 = 0)::INTEGER::DOUBLE", f"day({ts}) / 10.0::DOUBLE"]


def _normal(t: str, ts: str, penalties: list[float]) -> str:
    x = _with_regressors(t, ts)
    cells = [f"sum(({a}) * ({b}))" + (f" + {penalties[i] + 1e-10}" if i == j else "") + f" AS m{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)]
    return ", ".join(cells + [f"sum(({a}) * y) AS m{i}_{len(x)}" for i, a in enumerate(x)])


PENALTIES = [0.0] + [0.1] * 12 + [1.0] * 2


@query(f"WITH {DI}, {HZ}, t AS (SELECT series_id AS k, (i - 1)::DOUBLE AS t, ts, y, n, {CHANGES} FROM i), sy AS (SELECT k, any_value(n) AS n, {', '.join(f'any_value(c{j}) AS c{j}' for j in range(1, 6))}, {_normal('t', 'ts', PENALTIES)} FROM t GROUP BY k), {solve_sql('b', 'sy', 15, 'k, n, c1, c2, c3, c4, c5')} SELECT series_id, last + horizon AS ts, horizon, 'piecewise_regressors' AS model, {r(' + '.join(f'x{i} * ({c})' for i, c in enumerate(_with_regressors('(n + horizon - 1)', '(last + horizon)'))), 3)} AS mean FROM hz JOIN b ON b.k = series_id")
def forecast_piecewise_regressors(spark, sf_dir):
    d = _known(_daily(spark, sf_dir))
    ahead = _known(future_index(d, P, 7))
    return X.piecewise_regressors(d, ahead, P, ["promo", "heat"], strength=1.0).withColumn("mean", rounded("mean", 3))


S2 = """pt AS (SELECT c_custkey AS id, (c_custkey * 37 % 1790) / 10.0 - 89.5 AS lat, (c_custkey * 91 % 3590) / 10.0 - 179.5 AS lng FROM customer), xy AS (SELECT id, cos(radians(lng)) * cos(radians(lat)) AS x, sin(radians(lng)) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM pt),
fc AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS f FROM xy),
uv AS (SELECT id, f, CASE f WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u, CASE f WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM fc),
ij AS (SELECT id, f, floor(CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END * 1073741824)::BIGINT AS i, floor(CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END * 1073741824)::BIGINT AS j FROM uv),
cv AS (SELECT id, i, j, 30 AS k, f % 2 AS way, f::HUGEINT AS code FROM ij UNION ALL SELECT id, i, j, k - 1, xor(way, [1, 0, 0, 3][p + 1]), code * 4 + p FROM (SELECT *, list_position([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]][way + 1], (2 * (i >> (k - 1) & 1) + (j >> (k - 1) & 1))::INTEGER) - 1 AS p FROM cv WHERE k > 18))"""


@query(f"WITH RECURSIVE {S2}, c AS (SELECT id, (code * 2 + 1) * 68719476736 AS c FROM cv WHERE k = 18) SELECT id, (CASE WHEN c >= 9223372036854775808 THEN c - 18446744073709551616 ELSE c END)::BIGINT AS cell FROM c")
def ids_s2_cells(spark, sf_dir):
    """Cells of level 12, by way of those of level 20."""
    from loomgrid.functions import cells

    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1790 / 10 - 89.5).alias("lat"), (k * 91 % 3590 / 10 - 179.5).alias("lng"))
    return at.select("id", cells.s2_parent(cells.s2_cell("lat", "lng", 20), 12).alias("cell"))
