"""Queries whose SQL solves linear systems, smooths locally, or goes through states step by step: written out by
generators, table by table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import detectors as D
from loomgrid.operators import forecasting as X
from loomgrid.operators import hierarchies as H
from loomgrid.operators import joins as J
from loomgrid.operators import spatial as S
from loomgrid.plans import views as V
from loomgrid.plans.boost_queries import apply_sql, trees_sql
from loomgrid.plans.catalog import query, r
from loomgrid.plans.model_queries import CLOSURE, _levels
from loomgrid.plans.series_queries import DI, HZ, P, _daily, _out
from loomgrid.plans.space_queries import _nation_panel


def solve_sql(name: str, source: str, k: int, keep: str) -> str:
    """The table ``name`` (keep, x0...) that solves the k equations in each row of ``source``: m<i>_<j>, the right side at
    j = k.  Columns are eliminated in order, without exchange of rows."""
    parts, now = [], source
    for p in range(k):
        cols = []
        for i in range(k):
            for j in range(p + 1, k + 1):
                cols.append(f"m{p}_{j} / m{p}_{p} AS m{p}_{j}" if i == p else f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p} AS m{i}_{j}")
        parts.append(f"{name}_{p} AS MATERIALIZED (SELECT {keep}, {', '.join(cols)} FROM {now})")
        now = f"{name}_{p}"
    parts.append(f"{name} AS MATERIALIZED (SELECT {keep}, {', '.join(f'm{i}_{k} AS x{i}' for i in range(k))} FROM {now})")
    return ", ".join(parts)


def normal_sql(x: list[str], y: str, ridge: float = 0.0, weight: str = "1.0") -> str:
    """Columns m<i>_<j> of the weighted normal equations of y on the expressions x."""
    k = len(x)
    cell = lambda i, j: f"sum({weight} * ({x[i]}) * ({x[j]}))" + (f" + {ridge}" if i == j and ridge else "") + f" AS m{i}_{j}"
    return ", ".join([cell(i, j) for i in range(k) for j in range(k)] + [f"sum({weight} * ({x[i]}) * ({y})) AS m{i}_{k}" for i in range(k)])


# Kriging and neighbours' Gaussian processes

NEAR = f"""{V.GEO}, pr AS (SELECT a.id, a.x, a.y, b.x AS bx, b.y AS b_y, b.z AS bz, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS k FROM geo a JOIN geo b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144),
nb AS MATERIALIZED (SELECT id, any_value(x) AS x, any_value(y) AS y, count(*) FILTER (k <= 8) AS n, {', '.join(f'max(bx) FILTER (k = {i + 1}) AS px{i}, max(b_y) FILTER (k = {i + 1}) AS py{i}, max(bz) FILTER (k = {i + 1}) AS pz{i}' for i in range(8))} FROM pr GROUP BY id)"""
GAP = lambda i, j: f"sqrt((px{i} - px{j}) ** 2 + (py{i} - py{j}) ** 2)"
HERE = lambda i: f"sqrt((px{i} - x) ** 2 + (py{i} - y) ** 2)"


def _system(cov, border: bool) -> str:
    """Covariances of eight neighbours (missing ones stand alone), bordered by ones for unbiased weights."""
    cols = []
    for i in range(8):
        cols += [f"CASE WHEN {max(i, j)} < n THEN {cov(GAP(i, j), i == j)} ELSE {float(i == j)} END AS m{i}_{j}" for j in range(8)]
        cols += [f"({i} < n)::INTEGER::DOUBLE AS m{i}_8", f"CASE WHEN {i} < n THEN {cov(HERE(i), False)} ELSE 0 END AS m{i}_9"] if border else [f"CASE WHEN {i} < n THEN {cov(HERE(i), False)} ELSE 0 END AS m{i}_8"]
    if border:
        cols += [*[f"({j} < n)::INTEGER::DOUBLE AS m8_{j}" for j in range(8)], "0.0::DOUBLE AS m8_8", "1.0::DOUBLE AS m8_9"]
    return f"SELECT *, {', '.join(cols)} FROM nb"


KEEP = "id, x, y, n, " + ", ".join(f"px{i}, py{i}, pz{i}" for i in range(8))
EXPONENTIAL = lambda h, same: "8.1e6" if same else f"CASE WHEN {h} = 0 THEN 8.1e6 ELSE 8e6 * exp(-{h} / 5.0) END"
GAMMA = lambda h: f"CASE WHEN {h} = 0 THEN 0 ELSE 1e5 + 8e6 * (1 - exp(-{h} / 5.0)) END"
WEIGHTED = lambda f: " + ".join(f"coalesce(x{i} * ({f(i)}), 0)" for i in range(8))


def _near(spark, sf_dir):
    """Every point with its nearest others: predictions leave the point itself out."""
    g = V.geo(spark, sf_dir)
    return J.nearest(g, g, "id", 8, 12.0)


def _predictions(rows):
    return rows.select("id", rounded("mean", 3).alias("mean"), rounded("variance", 0).alias("variance"))


@query(f"WITH {NEAR}, sy AS ({_system(EXPONENTIAL, True)}), {solve_sql('w', 'sy', 9, KEEP)} SELECT id, {r(WEIGHTED(lambda i: f'pz{i}'), 3)} AS mean, {r(f'greatest(0, {WEIGHTED(lambda i: GAMMA(HERE(i)))} + {GAMMA(HERE(0))} - ({WEIGHTED(lambda i: GAMMA(GAP(0, i)))}))', 0)} AS variance FROM w")
def spatial_kriging(spark, sf_dir):
    return _predictions(S.krige(_near(spark, sf_dir), "id", "z", "exponential", 5.0, 8e6, 1e5))


@query()
def spatial_kriging_drift(spark, sf_dir):
    return _out(S.krige(_near(spark, sf_dir), "id", "z", "spherical", 9.0, 8e6, 1e5, drift=True))


COVARIANCE = lambda h, same: f"8e6 * exp(-{h} / 5.0)" + (" + 1e5" if same else "")


@query(f"WITH {NEAR}, sy AS ({_system(COVARIANCE, False)}), {solve_sql('w', 'sy', 8, KEEP)} SELECT id, {r('4500 + ' + WEIGHTED(lambda i: f'pz{i} - 4500'), 3)} AS mean, {r(f'8.1e6 - ({WEIGHTED(lambda i: COVARIANCE(HERE(i), False))})', 0)} AS variance FROM w")
def spatial_nngp(spark, sf_dir):
    return _predictions(S.nngp(_near(spark, sf_dir), "id", "z", 5.0, 8e6, 1e5, 4500.0))


LAGGED = """nd AS (SELECT c_nationkey AS node, avg(c_acctbal) / 1000 AS y, (count(*) % 7)::DOUBLE AS x FROM customer GROUP BY 1), ed AS (SELECT a.node AS src, b.node AS dst, 1.0 / count(*) OVER (PARTITION BY a.node) AS w FROM nd a JOIN nd b ON a.node <> b.node AND abs(a.node - b.node) <= 2),
lg AS (SELECT nd.node, any_value(nd.y) AS y, any_value(nd.x) AS x, coalesce(sum(w * o.y), 0) AS wy, coalesce(sum(w * o.x), 0) AS wx FROM nd LEFT JOIN ed ON src = nd.node LEFT JOIN nd o ON o.node = dst GROUP BY 1)"""


@query(f"WITH {LAGGED}, s1 AS (SELECT 1 AS g, {normal_sql(['1', 'x', 'wx'], 'wy')} FROM lg), {solve_sql('a', 's1', 3, 'g')}, ft AS (SELECT lg.*, x0 + x1 * x + x2 * wx AS f FROM lg, a), s2 AS (SELECT 1 AS g, {normal_sql(['1', 'x', 'f'], 'y')} FROM ft), {solve_sql('b', 's2', 3, 'g')} SELECT k::INTEGER AS k, {r('v')} AS coefficient FROM (SELECT unnest([0, 1, 2]) AS k, unnest([x0, x1, x2]) AS v FROM b)")
def spatial_s2sls(spark, sf_dir):
    nodes, edges = _nation_panel(spark, sf_dir)
    return _out(spark.createDataFrame([(k, float(v)) for k, v in enumerate(S.s2sls(nodes, edges, "node", ["x1"], "y"))], "k int, coefficient double"))


# Hierarchies: least squares on a tree goes up and down once


def _tree_sql(all_: float, region: float, nation: float) -> str:
    return f"""WITH RECURSIVE {CLOSURE}, ks AS (SELECT DISTINCT k FROM lv), ff AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up, ks.k, coalesce(lv.mean, 0) AS f FROM nation CROSS JOIN ks LEFT JOIN lv ON lv.leaf = 'n' || n_nationkey AND lv.k = ks.k),
r0 AS (SELECT up AS node, k, sum(f) AS s, count(*) * {nation} AS v FROM ff GROUP BY 1, 2), r1 AS (SELECT *, (s / {region} + s / v) / (1 / {region} + 1 / v) AS f, 1 / (1 / {region} + 1 / v) AS u FROM r0), a0 AS (SELECT k, sum(f) AS s, sum(s) AS b, sum(u) AS v FROM r1 GROUP BY 1),
a1 AS (SELECT *, (b * 1.05 / {all_} + s / v) / (1 / {all_} + 1 / v) AS f FROM a0), r2 AS (SELECT r1.node, r1.k, r1.s, r1.v, r1.f + r1.u / a1.v * (a1.f - a1.s) AS f FROM r1 JOIN a1 ON a1.k = r1.k)
SELECT 'all' AS node, k, {r('f', 4)} AS mean FROM a1 UNION ALL SELECT node, k, {r('f', 4)} FROM r2 UNION ALL SELECT ff.node, ff.k, {r(f'ff.f + {nation} / r2.v * (r2.f - r2.s)', 4)} FROM ff JOIN r2 ON r2.node = ff.up AND r2.k = ff.k"""


def _reconciled(spark, sf_dir, **kw):
    cl, lv, _ = _levels(spark, sf_dir)
    f = H.bottom_up(cl, lv, ["k"]).withColumn("mean", F.when(F.col("node") == "all", F.col("mean") * 1.05).otherwise(F.col("mean")))
    return H.reconcile(cl, f, ["k"], **kw).withColumn("mean", rounded("mean", 4))


@query(_tree_sql(1.0, 1.0, 1.0))
def hierarchy_ols(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query(_tree_sql(3.0, 2.0, 1.0))
def hierarchy_wls(spark, sf_dir):
    nodes = [x.node for x in _levels(spark, sf_dir)[0].select("node").distinct().collect()]
    return _reconciled(spark, sf_dir, weights={n: 3.0 if n == "all" else 2.0 if n[0] == "r" else 1.0 for n in nodes})


# Regressions of a series


def _arima_sql() -> str:
    """ARIMA (2, 1, 1): six passes of least squares, each with the residuals of the one before."""
    parts = ["z0 AS MATERIALIZED (SELECT series_id AS k, i - 1 AS i, z, 0.0::DOUBLE AS e FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY i) AS z FROM i) WHERE i > 1)"]
    for p in range(6):
        lags = f"l{p} AS MATERIALIZED (SELECT *, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(e, 1) OVER w AS e1 FROM z{p} WINDOW w AS (PARTITION BY k ORDER BY i))"
        normal = f"s{p} AS (SELECT k, {normal_sql(['1', 'z1', 'z2', 'e1'], 'z', 1e-8)} FROM l{p} WHERE z2 IS NOT NULL GROUP BY k)"
        parts += [lags, normal, solve_sql(f"c{p}", f"s{p}", 4, "k"), f"z{p + 1} AS MATERIALIZED (SELECT l.k, i, z, CASE WHEN z2 IS NULL THEN 0 ELSE z - (x0 + x1 * z1 + x2 * z2 + x3 * e1) END AS e FROM l{p} l JOIN c{p} c ON c.k = l.k)"]
    parts.append("f0 AS (SELECT z.k, 0 AS h, arg_max(z, i) AS a, arg_max(z, i, 2)[2] AS b, arg_max(e, i) AS e, 0.0::DOUBLE AS s FROM z6 z GROUP BY 1)")
    parts += [f"f{h} AS (SELECT f.k, {h} AS h, x0 + x1 * a + x2 * b + x3 * e AS a, a AS b, 0.0::DOUBLE AS e, s + x0 + x1 * a + x2 * b + x3 * e AS s FROM f{h - 1} f JOIN c5 c ON c.k = f.k)" for h in range(1, 8)]
    return ", ".join(parts)


@query(f"WITH {DI}, {HZ}, {_arima_sql()}, fs AS ({' UNION ALL '.join(f'SELECT k, h, s FROM f{h}' for h in range(1, 8))}), en AS (SELECT series_id, arg_max(y, i) AS y FROM i GROUP BY 1) SELECT hz.series_id, last + horizon AS ts, horizon, 'arima' AS model, {r('en.y + s', 4)} AS mean FROM hz JOIN fs ON fs.k = hz.series_id AND fs.h = hz.horizon JOIN en ON en.series_id = hz.series_id")
def forecast_arima(spark, sf_dir):
    return X.arima(_daily(spark, sf_dir), P, 7, order=(2, 1, 1)).withColumn("mean", rounded("mean", 4))


def _design(t: str) -> list[str]:
    """Columns of a piecewise linear trend with a weekly wave of order 3; changepoints c1..c5 are columns."""
    wave = [f"{f}(2 * pi() * {k} * ({t}) / 7)" for k in (1, 2, 3) for f in ("sin", "cos")]
    return ["1.0", t, *[f"greatest(0, {t} - c{k})" for k in range(1, 6)], *wave]


CHANGES = ", ".join(f"floor({k} * (greatest(1, floor(n * 0.8)) - 1) / 6)::DOUBLE AS c{k}" for k in range(1, 6))


def _piecewise_normal() -> str:
    x = _design("t")
    cells = [f"sum(({a}) * ({b}))" + (f" + {1e-10 if i == 0 else 0.1 + 1e-10}" if i == j else "") + f" AS m{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)]
    return ", ".join(cells + [f"sum(({a}) * y) AS m{i}_{len(x)}" for i, a in enumerate(x)])


@query(f"WITH {DI}, {HZ}, t AS (SELECT series_id AS k, (i - 1)::DOUBLE AS t, y, n, {CHANGES} FROM i), sy AS (SELECT k, any_value(n) AS n, {', '.join(f'any_value(c{j}) AS c{j}' for j in range(1, 6))}, {_piecewise_normal()} FROM t GROUP BY k), {solve_sql('b', 'sy', 13, 'k, n, c1, c2, c3, c4, c5')} SELECT series_id, last + horizon AS ts, horizon, 'piecewise_linear_seasonal' AS model, {r(' + '.join(f'x{i} * ({c})' for i, c in enumerate(_design('(n + horizon - 1)'))), 4)} AS mean FROM hz JOIN b ON b.k = series_id")
def forecast_piecewise_linear_seasonal(spark, sf_dir):
    return X.piecewise(_daily(spark, sf_dir), P, 7).withColumn("mean", rounded("mean", 4))


@query()
def forecast_piecewise_huber(spark, sf_dir):
    return _out(X.piecewise(_daily(spark, sf_dir), P, 7, huber=300.0))


# Local smoothing


def loess_sql(name: str, source: str, at: str, window: int) -> str:
    """Tables up to ``name`` (k, p, v): the tricube local linear fit of ``source`` (k, x, v) at ``at`` (k, p)."""
    return f"""{name}_d AS MATERIALIZED (SELECT a.k, a.p, s.x, s.v, abs(s.x - a.p) AS d, row_number() OVER (PARTITION BY a.k, a.p ORDER BY abs(s.x - a.p)) AS o, count(*) OVER (PARTITION BY a.k, a.p) AS n FROM ({at}) a JOIN ({source}) s ON s.k = a.k),
{name}_h AS (SELECT k, p, greatest(max(d) * CASE WHEN {window} > max(n) THEN {window}::DOUBLE / max(n) ELSE 1 END, 1.0) AS h FROM {name}_d WHERE o <= {window} GROUP BY 1, 2),
{name}_w AS MATERIALIZED (SELECT d.k, d.p, x, v, greatest(0, 1 - (d / (h * 1.0000001)) ** 3) ** 3 AS w FROM {name}_d d JOIN {name}_h h ON h.k = d.k AND h.p = d.p),
{name}_m AS (SELECT k, p, sum(w * x) / sum(w) AS mx, sum(w * v) / sum(w) AS mv FROM {name}_w GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT w.k, w.p, any_value(mv) + (w.p - any_value(mx)) * CASE WHEN sum(w * (x - mx) ** 2) > 1e-12 THEN sum(w * (x - mx) * (v - mv)) / sum(w * (x - mx) ** 2) ELSE 0 END AS v FROM {name}_w w JOIN {name}_m m ON m.k = w.k AND m.p = w.p GROUP BY 1, 2)"""


def stl_sql(name: str, source: str, season: int, passes: int = 5) -> str:
    """The table ``name`` (k, i, y, trend, seasonal, remainder) of ``source`` (k, i from 0, y), and those before it."""
    from math import ceil

    window = ceil(1.5 * season / (1 - 1.5 / 7))
    window += 1 - window % 2
    low = season + 1 - season % 2
    parts, trend = [], f"SELECT k, i, y, 0.0::DOUBLE AS t FROM {source}"
    for q in range(passes):
        g = f"{name}{q}"
        parts.append(f"{g}_d AS MATERIALIZED (SELECT k, i, y, y - t AS d FROM ({trend}))")
        sub = f"SELECT k || '|' || (i % {season}) AS k, (i // {season})::DOUBLE AS x, d AS v FROM {g}_d"
        places = f"SELECT k || '|' || (i % {season}) AS k, unnest(range(-1, max(i // {season}) + 2))::DOUBLE AS p FROM {g}_d GROUP BY k, i % {season}"
        parts.append(loess_sql(f"{g}_c", sub, places, 7))
        parts.append(f"{g}_y AS MATERIALIZED (SELECT regexp_extract(k, '^(.*)\\|', 1) AS k, (regexp_extract(k, '(\\d+)$', 1)::BIGINT + {season} * (p::BIGINT + 1)) AS j, v FROM {g}_c)")
        mean = lambda src, n: f"SELECT k, j - {n - 1} AS j, v FROM (SELECT k, j, avg(v) OVER w AS v, count(*) OVER w AS c FROM ({src}) WINDOW w AS (PARTITION BY k ORDER BY j ROWS {n - 1} PRECEDING)) WHERE c = {n}"
        parts.append(f"{g}_s AS MATERIALIZED (SELECT k, j::DOUBLE AS x, v FROM ({mean(mean(mean(f'SELECT * FROM {g}_y', season), season), 3)}))")
        parts.append(loess_sql(f"{g}_l", f"SELECT * FROM {g}_s", f"SELECT k, x AS p FROM {g}_s", low))
        parts.append(f"{g}_z AS MATERIALIZED (SELECT d.k, d.i, d.y, c.v - l.v AS s FROM {g}_d d JOIN {g}_y c ON c.k = d.k AND c.j = d.i + {season} JOIN {g}_l l ON l.k = d.k AND l.p = d.i)")
        parts.append(loess_sql(f"{g}_t", f"SELECT k, i::DOUBLE AS x, y - s AS v FROM {g}_z", f"SELECT k, i::DOUBLE AS p FROM {g}_z", window))
        trend = f"SELECT z.k, z.i, z.y, t.v AS t FROM {g}_z z JOIN {g}_t t ON t.k = z.k AND t.p = z.i"
    parts.append(f"{name} AS MATERIALIZED (SELECT z.k, z.i, z.y, t.v AS trend, z.s AS seasonal, z.y - t.v - z.s AS remainder FROM {name}{passes - 1}_z z JOIN {name}{passes - 1}_t t ON t.k = z.k AND t.p = z.i)")
    return ", ".join(parts)


SERIES = "sr AS (SELECT series_id AS k, i - 1 AS i, y FROM i)"


@query(f"WITH {DI}, {SERIES}, {stl_sql('st', 'sr', 7)} SELECT i.series_id, i.ts, {r('i.y')} AS y, {r('trend', 4)} AS trend, {r('seasonal', 4)} AS seasonal, {r('remainder', 4)} AS remainder FROM i JOIN st ON st.k = i.series_id AND st.i = i.i - 1")
def decompose_stl(spark, sf_dir):
    made = D.decompose(_daily(spark, sf_dir), P, 7)
    return made.select("series_id", "ts", rounded("y").alias("y"), *[rounded(c, 4).alias(c) for c in ("trend", "seasonal", "remainder")])


def _mstl_sql() -> str:
    """Seasons of 5 and 7 days in two rounds, then the trend."""
    parts, s5, s7 = [], None, None
    for q in range(2):
        rest = "sr" if s7 is None else f"(SELECT s.k, s.i, s.y - o.seasonal AS y FROM sr s JOIN {s7} o ON o.k = s.k AND o.i = s.i)"
        parts += [f"a{q} AS MATERIALIZED (SELECT k, i, y FROM {rest})", stl_sql(f"p{q}", f"a{q}", 5)]
        s5 = f"p{q}"
        parts += [f"b{q} AS MATERIALIZED (SELECT s.k, s.i, s.y - o.seasonal AS y FROM sr s JOIN {s5} o ON o.k = s.k AND o.i = s.i)", stl_sql(f"q{q}", f"b{q}", 7)]
        s7 = f"q{q}"
    parts.append("lf AS MATERIALIZED (SELECT s.k, s.i, s.y, a.seasonal AS s5, b.seasonal AS s7, s.y - a.seasonal - b.seasonal AS v, count(*) OVER (PARTITION BY s.k) AS n FROM sr s JOIN p1 a ON a.k = s.k AND a.i = s.i JOIN q1 b ON b.k = s.k AND b.i = s.i)")
    return ", ".join(parts)


@query(f"WITH {DI}, {SERIES}, {_mstl_sql()}, {loess_sql('tr', 'SELECT k, i::DOUBLE AS x, v FROM lf', 'SELECT k, i::DOUBLE AS p FROM lf', 21)} SELECT i.series_id, i.ts, {r('i.y')} AS y, {r('tr.v', 4)} AS trend, {r('s5', 4)} AS seasonal_5, {r('s7', 4)} AS seasonal_7, {r('lf.v - tr.v', 4)} AS remainder FROM i JOIN lf ON lf.k = i.series_id AND lf.i = i.i - 1 JOIN tr ON tr.k = lf.k AND tr.p = lf.i")
def decompose_mstl(spark, sf_dir):
    """On 30 days, so that the trend's window is 21."""
    made = D.decompose_multiple(_daily(spark, sf_dir), P, [5, 7])
    return made.select("series_id", "ts", rounded("y").alias("y"), *[rounded(c, 4).alias(c) for c in ("trend", "seasonal_5", "seasonal_7", "remainder")])


LAST = "la AS (SELECT k, max(i) AS n FROM sr GROUP BY 1), se AS (SELECT st.k, st.i - (n - 6) AS ph, seasonal FROM st JOIN la ON la.k = st.k WHERE st.i > n - 7), ad AS (SELECT k, i + 1 AS i, y - seasonal AS y FROM st)"


@query(f"""WITH RECURSIVE {DI}, {HZ}, {SERIES}, {stl_sql('st', 'sr', 7)}, {LAST}, e AS (SELECT a.k, a.i, b.y - a.y AS t, a.y AS l FROM ad a JOIN ad b ON a.k = b.k AND a.i = 1 AND b.i = 2
UNION ALL SELECT x.k, x.i, 0.1 * (0.3 * x.y + 0.7 * (l + t) - l) + 0.9 * t, 0.3 * x.y + 0.7 * (l + t) FROM e JOIN ad x ON x.k = e.k AND x.i = e.i + 1 WHERE x.i > 1) SELECT hz.series_id, last + horizon AS ts, horizon, 'stl' AS model, {r('l + t * horizon + seasonal', 4)} AS mean FROM hz JOIN la ON la.k = hz.series_id JOIN e ON e.k = la.k AND e.i = n + 1 JOIN se ON se.k = la.k AND ph = (horizon - 1) % 7""")
def forecast_stl(spark, sf_dir):
    return X.stl_forecast(_daily(spark, sf_dir), P, 7).withColumn("mean", rounded("mean", 4))


@query(f"""WITH RECURSIVE {DI}, {HZ}, {SERIES}, {stl_sql('st', 'sr', 7)}, {LAST}, e AS (SELECT k, i, y AS l FROM ad WHERE i = 1 UNION ALL SELECT a.k, a.i, 0.4 * a.y + 0.6 * l FROM e JOIN ad a ON a.k = e.k AND a.i = e.i + 1), b AS (SELECT k, regr_slope(y, i) AS b FROM ad GROUP BY 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'stl_theta' AS model, {r('l + 0.5 * b * (horizon - 1 + 1 / 0.4 - (0.6 ** (n + 1)) / 0.4) + seasonal', 4)} AS mean FROM hz JOIN la ON la.k = hz.series_id JOIN e ON e.k = la.k AND e.i = n + 1 JOIN b ON b.k = la.k JOIN se ON se.k = la.k AND ph = (horizon - 1) % 7""")
def forecast_stl_theta(spark, sf_dir):
    return X.decomposed(_daily(spark, sf_dir), P, 7, [7], X.theta, alpha=0.4).withColumn("mean", rounded("mean", 4))


# Paths through reference states

STATES = [200.0, 400.0, 600.0, 800.0]
EMIT = lambda j: f"((y - {STATES[j]}) / 150.0) ** 2 / 2"
FROM = lambda j: ", ".join(f"d{a} + {(a - j) ** 2 / 2}" for a in range(4))
WHICH = lambda j: f"list_position([{FROM(j)}], least({FROM(j)})) - 1"


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, n, {', '.join(f'{EMIT(j)} AS d{j}, 0 AS b{j}' for j in range(4))} FROM i WHERE i = 1 UNION ALL SELECT i.series_id, i.i, i.n, {', '.join(f'least({FROM(j)}) + {EMIT(j)}, {WHICH(j)}' for j in range(4))} FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
p AS (SELECT series_id, i, list_position([d0, d1, d2, d3], least(d0, d1, d2, d3)) - 1 AS s FROM e WHERE i = n UNION ALL SELECT e.series_id, e.i, CASE p.s WHEN 0 THEN z.b0 WHEN 1 THEN z.b1 WHEN 2 THEN z.b2 ELSE z.b3 END FROM p JOIN e ON e.series_id = p.series_id AND e.i = p.i - 1 JOIN e z ON z.series_id = p.series_id AND z.i = p.i)
SELECT i.series_id, ts, {r('y')} AS y, s::BIGINT AS state FROM i JOIN p ON p.series_id = i.series_id AND p.i = i.i""")
def detect_reference_path(spark, sf_dir):
    return _out(D.match_reference(_daily(spark, sf_dir), P, STATES, 150.0, 1.0))


SUMMED = lambda j, c: " + ".join(f"{c}{a} * exp(-{(a - j) ** 2 / 2})" for a in range(4))
LIKE = lambda j, y: f"exp(-0.5 * (({y} - {STATES[j]}) / 150.0) ** 2)"
TOTAL = lambda c: " + ".join(f"{c}{j}" for j in range(4))


@query(f"""WITH RECURSIVE {DI}, a AS (SELECT series_id, i, n, y, {', '.join(f'{LIKE(j, "y")} / ({" + ".join(LIKE(q, "y") for q in range(4))}) AS f{j}' for j in range(4))} FROM i WHERE i = 1 UNION ALL SELECT series_id, i, n, y, {', '.join(f'g{j} / ({TOTAL("g")})' for j in range(4))} FROM (SELECT i.series_id, i.i, i.n, i.y, {', '.join(f'({SUMMED(j, "f")}) * {LIKE(j, "i.y")} AS g{j}' for j in range(4))} FROM a JOIN i ON i.series_id = a.series_id AND i.i = a.i + 1)),
b AS (SELECT series_id, i, {', '.join(f'1.0::DOUBLE AS h{j}' for j in range(4))} FROM a WHERE i = n UNION ALL SELECT series_id, i, {', '.join(f'g{j} / ({TOTAL("g")})' for j in range(4))} FROM (SELECT b.series_id, b.i - 1 AS i, {', '.join('(' + ' + '.join(f'h{q} * {LIKE(q, "i.y")} * exp(-{(j - q) ** 2 / 2})' for q in range(4)) + f') AS g{j}' for j in range(4))} FROM b JOIN i ON i.series_id = b.series_id AND i.i = b.i WHERE b.i > 1))
SELECT i.series_id, ts, {r('i.y')} AS y, {r('(' + ' + '.join(f'f{j} * h{j} * {STATES[j]}' for j in range(4)) + ') / (' + ' + '.join(f'f{j} * h{j}' for j in range(4)) + ')', 4)} AS signal FROM i JOIN a ON a.series_id = i.series_id AND a.i = i.i JOIN b ON b.series_id = i.series_id AND b.i = i.i""")
def detect_reference_mean(spark, sf_dir):
    return D.reference_mean(_daily(spark, sf_dir), P, STATES, STATES, 150.0, 1.0).select("series_id", "ts", rounded("y").alias("y"), rounded("signal", 4).alias("signal"))


@query()
def filter_sequence(spark, sf_dir):
    return _out(D.locate(_daily(spark, sf_dir), P, [0.0, 10.0, 20.0, 30.0], [300.0, 500.0, 700.0, 400.0], (5.0, 0.5), 1e4))


@query()
def filter_sequence_unscented(spark, sf_dir):
    return _out(D.locate(_daily(spark, sf_dir), P, [0.0, 10.0, 20.0, 30.0], [300.0, 500.0, 700.0, 400.0], (5.0, 0.5), 1e4, unscented=True))


# Boosted lags: the SQL grows the trees on the same features and applies them to the rows ahead

LAGS = f"{DI}, fe AS (SELECT series_id, i, n, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, avg(y) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, lead(y, 1) OVER w AS y2 FROM i WINDOW w AS (PARTITION BY series_id ORDER BY i))"
AHEAD = "en AS (SELECT series_id, max(n) AS n, max(y) FILTER (i = n) AS l1, max(y) FILTER (i = n - 1) AS l2, avg(y) FILTER (i > n - 3) AS m3, max(y) FILTER (i = n - 2) AS l3 FROM i GROUP BY 1)"
COLS = ["l1", "l2", "m3"]


@query(f"""WITH {LAGS}, {AHEAD}, {HZ}, du AS (SELECT series_id || '|' || i AS id, l1, l2, m3, y FROM fe WHERE i > 3), {trees_sql('l2', COLS, 3, 2, 0.1, tag='u')}, dv AS (SELECT series_id || '|' || i AS id, l1, l2, m3, y2 AS y FROM fe WHERE i > 3 AND y2 IS NOT NULL), {trees_sql('l2', COLS, 3, 2, 0.1, tag='v')},
{apply_sql('a1', 'SELECT series_id AS id, l1, l2, m3 FROM en', COLS, 3, 2, 'u')}, {apply_sql('a2', 'SELECT series_id AS id, l1, l2, m3 FROM en', COLS, 3, 2, 'v')}
SELECT hz.series_id, last + horizon AS ts, horizon, 'boosted_direct' AS model, {r('CASE horizon WHEN 1 THEN a1.f ELSE a2.f END', 4)} AS mean FROM hz JOIN a1 ON a1.id = hz.series_id JOIN a2 ON a2.id = hz.series_id WHERE horizon <= 2""")
def forecast_boosted_direct(spark, sf_dir):
    return X.boosted_direct(_daily(spark, sf_dir), P, 2, lags=(1, 2), windows=(3,), trees=3, depth=2, bins=512).withColumn("mean", rounded("mean", 4))


@query(f"""WITH {LAGS}, {AHEAD}, {HZ}, du AS (SELECT series_id || '|' || i AS id, l1, l2, m3, y FROM fe WHERE i > 3), {trees_sql('l2', COLS, 3, 2, 0.1, tag='u')},
{apply_sql('a1', 'SELECT series_id AS id, l1, l2, m3 FROM en', COLS, 3, 2, 'u')}, {apply_sql('a2', 'SELECT series_id AS id, f AS l1, en.l1 AS l2, (f + en.l1 + en.l2) / 3 AS m3 FROM en JOIN a1 ON a1.id = series_id', COLS, 3, 2, 'u')}, {apply_sql('a3', 'SELECT series_id AS id, a2.f AS l1, a1.f AS l2, (a2.f + a1.f + en.l1) / 3 AS m3 FROM en JOIN a1 ON a1.id = series_id JOIN a2 ON a2.id = series_id', COLS, 3, 2, 'u')}
SELECT hz.series_id, last + horizon AS ts, horizon, 'boosted_lag' AS model, {r('CASE horizon WHEN 1 THEN a1.f WHEN 2 THEN a2.f ELSE a3.f END', 4)} AS mean FROM hz JOIN a1 ON a1.id = hz.series_id JOIN a2 ON a2.id = hz.series_id JOIN a3 ON a3.id = hz.series_id WHERE horizon <= 3""")
def forecast_boosted_lag(spark, sf_dir):
    return X.boosted_lags(_daily(spark, sf_dir), P, 3, lags=(1, 2), windows=(3,), trees=3, depth=2, bins=512).withColumn("mean", rounded("mean", 4))


def _piecewise_part(name: str, rows: str) -> str:
    """The table ``name`` (k, n, c1..c5, x0...) of the piecewise trends of a table (k, t, y, n)."""
    return f"{name}_t AS (SELECT *, {CHANGES} FROM ({rows})), {name}_s AS (SELECT k, any_value(n) AS n, {', '.join(f'any_value(c{j}) AS c{j}' for j in range(1, 6))}, {_piecewise_normal()} FROM {name}_t GROUP BY k), {solve_sql(name, f'{name}_s', 13, 'k, n, c1, c2, c3, c4, c5')}"


def _piecewise_at(step: str) -> str:
    return " + ".join(f"x{i} * ({c})" for i, c in enumerate(_design(f"(n + {step} - 1)")))


@query(f"""WITH {DI}, {HZ}, {_piecewise_part('tr', 'SELECT series_id AS k, (i - 1)::DOUBLE AS t, y, n - 5 AS n FROM i WHERE i <= n - 5')}, {_piecewise_part('fu', 'SELECT series_id AS k, (i - 1)::DOUBLE AS t, y, n FROM i')},
va AS (SELECT i.series_id, i.y, i.i - (i.n - 5) AS h FROM i WHERE i.i > i.n - 5), lv AS (SELECT series_id, avg(y - ({_piecewise_at('h')})) AS v FROM va JOIN tr ON tr.k = series_id GROUP BY 1), pl AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS x FROM lv),
nb AS (SELECT a.series_id, avg(lv.v) AS c FROM pl a JOIN pl b ON abs(a.x - b.x) = 1 JOIN lv ON lv.series_id = b.series_id GROUP BY 1) SELECT hz.series_id, last + horizon AS ts, horizon, 'spatial_piecewise_linear_seasonal' AS model, {r('(' + _piecewise_at('horizon') + ') + coalesce(c, 0)', 4)} AS mean FROM hz JOIN fu ON fu.k = hz.series_id LEFT JOIN nb ON nb.series_id = hz.series_id""")
def forecast_spatial_piecewise(spark, sf_dir):
    d = _daily(spark, sf_dir)
    names = [x.series_id for x in d.select("series_id").distinct().orderBy("series_id").collect()]
    places = spark.createDataFrame([(n, float(k), 0.0) for k, n in enumerate(names)], "series_id string, x double, y double")
    return X.kriged(d, P, 7, places, 2, 1.0, scale=2.0, base=("piecewise_linear_seasonal", {})).withColumn("mean", rounded("mean", 4))
