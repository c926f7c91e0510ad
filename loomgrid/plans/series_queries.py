"""Queries of forecasts, detectors and conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import conformal as C
from loomgrid.operators import detectors as D
from loomgrid.operators import forecasting as X
from loomgrid.operators import splits as S
from loomgrid.operators.panel import Panel
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r

P = Panel(allow_irregular=True)
SCHEMA = ("series_id", "ts", "horizon", "model")


def _daily(spark, sf_dir):
    return V.daily(spark, sf_dir).drop("n")


def _out(df, *names):
    return df.select(*[rounded(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in (names or df.columns)])


BACK = f"{V.DAILY}, bk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back, max(ts) OVER (PARTITION BY series_id) AS last FROM daily), h AS (SELECT DISTINCT series_id, last, range::INTEGER AS horizon FROM bk, range(1, 8))"
HEAD = "h.series_id, (last + h.horizon) AS ts, h.horizon"


@query(f"WITH {BACK} SELECT {HEAD}, 'naive' AS model, {r('b.y')} AS mean FROM h JOIN (SELECT series_id, y FROM bk WHERE back = 1) b ON b.series_id = h.series_id")
def forecast_naive(spark, sf_dir):
    return _out(X.naive(_daily(spark, sf_dir), P, 7))


@query(f"WITH {BACK} SELECT {HEAD}, 'seasonal_naive' AS model, {r('b.y')} AS mean FROM h JOIN (SELECT series_id, y, back FROM bk) b ON b.series_id = h.series_id AND back = 5 - (h.horizon - 1) % 5")
def forecast_seasonal_naive(spark, sf_dir):
    return _out(X.seasonal_naive(_daily(spark, sf_dir), P, 7, 5))


@query(f"WITH {BACK} SELECT {HEAD}, 'window_average' AS model, {r('m')} AS mean FROM h JOIN (SELECT series_id, avg(y) AS m FROM bk WHERE back <= 9 GROUP BY 1) b ON b.series_id = h.series_id")
def forecast_window_average(spark, sf_dir):
    return _out(X.window_average(_daily(spark, sf_dir), P, 7, 9))


@query(f"WITH {BACK} SELECT {HEAD}, 'seasonal_window_average' AS model, {r('m')} AS mean FROM h JOIN (SELECT series_id, (back - 1) % 7 AS ph, avg(y) AS m FROM bk WHERE back <= 21 GROUP BY 1, 2) b ON b.series_id = h.series_id AND ph = 6 - (h.horizon - 1) % 7")
def forecast_seasonal_window_average(spark, sf_dir):
    return _out(X.seasonal_window_average(_daily(spark, sf_dir), P, 7, 7, 3))


def _idx(view: str, name: str) -> str:
    return f"{view}, i AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {name})"


DI, SI = _idx(V.DAILY, "daily"), _idx(V.SPARSE, "sparse")
HZ = "hz AS (SELECT series_id, max(ts) AS last, range::INTEGER AS horizon FROM i, range(1, 8) GROUP BY 1, 3)"


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, n, y AS l FROM i WHERE i = 1 UNION ALL SELECT i.series_id, i.i, i.n, 0.4 * i.y + 0.6 * e.l FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
s AS (SELECT series_id, regr_slope(y, i) AS b FROM i GROUP BY 1), {HZ}
SELECT hz.series_id, last + horizon AS ts, horizon, 'theta' AS model, {r('l + 0.5 * b * (horizon - 1 + 1 / 0.4 - (0.6 ** n) / 0.4)')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n JOIN s ON s.series_id = hz.series_id""")
def forecast_theta(spark, sf_dir):
    return _out(X.theta(_daily(spark, sf_dir), P, 7, alpha=0.4))


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT a.series_id, a.i, a.n, a.y AS l, b.y - a.y AS t FROM i a JOIN i b ON a.series_id = b.series_id AND a.i = 1 AND b.i = 2
UNION ALL SELECT i.series_id, i.i, i.n, 0.3 * i.y + 0.7 * (l + 0.9 * t), 0.1 * (0.3 * i.y + 0.7 * (l + 0.9 * t) - l) + 0.9 * 0.9 * t FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1), {HZ}
SELECT hz.series_id, last + horizon AS ts, horizon, 'ets' AS model, {r('l + 0.9 * (1 - 0.9 ** horizon) / 0.1 * t')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n""")
def forecast_ets(spark, sf_dir):
    return _out(X.ets(_daily(spark, sf_dir), P, 7, alpha=0.3, beta=0.1, phi=0.9))


CRO = f"""{SI}, e AS (SELECT series_id, i, n, CASE WHEN y > 0 THEN y END AS z, CASE WHEN y > 0 THEN 1.0::DOUBLE END AS p, CASE WHEN y > 0 THEN 1 ELSE 0 END AS seen FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, i.n, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN y ELSE z + 0.1 * (y - z) END ELSE z END, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN i.i::DOUBLE ELSE p + 0.1 * (i.i - seen - p) END ELSE p END, CASE WHEN y > 0 THEN i.i ELSE seen END
FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1), {HZ}, c AS (SELECT series_id, coalesce(z / p, 0) AS m FROM e WHERE i = n)"""


@query(f"WITH RECURSIVE {CRO} SELECT hz.series_id, last + horizon AS ts, horizon, 'croston' AS model, {r('m')} AS mean FROM hz JOIN c ON c.series_id = hz.series_id")
def forecast_croston(spark, sf_dir):
    return _out(X.croston(V.sparse(spark, sf_dir), P, 7))


@query(f"WITH RECURSIVE {CRO} SELECT hz.series_id, last + horizon AS ts, horizon, 'sba' AS model, {r('m * 0.95')} AS mean FROM hz JOIN c ON c.series_id = hz.series_id")
def forecast_sba(spark, sf_dir):
    return _out(X.sba(V.sparse(spark, sf_dir), P, 7))


@query(f"""WITH RECURSIVE {SI}, e AS (SELECT series_id, i, n, CASE WHEN y > 0 THEN y END AS z, 0.1 * (y > 0)::INTEGER::DOUBLE AS p FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, i.n, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN y ELSE z + 0.1 * (y - z) END ELSE z END, p + 0.1 * ((y > 0)::INTEGER - p) FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1), {HZ}
SELECT hz.series_id, last + horizon AS ts, horizon, 'tsb' AS model, {r('p * coalesce(z, 0)')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n""")
def forecast_tsb(spark, sf_dir):
    return _out(X.tsb(V.sparse(spark, sf_dir), P, 7))


def _model(name: str, view, **kw):
    def run(spark, sf_dir):
        return _out(X.MODELS[name](view(spark, sf_dir), P, 7, **kw))

    run.__name__ = f"forecast_{name}"
    return query()(run)


_model("auto_arima", _daily)


def _croston_sql(name: str, source: str) -> str:
    """Croston's level of each key of a table (k, i, y) whose rows are numbered from 1."""
    return f"""{name}_n AS (SELECT k, max(i) AS n FROM {source} GROUP BY 1), {name}_e AS (SELECT k, i, CASE WHEN y > 0 THEN y END AS z, CASE WHEN y > 0 THEN 1.0::DOUBLE END AS p, CASE WHEN y > 0 THEN 1 ELSE 0 END AS seen FROM {source} WHERE i = 1
UNION ALL SELECT s.k, s.i, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN y ELSE z + 0.1 * (y - z) END ELSE z END, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN s.i::DOUBLE ELSE p + 0.1 * (s.i - seen - p) END ELSE p END, CASE WHEN y > 0 THEN s.i ELSE seen END
FROM {name}_e e JOIN {source} s ON s.k = e.k AND s.i = e.i + 1), {name} AS (SELECT e.k, coalesce(z / p, 0) AS m FROM {name}_e e JOIN {name}_n n ON n.k = e.k AND n.n = e.i)"""


def _buckets(source: str, size: int) -> str:
    """Sums of trailing complete buckets; the series itself where there is none."""
    return f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY b DESC) AS i, y FROM (SELECT k, (n - i) // {size} AS b, sum(y) AS y, count(*) AS c FROM (SELECT *, max(i) OVER (PARTITION BY k) AS n FROM {source}) GROUP BY 1, 2 HAVING count(*) = {size})"


@query(f"WITH RECURSIVE {SI}, {HZ}, ser AS (SELECT series_id AS k, i, y FROM i), bk AS ({_buckets('ser', 5)}), {_croston_sql('c', 'bk')} SELECT series_id, last + horizon AS ts, horizon, 'adida' AS model, {r('m / 5')} AS mean FROM hz JOIN c ON c.k = hz.series_id")
def forecast_adida(spark, sf_dir):
    return _out(X.adida(V.sparse(spark, sf_dir), P, 7, bucket=5))


PARTS = "ho AS (SELECT series_id, least(greatest(max(n) // 5, 1), 8) AS h, max(n) AS n FROM i GROUP BY 1), pt AS (SELECT series_id || '|full' AS k, i, y FROM i UNION ALL SELECT i.series_id || '|train', i.i, y FROM i JOIN ho ON ho.series_id = i.series_id WHERE i.i <= ho.n - h)"
TSB = """ts_e AS (SELECT k, i, CASE WHEN y > 0 THEN y END AS z, 0.1 * (y > 0)::INTEGER::DOUBLE AS p FROM pt WHERE i = 1
UNION ALL SELECT s.k, s.i, CASE WHEN y > 0 THEN CASE WHEN z IS NULL THEN y ELSE z + 0.1 * (y - z) END ELSE z END, p + 0.1 * ((y > 0)::INTEGER - p) FROM ts_e e JOIN pt s ON s.k = e.k AND s.i = e.i + 1), ts AS (SELECT k, arg_max(p * coalesce(z, 0), i) AS m FROM ts_e GROUP BY 1)"""


@query(f"""WITH RECURSIVE {SI}, {HZ}, {PARTS}, {_croston_sql('cr', 'pt')}, bk AS ({_buckets('pt', 7)}), {_croston_sql('ad', 'bk')}, {TSB},
lv AS (SELECT k, 1 AS o, 0.0::DOUBLE AS m FROM cr UNION ALL SELECT k, 2, m FROM ts UNION ALL SELECT k, 3, m * 0.95 FROM cr UNION ALL SELECT k, 4, m FROM cr UNION ALL SELECT k, 5, m / 7 FROM ad),
te AS (SELECT i.series_id, i.y, h FROM i JOIN ho ON ho.series_id = i.series_id WHERE i.i > ho.n - h), ls AS (SELECT series_id, o, CASE WHEN sum(abs(y)) > 0 THEN sum(abs(m - y)) / sum(abs(y)) ELSE any_value(abs(m)) * any_value(h) END AS loss FROM te JOIN lv ON lv.k = series_id || '|train' GROUP BY 1, 2),
pk AS (SELECT series_id, arg_min(o, loss * 1e9 + o * 1e-3) AS o FROM ls GROUP BY 1) SELECT hz.series_id, last + horizon AS ts, horizon, 'intermittent_demand' AS model, {r('m')} AS mean FROM hz JOIN pk ON pk.series_id = hz.series_id JOIN lv ON lv.k = hz.series_id || '|full' AND lv.o = pk.o""")
def forecast_intermittent_demand(spark, sf_dir):
    return _out(X.intermittent(V.sparse(spark, sf_dir), P, 7))


THETAS = "gr AS (SELECT row_number() OVER () AS g, t, a FROM (SELECT t, a FROM (VALUES (1.0), (1.5), (2.0), (3.0)) x(t), (VALUES (0.1), (0.2), (0.3), (0.5), (0.8)) y(a) ORDER BY t, a))"


@query(f"""WITH RECURSIVE {DI}, {HZ}, {PARTS}, {THETAS}, e AS (SELECT k, a, i, y AS l FROM pt, (SELECT DISTINCT a FROM gr) WHERE i = 1 UNION ALL SELECT s.k, e.a, s.i, e.a * s.y + (1 - e.a) * e.l FROM e JOIN pt s ON s.k = e.k AND s.i = e.i + 1),
lv AS (SELECT k, a, arg_max(l, i) AS l, max(i) AS n FROM e GROUP BY 1, 2), sl AS (SELECT k, regr_slope(y, i) AS b FROM pt GROUP BY 1), f AS (SELECT lv.k, g, range AS h, l + (1 - 1 / t) * b * (range - 1 + 1 / gr.a - ((1 - gr.a) ** n) / gr.a) AS m FROM lv JOIN gr ON gr.a = lv.a JOIN sl ON sl.k = lv.k, range(1, 9)),
ls AS (SELECT i.series_id, g, avg((m - y) ** 2) AS loss FROM i JOIN ho ON ho.series_id = i.series_id JOIN f ON f.k = i.series_id || '|train' AND f.h = i.i - (ho.n - ho.h) WHERE i.i > ho.n - ho.h GROUP BY 1, 2), pk AS (SELECT series_id, g FROM ls QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(loss, 9), g) = 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'optimized_theta' AS model, {r('m')} AS mean FROM hz JOIN pk ON pk.series_id = hz.series_id JOIN f ON f.k = hz.series_id || '|full' AND f.g = pk.g AND f.h = hz.horizon""")
def forecast_optimized_theta(spark, sf_dir):
    return _out(X.optimized_theta(_daily(spark, sf_dir), P, 7))


ETSG = "gr AS (SELECT row_number() OVER () AS g, a, b, f FROM (SELECT a, b, f FROM (VALUES (0.1), (0.2), (0.3), (0.5), (0.8), (0.95)) x(a), (VALUES (0.0), (0.05), (0.1), (0.2), (0.4)) y(b), (VALUES (0.8), (0.9), (0.95), (0.98), (1.0)) z(f) ORDER BY a, b, f))"
DAMP = "CASE WHEN f = 1 THEN range ELSE f * (1 - f ** range) / (1 - f) END"


@query(f"""WITH RECURSIVE {DI}, {HZ}, {PARTS}, {ETSG}, e AS (SELECT p.k, g, a, b, f, 2 AS i, (a * q.y + (1 - a) * (p.y + f * (q.y - p.y)))::DOUBLE AS l, (b * (a * q.y + (1 - a) * (p.y + f * (q.y - p.y)) - p.y) + (1 - b) * f * (q.y - p.y))::DOUBLE AS t FROM pt p JOIN pt q ON p.k = q.k AND p.i = 1 AND q.i = 2, gr
UNION ALL SELECT s.k, g, a, b, f, s.i, a * s.y + (1 - a) * (l + f * t), b * (a * s.y + (1 - a) * (l + f * t) - l) + (1 - b) * f * t FROM e JOIN pt s ON s.k = e.k AND s.i = e.i + 1),
lv AS (SELECT k, g, any_value(f) AS f, arg_max(l, i) AS l, arg_max(t, i) AS t FROM e GROUP BY 1, 2), fc AS (SELECT k, g, range AS h, l + t * ({DAMP}) AS m FROM lv, range(1, 9)),
ls AS (SELECT i.series_id, g, avg((m - y) ** 2) AS loss FROM i JOIN ho ON ho.series_id = i.series_id JOIN fc ON fc.k = i.series_id || '|train' AND fc.h = i.i - (ho.n - ho.h) WHERE i.i > ho.n - ho.h GROUP BY 1, 2), pk AS (SELECT series_id, g FROM ls QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(loss, 7), g) = 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'auto_ets' AS model, {r('m')} AS mean FROM hz JOIN pk ON pk.series_id = hz.series_id JOIN fc ON fc.k = hz.series_id || '|full' AND fc.g = pk.g AND fc.h = hz.horizon""")
def forecast_auto_ets(spark, sf_dir):
    return _out(X.auto_ets(_daily(spark, sf_dir), P, 7))


@query(f"""WITH RECURSIVE {DI}, {HZ}, s0 AS (SELECT series_id, list(y ORDER BY i) AS v, avg(y) AS m FROM i WHERE i <= 7 GROUP BY 1), t0 AS (SELECT a.series_id, avg((b.y - a.y) / 7) AS t FROM i a JOIN i b ON a.series_id = b.series_id AND b.i = a.i + 7 WHERE a.i <= 7 GROUP BY 1),
e AS (SELECT i.series_id, 1 AS i, i.y - (v[1] - m) AS l, t, list_transform(v, lambda x: x - m) AS s FROM i JOIN s0 ON s0.series_id = i.series_id JOIN t0 ON t0.series_id = i.series_id WHERE i.i = 1
UNION ALL SELECT series_id, i, nl, 0.1 * (nl - l) + 0.9 * 0.95 * t, list_transform(s, lambda x, j: CASE WHEN j = k THEN 0.2 * (y - nl) + 0.8 * x ELSE x END) FROM (SELECT e.*, i.y, (e.i % 7) + 1 AS k, 0.3 * (i.y - s[(e.i % 7) + 1]) + 0.7 * (l + 0.95 * t) AS nl FROM (SELECT series_id, i + 0 AS i, l, t, s FROM e) e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1) REPLACE (i + 1 AS i))
SELECT hz.series_id, last + horizon AS ts, horizon, 'ets' AS model, {r('l + 0.95 * (1 - 0.95 ** horizon) / 0.05 * t + s[(e.i + horizon - 1) % 7 + 1]')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id JOIN (SELECT series_id, max(i) AS n FROM i GROUP BY 1) x ON x.series_id = e.series_id AND x.n = e.i""".replace("SELECT series_id, i, nl, 0.1", "SELECT series_id, i + 1, nl, 0.1").replace(" REPLACE (i + 1 AS i))", ")"))
def forecast_ets_seasonal(spark, sf_dir):
    return _out(X.ets(_daily(spark, sf_dir), P, 7, alpha=0.3, beta=0.1, gamma=0.2, phi=0.95, season=7))


LL = "(v + 0.1) / (v + 1.1)"


@query(f"""WITH RECURSIVE {DI}, {HZ}, e AS (SELECT series_id, i, n, y AS l, 1.0::DOUBLE AS v FROM i WHERE i = 1 UNION ALL SELECT i.series_id, i.i, i.n, l + {LL} * (y - l), (1 - {LL}) ** 2 * (v + 0.1) + ({LL}) ** 2 FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'local_level_kalman' AS model, {r('l')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n""")
def forecast_local_level_kalman(spark, sf_dir):
    return _out(X.kalman(_daily(spark, sf_dir), P, 7))


def trend_filter(source: str, level: str, trend: str, noise: str, keep: str = "") -> str:
    """The recursive table kt: a local linear trend's state (l, t), covariance (a, b, c) and log-likelihood of a table
    (k, i, y), whose rows carry the columns ``keep``."""
    more = "".join(f", s.{c}" for c in keep.split())
    first = "".join(f", {c}" for c in keep.split())
    return f"""kt AS (SELECT k, i{first}, y AS l, 0.0::DOUBLE AS t, ({noise})::DOUBLE AS a, 0.0::DOUBLE AS b, ({noise})::DOUBLE AS c, 0.0::DOUBLE AS ll FROM {source} WHERE i = 1
UNION ALL SELECT k, i{first}, pl + pa / sv * (y - pl), t + pb / sv * (y - pl), pa - pa * pa / sv, pb - pa * pb / sv, pc - pb * pb / sv, ll - 0.5 * (ln(2 * pi() * sv) + (y - pl) ** 2 / sv)
FROM (SELECT s.k, s.i{more}, s.y, l + t AS pl, t, a + 2 * b + c + ({level.replace('@', 's.')}) AS pa, b + c AS pb, c + ({trend.replace('@', 's.')}) AS pc, a + 2 * b + c + ({level.replace('@', 's.')}) + ({noise.replace('@', 's.')}) AS sv, ll FROM kt JOIN {source} s ON s.k = kt.k AND s.i = kt.i + 1))"""


@query(f"WITH RECURSIVE {DI}, {HZ}, sr AS (SELECT series_id AS k, i, y FROM i), {trend_filter('sr', '0.1', '0.01', '1.0')} SELECT series_id, last + horizon AS ts, horizon, 'kalman' AS model, {r('l + t * horizon')} AS mean FROM hz JOIN (SELECT k, arg_max(l, i) AS l, arg_max(t, i) AS t FROM kt GROUP BY 1) ON k = series_id")
def forecast_kalman(spark, sf_dir):
    return _out(X.kalman_trend(_daily(spark, sf_dir), P, 7))


@query(f"WITH {BACK}, l AS (SELECT *, ln(1 + y) AS z FROM bk) SELECT {HEAD}, 'log1p_window_average' AS model, {r('exp(m) - 1')} AS mean FROM h JOIN (SELECT series_id, avg(z) AS m FROM l WHERE back <= 9 GROUP BY 1) b ON b.series_id = h.series_id")
def forecast_log1p(spark, sf_dir):
    return _out(X.log1p(X.window_average)(_daily(spark, sf_dir), P, 7, size=9))


@query(f"""WITH {BACK}, a AS (SELECT series_id, y FROM bk WHERE back = 1), b AS (SELECT series_id, avg(y) AS m FROM bk WHERE back <= 9 GROUP BY 1)
SELECT {HEAD}, {r('(3 * a.y + b.m) / 4')} AS mean FROM h JOIN a ON a.series_id = h.series_id JOIN b ON b.series_id = h.series_id""")
def forecast_ensemble(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return _out(X.ensemble([X.naive(d, P, 7), X.window_average(d, P, 7, 9)], [3, 1]))


SCORES = "sc AS (SELECT 's' || (l_suppkey % 7)::VARCHAR AS series_id, 'm' || (l_partkey % 6)::VARCHAR AS model, avg(l_discount + l_partkey % 6 * 0.01) AS score FROM lineitem GROUP BY 1, 2)"


def _scores(spark, sf_dir):
    from loomgrid.sources.tables import table

    li = table(spark, sf_dir, "lineitem")
    m = F.col("l_partkey") % 6
    return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("series_id"), F.concat(F.lit("m"), m).alias("model")).agg(F.avg(F.col("l_discount") + m * 0.01).alias("score"))


@query(f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, model) AS k, min(score) OVER (PARTITION BY series_id) AS b FROM sc) SELECT series_id, model, {r('((b / score) ** 2) / sum((b / score) ** 2) OVER (PARTITION BY series_id)')} AS weight FROM k WHERE k <= 4")
def forecast_validation_weights(spark, sf_dir):
    return _out(X.validation_weights(_scores(spark, sf_dir), ["series_id"]))


@query(f"WITH {SCORES}, k AS (SELECT *, min(score) OVER (PARTITION BY series_id) AS b FROM sc), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY model DESC, score) AS k FROM k WHERE score <= 1.2 * b) SELECT series_id, model, {r('score')} AS score FROM n WHERE k = 1")
def forecast_robust_pick(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("complexity", -F.substring("model", 2, 9).cast("int"))
    return _out(X.robust_pick(s, ["series_id"], "complexity", slack=0.2), "series_id", "model", "score")


@query(f"""WITH {V.DAILY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM daily)), f AS (SELECT printf('fold_%04d', k) AS fold_id, 15 + 4 * k AS c FROM range(100000) x(k) WHERE 15 + 4 * k < (SELECT count(*) FROM t) - 4),
tr AS (SELECT fold_id, series_id, max_by(y, daily.ts) AS mean FROM daily JOIN t ON t.ts = daily.ts, f WHERE i <= c GROUP BY 1, 2)
SELECT f.fold_id, daily.series_id, daily.ts, (i - c)::INTEGER AS horizon, 'naive' AS model, {r('mean')} AS mean, {r('y')} AS y FROM daily JOIN t ON t.ts = daily.ts, f, tr WHERE tr.fold_id = f.fold_id AND tr.series_id = daily.series_id AND i > c AND i <= c + 4""")
def forecast_backtest(spark, sf_dir):
    d = _daily(spark, sf_dir)
    folds = S.rolling_origin(d, "ts", 4, 4, 16)
    return _out(X.backtest(d, P, folds, X.naive, 4), "fold_id", "series_id", "ts", "horizon", "model", "mean", "y")


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, greatest(0, y - 500 - 50) AS u, greatest(0, -(y - 500) - 50) AS d FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, greatest(0, CASE WHEN greatest(u, d) > 800 THEN 0 ELSE u END + (y - 500) - 50), greatest(0, CASE WHEN greatest(u, d) > 800 THEN 0 ELSE d END - (y - 500) - 50) FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1)
SELECT i.series_id, ts, {r('y')} AS y, {r('greatest(u, d)')} AS score, greatest(u, d) > 800 AS triggered FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i""")
def detect_cusum(spark, sf_dir):
    return _out(D.cusum(_daily(spark, sf_dir), P, 500.0, 50.0, 800.0))


PH = "CASE WHEN s > 900 THEN 0 ELSE {0} END"


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, 1.0::DOUBLE AS n, y AS m, -10.0::DOUBLE AS c, -10.0::DOUBLE AS w, 0.0::DOUBLE AS s FROM i WHERE i = 1
UNION ALL SELECT series_id, i, n, m, c, least(w, c), c - least(w, c) FROM (SELECT i.series_id, i.i, {PH.format('e.n')} + 1 AS n, {PH.format('m')} + (y - {PH.format('m')}) / ({PH.format('e.n')} + 1) AS m, {PH.format('c')} + y - ({PH.format('m')} + (y - {PH.format('m')}) / ({PH.format('e.n')} + 1)) - 10 AS c, {PH.format('w')} AS w FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1))
SELECT i.series_id, ts, {r('y')} AS y, {r('s')} AS score, s > 900 AS triggered FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i""")
def detect_page_hinkley(spark, sf_dir):
    return _out(D.page_hinkley(_daily(spark, sf_dir), P, 10.0, 900.0))


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, y * y AS v FROM i WHERE i = 1 UNION ALL SELECT i.series_id, i.i, 0.2 * y * y + 0.8 * v FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1)
SELECT i.series_id, ts, {r('y')} AS y, {r('sqrt(v)')} AS volatility FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i""")
def detect_ewma_volatility(spark, sf_dir):
    return _out(D.ewma_volatility(_daily(spark, sf_dir), P, 0.2))


RW = "greatest(0, CASE WHEN greatest(u, d) > 800 THEN 0 ELSE {0} END {1} (y - 500) - 50)"


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, greatest(0, y - 500 - 50) AS u, greatest(0, -(y - 500) - 50) AS d, (y - 500) ** 2 AS v FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, {RW.format('u', '+')}, {RW.format('d', '-')}, 0.2 * (y - 500) ** 2 + 0.8 * v FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
s AS (SELECT e.series_id, e.i, ts, y, greatest(u, d) AS score, greatest(u, d) > 800 AS triggered, sqrt(v) AS vol FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i), l AS (SELECT *, last_value(CASE WHEN triggered THEN i END IGNORE NULLS) OVER w AS at, last_value(CASE WHEN triggered THEN score END IGNORE NULLS) OVER w AS held FROM s WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series_id, ts, {r('y')} AS y, {r('score')} AS score, triggered, {r('CASE WHEN i - "at" < 3 THEN 0.5 * greatest(vol, held, score) ELSE 0 END')} AS extra FROM l""")
def detect_regime_width(spark, sf_dir):
    return _out(D.regime_width(_daily(spark, sf_dir), P, 500.0, 50.0, 800.0, 0.2, 3, 0.5))


KF = "(v + 25) / (v + 25 + 400)"


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, y AS l, 400.0::DOUBLE AS v FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, l + {KF} * (y - l), (1 - {KF}) ** 2 * (v + 25) + ({KF}) ** 2 * 400 FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
sm AS (SELECT e.series_id, e.i, l AS s FROM e JOIN (SELECT series_id, max(i) AS n FROM i GROUP BY 1) z ON z.series_id = e.series_id AND z.n = e.i UNION ALL SELECT e.series_id, e.i, l + v / (v + 25) * (sm.s - l) FROM sm JOIN e ON e.series_id = sm.series_id AND e.i = sm.i - 1)
SELECT i.series_id, ts, {r('y')} AS y, {r('l')} AS level, {r('v')} AS variance, {r('sm.s')} AS smoothed FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i JOIN sm ON sm.series_id = e.series_id AND sm.i = e.i""")
def filter_kalman_level(spark, sf_dir):
    return _out(D.kalman_level(_daily(spark, sf_dir), P, 25.0, 400.0), "series_id", "ts", "y", "level", "variance", "smoothed")


@query(f"""WITH RECURSIVE {DI}, e AS (SELECT series_id, i, {KF.replace('v', '400')} * (y - 500) AS m, (1 - {KF.replace('v', '400')}) ** 2 * 425 + ({KF.replace('v', '400')}) ** 2 * 400 AS v, 500.0::DOUBLE AS c FROM i WHERE i = 1
UNION ALL SELECT i.series_id, i.i, m + {KF} * (y - 500 - m), (1 - {KF}) ** 2 * (v + 25) + ({KF}) ** 2 * 400, 500 + m FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1)
SELECT i.series_id, ts, {r('y')} AS y, 500.0::DOUBLE AS structural, {r('c')} AS corrected FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i""")
def filter_residual_corrector(spark, sf_dir):
    return _out(D.correct_residuals(_daily(spark, sf_dir).withColumn("structural", F.lit(500.0)), P, "structural", 25.0, 400.0))


CONF = f"{V.GEO}, ca AS (SELECT *, abs(z - 4500) AS e FROM geo WHERE id % 2 = 0), rk AS (SELECT grp, e, row_number() OVER (PARTITION BY grp ORDER BY e) AS k, count(*) OVER (PARTITION BY grp) AS n FROM ca), ra AS (SELECT grp, max(n) AS n, min(CASE WHEN k >= ceil(round((n + 1) * 0.8, 9)) THEN e END) AS radius FROM rk GROUP BY 1)"


@query(f"WITH {CONF} SELECT grp, n, {r('radius')} AS radius FROM ra")
def conformal_groups(spark, sf_dir):
    g = V.geo(spark, sf_dir).where("id % 2 = 0")
    return _out(C.split_radius(g, ["grp"], F.col("z") - 4500, 0.2))


@query(f"WITH {CONF}, t AS (SELECT g.grp, z BETWEEN 4500 - radius AND 4500 + radius AS i, 2 * radius AS w FROM geo g JOIN ra ON ra.grp = g.grp WHERE id % 2 = 1) SELECT grp, count(*) AS n, {r('avg(i::INTEGER)')} AS coverage, {r('avg(w)')} AS width FROM t GROUP BY 1")
def conformal_report(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("p", F.lit(4500.0))
    radius = C.split_radius(g.where("id % 2 = 0"), ["grp"], F.col("z") - F.col("p"), 0.2).drop("n")
    return _out(C.report(C.intervals(g.where("id % 2 = 1"), radius, ["grp"], "p"), ["grp"], "z"))


@query(f"WITH {V.GEO}, s AS (SELECT grp, abs(z - 4500) AS e, sum(x + 1) AS w FROM geo GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY e) AS c, sum(w) OVER (PARTITION BY grp) AS t FROM s) SELECT grp, {r('min(e)')} AS quantile FROM c WHERE c >= 0.8 * t - 1e-9 GROUP BY 1")
def conformal_weighted(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("w", F.col("x") + 1)
    return _out(C.weighted_radius(g, ["grp"], F.col("z") - 4500, "w", 0.2))


@query(f"""WITH {V.GEO}, p AS (SELECT a.id, abs(b.z - 4500) AS e, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS k FROM geo a JOIN geo b ON a.id % 2 = 1 AND b.id % 2 = 0 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64),
q AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e) AS k, count(*) OVER (PARTITION BY id) AS n FROM p WHERE k <= 9) SELECT id, {r('coalesce(min(CASE WHEN k >= ceil(round((n + 1) * 0.8, 9)) THEN e END), max(e))')} AS radius FROM q GROUP BY 1""")
def conformal_nearest(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("e", F.col("z") - 4500)
    return _out(C.nearest_radius(g.where("id % 2 = 1"), g.where("id % 2 = 0"), "id", "e", 9, 8.0, 0.2))


@query(f"""WITH {V.DAILY}, c AS (SELECT (SELECT min(ts) FROM daily) + 9 + 10 * range::INTEGER AS cutoff FROM range(2)), k AS (SELECT cutoff, series_id, abs(y - 500) AS e, row_number() OVER (PARTITION BY cutoff, series_id ORDER BY abs(y - 500)) AS k, count(*) OVER (PARTITION BY cutoff, series_id) AS n FROM daily JOIN c ON ts <= cutoff)
SELECT cutoff, series_id, {r('coalesce(min(CASE WHEN k >= ceil(round((n + 1) * 0.8, 9)) THEN e END), max(e))')} AS radius FROM k GROUP BY 1, 2""")
def conformal_rolling(spark, sf_dir):
    d = _daily(spark, sf_dir)
    cuts = d.agg(F.min("ts").alias("a")).select(F.explode(F.array(F.date_add("a", 9), F.date_add("a", 19))).alias("cutoff"))
    return _out(C.rolling_radius(d, ["series_id"], "ts", F.col("y") - 500, 0.2, cuts))


@query(f"""WITH {V.BINARY}, g AS (SELECT p, sum(y)::DOUBLE AS s, count(*) AS n FROM bin GROUP BY 1), c AS (SELECT p, sum(s) OVER o AS s, sum(n) OVER o AS n, row_number() OVER o AS k FROM g WINDOW o AS (ORDER BY p)),
mm AS (SELECT x.k, x.p, (SELECT max(lo) FROM (SELECT a.k, min((b.s - a.s) / (b.n - a.n)) AS lo FROM (SELECT k, s, n FROM c UNION ALL SELECT 0, 0, 0) a JOIN c b ON b.k > a.k AND b.k >= x.k WHERE a.k < x.k GROUP BY a.k)) AS rate FROM c x)
SELECT max(p) AS upto, {r('rate')} AS rate FROM mm GROUP BY round(rate, 12), rate""")
def calibrate_isotonic(spark, sf_dir):
    """The blocks against the max-min formula of isotonic regression."""
    return _out(C.isotonic(V.binary(spark, sf_dir), "p", "y"))


def _newton(k: int) -> str:
    return f"n{k} AS MATERIALIZED (SELECT a + (hbb * ga - hab * gb) / det AS a, b + (haa * gb - hab * ga) / det AS b FROM (SELECT *, haa * hbb - hab * hab AS det FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum((y - q) * p) AS ga, sum(y - q) AS gb, sum(q * (1 - q) * p * p) + 1e-9 AS haa, sum(q * (1 - q) * p) AS hab, sum(q * (1 - q)) + 1e-9 AS hbb FROM (SELECT y, p, a, b, 1 / (1 + exp(-(p * a + b))) AS q FROM bin, n{k - 1}))))"


def _warmth(k: int) -> str:
    return f"k{k} AS MATERIALIZED (SELECT greatest(1e-3, k + g / (h + 1e-12)) AS k FROM (SELECT any_value(k) AS k, sum((y - q) * x) AS g, sum(q * (1 - q) * x * x) AS h FROM (SELECT y, p - 1 AS x, k, 1 / (1 + exp(-(p - 1) * k)) AS q FROM bin, k{k - 1})))"


@query(f"WITH {V.BINARY}, n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b), {', '.join(map(_newton, range(1, 21)))}, k0 AS (SELECT 1.0::DOUBLE AS k), {', '.join(map(_warmth, range(1, 31)))} SELECT {r('a')} AS a, {r('b')} AS b, {r('1 / k')} AS temperature FROM n20, k30")
def calibrate_platt_temperature(spark, sf_dir):
    b = V.binary(spark, sf_dir)
    a, c = C.platt(b, "p", "y")
    return _out(spark.createDataFrame([(a, c, C.temperature(b.withColumn("x", F.col("p") - 1), "x", "y"))], "a double, b double, temperature double"))
