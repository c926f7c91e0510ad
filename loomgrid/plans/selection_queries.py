"""Queries of expert banks, corrections, wrappers, automatic filters and forecasts from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import forecasting as X
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.plans.series_queries import BACK, DI, HEAD, HZ, P, _daily, _out, trend_filter

SIMPLE = [("naive", {}), ("seasonal_naive", {"season": 7}), ("window_average", {"size": 9}), ("seasonal_window_average", {"season": 7, "cycles": 2})]


def levels_sql(rows: str) -> str:
    """(model, o, series_id, phase, mean) of the SIMPLE models from a table (series_id, y, back): phase -1 is every step."""
    return f"""SELECT 'naive' AS model, 0 AS o, series_id, -1 AS phase, y AS mean FROM {rows} WHERE back = 1 UNION ALL SELECT 'seasonal_naive', 1, series_id, 7 - back, y FROM {rows} WHERE back <= 7
UNION ALL SELECT 'window_average', 2, series_id, -1, avg(y) FROM {rows} WHERE back <= 9 GROUP BY 3 UNION ALL SELECT 'seasonal_window_average', 3, series_id, 6 - (back - 1) % 7, avg(y) FROM {rows} WHERE back <= 14 GROUP BY 3, 4"""


BANK = f"{BACK}, tr AS (SELECT series_id, y, back - 6 AS back FROM bk WHERE back > 6), te AS (SELECT series_id, ts, y, 7 - back AS h FROM bk WHERE back <= 6), lv AS ({levels_sql('tr')}), ls AS (SELECT model, o, avg((mean - y) ** 2) AS loss, count(*) AS n FROM te JOIN lv ON lv.series_id = te.series_id AND (phase = -1 OR phase = (h - 1) % 7) GROUP BY 1, 2)"


@query(f"WITH {BANK} SELECT model, {r('loss')} AS loss, n FROM ls")
def forecast_bank_scores(spark, sf_dir):
    return _out(X.bank_scores(_daily(spark, sf_dir), P, 6, SIMPLE), "model", "loss", "n")


@query(f"WITH {BANK}, fl AS ({levels_sql('bk')}), b AS (SELECT model FROM ls ORDER BY round(loss, 9), o LIMIT 1) SELECT {HEAD}, fl.model, {r('mean')} AS mean FROM h JOIN fl ON fl.series_id = h.series_id AND (phase = -1 OR phase = (h.horizon - 1) % 7) JOIN b ON b.model = fl.model")
def forecast_expert_bank(spark, sf_dir):
    return _out(X.expert_bank(_daily(spark, sf_dir), P, 7, 6, SIMPLE), "series_id", "ts", "horizon", "model", "mean")


SCALE = f"{V.DAILY}, st AS (SELECT series_id, avg(y) AS m, greatest(stddev_pop(y), 1e-6) AS s FROM daily GROUP BY 1)"


@query(f"WITH RECURSIVE {DI}, st AS (SELECT series_id, avg(y) AS m, greatest(stddev_pop(y), 1e-6) AS s FROM i GROUP BY 1), {HZ}, e AS (SELECT i.series_id, i, n, (y - m) / s AS l FROM i JOIN st ON st.series_id = i.series_id WHERE i = 1 UNION ALL SELECT i.series_id, i.i, i.n, 0.4 * (i.y - m) / s + 0.6 * e.l FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1 JOIN st ON st.series_id = e.series_id), b AS (SELECT i.series_id, regr_slope((y - m) / s, i) AS b FROM i JOIN st ON st.series_id = i.series_id GROUP BY 1) SELECT hz.series_id, last + horizon AS ts, horizon, 'scaled_theta' AS model, {r('(l + 0.5 * b * (horizon - 1 + 1 / 0.4 - (0.6 ** n) / 0.4)) * s + m')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n JOIN b ON b.series_id = hz.series_id JOIN st ON st.series_id = hz.series_id")
def forecast_scaled(spark, sf_dir):
    return _out(X.scaled(X.theta)(_daily(spark, sf_dir), P, 7, alpha=0.4))


PLUS = f"""{BACK}, va AS (SELECT a.series_id, a.ts, 7 - a.back AS h, a.y, b.y AS mean, a.y - b.y AS r, ((a.ts - DATE '1970-01-01') % 3 + 3) % 3 AS ph FROM bk a JOIN bk b ON a.series_id = b.series_id AND a.back <= 6 AND b.back = 7),
ch AS (SELECT h, avg(r) * count(*) / (count(*) + 5.0) AS c FROM va GROUP BY 1), v1 AS (SELECT va.*, r - c AS r1 FROM va JOIN ch ON ch.h = va.h), cp AS (SELECT ph, avg(r1) * count(*) / (count(*) + 5.0) AS c FROM v1 GROUP BY 1), v2 AS (SELECT v1.*, r1 - c AS r2 FROM v1 JOIN cp ON cp.ph = v1.ph),
cs AS (SELECT series_id, avg(r2) * count(*) / (count(*) + 5.0) AS c FROM v2 GROUP BY 1), v3 AS (SELECT v2.*, r2 - c AS r3 FROM v2 JOIN cs ON cs.series_id = v2.series_id), ok AS (SELECT (avg(r3 * r3) <= avg(r * r))::INTEGER AS ok FROM v3), f AS (SELECT {HEAD.replace("last", "h.last")}, b.y AS mean FROM h JOIN bk b ON b.series_id = h.series_id AND back = 1)"""


@query(f"WITH {PLUS} SELECT f.series_id, f.ts, f.horizon, 'lag_plus' AS model, {r('mean + ok * (coalesce(ch.c, 0) + coalesce(cp.c, 0) + cs.c)')} AS mean FROM f JOIN cs ON cs.series_id = f.series_id LEFT JOIN ch ON ch.h = f.horizon LEFT JOIN cp ON cp.ph = ((f.ts - DATE '1970-01-01') % 3 + 3) % 3, ok")
def forecast_lag_plus(spark, sf_dir):
    return _out(X.lag_plus(_daily(spark, sf_dir), P, 7, ("naive", {}), 6, period=3))


GRID = "gr AS (SELECT row_number() OVER () AS g, q, o FROM (SELECT q, o FROM (VALUES (0.01), (0.1), (1.0)) a(q), (VALUES (0.1), (1.0), (10.0)) b(o) ORDER BY q, o))"


@query(f"""WITH RECURSIVE {DI}, {HZ}, {GRID}, e AS (SELECT series_id, g, q, o, i, n, y AS l, o::DOUBLE AS v FROM i, gr WHERE i = 1 UNION ALL SELECT i.series_id, g, q, o, i.i, i.n, l + (v + q) / (v + q + o) * (y - l), (1 - (v + q) / (v + q + o)) ** 2 * (v + q) + ((v + q) / (v + q + o)) ** 2 * o FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
s AS (SELECT g, sum(0.5 * (ln(2 * pi() * (v + q * (i.i - i.n + 5) + o)) + (i.y - l) ** 2 / (v + q * (i.i - i.n + 5) + o))) AS nll, sum((i.y - l) ** 2) AS sse FROM e JOIN i ON i.series_id = e.series_id AND e.i = e.n - 5 AND i.i > i.n - 5 GROUP BY 1), b AS (SELECT g FROM s ORDER BY round(nll, 6), round(sse, 6), g LIMIT 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'auto_local_level_kalman' AS model, {r('l')} AS mean FROM hz JOIN e ON e.series_id = hz.series_id AND e.i = e.n JOIN b ON b.g = e.g""")
def forecast_auto_local_level_kalman(spark, sf_dir):
    return _out(X.auto_kalman_level(_daily(spark, sf_dir), P, 7))


GRID3 = "gr AS (SELECT row_number() OVER () AS g, a, b, c FROM (SELECT a, b, c FROM (VALUES (0.01), (0.1), (1.0)) x(a), (VALUES (0.001), (0.01), (0.1)) y(b), (VALUES (0.1), (1.0), (10.0)) z(c) ORDER BY a, b, c))"


@query(f"""WITH RECURSIVE {DI}, {HZ}, {GRID3}, sr AS (SELECT i.series_id || '|' || g AS k, i, y, a AS ga, b AS gb, c AS gc, g, n, series_id AS sid FROM i, gr), {trend_filter('sr', '@ga', '@gb', '@gc', 'ga gb gc g n sid').replace('(@gc)', '(gc)').replace('(s.gc)::DOUBLE AS a', '(gc)::DOUBLE AS a').replace('(s.gc)::DOUBLE AS c', '(gc)::DOUBLE AS c')},
f0 AS (SELECT kt.*, range AS h FROM kt, range(1, 6) WHERE i = n - 5), f1 AS (SELECT g, sid, h, n, l + t * h AS m, a + 2 * h * b + h * h * c + h * ga + gb * (h - 1) * h * (2 * h - 1) / 6 + gc AS v FROM f0),
s AS (SELECT g, sum(0.5 * (ln(2 * pi() * v) + (y - m) ** 2 / v)) AS nll, sum((y - m) ** 2) AS sse FROM f1 JOIN i ON i.series_id = sid AND i.i = f1.n - 5 + h GROUP BY 1), b AS (SELECT g FROM s ORDER BY round(nll, 6), round(sse, 6), g LIMIT 1)
SELECT hz.series_id, last + horizon AS ts, horizon, 'auto_kalman' AS model, {r('l + t * horizon')} AS mean FROM hz JOIN kt ON kt.sid = hz.series_id AND kt.i = kt.n JOIN b ON b.g = kt.g""")
def forecast_auto_kalman(spark, sf_dir):
    return _out(X.auto_kalman_trend(_daily(spark, sf_dir), P, 7))


@query()
def forecast_mstl_boosted(spark, sf_dir):
    return _out(X.decomposed(_daily(spark, sf_dir), P, 3, [5, 7], X.boosted_lags, lags=(1, 2), windows=(3,), trees=3, depth=2, bins=16))


@query()
def forecast_rectified_recursive(spark, sf_dir):
    return _out(X.rectified_lags(_daily(spark, sf_dir), P, 3, lags=(1, 2), windows=(3,), trees=3, depth=2, bins=16))


PLACES = "pl AS (SELECT series_id, (row_number() OVER (ORDER BY series_id) - 1)::DOUBLE AS x FROM (SELECT DISTINCT event_type AS series_id FROM events))"


@query(f"""WITH {BACK}, {PLACES}, lv AS (SELECT a.series_id, avg(a.y - b.y) AS v FROM bk a JOIN bk b ON a.series_id = b.series_id AND a.back <= 5 AND b.back = 6 GROUP BY 1),
nb AS (SELECT a.series_id, lv.v, row_number() OVER (PARTITION BY a.series_id ORDER BY abs(a.x - b.x), b.series_id) AS k FROM pl a JOIN pl b ON a.series_id <> b.series_id AND abs(a.x - b.x) <= 1.0 JOIN lv ON lv.series_id = b.series_id), c AS (SELECT series_id, avg(v) AS c FROM nb WHERE k <= 2 GROUP BY 1)
SELECT {HEAD.replace("last", "h.last")}, 'kriging' AS model, {r('b.y + coalesce(c, 0)')} AS mean FROM h JOIN bk b ON b.series_id = h.series_id AND back = 1 LEFT JOIN c ON c.series_id = h.series_id""")
def forecast_kriging(spark, sf_dir):
    """Series on a line: neighbours at equal distances have equal weights."""
    d = _daily(spark, sf_dir)
    names = [x.series_id for x in d.select("series_id").distinct().orderBy("series_id").collect()]
    places = spark.createDataFrame([(n, float(k), 0.0) for k, n in enumerate(names)], "series_id string, x double, y double")
    return _out(X.kriged(d, P, 7, places, 2, 1.0, scale=2.0))
