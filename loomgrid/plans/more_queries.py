"""Queries of model selection, boosted forecasts, sequence matching and further metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import forecasting as X
from loomgrid.operators import metrics as M
from loomgrid.operators import splits as S
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.plans.metric_queries import SPLIT, _split
from loomgrid.plans.series_queries import P, SCORES, _daily, _out, _scores
from loomgrid.sources.tables import table


@query(f"""WITH {SPLIT}, av AS (SELECT series_id, avg(y) AS m FROM b WHERE back <= 7 GROUP BY 1), m AS (SELECT j.series_id, any_value(nm) AS nm, avg(2 * abs(mean - y) / (abs(mean) + abs(y))) AS s0, avg(abs(mean - y)) AS a0, avg(2 * abs(m - y) / (abs(m) + abs(y))) AS s1, avg(abs(m - y)) AS a1 FROM j JOIN sc ON sc.series_id = j.series_id JOIN av ON av.series_id = j.series_id GROUP BY 1)
SELECT series_id, 'seasonal_naive' AS model, 1.0::DOUBLE AS relative_smape, 1.0::DOUBLE AS relative_mase, 1.0::DOUBLE AS owa FROM m UNION ALL SELECT series_id, 'window_average', {r('s1 / s0')}, {r('a1 / a0')}, {r('(s1 / s0 + a1 / a0) / 2')} FROM m""")
def metric_competition(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    naive = M.naive_scale(train, "series_id", "ts", "y", 7, ["series_id"])
    other = X.window_average(train, P, 7, 7).select("series_id", "ts", F.col("mean").alias("other"))
    rows = rows.join(other, ["series_id", "ts"])
    a = M.forecast_metrics(rows, ["series_id"], naive=naive).withColumn("model", F.lit("seasonal_naive"))
    b = M.forecast_metrics(rows, ["series_id"], "other", naive=naive).withColumn("model", F.lit("window_average"))
    return _out(M.competition(a.unionByName(b), ["series_id"], baseline="seasonal_naive"))


@query(f"WITH s AS (SELECT c_mktsegment AS level, sum(c_acctbal * (c_custkey % 5 + 1)) / sum(c_custkey % 5 + 1) AS s FROM customer GROUP BY 1) SELECT {r('avg(s)', 4)} AS score FROM s")
def metric_equal_level(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("w", F.col("c_custkey") % 5 + 1)
    return M.equal_level(c, "c_mktsegment", "c_acctbal", "w").select(rounded("score", 4).alias("score"))


@query(f"WITH {V.DAILY}, h AS (SELECT series_id, ts, (y >= 700)::INTEGER AS hit FROM daily) SELECT series_id, ts, hit, coalesce(max(hit) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS within FROM h")
def metric_event_labels(spark, sf_dir):
    return M.event_labels(_daily(spark, sf_dir), "series_id", "ts", "y", 700.0, 3).select("series_id", "ts", "hit", "within")


@query(f"WITH s AS (SELECT l_orderkey, stddev_pop(l_discount) AS s FROM lineitem GROUP BY 1) SELECT {r('avg(s)')} AS volatility FROM s")
def metric_jitter(spark, sf_dir):
    return _out(M.jitter(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount"))


@query(f"WITH {V.FLOWS} SELECT {r('sum(w * (a.n_regionkey - b.n_regionkey) ** 2) / 2', 3)} AS penalty FROM flows JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst")
def graph_laplacian_penalty(spark, sf_dir):
    return M.laplacian_penalty(V.flows(spark, sf_dir), table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").select(rounded("penalty", 3).alias("penalty"))


@query(f"WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score, model) AS k FROM sc), b AS (SELECT series_id, max(score) FILTER (model = 'm5') AS base, max(score) FILTER (k = 1) AS s1, max(score) FILTER (k = 2) AS s2 FROM k GROUP BY 1) SELECT k.series_id, model, 1.0::DOUBLE AS weight FROM k JOIN b ON b.series_id = k.series_id WHERE k = 1 AND s1 <= base * 0.95 AND s1 <= s2 * 0.99")
def forecast_gate(spark, sf_dir):
    return _out(X.gate(_scores(spark, sf_dir), ["series_id"], "m5", 0.05, 0.01))


@query()
def forecast_auto_forecaster(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return _out(X.auto_forecast(d, P, 5, S.rolling_origin(d, "ts", 5, 5, 15, 2)))


@query()
def split_environmental(spark, sf_dir):
    return S.environmental(V.geo(spark, sf_dir), "id", ["x", "y"], 4)
