"""Queries of the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import metrics as M
from loomgrid.operators.panel import Panel
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table


def _r(df, *keep):
    return df.select(*[F.col(c) if c in keep or df.schema[c].dataType.simpleString() in ("bigint", "int", "string", "date", "boolean") else rounded(c).alias(c) for c in df.columns])


SPLIT = f"""{V.DAILY}, cut AS (SELECT max(ts) - 7 AS c FROM daily), tr AS (SELECT d.* FROM daily d, cut WHERE ts <= c), te AS (SELECT d.*, (ts - c)::INTEGER AS horizon FROM daily d, cut WHERE ts > c),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM tr),
fc AS (SELECT series_id, (c + 8 - back::INTEGER)::DATE AS ts, (8 - back)::INTEGER AS horizon, y AS mean FROM b, cut WHERE back <= 7),
sc AS (SELECT series_id, avg(abs(d)) AS nm, avg(d * d) AS nq FROM (SELECT series_id, y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM tr) GROUP BY 1),
j AS (SELECT te.series_id, te.y, fc.mean, te.horizon FROM te JOIN fc USING (series_id, ts, horizon))"""


def _split(spark, sf_dir):
    """Training rows, and test rows joined with the seasonal-naive forecast of the last 7 days."""
    from loomgrid.operators.forecasting import seasonal_naive

    d = V.daily(spark, sf_dir).drop("n")
    cut = d.agg(F.date_sub(F.max("ts"), 7).alias("cut"))
    rows = d.crossJoin(F.broadcast(cut))
    train, test = rows.where("ts <= cut").drop("cut"), rows.where("ts > cut").withColumn("horizon", F.datediff("ts", "cut")).drop("cut")
    forecast = seasonal_naive(train, Panel(), 7, 7).drop("model")
    return train, M.aligned(forecast, test, ["series_id", "ts", "horizon"])


@query(f"""WITH {SPLIT} SELECT j.series_id, {r('avg(abs(mean - y))')} AS mae, {r('sqrt(avg((mean - y) ** 2))')} AS rmse, {r('avg(mean - y)')} AS bias, {r('avg(2 * abs(mean - y) / (abs(mean) + abs(y)))')} AS smape,
{r('sqrt(avg((mean - y) ** 2)) / avg(abs(y))')} AS nrmse, {r('sum(abs(mean - y)) / sum(abs(y))')} AS wape, {r('avg(abs(mean - y)) / any_value(nm)')} AS mase, {r('sqrt(avg((mean - y) ** 2) / any_value(nq))')} AS rmsse FROM j JOIN sc ON j.series_id = sc.series_id GROUP BY 1""")
def panel_seasonal_naive_metrics(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    return _r(M.forecast_metrics(rows, ["series_id"], naive=M.naive_scale(train, "series_id", "ts", "y", 7, ["series_id"])))


@query(f"WITH {SPLIT}, m AS (SELECT horizon, avg(abs(mean - y)) AS mae, sqrt(avg((mean - y) ** 2)) AS rmse FROM j GROUP BY 1) SELECT {r('avg(mae)')} AS mae, {r('avg(rmse)')} AS rmse FROM m")
def metric_fold_means(spark, sf_dir):
    rows = _split(spark, sf_dir)[1]
    return _r(M.fold_means(M.forecast_metrics(rows, ["horizon"]), ["mae", "rmse"]))


@query(f"WITH {SPLIT}, m AS (SELECT j.series_id, sqrt(avg((mean - y) ** 2) / any_value(nq)) AS s, sum(y) AS w FROM j JOIN sc ON j.series_id = sc.series_id GROUP BY 1) SELECT {r('sum(s * w) / sum(w)')} AS wrmsse FROM m")
def metric_wrmsse(spark, sf_dir):
    train, rows = _split(spark, sf_dir)
    m = M.forecast_metrics(rows, ["series_id"], naive=M.naive_scale(train, "series_id", "ts", "y", 7, ["series_id"])).join(rows.groupBy("series_id").agg(F.sum("y").alias("w")), "series_id")
    return m.agg(rounded(F.sum(F.col("rmsse") * F.col("w")) / F.sum("w")).alias("wrmsse"))


QL = {0.1: "q10", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.9: "q90"}
QV = "qv AS (SELECT l_returnflag AS grp, l_orderkey, l_linenumber, l_quantity AS y, (l_linenumber * 3 % 11 + 5)::DOUBLE AS q10, (l_linenumber * 2 + 10)::DOUBLE AS q25, (l_partkey % 30 + 15)::DOUBLE AS q50, (l_suppkey % 20 + 30)::DOUBLE AS q75, 44.0::DOUBLE AS q90 FROM lineitem)"


def _quantiles(spark, sf_dir):
    n, d = F.col("l_linenumber"), "double"
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", n, F.col("l_quantity").alias("y"), (n * 3 % 11 + 5).cast(d).alias("q10"), (n * 2 + 10).cast(d).alias("q25"), (F.col("l_partkey") % 30 + 15).cast(d).alias("q50"), (F.col("l_suppkey") % 20 + 30).cast(d).alias("q75"), F.lit(44.0).alias("q90"))


PIN = " + ".join(f"(CASE WHEN y >= {c} THEN {k} * (y - {c}) ELSE (1 - {k}) * ({c} - y) END)" for k, c in QL.items())


@query(f"""WITH {QV} SELECT grp, {r('avg((y BETWEEN q10 AND q90)::INTEGER)')} AS coverage, {r('avg(q90 - q10)')} AS width, {r(f'avg(({PIN}) / 5)')} AS pinball, {r(f'avg(2 * ({PIN}) / 5)')} AS crps,
{r('avg((0.5 * abs(y - q50) + 0.1 * ((q90 - q10) + 10 * greatest(q10 - y, 0) + 10 * greatest(y - q90, 0))) / 1.5)')} AS wis, {r('avg((q25 < q10 OR q50 < q25 OR q75 < q50 OR q90 < q75)::INTEGER)')} AS crossing_rate FROM qv GROUP BY 1""")
def metric_intervals(spark, sf_dir):
    return _r(M.interval_metrics(_quantiles(spark, sf_dir), ["grp"], "y", QL, 0.2))


@query(f"""WITH {QV} SELECT l_orderkey, l_linenumber, q10 AS r0, greatest(q10, q25) AS r1, greatest(q10, q25, q50) AS r2, greatest(q10, q25, q50, q75) AS r3, greatest(q10, q25, q50, q75, q90) AS r4,
(CASE WHEN y >= q90 THEN 0.9 WHEN y >= q75 THEN 0.75 WHEN y >= q50 THEN 0.5 WHEN y >= q25 THEN 0.25 WHEN y >= q10 THEN 0.1 ELSE 0 END)::DOUBLE AS pit FROM qv""")
def metric_quantile_repair_pit(spark, sf_dir):
    rows = _quantiles(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(f"r{k}") for k, c in enumerate(M.repaired(list(QL.values())))], M.pit_level("y", QL).alias("pit"))


LL = "-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))"


@query(f"WITH {V.BINARY} SELECT count(*) AS n, sum(y)::BIGINT AS positives, {r(f'avg({LL})')} AS log_loss, {r('avg((p - y) ** 2)')} AS brier FROM bin")
def metric_binary(spark, sf_dir):
    return _r(M.binary_metrics(V.binary(spark, sf_dir), "y", "p"))


@query(f"WITH {V.BINARY}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM bin) SELECT {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS auc FROM k")
def metric_roc_auc(spark, sf_dir):
    return _r(M.roc_auc(V.binary(spark, sf_dir), "y", "p"))


@query(f"WITH {V.BINARY}, s AS (SELECT p, sum(y) AS pos, count(*) AS n FROM bin GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM s) SELECT {r('sum(pos * tp / m) / sum(pos)')} AS ap FROM c")
def metric_pr_auc(spark, sf_dir):
    return _r(M.pr_auc(V.binary(spark, sf_dir), "y", "p"))


CAL = f"{V.BINARY}, cb AS (SELECT least(floor(p * 10), 9)::INTEGER AS bucket, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM bin GROUP BY 1)"


@query(f"WITH {CAL} SELECT bucket, n, {r('mean_p')} AS mean_p, {r('rate')} AS rate, {r('abs(mean_p - rate)')} AS gap FROM cb")
def metric_calibration_buckets(spark, sf_dir):
    return _r(M.calibration_buckets(V.binary(spark, sf_dir), "y", "p", 10))


@query(f"WITH {CAL} SELECT {r('sum(n * abs(mean_p - rate)) / sum(n)')} AS ece FROM cb")
def metric_ece(spark, sf_dir):
    return _r(M.ece(V.binary(spark, sf_dir), "y", "p", 10))


RANKED = f"{V.RANKING}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS pos, row_number() OVER (PARTITION BY grp ORDER BY rel DESC, id) AS ideal FROM rk), h AS (SELECT *, sum((rel > 0)::INTEGER) OVER (PARTITION BY grp ORDER BY pos) AS hits FROM k)"


@query(f"""WITH {RANKED}, g AS (SELECT grp, sum(CASE WHEN pos <= 3 THEN (2 ** rel - 1) / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 3 THEN (2 ** rel - 1) / log2(ideal + 1) ELSE 0 END) AS best,
coalesce(avg(CASE WHEN rel > 0 THEN hits / pos END), 0) AS ap, coalesce(1 / min(CASE WHEN rel > 0 THEN pos END), 0) AS rr FROM h GROUP BY 1)
SELECT {r('avg(CASE WHEN best <> 0 THEN dcg / best ELSE 0 END)')} AS ndcg, {r('avg(ap)')} AS "map", {r('avg(rr)')} AS mrr, count(*) AS groups FROM g""")
def metric_ranking(spark, sf_dir):
    return _r(M.ranking_metrics(V.ranking(spark, sf_dir), "grp", "rel", "score", "id", 3))


@query(f"""WITH {V.RANKING}, k AS (SELECT grp, (rel = 3)::INTEGER AS p, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS pos FROM rk),
g AS (SELECT grp, sum(p) AS n, sum(p) FILTER (pos <= 2) AS top, min(CASE WHEN p = 1 THEN pos END) AS f FROM k GROUP BY 1 HAVING sum(p) > 0)
SELECT {r('avg(coalesce(top, 0) / n)')} AS recall, {r('avg((coalesce(top, 0) > 0)::INTEGER)')} AS hit, {r('avg(1 / f)')} AS mrr, count(*) AS groups FROM g""")
def metric_links(spark, sf_dir):
    rows = V.ranking(spark, sf_dir).withColumn("p", (F.col("rel") == 3).cast("int"))
    return _r(M.link_metrics(rows, "grp", "p", "score", "id", 2))


@query("""WITH t AS (SELECT (l_partkey % 4)::INTEGER AS a, (l_suppkey % 4)::INTEGER AS b FROM lineitem WHERE l_partkey % 4 <> 3 OR l_suppkey % 4 <> 0), c AS (SELECT x.range::INTEGER AS a, y.range::INTEGER AS b FROM range(4) x CROSS JOIN range(4) y),
n AS (SELECT c.a, c.b, count(t.a) AS n FROM c LEFT JOIN t ON c.a = t.a AND c.b = t.b GROUP BY 1, 2) SELECT a, b, n, (round((n + 1) / sum(n + 1) OVER (PARTITION BY a), 6) + 0.0) AS p FROM n""")
def metric_confusion(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4).cast("int").alias("a"), (F.col("l_suppkey") % 4).cast("int").alias("b")).where("a <> 3 OR b <> 0")
    return _r(M.confusion(t, "a", "b", 4))


@query(f"""WITH t AS (SELECT c_nationkey AS grp, (c_custkey % 5 - 2) / 10.0::DOUBLE AS w, c_acctbal / 1000 AS g FROM customer) SELECT grp, count(*) FILTER (w > 0) AS longs, count(*) FILTER (w < 0) AS shorts, {r('sum(abs(w))')} AS gross, {r('sum(w)')} AS net,
{r('coalesce(sum(w * g) FILTER (w > 0), 0)')} AS long_return, {r('coalesce(sum(w * g) FILTER (w < 0), 0)')} AS short_return, {r('sum(w * g)')} AS net_return FROM t GROUP BY 1""")
def metric_portfolio(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), ((F.col("c_custkey") % 5 - 2) / 10.0).alias("w"), (F.col("c_acctbal") / 1000).alias("g"))
    return _r(M.portfolio_summary(t, ["grp"], "w", "g"), "grp")


@query("""WITH s AS (SELECT l_returnflag AS grp, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY v) AS c, sum(w) OVER (PARTITION BY grp) AS t FROM s)
SELECT grp, min(v) AS quantile FROM c WHERE c >= 0.75 * t - 1e-9 GROUP BY 1""")
def metric_weighted_quantile(spark, sf_dir):
    return M.weighted_quantile(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_discount", "l_quantity", 0.75)


@query(f"WITH t AS (SELECT doc_id AS id, quality + toxic AS o, 0.2 AS p0, (doc_id % 5) / 10.0 AS p1, 0.8 - (doc_id % 5) / 10.0 AS p2 FROM labels) SELECT id, {r('((p0 - (o <= 0)::INTEGER) ** 2 + (p0 + p1 - (o <= 1)::INTEGER) ** 2 + (p0 + p1 + p2 - 1) ** 2) / 2')} AS rps FROM t")
def metric_rps(spark, sf_dir):
    i = F.col("doc_id")
    t = table(spark, sf_dir, "labels").select(i.alias("id"), (F.col("quality") + F.col("toxic")).alias("o"), F.lit(0.2).alias("p0"), (i % 5 / 10.0).alias("p1"), (0.8 - i % 5 / 10.0).alias("p2"))
    return t.select("id", rounded(M.rps(["p0", "p1", "p2"], "o")).alias("rps"))


@query(f"WITH {V.SPARSE} SELECT series_id, {r('CASE WHEN sum(abs(y)) <> 0 THEN sum(abs(0.25 - y)) / sum(abs(y)) ELSE sum(0.25) END')} AS loss FROM sparse GROUP BY 1")
def metric_intermittent_loss(spark, sf_dir):
    return V.sparse(spark, sf_dir).withColumn("p", F.lit(0.25)).groupBy("series_id").agg(rounded(M.intermittent_loss("p", "y")).alias("loss"))
