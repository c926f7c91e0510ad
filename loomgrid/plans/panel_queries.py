"""Queries of panel checks, aggregates, windows and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import calendar as cal
from loomgrid.functions.columns import rounded
from loomgrid.operators import panel as P
from loomgrid.operators import windows as X
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table

DAILY = P.Panel(allow_irregular=True)


@query(f"WITH {V.DAILY} SELECT series_id, ts, y FROM daily WHERE isnan(y) OR abs(y) = 'inf'::DOUBLE OR y IS NULL")
def panel_not_finite(spark, sf_dir):
    return P.not_finite(V.daily(spark, sf_dir), DAILY).select("series_id", "ts", "y")


@query("SELECT event_type AS series_id, ts::DATE AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def panel_duplicate_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("ts"), F.col("value").alias("y"))
    return P.duplicate_keys(e, DAILY)


ORDERS = "od AS (SELECT o_orderpriority AS series_id, o_orderdate::DATE AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("y"))


@query(f"WITH {ORDERS}, g AS (SELECT series_id, ts, (ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts))::BIGINT * 86400 AS gap_seconds FROM od) SELECT * FROM g WHERE gap_seconds <> 86400")
def panel_frequency_gaps(spark, sf_dir):
    return P.frequency_gaps(_orders(spark, sf_dir), DAILY)


@query(f"""WITH {ORDERS}, g AS (SELECT series_id, (ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts))::BIGINT * 86400 AS step FROM od),
c AS (SELECT series_id, step, count(*) AS n FROM g WHERE step IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, step) AS rn FROM c) SELECT series_id, step AS step_seconds FROM k WHERE rn = 1""")
def panel_inferred_step(spark, sf_dir):
    return P.infer_step(_orders(spark, sf_dir), DAILY)


@query(f"WITH {V.DAILY}, t AS (SELECT series_id, ts, CASE WHEN n % 3 = 0 THEN NULL ELSE y END AS y FROM daily), a AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS anchor FROM t) SELECT series_id, ts, {r('y')} AS y, anchor FROM a WHERE y IS NOT NULL")
def panel_observed_targets(spark, sf_dir):
    d = V.daily(spark, sf_dir).withColumn("y", F.when(F.col("n") % 3 != 0, F.col("y"))).drop("n")
    return P.observed(d, DAILY).select("series_id", "ts", rounded("y").alias("y"), "anchor")


@query("SELECT true AS is_panel FROM (SELECT 1)")
def panel_is_panel(spark, sf_dir):
    return P.is_panel(V.daily(spark, sf_dir), DAILY)


@query(f"WITH {V.DAILY}, l AS (SELECT series_id, max(ts) AS t FROM daily GROUP BY 1) SELECT series_id, h.range::INTEGER AS horizon, (t + h.range::INTEGER) AS ts FROM l CROSS JOIN range(1, 8) h")
def panel_future_index(spark, sf_dir):
    return P.future_index(V.daily(spark, sf_dir), DAILY, 7)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IS NULL OR l_quantity < 0 OR isnan(l_quantity)")
def panel_bad_weights(spark, sf_dir):
    return P.check_weights(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber")


@query(f"""SELECT l_returnflag AS series_id, date_trunc('month', l_shipdate)::DATE AS ts, {r('sum(l_quantity * l_extendedprice) / sum(l_quantity)')} AS y,
{r('sum(l_quantity * l_discount) / sum(l_quantity)')} AS l_discount, {r('sum(l_quantity)')} AS l_quantity FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""")
def panel_weighted_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.trunc(F.to_date("l_shipdate"), "month").alias("ts"), F.col("l_extendedprice").alias("y"), "l_discount", "l_quantity")
    p = P.Panel(known_future=("l_discount",), allow_irregular=True)
    return P.weighted_rows(li, p, "l_quantity").select("series_id", "ts", *[rounded(c).alias(c) for c in ("y", "l_discount", "l_quantity")])


DIAGNOSTICS = f"""{V.SPARSE}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM sparse),
g AS (SELECT series_id, run FROM (SELECT series_id, island, count(*) AS run FROM (SELECT series_id, i - row_number() OVER (PARTITION BY series_id ORDER BY i) AS island FROM i WHERE y = 0) GROUP BY 1, 2)),
m AS (SELECT series_id, max(run) AS longest FROM g GROUP BY 1),
diag AS (SELECT i.series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(y) AS min_y, max(y) AS max_y, {r('avg(y)')} AS mean_y, count(*) FILTER (y = 0) AS zero_count,
  {r('count(*) FILTER (y = 0) / count(*)')} AS zero_fraction, CASE WHEN count(*) FILTER (y <> 0) > 0 THEN {r('count(*) FILTER (y = 0) / count(*) FILTER (y <> 0)')} END AS zero_ratio,
  CASE WHEN count(*) FILTER (y <> 0) > 1 THEN {r('(max(CASE WHEN y <> 0 THEN i END) - min(CASE WHEN y <> 0 THEN i END)) / (count(*) FILTER (y <> 0) - 1)')} END AS mean_nonzero_gap,
  coalesce(any_value(longest), 0)::BIGINT AS longest_zero_run, count(*) FILTER (y = 0) > 0 AS has_zeros FROM i LEFT JOIN m ON i.series_id = m.series_id GROUP BY 1)"""


@query(f"WITH {DIAGNOSTICS} SELECT * FROM diag")
def panel_series_diagnostics(spark, sf_dir):
    d = P.series_diagnostics(V.sparse(spark, sf_dir), DAILY)
    return d.select(*[rounded(c).alias(c) if c in ("mean_y", "zero_fraction", "zero_ratio", "mean_nonzero_gap") else F.col(c) for c in d.columns])


@query(f"WITH {DIAGNOSTICS} SELECT count(*) AS series, sum(n)::BIGINT AS n_rows, sum(zero_count)::BIGINT AS zero_count, max(longest_zero_run) AS longest_zero_run, {r('sum(zero_count) / sum(n)')} AS zero_fraction FROM diag")
def panel_frame_diagnostics(spark, sf_dir):
    return P.frame_diagnostics(V.sparse(spark, sf_dir), DAILY).withColumn("zero_fraction", rounded("zero_fraction"))


@query(f"WITH {V.DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS c FROM daily) SELECT series_id, i // 5 AS block, {r('sum(y)')} AS y FROM i WHERE c % 5 = 0 GROUP BY 1, 2")
def panel_temporal_rollup(spark, sf_dir):
    return P.temporal_rollup(V.daily(spark, sf_dir), DAILY, 5).withColumn("y", rounded("y"))


W_ = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


@query(f"""WITH RECURSIVE {V.DAILY}, i AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM daily),
e AS (SELECT series_id, i, y AS e FROM i WHERE i = 1 UNION ALL SELECT i.series_id, i.i, 0.3 * i.y + 0.7 * e.e FROM e JOIN i ON i.series_id = e.series_id AND i.i = e.i + 1),
f AS (SELECT series_id, ts, y, i - 1 AS idx, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 7) OVER w AS l7, lag(y, 8) OVER w AS l8,
 avg(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7, avg(y) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS p14, stddev_pop(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7,
 min(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n5, max(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x5 FROM i {W_})
SELECT f.series_id, ts, {r('y')} AS y, idx::INTEGER AS calendar_elapsed_index, (idx % 7)::INTEGER AS calendar_elapsed_phase_7, {r('l1')} AS target_lag_1, {r('l7')} AS target_lag_7, {r('m7')} AS target_roll_mean_7,
 {r('p14')} AS target_partial_roll_mean_14, {r('s7')} AS target_roll_std_7, {r('n5')} AS target_roll_min_5, {r('x5')} AS target_roll_max_5, {r('l1 - l8')} AS target_delta_lag_7, {r('(l1 - l7) / 6')} AS target_roll_trend_7,
 {r('e.e')} AS target_ewm_alpha_030 FROM f JOIN e ON e.series_id = f.series_id AND e.i = f.idx WHERE idx >= 8""")
def window_lag_features(spark, sf_dir):
    d = X.lag_features(V.daily(spark, sf_dir).drop("n"), DAILY, lags=(1, 7), means=(7,), partial_means=(14,), stds=(7,), mins=(5,), maxs=(5,), ewm_percent=(30,), deltas=(7,), trends=(7,), phases=(7,))
    return d.select(*[F.col(c) if c in ("series_id", "ts", "calendar_elapsed_index", "calendar_elapsed_phase_7") else rounded(c).alias(c) for c in d.columns])


@query(f"""WITH {V.DAILY}, w AS (SELECT series_id, ts, y, median(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM daily),
u AS (SELECT series_id, ts, any_value(y) AS y, any_value(m) AS m, median(abs(x - m)) AS mad FROM (SELECT series_id, ts, y, m, unnest(l) AS x FROM w) GROUP BY 1, 2)
SELECT series_id, ts, {r('y')} AS y, {r('m')} AS rolling_median, {r('mad')} AS rolling_mad FROM u""")
def window_rolling_median(spark, sf_dir):
    return X.rolling_median(V.daily(spark, sf_dir).drop("n"), DAILY, 5).select("series_id", "ts", *[rounded(c).alias(c) for c in ("y", "rolling_median", "rolling_mad")])


@query(f"WITH {V.DAILY} SELECT series_id, ts, least(floor((row_number() OVER (PARTITION BY ts ORDER BY y, series_id) - 1) * 3 / count(*) OVER (PARTITION BY ts)), 2)::INTEGER AS bucket FROM daily")
def window_rank_buckets(spark, sf_dir):
    return X.rank_buckets(V.daily(spark, sf_dir), "y", "series_id", 3, "ts").select("series_id", "ts", "bucket")


@query(f"""WITH {V.DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY y, series_id) AS up, row_number() OVER (PARTITION BY ts ORDER BY y DESC, series_id) AS down FROM daily)
SELECT series_id, ts, {r('y')} AS y, CASE WHEN down <= 2 THEN 'long' ELSE 'short' END AS side FROM k WHERE down <= 2 OR up <= 2""")
def window_extremes(spark, sf_dir):
    return X.extremes(V.daily(spark, sf_dir), "y", "series_id", 2, "ts").select("series_id", "ts", rounded("y").alias("y"), "side")


@query(f"WITH {V.RANKING} SELECT grp, id, rank() OVER (PARTITION BY grp ORDER BY rel) + (count(*) OVER (PARTITION BY grp, rel) - 1) / 2 AS avg_rank FROM rk")
def window_average_ranks(spark, sf_dir):
    return V.ranking(spark, sf_dir).select("grp", "id", X.average_rank("rel", "grp").alias("avg_rank"))


@query(f"WITH {V.DAILY}, b AS (SELECT series_id, ts, {r('y')} AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC)::INTEGER AS back FROM daily) SELECT * FROM b WHERE back <= 3")
def window_last_rows(spark, sf_dir):
    return X.last_rows(V.daily(spark, sf_dir).drop("n"), DAILY, 3).withColumn("y", rounded("y"))


@query(f"""SELECT o_orderkey, isodow(o_orderdate)::INTEGER - 1 AS day_of_week, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day, dayofyear(o_orderdate)::INTEGER AS day_of_year,
{r('sin(2 * pi() * (isodow(o_orderdate) - 1) / 7)')} AS day_of_week_sin, {r('cos(2 * pi() * (isodow(o_orderdate) - 1) / 7)')} AS day_of_week_cos, {r('sin(2 * pi() * (month(o_orderdate) - 1) / 12)')} AS month_sin, {r('cos(2 * pi() * (month(o_orderdate) - 1) / 12)')} AS month_cos,
{r('sin(2 * pi() * (day(o_orderdate) - 1) / 31)')} AS day_sin, {r('cos(2 * pi() * (day(o_orderdate) - 1) / 31)')} AS day_cos, (day(o_orderdate) <= 3)::INTEGER AS month_start, (day(o_orderdate) BETWEEN 14 AND 16)::INTEGER AS month_middle,
(day(o_orderdate) + 2 >= day(last_day(o_orderdate)))::INTEGER AS month_end FROM orders""")
def calendar_features(spark, sf_dir):
    made = cal.calendar_features("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[rounded(c).alias(k) if k.endswith(("_sin", "_cos")) else c.alias(k) for k, c in made.items()])


@query(f"""WITH t AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS d FROM events)
SELECT event_id, {r('d')} AS elapsed, {r('sin(2 * pi() * d / 7)')} AS sin_1, {r('cos(2 * pi() * d / 7)')} AS cos_1, {r('sin(4 * pi() * d / 7)')} AS sin_2, {r('cos(4 * pi() * d / 7)')} AS cos_2 FROM t""")
def calendar_fourier_elapsed(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", cal.elapsed_days(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "ts").alias("elapsed"))
    return t.select("event_id", rounded("elapsed").alias("elapsed"), *[rounded(c).alias(k) for k, c in cal.fourier("elapsed", 7, 2).items()])


@query(f"""SELECT event_id, value % 24 BETWEEN 6 AND 18 AS by_day, (value % 24 >= 20 OR value % 24 <= 4) AS by_night,
{r('''CASE WHEN (value % 24 >= 20 OR value % 24 <= 4) THEN -1 ELSE 1 END * least(least(abs(value % 24 - 20), 24 - abs(value % 24 - 20)), least(abs(value % 24 - 4), 24 - abs(value % 24 - 4)))''')} AS night_distance FROM events""")
def calendar_periodic(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", cal.periodic_contains("value", 24, 6, 18).alias("by_day"), cal.periodic_contains("value", 24, 20, 4).alias("by_night"), rounded(cal.periodic_signed_distance("value", 24, 20, 4)).alias("night_distance")
    )


HOLIDAYS = [("new_year", "1995-01-01", -1, 1), ("mid_year", "1996-07-04", 0, 2), ("winter", "1997-12-25", -3, 0)]


@query(f"""WITH h(name, day, lo, hi) AS (VALUES {', '.join(f"('{n}', DATE '{d}', {a}, {b})" for n, d, a, b in HOLIDAYS)})
SELECT o_orderkey, name AS holiday, (o_orderdate::DATE - day)::INTEGER AS offset_days FROM orders JOIN h ON o_orderdate::DATE - day BETWEEN lo AND hi""")
def calendar_event_windows(spark, sf_dir):
    h = spark.createDataFrame(HOLIDAYS, "holiday string, day string, lo int, hi int").withColumn("day", F.to_date("day"))
    # A row a day of each window makes the interval join an equality join.
    days = h.select("holiday", F.explode(F.sequence("lo", "hi")).alias("offset_days"), "day").withColumn("day", F.date_add("day", F.col("offset_days")))
    return table(spark, sf_dir, "orders").join(F.broadcast(days), F.to_date("o_orderdate") == F.col("day")).select("o_orderkey", "holiday", "offset_days")


@query(f"""WITH {V.DAILY}, c AS (SELECT series_id, ts, n::DOUBLE AS n, (abs(n - 12) <= 1e-12)::INTEGER::DOUBLE AS i12, isodow(ts) - 1 AS dow FROM daily)
SELECT series_id, ts, i12 AS covariate_n_is_12, {r('n * sin(2 * pi() * dow / 7)')} AS covariate_n_x_day_of_week_sin, {r('i12 * cos(2 * pi() * dow / 7)')} AS covariate_n_is_12_x_day_of_week_cos FROM c""")
def window_covariate_interactions(spark, sf_dir):
    d = V.daily(spark, sf_dir).withColumn("n", F.col("n").cast("double"))
    flags, waves = X.indicators("n", [12.0]), cal.calendar_features("ts")
    a = X.interactions({"covariate_n": F.col("n")}, {"day_of_week_sin": waves["day_of_week_sin"]}) | X.interactions(flags, {"day_of_week_cos": waves["day_of_week_cos"]})
    return d.select("series_id", "ts", *[c.alias(k) for k, c in flags.items()], *[rounded(c).alias(k) for k, c in a.items()])
