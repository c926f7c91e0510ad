"""Queries that write a format, read it back and return its rows, and those of hashes, holidays, roles and further folds."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from loomgrid.functions import hashing as H
from loomgrid.functions import holidays as HO
from loomgrid.functions import ids as I
from loomgrid.functions.columns import rounded
from loomgrid.operators import boosting as B
from loomgrid.operators import causal as C
from loomgrid.operators import conformal as K
from loomgrid.operators import forecasting as X
from loomgrid.operators import joins as J
from loomgrid.operators import panel as P
from loomgrid.operators import spatial as S
from loomgrid.operators import splits as L
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.plans.series_queries import BACK, HEAD, _daily, _out
from loomgrid.sources import files, memory, scalars
from loomgrid.sources.shared import Tables
from loomgrid.sources.tables import table

PANEL = P.Panel(allow_irregular=True)


def _place(spark, name: str) -> str:
    return Tables(spark, name).path()


@query(f"WITH {V.DAILY} SELECT series_id, ts, {r('y')} AS y, n FROM daily")
def source_csv(spark, sf_dir):
    path = _place(spark, "csv")
    V.daily(spark, sf_dir).write.csv(path, header=True)
    return _out(files.read_csv(spark, path, "series_id string, ts date, y double, n long"))


@query(f"WITH {V.DAILY} SELECT series_id, ts::TIMESTAMP + CASE WHEN day(ts) % 4 = 2 THEN INTERVAL 90 MINUTE WHEN day(ts) % 4 = 3 THEN INTERVAL 10 HOUR ELSE INTERVAL 0 HOUR END AS ts, {r('y')} AS y FROM daily")
def source_panel_csv(spark, sf_dir):
    """Times in four notations."""
    path = _place(spark, "panel")
    d = F.date_format("ts", "yyyy-MM-dd")
    k = F.dayofmonth("ts") % 4
    text = F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("T00:00:00"))).when(k == 2, F.concat(d, F.lit(" 01:30"))).otherwise(F.concat(d, F.lit("T12:00:00+02:00")))
    _daily(spark, sf_dir).withColumn("ts", text).write.csv(path, header=True)
    return _out(files.read_panel_csv(spark, path, PANEL))


SHAPES = "SELECT n_nationkey AS k, n_nationkey % 3 = 0 AS area, n_nationkey * 1.5 AS x, n_regionkey + 0.25 AS y FROM nation"


def _features(spark, sf_dir):
    """GeoJSON features: points and triangles, under two keys."""
    k, x, y = F.col("n_nationkey"), F.col("n_nationkey") * F.lit(1.5), F.col("n_regionkey") + F.lit(0.25)
    point = F.format_string('{"type":"Point","coordinates":[%s,%s]}', x, y)
    area = F.format_string('{"type":"Polygon","coordinates":[[[%s,%s],[9.0,0.0],[9.0,9.0],[%s,%s]]]}', x, y, x, y)
    shape = F.when(k % 3 == 0, area).otherwise(point)
    return table(spark, sf_dir, "nation").select(F.format_string('{"type":"Feature","%s":%s,"properties":{"id":"%d"}}', F.when(k % 2 == 0, "geometry").otherwise("cartometry"), shape, k).alias("value"))


def _shapes(rows):
    return rows.select("kind", F.get_json_object("properties", "$.id").alias("id"), rounded(F.coalesce("x", F.col("ring")[0]["x"])).alias("x"), rounded(F.coalesce("y", F.col("ring")[0]["y"])).alias("y"), F.coalesce(F.size("ring"), F.lit(0)).alias("corners"))


SHAPES_SQL = f"SELECT CASE WHEN area THEN 'Polygon' ELSE 'Point' END AS kind, k::VARCHAR AS id, x::DOUBLE AS x, y::DOUBLE AS y, CASE WHEN area THEN 4 ELSE 0 END AS corners FROM ({SHAPES})"


@query(SHAPES_SQL)
def source_geojson(spark, sf_dir):
    path = _place(spark, "geojson")
    whole = _features(spark, sf_dir).agg(F.concat_ws(",", F.collect_list("value")).alias("v"))  # one document of 25 features
    whole.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "v", F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return _shapes(files.read_geojson(spark, path).withColumn("ring", F.when(F.col("kind") == "Polygon", F.col("ring")))).withColumn("corners", F.when(F.col("kind") == "Point", 0).otherwise(F.col("corners")))


@query(SHAPES_SQL)
def source_geojson_lines(spark, sf_dir):
    path = _place(spark, "geojson-lines")
    _features(spark, sf_dir).write.text(path)
    return _shapes(files.read_geojson_lines(spark, path)).withColumn("corners", F.when(F.col("kind") == "Point", 0).otherwise(F.col("corners")))


@query("SELECT c_custkey AS row, round(c_acctbal, 2) + 0.0 AS prediction FROM customer")
def source_predictions(spark, sf_dir):
    path = _place(spark, "predictions")
    files.write_predictions(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.round("c_acctbal", 2).alias("prediction")), path)
    return files.read_csv(spark, path, "row long, prediction double").select("row", rounded("prediction", 2).alias("prediction"))


@query(f"WITH {BACK} SELECT {HEAD.replace('last', 'h.last')}, 'naive' AS model, {r('b.y')} AS mean, 7 AS manifest_horizon FROM h JOIN (SELECT series_id, y FROM bk WHERE back = 1) b ON b.series_id = h.series_id")
def source_forecast_folder(spark, sf_dir):
    path = _place(spark, "forecast")
    files.write_forecast(X.naive(_daily(spark, sf_dir), PANEL, 7), path, "naive", 7)
    manifest, rows = files.read_forecast(spark, path)
    return _out(rows).withColumn("manifest_horizon", F.lit(manifest["horizon"]))


CONFIG = '[[models]]\nname = "naive"\n[[models]]\nname = "window_average"\nsize = 9\n'


@query(f"WITH {BACK} SELECT {HEAD.replace('last', 'h.last')}, 'naive' AS model, {r('b.y')} AS mean FROM h JOIN (SELECT series_id, y FROM bk WHERE back = 1) b ON b.series_id = h.series_id UNION ALL SELECT {HEAD.replace('last', 'h.last')}, 'window_average', {r('m')} FROM h JOIN (SELECT series_id, avg(y) AS m FROM bk WHERE back <= 9 GROUP BY 1) b ON b.series_id = h.series_id")
def source_model_config(spark, sf_dir):
    """Models from a TOML text that went through a file."""
    path = _place(spark, "config")
    spark.createDataFrame([(CONFIG,)], "value string").coalesce(1).write.text(path)
    text = "\n".join(x.value for x in spark.read.text(path).collect())
    return _out(files.run_specs(_daily(spark, sf_dir), PANEL, 7, files.model_specs(text)))


STEP = "SELECT c_custkey AS id, avg(c_acctbal) OVER () AS m, c_custkey % 2 AS x, c_acctbal AS y FROM customer"


@query(f"WITH t AS ({STEP}), l AS (SELECT x, sum(y - m) / (count(*) + 1) AS v FROM t GROUP BY 1) SELECT id, {r('m + v', 4)} AS model, {r('m + v', 4)} AS weights FROM t JOIN l ON l.x = t.x")
def source_model_json(spark, sf_dir):
    """A booster and its bare trees, saved and loaded."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    spec = B.Spec(["x"], "y", trees=1, depth=1, rate=1.0)
    model, a, b = B.fit(d, spec), _place(spark, "model"), _place(spark, "weights")
    files.save_model(spark, model, a)
    files.save_weights(spark, model, b)
    made = d.withColumn("model", B.margin(files.load_model(spark, a))).withColumn("weights", B.margin(files.load_weights(spark, b, spec)))
    return made.select("id", rounded("model", 4).alias("model"), rounded("weights", 4).alias("weights"))


@query("SELECT range::BIGINT AS f0, range * 1.5::DOUBLE AS f1, CASE range % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS name FROM range(40)")
def source_pandas(spark, sf_dir):
    import pandas as pd

    rows = pd.DataFrame({"f0": range(40), "f1": [k * 1.5 for k in range(40)], "name": [("a", "b", None)[k % 3] for k in range(40)]})
    return memory.from_pandas(spark, rows)


@query("SELECT (range * 2)::DOUBLE AS f0, (range * 2 + 1)::DOUBLE AS f1, (range % 5)::DOUBLE AS y, 0.5::DOUBLE AS w FROM range(30)")
def source_numpy(spark, sf_dir):
    return memory.from_numpy(spark, np.arange(60).reshape(30, 2), y=np.arange(30) % 5, weight=np.full(30, 0.5))


@query("SELECT range AS k, range * 0.25::DOUBLE AS distance FROM range(50) WHERE range % 7 <> 0")
def source_relation(spark, sf_dir):
    import duckdb

    return memory.from_relation(spark, duckdb.sql("SELECT range AS k, range * 0.25::DOUBLE AS distance FROM range(50) WHERE range % 7 <> 0"))


@query("SELECT range AS step, CASE WHEN range % 2 = 0 THEN 'loss' ELSE 'rmse' END AS tag, range * 0.125::DOUBLE AS value FROM range(64)")
def source_scalars(spark, sf_dir):
    path = f"{_place(spark, 'scalars')}/events.out.tfevents.0"
    scalars.write_scalars(spark, path, [(k, "rmse" if k % 2 else "loss", k * 0.125) for k in range(64)])
    return scalars.read_scalars(spark, path).drop("path")


MULTIPLY = "(({0})::UHUGEINT * {1}::UHUGEINT & 18446744073709551615::UHUGEINT)"


def _splitmix(x: str) -> str:
    a = f"(({x} + 11400714819323198485::UHUGEINT) & 18446744073709551615::UHUGEINT)"
    b = MULTIPLY.format(f"xor({a}, {a} >> 30)", "13787848793156543929")
    c = MULTIPLY.format(f"xor({b}, {b} >> 27)", "10723151780598845931")
    return f"xor({c}, {c} >> 31)"


@query(f"SELECT range AS x, ({_splitmix('range::UHUGEINT')})::VARCHAR AS mixed FROM range(40)")
def hash_splitmix(spark, sf_dir):
    return spark.createDataFrame([(k, str(H.splitmix64(k))) for k in range(40)], "x long, mixed string")


@query("SELECT p_partkey AS id, ('0x' || left(md5('part:' || p_name), 15))::BIGINT AS stable, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE ('0x' || left(md5('zone:' || p_name), 15))::BIGINT END AS geo FROM part")
def hash_stable_ids(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), H.stable_id("p_name", "part").alias("stable"), I.geo_id(F.when(k % 2 == 0, k.cast("string")).otherwise(F.col("p_name")), "zone").alias("geo"))


@query("SELECT kind, level::INTEGER AS level, CASE kind WHEN 'h3' THEN level BETWEEN 0 AND 15 WHEN 's2' THEN level BETWEEN 0 AND 30 ELSE false END AS valid FROM (VALUES ('h3'), ('s2'), ('zip')) k(kind), (SELECT range - 2 AS level FROM range(36))")
def ids_levels(spark, sf_dir):
    kinds = spark.createDataFrame([("h3",), ("s2",), ("zip",)], "kind string")
    rows = kinds.crossJoin(spark.range(-2, 34).select(F.col("id").cast("int").alias("level")))
    return rows.withColumn("valid", I.level_is_valid("kind", "level"))


US = """y AS (SELECT range::INTEGER AS y FROM range(1992, 1999)), f AS (SELECT y, unnest([{'m': 1, 'd': 1, 'n': 'New Year''s Day'}, {'m': 6, 'd': 19, 'n': 'Juneteenth'}, {'m': 7, 'd': 4, 'n': 'Independence Day'}, {'m': 11, 'd': 11, 'n': 'Veterans Day'}, {'m': 12, 'd': 25, 'n': 'Christmas Day'}]) AS h FROM y),
d AS (SELECT (DATE '1992-01-01' + range::INTEGER) AS d FROM range(2557)), w AS (SELECT d, month(d) AS m, isodow(d) AS k, (day(d) - 1) // 7 + 1 AS nth, month(d + 7) <> month(d) AS final FROM d),
hd AS (SELECT make_date(y, h.m, h.d) AS ds, h.n AS holiday FROM f UNION ALL SELECT d, CASE WHEN m = 1 AND k = 1 AND nth = 3 THEN 'Martin Luther King Jr. Day' WHEN m = 2 AND k = 1 AND nth = 3 THEN 'Washington''s Birthday' WHEN m = 5 AND k = 1 AND final THEN 'Memorial Day' WHEN m = 9 AND k = 1 AND nth = 1 THEN 'Labor Day' WHEN m = 10 AND k = 1 AND nth = 2 THEN 'Columbus Day' WHEN m = 11 AND k = 4 AND nth = 4 THEN 'Thanksgiving' END FROM w)"""


@query(f"WITH {US} SELECT o_orderkey AS id, holiday FROM orders LEFT JOIN (SELECT * FROM hd WHERE holiday IS NOT NULL) ON ds = o_orderdate::DATE")
def calendar_country_holidays(spark, sf_dir):
    days = HO.holiday_table(spark, "US", range(1992, 1999))
    return HO.with_holidays(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", days).select("id", "holiday")


@query("""WITH y AS (SELECT range::INTEGER AS y FROM range(1990, 2040)), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), s AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM a),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * i - h - k) % 7 AS l FROM s), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l) SELECT y AS year, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM m""")
def calendar_easter(spark, sf_dir):
    return spark.createDataFrame([(y, HO.easter(y)) for y in range(1990, 2040)], "year int, easter date")


@query(f"WITH {V.DAILY} SELECT series_id, ts, {r('y')} AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS place FROM daily")
def panel_canonical(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = P.canonical(_daily(spark, sf_dir), PANEL)
    return _out(rows.withColumn("place", F.row_number().over(W.partitionBy("series_id").orderBy(F.monotonically_increasing_id())).cast("long")))


ROLES = P.Panel(static=("kind", "mixed"), known_future=("dow", "gap"), historical=("n",), allow_irregular=True)


@query("SELECT * FROM (VALUES ('kind', 'static'), ('mixed', 'static'), ('dow', 'known_future'), ('gap', 'known_future'), ('n', 'historical')) t(covariate, role)")
def panel_roles(spark, sf_dir):
    return spark.createDataFrame(P.roles(ROLES), "covariate string, role string")


@query(f"WITH {V.DAILY} SELECT series_id, 'mixed' AS covariate, count(DISTINCT n % 3) AS n FROM daily GROUP BY 1 HAVING count(DISTINCT n % 3) > 1")
def panel_varying_statics(spark, sf_dir):
    rows = V.daily(spark, sf_dir).withColumn("kind", F.length("series_id")).withColumn("mixed", F.col("n") % 3)
    return P.varying_statics(rows, ROLES)


@query(f"WITH {BACK} SELECT {HEAD.split(', h.horizon')[0]}, 'gap' AS covariate FROM h WHERE h.horizon % 3 = 0")
def panel_missing_future(spark, sf_dir):
    rows = P.future_index(_daily(spark, sf_dir), PANEL, 7).withColumn("dow", F.weekday("ts")).withColumn("gap", F.when(F.col("horizon") % 3 != 0, 1.0))
    return P.missing_future(rows, ROLES)


@query(f"WITH {V.DAILY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM daily)), c AS (SELECT DISTINCT n - k * 5 AS c FROM t, range(1, 4) x(k) WHERE n - k * 5 >= 14), f AS (SELECT printf('fold_%04d', row_number() OVER (ORDER BY c) - 1) AS fold_id, c - 1 AS c FROM c) SELECT fold_id, ts, CASE WHEN i <= c THEN 'train' ELSE 'test' END AS role FROM t, f WHERE i <= c + 5")
def split_candidate_schedule(spark, sf_dir):
    return L.candidate_folds(_daily(spark, sf_dir), "ts", 5)


@query(f"WITH {V.DAILY}, t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM daily)), c AS (SELECT DISTINCT 9 + 2 * range AS c FROM t, range(100000) WHERE 9 + 2 * range < n - 3 ORDER BY c DESC LIMIT 2), f AS (SELECT printf('fold_%04d', row_number() OVER (ORDER BY c) - 1) AS fold_id, c FROM c) SELECT fold_id, ts, CASE WHEN i <= c THEN 'train' ELSE 'test' END AS role FROM t, f WHERE i <= c + 3")
def split_last_folds(spark, sf_dir):
    """The last two of all folds."""
    return L.rolling_origin(_daily(spark, sf_dir), "ts", 3, 2, 10, n_splits=2)


@query("""WITH RECURSIVE g AS (SELECT c_nationkey AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS k FROM customer GROUP BY 1),
e AS (SELECT 0::BIGINT AS k, -1 AS g, 0 AS fold, [0, 0, 0]::BIGINT[] AS load UNION ALL SELECT x.k, x.g, pl - 1, list_transform(load, lambda v, i: CASE WHEN i = pl THEN v + n ELSE v END) FROM (SELECT g.k, g.g, g.n, load, list_position(load, list_min(load)) AS pl FROM e JOIN g ON g.k = e.k + 1) x)
SELECT c_custkey AS id, fold::INTEGER AS fold FROM customer JOIN e ON e.g = c_nationkey""")
def split_balanced_groups(spark, sf_dir):
    return L.balanced_groups(V.geo(spark, sf_dir), "id", "grp", 3)


@query(f"WITH {V.GEO}, o AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 AS i, count(*) OVER () AS n FROM geo) SELECT id, (CASE WHEN i < (n % 4) * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n % 4) * (n // 4 + 1)) // (n // 4) END)::INTEGER AS fold FROM o")
def split_environmental_ordered(spark, sf_dir):
    return L.environmental_ordered(V.geo(spark, sf_dir), "id", ["x", "y"], 4)


@query("SELECT a, b, c, d, 0 < a AND a <= b AND b < c AND c <= d AS ordered FROM (SELECT x.range AS a, y.range AS b, z.range AS c, w.range AS d FROM range(3) x, range(4) y, range(5) z, range(5) w)")
def conformal_split_order(spark, sf_dir):
    """Which boundaries the leakage guard lets pass."""

    def passes(*at) -> bool:
        try:
            K.check_split_order(*at)
        except ValueError:
            return False
        return True

    rows = [(a, b, c, d, passes(a, b, c, d)) for a in range(3) for b in range(4) for c in range(5) for d in range(5)]
    return spark.createDataFrame(rows, "a long, b long, c long, d long, ordered boolean")


@query(f"WITH {V.GEO}, p AS (SELECT a.id, b.id AS r_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM geo a JOIN geo b ON a.id <> b.id AND a.id % 3 = 0 AND b.id % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS rank FROM p) SELECT id, r_id, rank::INTEGER AS rank, {r('sqrt(d)')} AS distance FROM k WHERE rank <= 5")
def join_nearest_any(spark, sf_dir):
    """Neighbours at any distance: every left row has its five."""
    g = V.geo(spark, sf_dir)
    return _out(J.nearest_any(g.where("id % 3 = 0"), g.where("id % 2 = 0"), "id", 5), "id", "r_id", "rank", "distance")


@query(f"WITH {V.GEO}, p AS (SELECT a.id, b.id AS r_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM geo a JOIN geo b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 400), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS rank FROM p), q AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM k WHERE rank <= 4) SELECT id, r_id, rank::INTEGER AS rank FROM q WHERE n >= 3")
def join_nearest_bounded(spark, sf_dir):
    """At most four neighbours within 20, of rows with at least three."""
    g = V.geo(spark, sf_dir)
    return J.nearest_any(g, g, "id", 4, least=3, most=20.0).select("id", "r_id", "rank")


@query(f"""WITH {V.GEO}, p AS (SELECT a.id, abs(b.z - 4500) AS e, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS k FROM geo a JOIN geo b ON a.id % 2 = 1 AND b.id % 2 = 0),
q AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e) AS k, count(*) OVER (PARTITION BY id) AS n FROM p WHERE k <= 9) SELECT id, {r('coalesce(min(CASE WHEN k >= ceil(round((n + 1) * 0.8, 9)) THEN e END), max(e))')} AS radius FROM q GROUP BY 1""")
def conformal_nearest_any(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("e", F.col("z") - 4500)
    return _out(K.nearest_radius(g.where("id % 2 = 1"), g.where("id % 2 = 0"), "id", "e", 9, None, 0.2))


@query(f"WITH {V.GEO} SELECT id, CASE WHEN x >= 0 AND x < 50 AND y >= 0 AND y < 50 THEN 'a' WHEN x >= 30 AND x < 80 AND y >= 30 AND y < 80 THEN 'b' WHEN x >= 10 AND x < 95 AND y >= 5 AND y < 85 AND NOT (x >= 40 AND y < 40) THEN 'l' END AS zone FROM geo")
def join_zone_table(spark, sf_dir):
    """Zones from a table; the third has a corner cut out."""
    box = lambda a, b, c, d: [(a, c), (b, c), (b, d), (a, d)]
    rows = [("a", 1, box(0.0, 50.0, 0.0, 50.0)), ("b", 2, box(30.0, 80.0, 30.0, 80.0)), ("l", 3, [(10.0, 5.0), (40.0, 5.0), (40.0, 40.0), (95.0, 40.0), (95.0, 85.0), (10.0, 85.0)])]
    zones = spark.createDataFrame(rows, "zone string, ordinal int, ring array<struct<x: double, y: double>>")
    return J.zone_join(V.geo(spark, sf_dir), zones, "id", 16.0).select("id", "zone")


@query(f"WITH {V.GEO}, p AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS k FROM geo a JOIN geo b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1600) SELECT id, {r('max(d)')} AS bandwidth FROM p WHERE k <= 3 GROUP BY 1")
def spatial_bandwidth(spark, sf_dir):
    return _out(S.third_nearest(V.geo(spark, sf_dir), "id", 40.0))


REPORT = f"""{V.GEO}, gm AS (SELECT avg(x) AS gx, avg(y) AS gy FROM geo), rm AS (SELECT grp, avg(x) AS rx, avg(y) AS ry FROM geo GROUP BY 1), f AS (SELECT geo.grp = 7 AS held, z / 1000 AS t, x AS x0, y AS y0, x - rx + gx AS x1, y - ry + gy AS y1 FROM geo JOIN rm ON rm.grp = geo.grp, gm)"""


def _ridge(k: int) -> str:
    """Ridge coefficients (a, b, c) of t on x and y outside the held-out region, by Cramer's rule on the centred sums: the
    intercept has no penalty, so it drops out."""
    x, y = f"x{k}", f"y{k}"
    return f"""s{k} AS (SELECT avg({x}) AS mx, avg({y}) AS my, avg(t) AS mt, count(*) * var_pop({x}) + 1 AS xx, count(*) * var_pop({y}) + 1 AS yy, count(*) * covar_pop({x}, {y}) AS xy, count(*) * covar_pop({x}, t) AS xt, count(*) * covar_pop({y}, t) AS yt FROM f WHERE NOT held),
b{k} AS (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS b, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS c, mx, my, mt FROM s{k}), e{k} AS (SELECT held, t - (mt + b * ({x} - mx) + c * ({y} - my)) AS e FROM f, b{k})"""


@query(f"""WITH {REPORT}, {_ridge(0)}, {_ridge(1)} SELECT {r('(SELECT sqrt(avg(e * e)) FROM e0 WHERE held)')} AS raw_rmse, {r('(SELECT sqrt(avg(e * e)) FROM e1 WHERE held)')} AS invariant_rmse, {r('(SELECT avg(e * e) FROM e1 WHERE NOT held)')} AS training_loss, {r('(SELECT avg(abs(y1 - x1)) FROM f)')} AS variation""")
def causal_representation(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("t", F.col("z") / 1000).withColumn("grp", F.col("grp").cast("string"))
    made = C.representation_report(g, "grp", ["x", "y"], "t", "7")
    return _out(made, "raw_rmse", "invariant_rmse", "training_loss", "variation")
