"""Queries of geometry, kernels, ids, links and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import encoders as E
from loomgrid.functions import geometry as G
from loomgrid.functions import ids as I
from loomgrid.functions import scalars as S
from loomgrid.functions.columns import rounded
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table

ROUTES = "rt AS (SELECT o_orderkey AS id, (o_orderkey % 17)::DOUBLE AS ax, (o_orderkey % 23)::DOUBLE AS ay, (o_custkey % 17)::DOUBLE AS bx, (o_custkey % 23)::DOUBLE AS b_y FROM orders)"


def _routes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (k % 17).cast("double").alias("ax"), (k % 23).cast("double").alias("ay"), (c % 17).cast("double").alias("bx"), (c % 23).cast("double").alias("b_y"))


D = "sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))"


@query(f"""WITH {ROUTES} SELECT id, {r('(ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)')} AS squared, {r(D)} AS euclidean, CASE WHEN {D} > 0 THEN {r('(ax + bx) / 2')} END AS mid_x, CASE WHEN {D} > 0 THEN {r('(ay + b_y) / 2')} END AS mid_y,
CASE WHEN {D} > 0 THEN {r(f'(bx - ax) / {D}')} END AS bearing_x, CASE WHEN {D} > 0 THEN {r(f'(b_y - ay) / {D}')} END AS bearing_y FROM rt""")
def geometry_routes(spark, sf_dir):
    at = ("ax", "ay", "bx", "b_y")
    f = G.route_features(*at)
    return _routes(spark, sf_dir).select("id", rounded(G.squared_euclidean(*at)).alias("squared"), rounded(G.euclidean(*at)).alias("euclidean"), *[rounded(f[k]).alias(k) for k in ("mid_x", "mid_y", "bearing_x", "bearing_y")])


@query(f"""WITH {V.GEO} SELECT id, {r('sqrt((x - 10) ** 2 + (y - 20) ** 2)')} AS d0, {r('sqrt((x - 60) ** 2 + (y - 70) ** 2)')} AS d1, {r('exp(-((x - 10) ** 2 + (y - 20) ** 2) / (2 * 25.0 * 25.0))')} AS rbf0,
{r('(x - 5) * 0.6 + (y - 5) * 0.8')} AS along, {r('(y - 5) * 0.6 - (x - 5) * 0.8')} AS across,
{r('x * cos(radians(30)) + y * sin(radians(30))')} AS rot_x, {r('(y * cos(radians(30)) - x * sin(radians(30))) / 2')} AS rot_y FROM geo""")
def geometry_anchors_frames(spark, sf_dir):
    d = G.anchor_distances("x", "y", [(10, 20), (60, 70)])
    along, across = G.local_frame("x", "y", (5, 5), (3, 4))
    rx, ry = G.anisotropic("x", "y", 30, 2)
    cols = {"d0": d[0], "d1": d[1], "rbf0": G.rbf_anchors("x", "y", [(10, 20)], 25.0)[0], "along": along, "across": across, "rot_x": rx, "rot_y": ry}
    return V.geo(spark, sf_dir).select("id", *[rounded(c).alias(k) for k, c in cols.items()])


A1, A2, DL = "radians(x - 48)", "radians(y - 44)", "radians(z / 100 - x)"
HAV = f"asin(sqrt(sin(({A2} - {A1}) / 2) ** 2 + cos({A1}) * cos({A2}) * sin({DL} / 2) ** 2)) * 2"
EAST, NORTH = f"sin({DL}) * cos({A2})", f"(cos({A1}) * sin({A2}) - sin({A1}) * cos({A2}) * cos({DL}))"


@query(f"WITH {V.GEO} SELECT id, {r(f'{HAV} * 6371.0', 4)} AS km, {r(f'{HAV} * 6371.0088', 4)} AS km_causal, {r(f'{EAST} / sqrt(({EAST}) ** 2 + {NORTH} ** 2)')} AS east, {r(f'{NORTH} / sqrt(({EAST}) ** 2 + {NORTH} ** 2)')} AS north FROM geo")
def geometry_great_circle(spark, sf_dir):
    at = (F.col("x") - 48, F.col("x"), F.col("y") - 44, F.col("z") / 100)
    east, north = G.initial_bearing(*at)
    return V.geo(spark, sf_dir).select("id", rounded(G.haversine(*at), 4).alias("km"), rounded(G.haversine(*at, G.EARTH_KM_CAUSAL), 4).alias("km_causal"), rounded(east).alias("east"), rounded(north).alias("north"))


E2 = lambda a, b, c, d: f"sqrt(({a} - ({c})) ** 2 + ({b} - ({d})) ** 2)"
FWD = f"({E2('ax', 'ay', '3', '4')} + {E2('bx', 'b_y', '10', '12')} * 0.5)"
CRS = f"({E2('ax', 'ay', '10', '12')} + {E2('bx', 'b_y', '3', '4')} * 0.5)"


@query(f"WITH {ROUTES} SELECT id, {r(FWD)} AS forward, {r(CRS)} AS crossed, {r(f'least({FWD}, {CRS})')} AS minimum FROM rt")
def geometry_lane_distance(spark, sf_dir):
    left, right = ["ax", "ay", "bx", "b_y"], [F.lit(v) for v in (3.0, 4.0, 10.0, 12.0)]
    return _routes(spark, sf_dir).select("id", *[rounded(G.lane_distance(left, right, m, 1.0, 0.5)).alias(m) for m in ("forward", "crossed", "minimum")])


@query(f"""WITH {V.GEO} SELECT id, (x BETWEEN 10 AND 50 AND y BETWEEN 10 AND 60) AS in_box,
(y >= 0 AND y <= 40 AND x >= 20 AND x + y <= 60) AS in_triangle FROM geo""")
def geometry_in_polygon(spark, sf_dir):
    box, triangle = [(10.0, 10.0), (50.0, 10.0), (50.0, 60.0), (10.0, 60.0)], [(20.0, 0.0), (60.0, 0.0), (20.0, 40.0)]
    return V.geo(spark, sf_dir).select("id", G.in_polygon("x", "y", box).alias("in_box"), G.in_polygon("x", "y", triangle).alias("in_triangle"))


FZ = lambda blend: f"CASE WHEN abs(d) / 30 >= 1 THEN hard ELSE ({blend}) * 0.5 + (1 - ({blend})) * hard END"
M = "(abs(d) / 30)"


@query(f"""WITH {V.GEO}, k AS (SELECT id, x - y AS d, CASE WHEN x - y <= 0 THEN 1.0 ELSE 0.0 END AS hard, abs(x - y) / 40 AS q FROM geo)
SELECT id, {r('exp(-0.5 * q * q)')} AS o_gaussian, {r('CASE WHEN q >= 1 THEN 0 ELSE (1 - q * q) ** 2 END')} AS o_bisquare, {r('exp(-q)')} AS o_exponential, 0.0::DOUBLE AS o_none,
{r(FZ(f'1 - {M}'))} AS f_linear, {r(FZ(f'exp(-0.5 * (2.5 * {M}) ** 2)'))} AS f_gaussian, {r(FZ(f'exp(-3 * {M})'))} AS f_exponential, {r(FZ(f'(1 - {M} ** 2) ** 2'))} AS f_bisquare, {r(FZ(f'1 - {M} ** 2'))} AS f_epanechnikov, {r(FZ(f'(1 - {M} ** 3) ** 3'))} AS f_tricube,
{r('2 * exp(-q)')} AS c_exponential, {r('2 * exp(-q * q)')} AS c_squared_exponential, {r('2 * (1 + sqrt(3) * q) * exp(-sqrt(3) * q)')} AS c_matern32, {r('2 * (1 + sqrt(5) * q + 5 * q * q / 3) * exp(-sqrt(5) * q)')} AS c_matern52,
{r('0.1 + 2 * (1 - exp(-q))')} AS v_exponential, {r('0.1 + 2 * (1 - exp(-q * q))')} AS v_gaussian, {r('0.1 + 2 * CASE WHEN q >= 1 THEN 1 ELSE 1.5 * q - 0.5 * q ** 3 END')} AS v_spherical, {r('0.1 + 2 * q')} AS v_linear FROM k""")
def geometry_kernels(spark, sf_dir):
    d, h = F.col("x") - F.col("y"), F.abs(F.col("x") - F.col("y"))
    cols = {f"o_{k}": G.overlay_kernel(h, 40, k) for k in ("gaussian", "bisquare", "exponential", "none")}
    cols |= {f"f_{k}": G.fuzzy_left(d, 30, k) for k in ("linear", "gaussian", "exponential", "bisquare", "epanechnikov", "tricube")}
    cols |= {f"c_{k}": G.covariance(h, k, 40, 2.0) for k in ("exponential", "squared_exponential", "matern32", "matern52")}
    cols |= {f"v_{k}": G.semivariogram(h, k, 40, 2.0, 0.1) for k in ("exponential", "gaussian", "spherical", "linear")}
    return V.geo(spark, sf_dir).select("id", *[rounded(c).alias(k) for k, c in cols.items()])


@query(f"""WITH {V.BINARY}, t AS (SELECT id, p, greatest(2 * p, greatest(1 - p, 0.5)) AS m FROM bin) SELECT id, {r('ln(1 + p)')} AS log1p, {r('exp(p) - 1')} AS expm1, {r('1 / (1 + exp(-p))')} AS sigmoid, {r('ln(least(greatest(p, 0.001), 0.999) / (1 - least(greatest(p, 0.001), 0.999)))')} AS logit,
{r('exp(2 * p - m) / (exp(2 * p - m) + exp(1 - p - m) + exp(0.5 - m))')} AS softmax0, {r('0.9 * (1 - 0.9 ** (id % 7 + 1)) / (1 - 0.9)')} AS damped, {r('least(greatest(p, 0.2), 0.8)')} AS clamped FROM t""")
def scalar_links(spark, sf_dir):
    p = F.col("p")
    cols = {"log1p": F.log1p(p), "expm1": F.expm1(p), "sigmoid": S.sigmoid(p), "logit": S.logit(p, 0.001), "softmax0": S.softmax([p * 2, 1 - p, F.lit(0.5)])[0], "damped": S.damped_multiplier(0.9, F.col("id") % 7 + 1), "clamped": S.clamp(p, 0.2, 0.8)}
    return V.binary(spark, sf_dir).select("id", *[rounded(c).alias(k) for k, c in cols.items()])


@query(f"WITH {V.DAILY}, s AS (SELECT series_id, ts, y, avg(y) OVER (PARTITION BY series_id) AS m, greatest(stddev_pop(y) OVER (PARTITION BY series_id), 1e-9) AS sd FROM daily) SELECT series_id, ts, {r('(y - m) / sd')} AS scaled, {r('m')} AS scale_mean, {r('sd')} AS scale_std FROM s")
def scalar_local_scale(spark, sf_dir):
    d = S.local_scale(V.daily(spark, sf_dir), "series_id", "y")
    return d.select("series_id", "ts", *[rounded(c).alias(c) for c in ("scaled", "scale_mean", "scale_std")])


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '0x' || lower(hex(p_partkey)) WHEN 2 THEN 'a' || lower(hex(p_partkey)) ELSE 'zz' END AS t, p_partkey % 4 AS k FROM part)
SELECT id, CASE k WHEN 3 THEN NULL WHEN 2 THEN ('0xa' || lower(hex(id)))::BIGINT::VARCHAR ELSE id::VARCHAR END AS h3, CASE k WHEN 0 THEN id::VARCHAR WHEN 1 THEN id::VARCHAR END AS s2 FROM t""")
def ids_normalize(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 4 == 2, F.concat(F.lit("a"), F.lower(F.hex(k)))).otherwise("zz")
    return table(spark, sf_dir, "part").select(k.alias("id"), I.normalize_h3(t).alias("h3"), I.normalize_s2(t).alias("s2"))


TOP = "(-9223372036854775808 + {p} * 72057594037927936 + (c >> {s}))"


@query(f"""WITH t AS (SELECT o_orderkey AS id, list_distinct([o_orderkey * 64 + 7, o_custkey * 64 + 7, o_orderkey * 64 + 7]) AS s FROM orders)
SELECT id, array_to_string(list_sort(list_distinct(flatten([s, list_transform(s, lambda c: {TOP.format(p=7, s=6)}), list_transform(s, lambda c: {TOP.format(p=5, s=12)})]))), ',') AS cells, list_contains(s, 64 * 5 + 7) AS has_5, list_has_any(s, [64 * 5 + 7, 64 * 9 + 7]) AS has_any FROM t""")
def ids_sparse_sets(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, sf_dir, "orders").select(k.alias("id"), I.sorted_set(F.array(k * 64 + 7, c * 64 + 7, k * 64 + 7)).alias("s"))
    cells = F.array_join(F.transform(I.with_parents("s", 9, [7, 5]), lambda x: x.cast("string")), ",")
    return t.select("id", cells.alias("cells"), I.set_contains("s", 64 * 5 + 7).alias("has_5"), I.set_contains_any("s", [64 * 5 + 7, 64 * 9 + 7]).alias("has_any"))


ZIP = "lpad((o_custkey * 37 % 100000)::VARCHAR, 5, '0')"
ZIQ = "lpad((o_orderkey * 37 % 100000)::VARCHAR, 5, '0')"


@query(f"SELECT o_orderkey AS id, {ZIP}::BIGINT AS origin_zip5, left({ZIP}, 3)::BIGINT AS origin_zip3, left({ZIQ}, 2)::BIGINT AS destination_zip2, ({ZIP} = {ZIQ})::BIGINT AS zip_match, o_orderkey AS geo_id FROM orders")
def ids_zip_sets(spark, sf_dir):
    z = lambda c: F.lpad((F.col(c) * 37 % 100000).cast("string"), 5, "0")
    s = I.zip_sets(F.concat(z("o_custkey"), F.lit("-12")), z("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), s["origin_zip5"][0].alias("origin_zip5"), s["origin_zip3"][0].alias("origin_zip3"), s["destination_zip2"][0].alias("destination_zip2"), F.size(s["zip_match"]).cast("long").alias("zip_match"), I.geo_id("o_orderkey", "order").alias("geo_id"))


@query("SELECT o_orderkey AS id, (o_orderkey % 90)::DOUBLE AS lat0, (o_custkey % 180)::DOUBLE AS lng1, 2 AS points FROM orders")
def ids_route_points(spark, sf_dir):
    k, c = (F.col(x) for x in ("o_orderkey", "o_custkey"))
    pairs = F.format_string("[[%d, 1.0], [2.0, %d]]", k % 90, c % 180)
    mapped = F.format_string('{"coordinates": [[1.0, %d], [%d, 2.0]]}', k % 90, c % 180)
    t = table(spark, sf_dir, "orders").select(k.alias("id"), I.route_points(F.when(k % 2 == 0, pairs).otherwise(mapped)).alias("p"))
    return t.select("id", F.col("p")[0]["lat"].alias("lat0"), F.col("p")[1]["lng"].alias("lng1"), F.size("p").alias("points"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey AS id, " + ", ".join(f"(c_mktsegment = '{s}')::INTEGER::DOUBLE AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + ", (SELECT count(DISTINCT c_mktsegment) FROM customer c2 WHERE c2.c_mktsegment < c.c_mktsegment)::INTEGER AS code FROM customer c")
def encode_one_hot_ordinal(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    coded = E.lookup(c, E.ordinal_map(c, "c_mktsegment"), "c_mktsegment", "code", -1)
    hot = E.one_hot("c_mktsegment", E.categories(c, "c_mktsegment"))
    return coded.select(F.col("c_custkey").alias("id"), *[x.alias(k) for k, x in hot.items()], "code")


QUARTERS = ["q0", "q1", "q2", "q3"]
PARTS = E.partitions(QUARTERS)


@query("WITH t AS (SELECT c_custkey AS id, 'q' || (c_custkey % 4)::VARCHAR AS q FROM customer) SELECT id, " + ", ".join(f"(q IN ({', '.join(repr(x) for x in p)}))::INTEGER::DOUBLE AS q_in_{'_'.join(p)}" for p in PARTS) + " FROM t")
def encode_partitions(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("q"), (F.col("c_custkey") % 4).cast("string")).alias("q"))
    return t.select("id", *[c.alias(k) for k, c in E.partition_indicators("q", QUARTERS).items()])


@query(f"WITH g AS (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS g FROM lineitem) SELECT l_suppkey AS category, {r('(sum(l_quantity * l_discount) + 10 * any_value(g)) / (sum(l_quantity) + 10)', 8)} AS target_mean FROM lineitem, g GROUP BY 1")
def encode_target_means(spark, sf_dir):
    return E.target_means(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_quantity").withColumn("target_mean", rounded("target_mean", 8))


@query(f"""WITH g AS (SELECT avg(c_acctbal) AS g FROM customer), s AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1)
SELECT c_custkey AS id, {r('(s - c_acctbal + 10 * g) / (n - 1 + 10)')} AS target_mean FROM customer JOIN s ON c_nationkey = k, g""")
def encode_leave_one_out(spark, sf_dir):
    return E.leave_one_out(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").select(F.col("c_custkey").alias("id"), rounded("target_mean").alias("target_mean"))


@query("""WITH m AS (SELECT p_brand AS category, avg(p_retailprice) AS v FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1) SELECT p_partkey AS id, (round(coalesce(v, -1), 6) + 0.0) AS v FROM part LEFT JOIN m ON p_brand = category""")
def encode_lookup_unknown(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    means = p.where("p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("category")).agg(F.avg("p_retailprice").alias("v"))
    return E.lookup(p, means, "p_brand", "v", -1.0).select(F.col("p_partkey").alias("id"), rounded("v").alias("v"))
