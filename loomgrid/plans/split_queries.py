"""Queries of folds and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import joins as J
from loomgrid.operators import splits as S
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table

ROLE = "CASE WHEN i BETWEEN {a} AND c THEN 'train' WHEN i > c AND i <= c + 7 THEN 'test' END"
TIMES = "t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM daily)), f AS (SELECT 'fold_000' || k.range::VARCHAR AS fold_id, c FROM (SELECT *, row_number() OVER (ORDER BY c) - 1 AS range FROM (SELECT c FROM (SELECT 9 + 3 * range AS c FROM range(100)) WHERE c < (SELECT max(n) FROM t) - 7 ORDER BY c DESC LIMIT 4)) k)"


@query(f"WITH {V.DAILY}, {TIMES}, j AS (SELECT fold_id, ts, {ROLE.format(a=0)} AS role FROM t, f) SELECT * FROM j WHERE role IS NOT NULL")
def split_rolling_origin(spark, sf_dir):
    return S.rolling_origin(V.daily(spark, sf_dir), "ts", 7, 3, 10, 4)


@query(f"WITH {V.DAILY}, {TIMES}, j AS (SELECT fold_id, ts, {ROLE.format(a='c - 7')} AS role FROM t, f) SELECT * FROM j WHERE role IS NOT NULL")
def split_sliding_origin(spark, sf_dir):
    return S.rolling_origin(V.daily(spark, sf_dir), "ts", 7, 3, 10, 4, max_train=8)


@query(f"""WITH {V.DAILY}, t AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM daily), s AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM daily GROUP BY series_id)),
f AS (SELECT 'fold_000' || range::VARCHAR AS fold_id, 13 + 5 * range AS c FROM range(10), s WHERE 13 + 5 * range < n - 4), j AS (SELECT fold_id, series_id, ts, CASE WHEN i <= c THEN 'train' WHEN i <= c + 4 THEN 'test' END AS role FROM t, f) SELECT * FROM j WHERE role IS NOT NULL""")
def split_panel_rolling_origin(spark, sf_dir):
    return S.panel_rolling_origin(V.daily(spark, sf_dir), "series_id", "ts", 4, 5, 14)


BLOCKS = f"{V.GEO}, o AS (SELECT *, row_number() OVER (ORDER BY x, y, id) - 1 AS i, count(*) OVER () AS n FROM geo), b AS (SELECT id, x, y, ((i >= n // 4)::INTEGER + (i >= 2 * n // 4)::INTEGER + (i >= 3 * n // 4)::INTEGER) AS fold FROM o)"


@query(f"WITH {BLOCKS} SELECT id, fold FROM b")
def split_spatial_blocks(spark, sf_dir):
    return S.spatial_blocks(V.geo(spark, sf_dir), "id", 4)


@query(f"""WITH {V.GEO}, m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM geo) SELECT id, ((least(floor((y - c) / (d - c) * 2), 1) * 3 + least(floor((x - a) / (b - a) * 3), 2)) % 5)::INTEGER AS fold FROM geo, m""")
def split_grid_blocks(spark, sf_dir):
    return S.grid_blocks(V.geo(spark, sf_dir), "id", 5)


FOLDS4 = "fo AS (SELECT 'fold_000' || range::VARCHAR AS fold_id, b.id, CASE WHEN fold = range THEN 'test' ELSE 'train' END AS role, b.x, b.y, range FROM b, range(4))"


@query(f"WITH {BLOCKS}, {FOLDS4} SELECT fold_id, id, role FROM fo WHERE role = 'test' OR NOT EXISTS (SELECT 1 FROM b WHERE b.fold = fo.range AND (b.x - fo.x) ** 2 + (b.y - fo.y) ** 2 <= 9)")
def split_buffered(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return S.buffered(g, S.spatial_blocks(g, "id", 4), "id", 4, 3.0)


@query("WITH g AS (SELECT c_nationkey AS k, (row_number() OVER (ORDER BY c_nationkey) - 1) % 3 AS fold FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey AS id, fold::INTEGER AS fold FROM customer JOIN g ON c_nationkey = k")
def split_groups(spark, sf_dir):
    return S.group_folds(V.geo(spark, sf_dir), "id", "grp", 3)


ORDERED = "o AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS at, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))


@query(f"""WITH {ORDERED}, e AS (SELECT range AS f, range * (n // 4) + least(range, n % 4) AS a, (range + 1) * (n // 4) + least(range + 1, n % 4) AS b FROM range(4), (SELECT max(n) AS n FROM o)),
j AS (SELECT 'fold_000' || f::VARCHAR AS fold_id, id, CASE WHEN i >= a AND i < b THEN 'test' WHEN i < a - 5 OR i >= b + 5 THEN 'train' END AS role FROM o, e) SELECT * FROM j WHERE role IS NOT NULL""")
def split_temporal_blocks(spark, sf_dir):
    return S.temporal_blocks(_orders(spark, sf_dir), "id", "at", 4, 5)


@query(f"WITH {ORDERED}, j AS (SELECT id, CASE WHEN i >= n - ceil(n * 0.2) THEN 'test' WHEN i < n - ceil(n * 0.2) - 10 THEN 'train' END AS role FROM o) SELECT * FROM j WHERE role IS NOT NULL")
def split_out_of_time(spark, sf_dir):
    return S.out_of_time(_orders(spark, sf_dir), "id", "at", 0.2, gap=10)


@query(f"WITH {BLOCKS}, {FOLDS4}, t AS (SELECT id, row_number() OVER (ORDER BY z, id) - 1 AS i FROM geo) SELECT fold_id, fo.id, role FROM fo JOIN t ON t.id = fo.id WHERE (role = 'train' AND i < 800) OR (role = 'test' AND i >= 800 AND i < 1200)")
def split_spatial_temporal(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return S.spatial_temporal(g, S.spatial_blocks(g, "id", 4), "id", "z", 4, 800, 400)


@query(f"""WITH {BLOCKS}, {FOLDS4} SELECT fold_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, sum(('0x' || left(sha256(id::VARCHAR || ':' || role), 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM fo GROUP BY 1""")
def split_manifest(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return S.manifest(S.folds_of(S.spatial_blocks(g, "id", 4), "id", 4), "id")


@query(f"WITH {V.GEO} SELECT a.id AS id, b.id AS r_id, {r('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} AS distance FROM geo a JOIN geo b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 4")
def join_self_pairs(spark, sf_dir):
    return J.self_pairs(V.geo(spark, sf_dir), "id", 2.0).select("id", "r_id", rounded("distance").alias("distance"))


@query(f"""WITH {V.GEO}, p AS (SELECT a.id, b.id AS r_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS rank FROM geo a JOIN geo b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25) SELECT id, r_id, rank::INTEGER AS rank FROM p WHERE rank <= 3""")
def join_nearest(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return J.nearest(g, g, "id", 3, 5.0).select("id", "r_id", "rank")


@query(f"WITH {V.GEO} SELECT id FROM geo WHERE NOT EXISTS (SELECT 1 FROM geo b WHERE b.grp = 7 AND (b.x - geo.x) ** 2 + (b.y - geo.y) ** 2 <= 36)")
def join_beyond(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return J.beyond(g, g.where("grp = 7"), 6.0, "id").select("id")


@query("""WITH l AS (SELECT event_id, event_type, ts FROM events WHERE event_id % 3 <> 0), m AS (SELECT event_type, ts, max(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT event_id, (SELECT v FROM m WHERE m.event_type = l.event_type AND m.ts <= l.ts ORDER BY m.ts DESC LIMIT 1) AS v FROM l""")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    right = e.where("event_id % 3 = 0").groupBy("event_type", "ts").agg(F.max("value").alias("v"))
    return J.asof(e.where("event_id % 3 <> 0").drop("value"), right, "event_type", "ts", "v").select("event_id", "v")


@query(f"WITH {V.BINARY} SELECT id, {r('CASE WHEN p <= 0.1 THEN 0 WHEN p <= 0.5 THEN (p - 0.1) / 0.4 * 0.3 WHEN p <= 0.9 THEN 0.3 + (p - 0.5) / 0.4 * 0.7 ELSE 1 END')} AS v FROM bin")
def join_interpolate(spark, sf_dir):
    return V.binary(spark, sf_dir).select("id", rounded(J.interpolate(F.col("p"), [(0.1, 0.0), (0.5, 0.3), (0.9, 1.0)])).alias("v"))


@query(f"""WITH {V.DAILY}, f AS (SELECT series_id, ts, n FROM daily WHERE ts > (SELECT max(ts) - 5 FROM daily)), k AS (SELECT * FROM f WHERE n % 2 = 0), h AS (SELECT series_id, max_by(n, ts) AS n FROM daily WHERE ts <= (SELECT max(ts) - 5 FROM daily) GROUP BY 1)
SELECT f.series_id, f.ts, coalesce(k.n, h.n) AS n FROM f LEFT JOIN k USING (series_id, ts) LEFT JOIN h ON h.series_id = f.series_id""")
def join_known_future(spark, sf_dir):
    d = V.daily(spark, sf_dir).drop("y").crossJoin(F.broadcast(V.daily(spark, sf_dir).agg(F.date_sub(F.max("ts"), 5).alias("cut"))))
    future, past = d.where("ts > cut"), d.where("ts <= cut")
    return J.with_last_known(future.select("series_id", "ts"), future.where("n % 2 = 0"), past, ["series_id", "ts"], "series_id", "ts", ["n"])


@query(f"WITH {V.FLOWS}, v AS (SELECT n_nationkey AS node, n_regionkey + 1.5 AS v FROM nation) SELECT v.node, {r('coalesce((SELECT sum(w * u.v) FROM flows JOIN v u ON u.node = dst WHERE src = v.node), 0)', 4)} AS lag_v FROM v")
def join_spatial_lag(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") + 1.5).alias("v"))
    return J.spatial_lag(V.flows(spark, sf_dir), nodes, "node", ["v"]).withColumn("lag_v", rounded("lag_v", 4))


ZONES = [("a", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]), ("b", [(30.0, 30.0), (80.0, 30.0), (80.0, 80.0), (30.0, 80.0)])]


@query(f"WITH {V.GEO} SELECT id, CASE WHEN x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 50 THEN 'a' WHEN x BETWEEN 30 AND 80 AND y BETWEEN 30 AND 80 THEN 'b' END AS zone FROM geo")
def join_in_zones(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    return g.select("id", J.in_zones(g, ZONES).alias("zone"))


@query(f"WITH {V.FLOWS}, t AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2) SELECT src, dst, w FROM flows WHERE (src IN (SELECT k FROM t)) <> (dst IN (SELECT k FROM t))")
def join_touching(spark, sf_dir):
    treated = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"))
    return J.touching(V.flows(spark, sf_dir), treated).select("src", "dst", "w")


TREE = "tree AS (SELECT 'all' AS node, NULL::VARCHAR AS parent UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _tree(spark, sf_dir):
    n, rg = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    top = spark.createDataFrame([("all", None)], "node string, parent string")
    a = rg.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("all").alias("parent"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return top.unionByName(a).unionByName(b)


@query(f"""WITH RECURSIVE {TREE}, leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)), up AS (SELECT node, node AS leaf FROM leaf UNION ALL SELECT t.parent, up.leaf FROM up JOIN tree t ON t.node = up.node WHERE t.parent IS NOT NULL) SELECT node, leaf FROM up""")
def join_closure(spark, sf_dir):
    return J.closure(_tree(spark, sf_dir), "node", "parent")


@query(f"""WITH RECURSIVE {TREE}, leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)), up AS (SELECT node, node AS leaf FROM leaf UNION ALL SELECT t.parent, up.leaf FROM up JOIN tree t ON t.node = up.node WHERE t.parent IS NOT NULL),
v AS (SELECT 'n' || c_nationkey AS leaf, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT node, {r('sum(v)', 4)} AS v FROM up JOIN v ON v.leaf = up.leaf GROUP BY 1""")
def hierarchy_rollup(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("leaf")).agg(F.sum("c_acctbal").alias("v"))
    return J.closure(_tree(spark, sf_dir), "node", "parent").join(v, "leaf").groupBy("node").agg(rounded(F.sum("v"), 4).alias("v"))
