"""Queries of graph features, graph smoothing, relations and the metrics of ranks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import graphs as N
from loomgrid.operators import metrics as M
from loomgrid.operators import relations as G
from loomgrid.operators import spatial as S
from loomgrid.operators import splits as P
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.plans.space_queries import TE, _timed
from loomgrid.sources.tables import table


def _out(df, *names):
    return df.select(*[rounded(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in (names or df.columns)])


@query(f"WITH {V.FLOWS} SELECT src::VARCHAR AS src, 'od:' || src || ':' || dst AS dst, 'to_pair' AS relation FROM flows UNION ALL SELECT 'od:' || src || ':' || dst, dst::VARCHAR, 'to_target' FROM flows")
def graph_pair_nodes(spark, sf_dir):
    return N.pair_nodes(V.flows(spark, sf_dir), "to_pair", "to_target", "od")


def _vectors(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("node"), F.array(F.col("n_regionkey").cast("double"), (F.col("n_nationkey") % 7).cast("double"), F.lit(1.0)).alias("v"))


def _trips(spark, sf_dir):
    """Order lines from customers' to suppliers' nations, with the day of shipment."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_quantity").alias("w"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("timestamp"))


TRIPS = """tr AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_quantity AS w, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
vc AS (SELECT n_nationkey AS node, n_regionkey::DOUBLE AS a, (n_nationkey % 7)::DOUBLE AS b, 1.0::DOUBLE AS c FROM nation)"""
MEANS = lambda own, other: f"SELECT {own} AS node, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM tr JOIN vc ON node = {other} GROUP BY 1"
COS = "(v.a * {0}.a + v.b * {0}.b + v.c * {0}.c) / sqrt((v.a ** 2 + v.b ** 2 + v.c ** 2) * ({0}.a ** 2 + {0}.b ** 2 + {0}.c ** 2))"
MEASURES = {
    "there": "coalesce(there, 0)", "back": "coalesce(back, 0)", "delta": "coalesce(there, 0) - coalesce(back, 0)", "out": "o", "into": "i", "imbalance": "coalesce((o - i) / nullif(o + i, 0), 0)",
    "asymmetry": "coalesce(abs(o - i) / nullif(o + i, 0), 0)", "out_share": "coalesce(o / nullif(o + i, 0), 0)", "in_share": "coalesce(i / nullif(o + i, 0), 0)",
    "drift": "CASE WHEN o = 0 OR i = 0 THEN 0 ELSE ot / o - it / i END",
}


@query(f"""WITH {TRIPS}, om AS ({MEANS('src', 'dst')}), im AS ({MEANS('dst', 'src')}),
f AS (SELECT v.node, {COS.format('om')} AS there, {COS.format('im')} AS back, (SELECT coalesce(sum(w), 0) FROM tr WHERE src = v.node) AS o, (SELECT coalesce(sum(w), 0) FROM tr WHERE dst = v.node) AS i,
    (SELECT coalesce(sum(w * timestamp), 0) FROM tr WHERE src = v.node) AS ot, (SELECT coalesce(sum(w * timestamp), 0) FROM tr WHERE dst = v.node) AS it FROM vc v LEFT JOIN om ON om.node = v.node LEFT JOIN im ON im.node = v.node)
SELECT node, {', '.join(f'{r(MEASURES[m], 4)} AS od_{n}' for n, m in N.DIRECTIONAL.items())} FROM f""")
def graph_directional_features(spark, sf_dir):
    made = N.directional_features(_trips(spark, sf_dir), _vectors(spark, sf_dir), "od")
    return made.select("node", *[rounded(c, 4).alias(c) for c in made.columns[1:]])


SYM = f"{V.FLOWS}, sy AS (SELECT src, dst, sum(w) / 1000 AS w FROM (SELECT src, dst, w FROM flows WHERE src <> dst UNION ALL SELECT dst, src, w FROM flows WHERE src <> dst) GROUP BY 1, 2), va AS (SELECT n_nationkey AS node, (n_nationkey * 7 % 11)::DOUBLE AS v FROM nation)"
SMOOTH = "SELECT va.node, CASE WHEN d > 0 THEN (va.v + 0.5 * s) / (1 + 0.5 * d) ELSE va.v END AS v FROM va LEFT JOIN (SELECT src, sum(w) AS d, sum(w * x.v) AS s FROM sy JOIN {0} x ON x.node = dst GROUP BY 1) ON src = va.node"


def _symmetric(spark, sf_dir):
    edges = S.weights(V.flows(spark, sf_dir), symmetric=True).withColumn("w", F.col("w") / 1000)
    return edges, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 7 % 11).cast("double").alias("v"))


@query(f"WITH {SYM}, s1 AS ({SMOOTH.format('va')}), s2 AS ({SMOOTH.format('s1')}), s3 AS ({SMOOTH.format('s2')}) SELECT node, {r('v')} AS v FROM s3")
def graph_smooth(spark, sf_dir):
    return _out(G.smooth(*_symmetric(spark, sf_dir), 0.5, 3))


@query(f"WITH {SYM}, p AS (SELECT src AS node, w * (a.v - b.v) AS g FROM sy JOIN va a ON a.node = src JOIN va b ON b.node = dst UNION ALL SELECT dst, w * (b.v - a.v) FROM sy JOIN va a ON a.node = src JOIN va b ON b.node = dst) SELECT va.node, {r('coalesce(sum(g), 0)')} AS g FROM va LEFT JOIN p ON p.node = va.node GROUP BY 1")
def graph_laplacian_gradient(spark, sf_dir):
    return _out(G.laplacian_gradient(*_symmetric(spark, sf_dir)))


@query(f"WITH {SYM}, p AS (SELECT sum(w * (a.v - b.v) ** 2) / 2 * 0.01 AS p FROM sy JOIN va a ON a.node = src JOIN va b ON b.node = dst) SELECT {r('p', 3)} AS penalty, {r('100 - p', 3)} AS adjusted FROM p")
def graph_adjusted_gain(spark, sf_dir):
    made = G.adjusted_gain(*_symmetric(spark, sf_dir), 100.0, 0.01)
    return made.select(rounded("penalty", 3).alias("penalty"), rounded("adjusted", 3).alias("adjusted"))


RELATIONS = """re AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'reverse_edge_similarity' WHEN 1 THEN 'hierarchy_parent_child' WHEN 2 THEN 'smooth_group' ELSE 'no_smooth_group' END AS kind, n_nationkey AS l, (n_nationkey * 3 + 1) % 25 AS r, 0.5 + n_regionkey AS w FROM nation),
va AS (SELECT n_nationkey AS node, (n_nationkey * 7 % 11)::DOUBLE AS v, (n_nationkey % 5)::DOUBLE AS x FROM nation)"""


def _relations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "reverse_edge_similarity").when(k == 1, "hierarchy_parent_child").when(k == 2, "smooth_group").otherwise("no_smooth_group")
    rows = n.select(kind.alias("kind"), F.col("n_nationkey").alias("left"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("right"), (F.col("n_regionkey") + 0.5).alias("w"))
    return rows, n.select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 7 % 11).cast("double").alias("v"), (F.col("n_nationkey") % 5).cast("double").alias("x"))


@query(f"WITH {RELATIONS} SELECT src, dst, {r('sum(w)')} AS w FROM (SELECT l AS src, r AS dst, w FROM re WHERE kind <> 'no_smooth_group' UNION ALL SELECT r, l, w FROM re WHERE kind <> 'no_smooth_group') GROUP BY 1, 2")
def rule_edges(spark, sf_dir):
    return _out(G.to_edges(_relations(spark, sf_dir)[0]))


ENDS = "en AS (SELECT kind, l AS node, w, 1 AS sign FROM re UNION ALL SELECT kind, r, w, -1 FROM re)"


@query(f"""WITH {RELATIONS}, {ENDS} SELECT va.node, {', '.join(f"{r(f"coalesce(sum(w) FILTER (kind = '{k}'), 0)")} AS degree_{k}" for k in G.KINDS if k != 'no_smooth_group')},
count(*) FILTER (kind = 'reverse_edge_similarity')::DOUBLE AS reverse_edge_count, coalesce(sum(sign) FILTER (kind = 'hierarchy_parent_child'), 0)::DOUBLE AS hierarchy_balance, 1.0::DOUBLE AS interaction_violation FROM va LEFT JOIN en ON en.node = va.node GROUP BY 1""")
def rule_features(spark, sf_dir):
    rows, nodes = _relations(spark, sf_dir)
    return _out(G.compile_rules(rows, nodes, {}, [["a", "b"], ["c"]], ["a", "c"])[0])


@query(f"""WITH {RELATIONS} SELECT 'relation_' || kind AS name, {r('sum(w * (a.v - b.v) ** 2)')} AS penalty FROM re JOIN va a ON a.node = l JOIN va b ON b.node = r WHERE kind <> 'no_smooth_group' GROUP BY 1
UNION ALL SELECT 'monotone_feature_x', {r('sum(greatest(0, a.v - b.v))')} FROM va a JOIN va b ON a.x < b.x UNION ALL SELECT 'interaction_constraints', 0.0::DOUBLE""")
def rule_penalties(spark, sf_dir):
    rows, nodes = _relations(spark, sf_dir)
    return _out(G.compile_rules(rows, nodes, {"x": 1}, [["a", "b"]], ["a"])[1])


@query(f"WITH {V.GEO} SELECT 'monotone_feature_x' AS name, {r('sum(greatest(0, b.z - a.z))', 1)} AS penalty FROM geo a JOIN geo b ON a.x < b.x")
def rule_monotone_penalty(spark, sf_dir):
    return G.monotone_penalty(V.geo(spark, sf_dir), "x", "z", -1, rows_a_bucket=100).select("name", rounded("penalty", 1).alias("penalty"))


ASSETS = "a AS (SELECT c_custkey AS id, c_acctbal / 10000 AS y, c_acctbal / 20000 + (c_custkey * 37 % 101) / 100.0 AS p FROM customer), b AS (SELECT *, ((row_number() OVER (ORDER BY y, id) - 1) * 5 // count(*) OVER ())::INTEGER AS ob, ((row_number() OVER (ORDER BY p, id) - 1) * 5 // count(*) OVER ())::INTEGER AS pb, row_number() OVER (ORDER BY p, id) - 1 AS i, count(*) OVER () AS n FROM a)"
CALIBRATION = "g AS (SELECT x.range::INTEGER AS predicted, z.range::INTEGER AS actual, (SELECT count(*) FROM b WHERE pb = x.range AND ob = z.range) AS n FROM range(5) x, range(5) z), q AS (SELECT *, (n + 1) / sum(n + 1) OVER (PARTITION BY predicted) AS p, (SELECT count(*) FROM b) / ((SELECT count(*) FROM b) + 100.0) AS shrinkage FROM g), h AS (SELECT *, shrinkage * p + (1 - shrinkage) / 5 AS calibrated FROM q)"


def _assets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("y"), (F.col("c_acctbal") / 20000 + F.col("c_custkey") * 37 % 101 / 100.0).alias("p"))


def _even(spark, buckets=5):
    """A calibration without any rows: even chances."""
    return M.rank_calibration(spark.createDataFrame([], "a int, p int"), "a", "p", buckets)


def _calibrated(spark, sf_dir):
    rows = M.scored_assets(_assets(spark, sf_dir), "id", "y", "p", 5, _even(spark))
    return M.rank_calibration(rows, "observed_bucket", "predicted_bucket", 5)


@query(f"WITH {ASSETS}, {CALIBRATION} SELECT predicted, actual, n, {r('p')} AS p, {r('shrinkage')} AS shrinkage, {r('calibrated')} AS calibrated FROM h")
def metric_rank_calibration(spark, sf_dir):
    return _out(_calibrated(spark, sf_dir), "predicted", "actual", "n", "p", "shrinkage", "calibrated")


RPS = "s AS (SELECT id, ob, pb, y, i, n, (SELECT sum((c - (ob <= actual)::INTEGER) ** 2) / 4 FROM (SELECT actual, sum(calibrated) OVER (ORDER BY actual) AS c FROM h WHERE predicted = pb)) AS rps FROM b)"


@query(f"WITH {ASSETS}, {CALIBRATION}, {RPS} SELECT id, ob AS observed_bucket, pb AS predicted_bucket, {r('rps')} AS rps FROM s")
def metric_rank_scores(spark, sf_dir):
    return _out(M.scored_assets(_assets(spark, sf_dir), "id", "y", "p", 5, _calibrated(spark, sf_dir)), "id", "observed_bucket", "predicted_bucket", "rps")


@query(f"WITH {ASSETS} SELECT count(*) AS assets, {r('avg((ob = pb)::INTEGER)')} AS exact, {r('avg((abs(ob - pb) <= 1)::INTEGER)')} AS within_one, count(*) FILTER (pb IN (0, 4)) AS extremes, {r('avg((ob = pb)::INTEGER) FILTER (pb IN (0, 4))')} AS extreme_rate FROM b")
def metric_hit_rates(spark, sf_dir):
    return _out(M.hit_rates(M.scored_assets(_assets(spark, sf_dir), "id", "y", "p", 5, _even(spark)), "observed_bucket", "predicted_bucket", 5))


@query(f"WITH {ASSETS}, {CALIBRATION}, {RPS}, l AS (SELECT sum(CASE WHEN i < n // 5 THEN -y WHEN i >= n - n // 5 THEN y ELSE 0 END) * 0.5 / (max(n) // 5) AS net, avg(rps) AS m FROM s) SELECT {r('net')} AS net_return, {r('m')} AS mean_rps, {r('-net + 0.01 * m')} AS loss FROM l")
def metric_portfolio_loss(spark, sf_dir):
    return _out(M.portfolio_loss(_assets(spark, sf_dir), "id", "y", "p", 5, _calibrated(spark, sf_dir), 0.01))


@query(f"""WITH {V.BINARY}, u AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM bin), a AS (SELECT sum(CASE WHEN o.p < i.p THEN 1.0 WHEN o.p = i.p THEN 0.5 ELSE 0 END) AS s FROM bin i JOIN bin o ON i.y = 1 AND o.y = 0),
k AS (SELECT y, row_number() OVER w AS pl, sum(y) OVER w AS tp FROM bin WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)) SELECT {r('s / (n1 * n0)')} AS auc, {r('(SELECT sum(tp / pl) FROM k WHERE y = 1) / n1')} AS ap FROM a, u""")
def metric_link_scores(spark, sf_dir):
    return _out(M.link_scores(V.binary(spark, sf_dir), "y", "p", "id"))


@query(f"WITH {V.GEO}, q AS (SELECT *, abs(z - 4500) AS e FROM geo), f AS (SELECT id, e, id % 4 AS rf, row_number() OVER (ORDER BY x, y, id) - 1 AS i, count(*) OVER () AS n FROM q), a AS (SELECT rf, avg(e) AS score FROM f GROUP BY 1), b AS (SELECT (i >= n // 4)::INTEGER + (i >= 2 * n // 4)::INTEGER + (i >= 3 * n // 4)::INTEGER AS sf, avg(e) AS score FROM f GROUP BY 1) SELECT {r('(SELECT avg(score) FROM a) - (SELECT avg(score) FROM b)')} AS gap")
def metric_spatial_cv_gap(spark, sf_dir):
    g = V.geo(spark, sf_dir).withColumn("e", F.abs(F.col("z") - 4500))
    mean = lambda df, by: df.groupBy(by).agg(F.avg("e").alias("score"))
    blocks = P.spatial_blocks(g, "id", 4).join(g.select("id", "e"), "id")
    return _out(M.spatial_cv_gap(mean(g, F.col("id") % 4), mean(blocks, "fold")))


@query(f"WITH s AS (SELECT l_orderkey, sqrt(avg((l_discount - 0.05) ** 2)) AS s, max(l_linenumber) AS w FROM lineitem GROUP BY 1) SELECT {r('sum(s * w) / sum(w)')} AS volatility FROM s")
def metric_jitter_baseline(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("b", F.lit(0.05))
    return _out(M.jitter_around(li, "l_orderkey", "l_discount", "b", "l_linenumber"))


@query(f"""WITH {V.GEO}, m AS (SELECT avg(z) AS m FROM geo), z AS (SELECT id, x, y, z - m AS z FROM geo, m), w AS (SELECT a.z AS p, b.z AS q, 1 / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-3) AS w FROM z a JOIN z b ON a.id <> b.id)
SELECT {r('(SELECT count(*) FROM z) / sum(w) * sum(w * p * q) / (SELECT sum(z * z) FROM z)')} AS moran FROM w""")
def spatial_morans_i_inverse(spark, sf_dir):
    return _out(S.morans_i_inverse(V.geo(spark, sf_dir), "id", "z", epsilon=1e-3))


@query(f"WITH {TE} SELECT count(DISTINCT src) AS ids, 4 AS width, true AS inside FROM te")
def graph_embedding_fit(spark, sf_dir):
    """Every id has its vector, of the right width and bounds; values are checked in the tests."""
    made = N.fit_embeddings(_timed(spark, sf_dir).withColumn("y", F.col("timestamp") % 7 / 7), "src", "y", 4)
    bounds = F.forall("v", lambda x: x.between(-1.0, 1.0))
    return made.agg(F.count(F.lit(1)).alias("ids"), F.max(F.size("v")).alias("width"), F.min(bounds).alias("inside"))
