"""Queries of spatial statistics, panel effects and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.functions.columns import rounded
from loomgrid.operators import causal as C
from loomgrid.operators import graphs as N
from loomgrid.operators import joins as J
from loomgrid.operators import spatial as S
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table


def _out(df, *names):
    return df.select(*[rounded(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in (names or df.columns)])


@query(f"WITH {V.FLOWS}, s AS (SELECT src, dst, w FROM flows WHERE src <> dst) SELECT src, dst, {r('w / sum(w) OVER (PARTITION BY src)')} AS w FROM s")
def spatial_weights(spark, sf_dir):
    return _out(S.weights(V.flows(spark, sf_dir), row_normalize=True))


@query(f"WITH {V.FLOWS} SELECT n AS node FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 2) WHERE n NOT IN (SELECT src FROM flows) AND n NOT IN (SELECT dst FROM flows)")
def spatial_isolates(spark, sf_dir):
    """Nodes of all flows, and some that no flow has."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("node")).unionByName(n.where("n_regionkey = 2").select((F.col("n_nationkey") + 100).cast("long").alias("node")))
    return S.isolates(V.flows(spark, sf_dir), nodes, "node")


@query("SELECT true AS symmetric FROM (SELECT 1)")
def spatial_symmetry(spark, sf_dir):
    return S.is_symmetric(S.weights(V.flows(spark, sf_dir), symmetric=True))


@query(f"""WITH {V.GEO}, z AS (SELECT id, x, y, z - avg(z) OVER () AS z FROM geo), p AS (SELECT sum(a.z * b.z) AS t, count(*) AS w FROM z a JOIN z b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 BETWEEN 1e-12 AND 9)
SELECT {r('(SELECT count(*) FROM z) / w * t / (SELECT sum(z * z) FROM z)')} AS moran FROM p""")
def spatial_morans_i(spark, sf_dir):
    return _out(S.morans_i_within(V.geo(spark, sf_dir), "z", 3.0))


VG = f"{V.GEO}, p AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, (a.z - b.z) ** 2 / 2 AS g FROM geo a JOIN geo b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 100), vg AS (SELECT least(floor(d / 2), 4)::INTEGER AS bin, avg(d) AS mean_distance, avg(g) AS gamma, count(*) AS n FROM p GROUP BY 1)"


@query(f"WITH {VG} SELECT bin, {r('mean_distance')} AS mean_distance, {r('gamma', 3)} AS gamma, n, (bin + 0.5) * 2.0::DOUBLE AS centre FROM vg")
def spatial_variogram(spark, sf_dir):
    v = S.variogram(V.geo(spark, sf_dir), "id", "z", 5, 10.0)
    return v.select("bin", rounded("mean_distance").alias("mean_distance"), rounded("gamma", 3).alias("gamma"), "n", "centre")


@query(f"""WITH {VG}, g AS (SELECT a AS scale, s AS sill, n0 AS nugget, row_number() OVER (ORDER BY a, s, n0) AS k FROM (VALUES (2.0::DOUBLE), (5.0), (9.0)) x(a), (VALUES (1000000.0::DOUBLE), (8000000.0)) y(s), (VALUES (0.0::DOUBLE), (500000.0)) z(n0)),
e AS (SELECT k, scale, sill, nugget, sum(n * (nugget + sill * (1 - exp(-mean_distance / scale)) - gamma) ** 2) AS sse FROM vg, g GROUP BY ALL) SELECT scale, sill, nugget, sse > 0 AS fitted FROM e ORDER BY round(sse, 9), k LIMIT 1""")
def spatial_fit_variogram(spark, sf_dir):
    v = S.variogram(V.geo(spark, sf_dir), "id", "z", 5, 10.0)
    return S.fit_variogram(v, "exponential", [2, 5, 9], [1e6, 8e6], [0, 5e5]).select("scale", "sill", "nugget", (F.col("sse") > 0).alias("fitted"))


@query(f"SELECT {r('regr_slope(c_acctbal, x)')} AS slope, {r('regr_intercept(c_acctbal, x)')} AS intercept, count(*) AS n FROM (SELECT c_acctbal, (c_custkey % 97)::DOUBLE AS x FROM customer)")
def spatial_ols(spark, sf_dir):
    fit = S.ols(V.geo(spark, sf_dir), ["x"], "z")
    return _out(spark.createDataFrame([(float(fit["beta"][1]), float(fit["beta"][0]), fit["n"])], "slope double, intercept double, n long"))


def _nation_panel(spark, sf_dir):
    bal = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg((F.avg("c_acctbal") / 1000).alias("y"), F.count(F.lit(1)).alias("c"))
    nodes = bal.select("node", "y", (F.col("c") % 7).cast("double").alias("x1"))
    edges = S.weights(nodes.select(F.col("node").alias("src")).join(nodes.select(F.col("node").alias("dst")), F.abs(F.col("src") - F.col("dst")) <= 2).withColumn("w", F.lit(1.0)), row_normalize=True)
    return nodes, edges


@query()
def spatial_lag_ml(spark, sf_dir):
    nodes, edges = _nation_panel(spark, sf_dir)
    out = []
    for model in ("lag", "error", "durbin"):
        fit = S.spatial_ml(nodes, edges, "node", ["x1"], "y", model)
        out.append((model, *[float(fit[k]) for k in ("rho", "sigma2", "aic")]))
    return spark.createDataFrame(out, "model string, rho double, sigma2 double, aic double")


@query(f"WITH {V.GEO}, s AS (SELECT id, floor((x * 0.6 + y * 0.4) * (1 + id % 3) * (1 + 0.5 * exp(-(x - y) * (x - y) / 200)) * 1000000 + 0.5) / 1000000 AS score FROM geo) SELECT id, {r('score')} AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s")
def spatial_overlay(spark, sf_dir):
    g = V.geo(spark, sf_dir)
    kernel = G.overlay_kernel(F.abs(F.col("x") - F.col("y")), 10.0, "gaussian")
    return S.overlay(g, "id", {"x": 0.6, "y": 0.4}, 1 + F.col("id") % 3, kernel, 0.5).select("id", rounded("score").alias("score"), "rank")


CP = f"{V.DAILY}, ca AS (SELECT series_id AS unit, ts::VARCHAR AS t, y, series_id IN ('purchase') AS tr, ts::VARCHAR >= '2024-01-21' AS po FROM daily)"


def _effect():
    """Treated units and times after the start."""
    return F.col("unit").isin("purchase"), F.col("t") >= "2024-01-21"


def _causal(spark, sf_dir):
    return V.daily(spark, sf_dir).select(F.col("series_id").alias("unit"), F.col("ts").cast("string").alias("t"), "y")


MEANS = "avg(y) FILTER (tr AND NOT po) AS treated_pre, avg(y) FILTER (tr AND po) AS treated_post, avg(y) FILTER (NOT tr AND NOT po) AS control_pre, avg(y) FILTER (NOT tr AND po) AS control_post"


@query(f"WITH {CP}, m AS (SELECT {MEANS} FROM ca) SELECT {r('treated_pre')} AS treated_pre, {r('treated_post')} AS treated_post, {r('control_pre')} AS control_pre, {r('control_post')} AS control_post, {r('(treated_post - treated_pre) - (control_post - control_pre)')} AS effect FROM m")
def causal_did(spark, sf_dir):
    return _out(C.did(_causal(spark, sf_dir), *_effect(), "y"))


MW = f"{CP}, t AS (SELECT avg(y) AS t FROM ca WHERE tr AND NOT po), m AS (SELECT unit, avg(y) FILTER (NOT po) AS pre, avg(y) FILTER (po) AS post FROM ca WHERE NOT tr GROUP BY 1), w AS (SELECT unit, pre, post, 1 / (abs(pre - t) + 1e-6) AS w FROM m, t)"


@query(f"WITH {MW} SELECT unit, {r('w / sum(w) OVER ()')} AS weight FROM w")
def causal_matched_weights(spark, sf_dir):
    return _out(C.matched_weights(_causal(spark, sf_dir), "unit", *_effect(), "y"))


@query(f"WITH {MW} SELECT {r('(SELECT avg(y) FILTER (po) - avg(y) FILTER (NOT po) FROM ca WHERE tr) - sum(w * (post - pre)) / sum(w)')} AS effect FROM w")
def causal_matched_did(spark, sf_dir):
    return _out(C.matched_did(_causal(spark, sf_dir), "unit", *_effect(), "y"))


PL = f"{CP}, m AS (SELECT unit, avg(y) FILTER (po) AS post, avg(y) FILTER (NOT po) AS pre FROM ca WHERE NOT tr GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY md5('placebo' || unit)) AS k FROM m), pl AS (SELECT unit, (post - pre) - (SELECT avg(y) FILTER (po) - avg(y) FILTER (NOT po) FROM ca WHERE NOT tr AND ca.unit <> k.unit) AS effect FROM k WHERE k <= 3)"


@query(f"WITH {PL} SELECT unit, {r('effect')} AS effect FROM pl")
def causal_placebo(spark, sf_dir):
    return _out(C.placebo(_causal(spark, sf_dir), "unit", *_effect(), "y", 3))


@query(f"WITH {PL} SELECT {r('stddev_pop(effect) * 1.96 / 250')} AS lift FROM pl")
def causal_detectable_lift(spark, sf_dir):
    return _out(C.detectable_lift(C.placebo(_causal(spark, sf_dir), "unit", *_effect(), "y", 3), 250.0))


@query(f"WITH {MW}, g AS (SELECT unit, round(abs(pre - t), 9) + 0.0 AS gap, 0.0::DOUBLE AS exposure FROM m, t), k AS (SELECT *, row_number() OVER (ORDER BY gap, unit)::INTEGER AS rank FROM g) SELECT unit, {r('gap')} AS gap, exposure, rank FROM k WHERE rank <= 2")
def causal_design(spark, sf_dir):
    none = spark.createDataFrame([], "unit string, exposure double")
    return _out(C.design(_causal(spark, sf_dir), "unit", *_effect(), "y", none, 2))


@query(f"WITH {V.FLOWS}, t AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), b AS (SELECT src AS node, dst AS o, w FROM flows UNION ALL SELECT dst, src, w FROM flows) SELECT node, {r('sum(w)', 4)} AS exposure FROM b WHERE o IN (SELECT k FROM t) AND node NOT IN (SELECT k FROM t) GROUP BY 1")
def causal_exposures(spark, sf_dir):
    treated = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"))
    return C.exposures(V.flows(spark, sf_dir), treated).withColumn("exposure", rounded("exposure", 4))


HV = "2 * 6371.0088 * asin(sqrt(sin(radians(u.lat - t.lat) / 2) ** 2 + cos(radians(u.lat)) * cos(radians(t.lat)) * sin(radians(u.lng - t.lng) / 2) ** 2))"


@query(f"WITH {V.GEO}, v AS (SELECT id, x / 3 AS lat, y AS lng, grp = 3 AS treated FROM geo) SELECT {r(f'min({HV})', 4)} AS min_km, {r(f'avg({HV})', 4)} AS mean_km FROM v u, v t WHERE NOT u.treated AND t.treated")
def causal_distances(spark, sf_dir):
    u = V.geo(spark, sf_dir).select("id", (F.col("x") / 3).alias("lat"), F.col("y").alias("lng"), (F.col("grp") == 3).alias("treated"))
    d = C.treated_control_distance(u, "id")
    return d.select(*[rounded(c, 4).alias(c) for c in d.columns])


@query(f"WITH {V.GEO} SELECT id, {r('z - avg(z) OVER (PARTITION BY grp) + avg(z) OVER ()')} AS z FROM geo")
def causal_centred(spark, sf_dir):
    return _out(C.centred(V.geo(spark, sf_dir), "grp", ["z"]), "id", "z")


@query(f"""WITH {V.FLOWS}, o AS (SELECT src AS node, count(*) AS d, sum(w) AS w FROM flows GROUP BY 1), i AS (SELECT dst AS node, count(*) AS d, sum(w) AS w FROM flows GROUP BY 1),
b AS (SELECT src AS node, dst AS p FROM flows WHERE src <> dst UNION ALL SELECT dst, src FROM flows WHERE src <> dst), p AS (SELECT node, count(*) AS partners, avg((c = 2)::INTEGER) AS rec FROM (SELECT node, p, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) AS in_degree, {r('coalesce(o.w, 0)', 4)} AS out_w, {r('coalesce(i.w, 0)', 4)} AS in_w, coalesce(partners, 0) AS partners, {r('coalesce(rec, 0)')} AS reciprocity,
{r('(coalesce(o.w, 0) - coalesce(i.w, 0)) / (coalesce(o.w, 0) + coalesce(i.w, 0))')} AS imbalance FROM o FULL JOIN i ON o.node = i.node LEFT JOIN p ON p.node = coalesce(o.node, i.node)""")
def graph_directional(spark, sf_dir):
    d = N.directional(V.flows(spark, sf_dir))
    return d.select(*[rounded(c, 4).alias(c) if c in ("out_w", "in_w") else rounded(c).alias(c) if c in ("reciprocity", "imbalance") else F.col(c) for c in d.columns])


@query(f"WITH {V.FLOWS}, e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w * CASE WHEN src < dst THEN 1 ELSE -1 END AS d, w FROM flows WHERE src <> dst) SELECT src, dst, {r('sum(d) / sum(w)')} AS asymmetry FROM e GROUP BY 1, 2")
def graph_asymmetry(spark, sf_dir):
    return _out(N.asymmetry(V.flows(spark, sf_dir)))


@query(f"WITH {V.FLOWS} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, {r('sum(w)', 4)} AS w FROM flows GROUP BY 1, 2")
def graph_undirected(spark, sf_dir):
    return N.normalize(V.flows(spark, sf_dir), directed=False).withColumn("w", rounded("w", 4))


@query(f"WITH {V.FLOWS}, n AS (SELECT src AS node FROM flows UNION SELECT dst FROM flows) SELECT node, row_number() OVER (ORDER BY node) - 1 AS index FROM n")
def graph_indexed(spark, sf_dir):
    return N.indexed(V.flows(spark, sf_dir)).select("node", F.col("index").cast("long").alias("index"))


@query(f"WITH {V.FLOWS}, s AS (SELECT src, dst, w, CASE WHEN (src + dst) % 2 = 0 THEN 'a' ELSE 'b' END AS relation FROM flows) SELECT src, dst, relation, {r('w', 4)} AS w FROM s UNION ALL SELECT dst, src, 'rev_' || relation, {r('w', 4)} FROM s")
def graph_reversed(spark, sf_dir):
    e = V.flows(spark, sf_dir).withColumn("relation", F.when((F.col("src") + F.col("dst")) % 2 == 0, "a").otherwise("b"))
    return N.reversed_edges(e, "relation").withColumn("w", rounded("w", 4))


TE = "te AS (SELECT user_id AS src, (user_id * 7 + length(event_type)) % 150 AS dst, 1.0::DOUBLE AS w, epoch(ts) / 86400.0 AS timestamp FROM events)"


def _timed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("src"), ((F.col("user_id") * 7 + F.length("event_type")) % 150).alias("dst"), F.lit(1.0).alias("w"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0).alias("timestamp"))


@query(f"WITH {TE} SELECT src AS node, {r('sum(w * 0.5 ** (((SELECT max(timestamp) FROM te) - timestamp) / 7))', 4)} AS degree FROM te GROUP BY 1")
def graph_time_weighted_degree(spark, sf_dir):
    d = N.time_weighted_degree(_timed(spark, sf_dir), 7.0)
    return d.select("node", rounded("degree", 4).alias("degree"))


@query(f"""WITH {V.FLOWS}, f AS (SELECT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 'a' ELSE 'b' END AS relation FROM flows), w0 AS (SELECT n_nationkey AS walk, n_nationkey AS node FROM nation),
w1 AS (SELECT walk, arg_min(dst, md5('walk1|' || walk || '|' || dst)) AS node FROM w0 JOIN f ON src = node AND relation = 'a' GROUP BY 1), w2 AS (SELECT walk, arg_min(dst, md5('walk2|' || walk || '|' || dst)) AS node FROM w1 JOIN f ON src = node AND relation = 'b' GROUP BY 1)
SELECT walk, 0 AS step, node FROM w0 UNION ALL SELECT walk, 1, node FROM w1 UNION ALL SELECT walk, 2, node FROM w2""")
def graph_metapath_walks(spark, sf_dir):
    e = V.flows(spark, sf_dir).withColumn("relation", F.when((F.col("src") + F.col("dst")) % 2 == 0, "a").otherwise("b"))
    return N.metapath_walks(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), e, ["a", "b"])


def _walk_step(k: int) -> str:
    draw = f"md5('time{k}|' || walk || '|' || dst || '|' || timestamp::DECIMAL(38,6)::VARCHAR)"
    return f"w{k} AS (SELECT walk, m.node, m.tm FROM (SELECT walk, arg_min({{'node': dst, 'tm': timestamp}}, {draw}) AS m FROM w{k - 1} JOIN te ON src = node AND (tm IS NULL OR timestamp > tm + 0.5) GROUP BY 1))"


@query(f"""WITH {TE}, w0 AS (SELECT DISTINCT src AS walk, src AS node, NULL::DOUBLE AS tm FROM te), {', '.join(map(_walk_step, (1, 2, 3)))}
""" + " UNION ALL ".join(f"SELECT walk, {k} AS step, node, {r('tm')} AS \"at\" FROM w{k}" for k in range(4)))  # fmt: skip
def graph_temporal_walks(spark, sf_dir):
    e = _timed(spark, sf_dir)
    return _out(N.temporal_walks(e.select(F.col("src").alias("node")).distinct(), e, 3, 0.5))


NODES = f"{TE}, e AS (SELECT DISTINCT src, dst FROM te), nd AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS index FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), c AS (SELECT count(*) AS n FROM nd)"


@query(f"""WITH {NODES}, s AS (SELECT n, (SELECT max(s) FROM range(1, 100000) t(s) WHERE s <= greatest(1, floor(n * 0.618)) AND gcd(s, n) = 1) AS step FROM c), d AS (SELECT src, count(*) AS d FROM e GROUP BY 1),
k AS (SELECT e.src, e.dst AS target, unnest(range(least(d + 3, n))) AS k, n, step, ('0x' || left(md5('negstart|' || e.src || '|' || e.dst), 12))::BIGINT AS start FROM e JOIN d ON d.src = e.src, s),
f AS (SELECT k.src, target, node AS dst, k FROM k JOIN nd ON index = (start % n + k * step) % n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = k.src AND e.dst = nd.node))
SELECT src, target, dst FROM f QUALIFY row_number() OVER (PARTITION BY src, target ORDER BY k) <= 3""")
def graph_negative_edges(spark, sf_dir):
    e = _timed(spark, sf_dir).select("src", "dst").distinct()
    return N.negative_edges(e, N.indexed(e), 3)


@query(f"WITH {V.FLOWS}, v AS (SELECT n_nationkey AS node, n_regionkey::DOUBLE AS v FROM nation), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM flows), a AS (SELECT v.node, coalesce((SELECT sum(s * u.v) FROM s JOIN v u ON u.node = dst WHERE src = v.node), v.v) AS v FROM v) SELECT a.node, {r('coalesce((SELECT sum(s * u.v) FROM s JOIN a u ON u.node = dst WHERE src = a.node), a.v)')} AS v FROM a")
def graph_diffuse(spark, sf_dir):
    values = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("double").alias("v"))
    return _out(N.diffuse(V.flows(spark, sf_dir), values, 2))


@query(f"WITH {V.RANKING}, u AS (SELECT grp, id, score / 10000 + 0.15 * (score / 10000 - avg(score / 10000) OVER (PARTITION BY grp)) AS u FROM rk), e AS (SELECT *, exp(u - max(u) OVER (PARTITION BY grp)) AS e FROM u) SELECT grp, id, {r('e / sum(e) OVER (PARTITION BY grp)')} AS probability, row_number() OVER (PARTITION BY grp ORDER BY u DESC, id) = 1 AS chosen FROM e")
def graph_choice_softmax(spark, sf_dir):
    d = V.ranking(spark, sf_dir).withColumn("u", F.col("score") / 10000)
    return _out(N.choice_softmax(d, "grp", "id", "u"))


@query(f"WITH {V.RANKING}, a AS (SELECT *, max(rel >= 2) OVER (PARTITION BY grp) AS any_ok FROM rk), k AS (SELECT grp, id, any_ok, row_number() OVER (PARTITION BY grp ORDER BY score - id * 100.0 DESC, id) AS k FROM a WHERE rel >= 2 OR NOT any_ok) SELECT grp, id, NOT any_ok AS fallback FROM k WHERE k = 1")
def graph_constrained_pick(spark, sf_dir):
    d = V.ranking(spark, sf_dir).withColumn("pen", F.col("id") * 100.0)
    return N.constrained_pick(d, "grp", "id", "score", "pen", F.col("rel") >= 2)


@query(f"""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS a FROM x GROUP BY 1, 2)
SELECT vec_id, label < 8 AS known, (k - 1)::INTEGER AS k, {r('CASE WHEN label < 8 THEN (SELECT a FROM m WHERE m.label = x.label AND m.k = x.k) ELSE (SELECT avg(a) FROM m WHERE label < 8 AND m.k = x.k) END')} AS v FROM x""")
def graph_embedding_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = e.where("label < 8").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    t = means.groupBy(F.col("label").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    return _out(N.embedding_lookup(e.select("vec_id", "label"), "label", t).select("vec_id", "known", F.posexplode("v").alias("k", "v")))


@query(f"""WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.id, b.id AS r_id, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, r_id) AS k FROM p) SELECT id, r_id, {r('c')} AS cosine FROM k WHERE k <= 5""")
def graph_vector_search(spark, sf_dir):
    from loomgrid.operators.vectors import cosine_top_k

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _out(cosine_top_k(e.where("id % 50 = 0"), e, "id", "v", 5))
