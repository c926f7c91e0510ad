"""Queries of boosting, hierarchies and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import boosting as B
from loomgrid.operators import hierarchies as H
from loomgrid.operators import joins as J
from loomgrid.plans.catalog import query, r
from loomgrid.plans.split_queries import TREE, _tree
from loomgrid.sources.tables import table


def _out(df, *names):
    return df.select(*[rounded(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in (names or df.columns)])


EDGES = {"l_discount": [0.015, 0.035, 0.055, 0.075], "l_tax": [0.015, 0.045], "l_linenumber": [1.5, 2.5, 3.5, 4.5, 5.5]}
BIN = lambda c: " + ".join(f"({c} > {e})::INTEGER" for e in EDGES[c])
HIST = " UNION ALL ".join(f"SELECT '{c}' AS feature, ({BIN(c)})::INTEGER AS bin, l_quantity AS w, l_extendedprice / 1000 AS y FROM lineitem" for c in EDGES)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)


@query(f"WITH h AS ({HIST}) SELECT feature, bin, count(*) AS n, {r('sum(w)', 4)} AS w, {r('sum(w * y)')} AS wy, {r('sum(w * y * y) / sum(w)', 4)} AS mean_square, {r('(sum(w * y * y) - sum(w * y) ** 2 / sum(w)) / sum(w)', 4)} AS spread FROM h GROUP BY 1, 2")
def boost_histogram(spark, sf_dir):
    h = B.histogram(_lines(spark, sf_dir), list(EDGES), "y", "l_quantity", EDGES)
    sse = B.weighted_sse(F.col("w"), F.col("wy"), F.col("wyy"))
    return h.select("feature", "bin", "n", rounded("w", 4).alias("w"), rounded("wy").alias("wy"), rounded(F.col("wyy") / F.col("w"), 4).alias("mean_square"), rounded(sse / F.col("w"), 4).alias("spread"))


@query(f"WITH h AS ({HIST.replace('FROM lineitem', 'FROM lineitem WHERE l_quantity > 20')}) SELECT feature, bin, count(*) AS n, {r('sum(w)', 4)} AS w FROM h GROUP BY 1, 2")
def boost_sibling_histogram(spark, sf_dir):
    d = _lines(spark, sf_dir)
    h = lambda x: B.histogram(x, list(EDGES), "y", "l_quantity", EDGES)
    return B.subtract(h(d), h(d.where("l_quantity <= 20"))).select("feature", "bin", "n", rounded("w", 4).alias("w"))


CLOSURE = f"""{TREE}, leaf AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)), cl AS (SELECT node, node AS leaf FROM leaf UNION ALL SELECT t.parent, cl.leaf FROM cl JOIN tree t ON t.node = cl.node WHERE t.parent IS NOT NULL),
lv AS (SELECT 'n' || c_nationkey AS leaf, c_mktsegment AS k, sum(c_acctbal) AS mean FROM customer GROUP BY 1, 2), hi AS (SELECT 'n' || c_nationkey AS leaf, count(*)::DOUBLE AS total FROM customer GROUP BY 1)"""


def _levels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    node = F.concat(F.lit("n"), "c_nationkey").alias("node")
    return J.closure(_tree(spark, sf_dir), "node", "parent"), c.groupBy(node, F.col("c_mktsegment").alias("k")).agg(F.sum("c_acctbal").alias("mean")), c.groupBy(node).agg(F.count(F.lit(1)).cast("double").alias("total"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, k, {r('sum(mean)')} AS mean FROM cl JOIN lv ON lv.leaf = cl.leaf GROUP BY 1, 2")
def hierarchy_bottom_up(spark, sf_dir):
    cl, lv, _ = _levels(spark, sf_dir)
    return H.bottom_up(cl, lv, ["k"]).withColumn("mean", rounded("mean"))


@query(f"WITH RECURSIVE {CLOSURE}, t AS (SELECT k, sum(mean) * 1.1 AS t FROM lv GROUP BY 1), p AS (SELECT leaf, total / sum(total) OVER () AS p FROM hi) SELECT cl.node, k, {r('sum(t * p)')} AS mean FROM cl JOIN p ON p.leaf = cl.leaf, t GROUP BY 1, 2")
def hierarchy_top_down(spark, sf_dir):
    cl, lv, hi = _levels(spark, sf_dir)
    totals = lv.groupBy("k").agg((F.sum("mean") * 1.1).alias("mean")).withColumn("node", F.lit("all"))
    return H.top_down(cl, "all", totals, hi, ["k"]).withColumn("mean", rounded("mean"))


@query(f"WITH RECURSIVE {CLOSURE}, m AS (SELECT cl.node AS m, k, sum(mean) * 0.9 AS t FROM cl JOIN lv ON lv.leaf = cl.leaf WHERE cl.node LIKE 'r%' GROUP BY 1, 2), p AS (SELECT cl.node AS m, hi.leaf, total / sum(total) OVER (PARTITION BY cl.node) AS p FROM cl JOIN hi ON hi.leaf = cl.leaf WHERE cl.node LIKE 'r%') SELECT cl.node, k, {r('sum(t * p)')} AS mean FROM cl JOIN p ON p.leaf = cl.leaf JOIN m ON m.m = p.m GROUP BY 1, 2")
def hierarchy_middle_out(spark, sf_dir):
    cl, lv, hi = _levels(spark, sf_dir)
    f = H.bottom_up(cl, lv, ["k"]).where("node LIKE 'r%'").withColumn("mean", F.col("mean") * 0.9)
    return H.middle_out(cl, [f"r{k}" for k in range(5)], f, hi, ["k"]).withColumn("mean", rounded("mean"))


@query(f"WITH RECURSIVE {CLOSURE}, s AS (SELECT k, sum(mean) AS s FROM lv GROUP BY 1) SELECT node, lv.k, {r('sum(mean * sqrt(1.21))')} AS mean FROM cl JOIN lv ON lv.leaf = cl.leaf JOIN s ON s.k = lv.k GROUP BY 1, 2")
def hierarchy_proportional(spark, sf_dir):
    cl, lv, _ = _levels(spark, sf_dir)
    f = H.bottom_up(cl, lv, ["k"]).withColumn("mean", F.when(F.col("node") == "all", F.col("mean") * 1.21).otherwise(F.col("mean")))
    return H.proportional(cl, "all", f, ["k"], 0.5).withColumn("mean", rounded("mean"))


def _reconciled(name: str, **kw):
    def run(spark, sf_dir):
        cl, lv, _ = _levels(spark, sf_dir)
        f = H.bottom_up(cl, lv, ["k"]).withColumn("mean", F.when(F.col("node") == "all", F.col("mean") * 1.05).otherwise(F.col("mean")))
        args = dict(kw)
        nodes = [x.node for x in cl.select("node").distinct().collect()]
        if name == "mint":
            args["residuals"] = {n: [((k * 7 + len(n) * 3 + ord(n[-1])) % 11) - 5.0 + 0.1 * k for k in range(12)] for n in nodes}
        out = H.reconcile(cl, f, ["k"], **args)
        return out.withColumn("mean", rounded("mean"))

    run.__name__ = f"hierarchy_{name}"
    return query()(run)


_reconciled("mint")
