"""Queries of boosted trees.  The SQL grows the same trees round by round: cells, prefix sums, the best split of each
node, and the leaves, as one chain of materialised tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.functions.columns import rounded
from loomgrid.operators import boosting as B
from loomgrid.operators.ordered import dealt
from loomgrid.plans import views as V
from loomgrid.plans.catalog import query, r
from loomgrid.sources.tables import table


def _out(df, *names):
    return df.select(*[rounded(c).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in (names or df.columns)])


#: (g, h, initial margin, prediction) of each loss in SQL, of margin f and target y.
SQL_LOSS = {
    "l2": ("f - y", "1.0", "avg(y)", "f"),
    "log_l2": ("f - ln(y + 0.5)", "1.0", "avg(ln(y + 0.5))", "exp(f) - 0.5"),
    "l1": ("sign(f - y)", "1.0", "quantile", "f"),
    "huber": ("least(greatest(f - y, -1.0), 1.0)", "1.0", "quantile", "f"),
    "logistic": ("1 / (1 + exp(-f)) - y", "greatest(1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))), 1e-12)", "ln(avg(y) / (1 - avg(y)))", "1 / (1 + exp(-f))"),
    "poisson": ("exp(f) - y", "greatest(exp(f), 1e-12)", "ln(avg(y))", "exp(f)"),
    "negative_binomial": ("(exp(f) - y) / (1 + exp(f) * 0.5)", "greatest(exp(f) * (1 + y * 0.5) / (1 + exp(f) * 0.5) ** 2, 1e-12)", "ln(avg(y))", "exp(f)"),
    "tweedie": ("exp(f * 0.5) - y * exp(f * -0.5)", "greatest(exp(f * 0.5) * 0.5 + y * exp(f * -0.5) * 0.5, 1e-12)", "ln(avg(y))", "exp(f)"),
    "quantile": ("CASE WHEN y > f THEN -{q} ELSE 1 - {q} END", "1.0", "quantile", "f"),
}


def trees_sql(loss: str, features: list[str], trees: int, depth: int, rate: float, q: float = 0.5, tag: str = "", monotone: dict[str, int] | None = None, rule: tuple[str, str, str] | None = None) -> str:
    """CTEs from a table ``d{tag}`` (id, y, features) to ``m{tag}`` (id, f): the margins after all trees.  ``rule`` stands in
    for the loss's gradient, hessian and first margin."""
    g, h, init = rule or [x.format(q=q) for x in SQL_LOSS[loss][:3]]
    if init == "quantile":
        init = f"(SELECT min(y) FROM (SELECT y, sum(count(*)) OVER (ORDER BY y) AS c, sum(count(*)) OVER () AS n FROM d{tag} GROUP BY y) WHERE c >= {q} * n - 1e-9 * n)"
    else:
        init = f"(SELECT {init} FROM d{tag})"
    cols = ", ".join(features)
    parts = [f"r{tag}0 AS MATERIALIZED (SELECT id, y, {cols}, {init}::DOUBLE AS f FROM d{tag})"]
    signs = " ".join(f"WHEN j = {j} THEN {monotone[c]}" for j, c in enumerate(features) if monotone and c in monotone)
    fits = f"AND (CASE {signs} ELSE 0 END) * (-(tg - lg) / (th - lh + 1.0) + lg / (lh + 1.0)) >= 0" if signs else ""
    for t in range(trees):
        k = f"{tag}{t}"
        parts.append(f"n{k}_0 AS MATERIALIZED (SELECT id, y, f, {cols}, {g} AS g, {h} AS h, 0 AS n FROM r{k})")
        for level in range(depth):
            now = f"n{k}_{level}"
            cells = " UNION ALL ".join(f"SELECT n, {j} AS j, {c}::DOUBLE AS v, sum(g) AS g, sum(h) AS h, count(*) AS w FROM {now} WHERE n >= {2**level - 1} GROUP BY n, v" for j, c in enumerate(features))
            parts += [
                f"c{k}_{level} AS (SELECT n, j, (v + lead(v) OVER o) / 2 AS cut, sum(g) OVER o AS lg, sum(h) OVER o AS lh, sum(w) OVER o AS lw, sum(g) OVER a AS tg, sum(h) OVER a AS th, sum(w) OVER a AS tw FROM ({cells}) WINDOW o AS (PARTITION BY n, j ORDER BY v), a AS (PARTITION BY n, j))",
                f"s{k}_{level} AS (SELECT *, lg * lg / (lh + 1.0) + (tg - lg) ** 2 / (th - lh + 1.0) - tg * tg / (th + 1.0) AS gain FROM c{k}_{level} WHERE cut IS NOT NULL AND lw >= 1 AND tw - lw >= 1 {fits})",
                f"p{k}_{level} AS MATERIALIZED (SELECT n, j, cut, gain FROM s{k}_{level} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY n ORDER BY round(gain, 7) DESC, j, cut) = 1)",
            ]
            left = "CASE " + " ".join(f"WHEN p.j = {j} THEN {c} <= p.cut" for j, c in enumerate(features)) + " END"
            parts.append(f"n{k}_{level + 1} AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN p.n IS NULL THEN d.n WHEN {left} THEN 2 * d.n + 1 ELSE 2 * d.n + 2 END AS n) FROM {now} d LEFT JOIN p{k}_{level} p ON p.n = d.n)")
        leaves = f"n{k}_{depth}"
        if loss in ("l1", "quantile"):
            value = f"SELECT n, min(e) AS v FROM (SELECT n, e, sum(count(*)) OVER (PARTITION BY n ORDER BY e) AS c, sum(count(*)) OVER (PARTITION BY n) AS t FROM (SELECT n, y - f AS e FROM {leaves}) GROUP BY n, e) WHERE c >= {q} * t - 1e-9 * t GROUP BY n"
        else:
            value = f"SELECT n, -sum(g) / (sum(h) + 1.0) AS v FROM {leaves} GROUP BY n"
        parts.append(f"v{k} AS MATERIALIZED (SELECT n, {rate} * v AS v FROM ({value}))")
        parts.append(f"r{tag}{t + 1} AS MATERIALIZED (SELECT id, y, {cols}, f + v AS f FROM {leaves} d JOIN v{k} l ON l.n = d.n)")
    return ", ".join([*parts, f"m{tag} AS (SELECT id, y, {cols}, f FROM r{tag}{trees})"])


def apply_sql(name: str, rows: str, features: list[str], trees: int, depth: int, tag: str) -> str:
    """Tables up to ``name`` (id, f): the margins by ``trees_sql``'s trees of a tag, of other rows (id, features)."""
    cols = ", ".join(features)
    parts = [f"{name}_0 AS MATERIALIZED (SELECT id, {cols}, (SELECT any_value(f) FROM r{tag}0) AS f FROM ({rows}))"]
    for t in range(trees):
        now = f"(SELECT *, 0 AS n FROM {name}_{t})"
        for level in range(depth):
            left = "CASE " + " ".join(f"WHEN p.j = {j} THEN {c} <= p.cut" for j, c in enumerate(features)) + " END"
            now = f"(SELECT d.* REPLACE (CASE WHEN p.n IS NULL THEN d.n WHEN {left} THEN 2 * d.n + 1 ELSE 2 * d.n + 2 END AS n) FROM {now} d LEFT JOIN p{tag}{t}_{level} p ON p.n = d.n)"
        parts.append(f"{name}_{t + 1} AS MATERIALIZED (SELECT id, {cols}, f + v AS f FROM {now} d JOIN v{tag}{t} l ON l.n = d.n)")
    return ", ".join([*parts, f"{name} AS (SELECT id, f FROM {name}_{trees})"])


def _signal(loss: str) -> tuple[str, str]:
    """The target in SQL, which Spark reads as well."""
    base = "(CASE WHEN a + b > 11 THEN 3.0 ELSE 1.0 END + a / 6)"
    if loss == "logistic":
        return "CAST(CASE WHEN (a + b + c_custkey % 5) > 13 THEN 1 ELSE 0 END AS DOUBLE)", base
    if loss in ("poisson", "tweedie", "negative_binomial"):
        return f"CAST(floor({base} + c_custkey % 3) AS DOUBLE)", base
    return f"CAST({base} + c_custkey % 4 * 0.25 AS DOUBLE)", base


D = "x AS (SELECT c_custkey, (c_custkey % 13)::DOUBLE AS a, (c_custkey * 7 % 11)::DOUBLE AS b FROM customer), d{tag} AS (SELECT c_custkey AS id, a, b, {y} AS y FROM x)"


def _rows(spark, sf_dir, loss: str):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 13).cast("double").alias("a"), (F.col("c_custkey") * 7 % 11).cast("double").alias("b"))
    return c.withColumn("y", F.expr(_signal(loss)[0]))


def _boost(loss: str, **kw):
    monotone = kw.get("monotone")
    q = kw.get("alpha", 0.5) if loss == "quantile" else 0.5

    def run(spark, sf_dir):
        d = _rows(spark, sf_dir, loss)
        model = B.fit(d, B.Spec(["a", "b"], "y", loss=loss, trees=3, depth=2, bins=16, rate=0.5, **kw))
        made = B.predict(B.Model.from_json(model.to_json()), d)
        return _out(made.select(F.col("c_custkey").alias("id"), "prediction"))

    run.__name__ = f"boost_{loss}"
    sql = f"WITH {D.format(tag='', y=_signal(loss)[0])}, {trees_sql(loss, ['a', 'b'], 3, 2, 0.5, q, monotone=monotone)} SELECT id, {r(SQL_LOSS[loss][3])} AS prediction FROM m"
    return query(sql)(run)


for _loss, _kw in (("l2", {}), ("log_l2", {}), ("l1", {}), ("huber", {"alpha": 1.0}), ("logistic", {}), ("poisson", {}), ("negative_binomial", {}), ("tweedie", {}), ("quantile", {"alpha": 0.8})):
    _boost(_loss, **_kw)


@query(f"WITH {D.format(tag='', y=_signal('l2')[0])}, {trees_sql('l2', ['a', 'b'], 3, 1, 0.5, monotone={'a': 1, 'b': -1})} SELECT id, {r('f')} AS prediction FROM m")
def boost_monotone(spark, sf_dir):
    model = B.fit(_rows(spark, sf_dir, "l2"), B.Spec(["a", "b"], "y", trees=3, depth=1, bins=16, rate=0.5, monotone={"a": 1, "b": -1}))
    return _out(B.predict(model, _rows(spark, sf_dir, "l2")).select(F.col("c_custkey").alias("id"), "prediction"))


LEVELS = (0.1, 0.5, 0.9)
QSETS = ", ".join(f"d{k} AS (SELECT * FROM dq), {trees_sql('quantile', ['a'], 2, 1, 0.5, q, tag=str(k) + 'q').replace(f'd{k}q', f'd{k}')}" for k, q in enumerate(LEVELS))


@query(f"WITH x AS (SELECT c_custkey, (c_custkey % 13)::DOUBLE AS a, c_acctbal AS y FROM customer), dq AS (SELECT c_custkey AS id, a, y FROM x), {QSETS} SELECT a.id AS c_custkey, {r('a.f')} AS q10, {r('greatest(a.f, b.f)')} AS q50, {r('greatest(a.f, b.f, c.f)')} AS q90 FROM m0q a JOIN m1q b ON b.id = a.id JOIN m2q c ON c.id = a.id")
def boost_quantiles(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 13).cast("double").alias("a"), F.col("c_acctbal").alias("y"))
    models = B.quantile_set(d, B.Spec(["a"], "y", trees=2, depth=1, bins=16, rate=0.5), list(LEVELS))
    return _out(B.predict_quantiles(models, d), "c_custkey", "q10", "q50", "q90")


HURDLE = f"{V.SPARSE}, sx AS (SELECT series_id, ts, y, day(ts)::DOUBLE AS x, (series_id::BIGINT % 20)::DOUBLE AS k FROM sparse), dz AS (SELECT series_id || '|' || ts AS id, x, k, (y > 0)::INTEGER::DOUBLE AS y FROM sx), dp AS (SELECT series_id || '|' || ts AS id, x, k, y FROM sx WHERE y > 0)"


@query(f"""WITH {HURDLE}, {trees_sql('logistic', ['x', 'k'], 2, 1, 0.5, tag='z')}, {trees_sql('poisson', ['x', 'k'], 2, 1, 0.5, tag='p')},
u AS (SELECT DISTINCT x, k, f FROM mp), z AS (SELECT DISTINCT x, k, f FROM mz) SELECT sx.series_id, sx.ts, {r('1 / (1 + exp(-z.f)) * exp(u.f)')} AS prediction FROM sx JOIN z ON z.x = sx.x AND z.k = sx.k JOIN u ON u.x = sx.x AND u.k = sx.k""")
def boost_hurdle(spark, sf_dir):
    """A count by a zero part and a positive part, where both parts know the row's features."""
    s = V.sparse(spark, sf_dir).withColumns({"x": F.dayofmonth("ts").cast("double"), "k": (F.col("series_id").cast("long") % 20).cast("double"), "some": (F.col("y") > 0).cast("double")})
    spec = {"features": ["x", "k"], "trees": 2, "depth": 1, "bins": 40, "rate": 0.5}
    zero = B.fit(s, B.Spec(y="some", loss="logistic", **spec))
    size = B.fit(s.where("y > 0"), B.Spec(y="y", loss="poisson", **spec))
    made = s.withColumn("prediction", B.transform(zero.spec, B.margin(zero)) * B.transform(size.spec, B.margin(size)))
    return _out(made.join(s.where("y > 0").select("x", "k").distinct(), ["x", "k"], "left_semi"), "series_id", "ts", "prediction")


GR = "t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity / 10 AS y, l_tax * 10 AS f FROM lineitem)"


@query(f"WITH {GR} SELECT k, i, " + ", ".join(f"{r(f'({SQL_LOSS[n][j].format(q=0.8)})::DOUBLE')} AS {x}_{n}" for n in SQL_LOSS for j, x in ((0, "g"), (1, "h"))) + " FROM t")
def boost_gradients(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 10).alias("y"), (F.col("l_tax") * 10).alias("f"))
    alpha = {"huber": 1.0, "quantile": 0.8}
    cols = []
    for n in SQL_LOSS:
        g, h = B.gradients(B.Spec([], "y", loss=n, alpha=alpha.get(n, 0.5)), F.col("f"), F.col("y"))
        cols += [rounded(g).alias(f"g_{n}"), rounded(h).alias(f"h_{n}")]
    return t.select("k", "i", *cols)


SOFT = "t AS (SELECT l_orderkey AS k, l_linenumber AS i, l_linenumber % 3 AS y, l_tax * 10 AS a, l_discount * 10 AS b, 0.25::DOUBLE AS c FROM lineitem), e AS (SELECT *, exp(a) / (exp(a) + exp(b) + exp(c)) AS p0, exp(b) / (exp(a) + exp(b) + exp(c)) AS p1, exp(c) / (exp(a) + exp(b) + exp(c)) AS p2 FROM t)"


@query(f"WITH {SOFT} SELECT k, i, " + ", ".join(f"{r(f'p{j} - (y = {j})::INTEGER')} AS g{j}, {r(f'p{j} * (1 - p{j})')} AS h{j}" for j in range(3)) + " FROM e")
def boost_softmax_gradients(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_linenumber") % 3).alias("y"), (F.col("l_tax") * 10).alias("a"), (F.col("l_discount") * 10).alias("b"), F.lit(0.25).alias("c"))
    pairs = B.softmax_gradients([F.col(x) for x in "abc"], F.col("y"), [0, 1, 2])
    return t.select("k", "i", *[x.alias(f"{n}{j}") for j, p in enumerate(pairs) for n, x in (("g", rounded(p[0])), ("h", rounded(p[1])))])


PAIR = f"{V.RANKING}, t AS (SELECT grp AS k, id AS i, max(rel)::DOUBLE AS y, max(score) / 50000 AS f FROM rk GROUP BY 1, 2), o AS (SELECT *, 2 ** y - 1 AS gain, 1 / log2(row_number() OVER (PARTITION BY k ORDER BY f DESC, i) + 1) AS disc, 1 / log2(row_number() OVER (PARTITION BY k ORDER BY y DESC, i) + 1) AS best FROM t), w AS (SELECT *, sum(gain * best) OVER (PARTITION BY k) AS ideal FROM o)"
PAIR_SUMS = """p AS (SELECT a.k, a.i, b.i AS j, 1 / (1 + exp(a.f - b.f)) AS rho, abs(a.gain - b.gain) * abs(a.disc - b.disc) / a.ideal AS n FROM w a JOIN w b ON a.k = b.k AND a.y > b.y),
s AS (SELECT k, i, -rho AS g, rho * (1 - rho) AS h, -n * rho AS gn, n * rho * (1 - rho) AS hn FROM p UNION ALL SELECT k, j, rho, rho * (1 - rho), n * rho, n * rho * (1 - rho) FROM p)"""


def _candidates(spark, sf_dir):
    return dealt(V.ranking(spark, sf_dir), "grp").groupBy("grp", "id").agg(F.max("rel").alias("rel"), F.max("score").alias("score"))


@query(f"WITH {PAIR}, {PAIR_SUMS} SELECT t.k, t.i, " + ", ".join(f"{r(f'coalesce(sum({x}), 0)')} AS {x}" for x in ("g", "h", "gn", "hn")) + " FROM t LEFT JOIN s ON s.k = t.k AND s.i = t.i GROUP BY 1, 2")
def boost_pair_gradients(spark, sf_dir):
    t = _candidates(spark, sf_dir).select(F.col("grp").alias("k"), F.col("id").alias("i"), F.col("rel").alias("y"), (F.col("score") / 50000).alias("f"))
    plain, ndcg = B.pair_gradients(t, "k", "i", "y", "f"), B.pair_gradients(t, "k", "i", "y", "f", by_ndcg=True).withColumnsRenamed({"g": "gn", "h": "hn"})
    return _out(plain.join(ndcg, ["k", "i"]))


CLASSES = "x AS (SELECT c_custkey, (c_custkey % 13)::DOUBLE AS a, (c_custkey * 7 % 11)::DOUBLE AS b, ((c_custkey % 13 + c_custkey * 7 % 11) // 8)::INTEGER AS y FROM customer)"


def _class(k: int) -> str:
    """A class's first tree: the gradients are those of the classes' shares."""
    p = f"(SELECT avg((y = {k})::INTEGER) FROM x)"
    rule = (f"{p} - y", f"{p} * (1 - {p})", "ln(avg(y))")
    return f"dk{k} AS (SELECT c_custkey AS id, a, b, (y = {k})::INTEGER::DOUBLE AS y FROM x), {trees_sql('l2', ['a', 'b'], 1, 2, 0.5, tag=f'k{k}', rule=rule)}"


@query(f"""WITH {CLASSES}, {', '.join(map(_class, range(3)))}, e AS (SELECT p.id, exp(p.f) AS a, exp(q.f) AS b, exp(s.f) AS c FROM mk0 p JOIN mk1 q ON q.id = p.id JOIN mk2 s ON s.id = p.id)
SELECT id, {', '.join(f"{r(f'{x} / (a + b + c)')} AS probability_{k}" for k, x in enumerate('abc'))}, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS predicted FROM e""")
def boost_softmax(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 13).cast("double").alias("a"), (F.col("c_custkey") * 7 % 11).cast("double").alias("b"))
    d = c.withColumn("y", F.floor((F.col("a") + F.col("b")) / 8).cast("int"))
    model = B.fit_multiclass(d, B.Spec(["a", "b"], "y", trees=1, depth=2, bins=16, rate=0.5), [0, 1, 2])
    return _out(B.predict_classes(model, d), "id", "probability_0", "probability_1", "probability_2", "predicted")


RANKED = f"""{PAIR.replace('max(score) / 50000 AS f', '0.0::DOUBLE AS f')}, {PAIR_SUMS}, z AS (SELECT t.k, t.i, t.y, coalesce(sum(gn), 0) AS g, greatest(coalesce(sum(hn), 0), 1e-12) AS h FROM t LEFT JOIN s ON s.k = t.k AND s.i = t.i GROUP BY 1, 2, 3),
dr AS (SELECT k || '|' || i AS id, y, g, h, (i * 3 % 7)::DOUBLE AS a FROM z)"""


@query(f"WITH {RANKED}, {trees_sql('l2', ['a'], 1, 2, 0.5, tag='r', rule=('g', 'h', 'min(0.0)')).replace('r0 AS MATERIALIZED (SELECT id, y, a,', 'r0 AS MATERIALIZED (SELECT id, y, g, h, a,')} SELECT a, {r('any_value(f)')} AS margin, count(*) AS n FROM mr GROUP BY a")
def boost_lambda_rank(spark, sf_dir):
    d = _candidates(spark, sf_dir).withColumn("a", (F.col("id") * 3 % 7).cast("double"))
    model = B.fit_ranker(d, B.Spec(["a"], "rel", trees=1, depth=2, bins=16, rate=0.5), "grp", "id")
    return _out(d.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("margin", B.margin(model)), "a", "margin", "n")


def _root(value: str) -> str:
    """The rows of which a root split is sought, and their mean."""
    return f"WITH t AS (SELECT c_custkey, (c_custkey % 24)::DOUBLE AS hour, (c_custkey % 17)::DOUBLE AS x, (c_custkey * 5 % 19)::DOUBLE AS z, {value} AS y FROM customer), m AS (SELECT avg(y) AS m, count(*) AS n FROM t)"


HOUR = "CASE WHEN c_custkey % 24 >= 22 OR c_custkey % 24 <= 4 THEN 5.0 ELSE 1.0 END + (c_custkey % 5) * 0.01"
GAIN = "{0} * {0} / ({1} + 1) + (0 - {0}) ** 2 / (n - {1} + 1)"


def _hours(spark, sf_dir, value: str):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_custkey") % 24).cast("double").alias("hour"), (F.col("c_custkey") % 17).cast("double").alias("x"), (F.col("c_custkey") * 5 % 19).cast("double").alias("z"), F.expr(f"CAST({value} AS DOUBLE)").alias("y"))


def _split_row(spark, split: dict, names: str):
    return spark.createDataFrame([tuple(split[n] for n in names.split())], ", ".join(f"{n} double" for n in names.split()))


@query(f"""{_root(HOUR)}, b AS (SELECT DISTINCT hour + 0.5 AS e FROM t WHERE hour < 23 UNION SELECT 23.5),
c AS (SELECT lo.e AS lo, hi.e AS hi, sum(y - m) AS s, count(*) AS w FROM b lo JOIN b hi ON lo.e <> hi.e JOIN t ON CASE WHEN lo.e < hi.e THEN hour > lo.e AND hour <= hi.e ELSE hour > lo.e OR hour <= hi.e END, m GROUP BY 1, 2),
g AS (SELECT lo, hi, {GAIN.format('s', 'w')} AS gain, (hi - lo + 24) % 24 AS width FROM c, m WHERE w < n) SELECT lo, hi, {r('gain', 4)} AS gain FROM g ORDER BY round(gain, 7) DESC, width, lo LIMIT 1""")
def boost_arc_split(spark, sf_dir):
    d = _hours(spark, sf_dir, HOUR)
    split = B.fit(d, B.Spec([], "y", trees=1, depth=1, bins=24, periodic={"hour": 24.0})).trees[0]["splits"]["0"]
    return _split_row(spark, split, "lo hi gain").withColumn("gain", rounded("gain", 4))


SETS = "CASE WHEN c_custkey % 17 = 3 OR c_custkey * 5 % 19 = 3 THEN 4.0 ELSE 1.0 END + c_custkey % 3"


@query(f"""{_root(SETS)}, e AS (SELECT DISTINCT c_custkey, unnest([x, z, 100 + hour]) AS id, y FROM t), c AS (SELECT id, sum(y - m) AS s, count(*) AS w FROM e, m GROUP BY 1)
SELECT id, {r(GAIN.format('s', 'w'), 4)} AS gain FROM c, m WHERE w < n ORDER BY round({GAIN.format('s', 'w')}, 7) DESC, id LIMIT 1""")
def boost_set_split(spark, sf_dir):
    d = _hours(spark, sf_dir, SETS).withColumn("ids", F.array(*[F.col(c).cast("long") for c in ("x", "z")], (F.col("hour") + 100).cast("long")))
    split = B.fit(d, B.Spec([], "y", trees=1, depth=1, sets=["ids"])).trees[0]["splits"]["0"]
    return _split_row(spark, split | {"id": float(split["id"])}, "id gain").withColumn("gain", rounded("gain", 4))


DIAGONAL = "CASE WHEN c_custkey % 17 + c_custkey * 5 % 19 > 20 THEN 4.0 ELSE 1.0 END + c_custkey % 3 * 0.1"


def _cuts(expr: str, kind: int) -> str:
    return f"SELECT {kind} AS kind, v AS t0, (v + lead(v) OVER (ORDER BY v)) / 2 AS t, sum(g) OVER (ORDER BY v) AS s, sum(w) OVER (ORDER BY v) AS w FROM (SELECT {expr} AS v, sum(y - m) AS g, count(*) AS w FROM t, m GROUP BY 1)"


@query(f"""{_root(DIAGONAL)}, c AS ({_cuts('x', 0)} UNION ALL {_cuts('z', 1)} UNION ALL {_cuts('x + z', 2)} UNION ALL {_cuts('x - z', 3)}), g AS (SELECT kind, t, {GAIN.format('s', 'w')} AS gain FROM c, m WHERE t IS NOT NULL),
p AS (SELECT max(gain) AS plain FROM g WHERE kind < 2) SELECT CASE kind WHEN 2 THEN 1.0 ELSE -1.0 END AS sign, t, {r('gain', 4)} AS gain FROM g, p WHERE kind >= 2 AND gain > 1.1 * plain ORDER BY round(gain, 7) DESC, kind, t LIMIT 1""")
def boost_diagonal_split(spark, sf_dir):
    d = _hours(spark, sf_dir, DIAGONAL)
    split = B.fit(d, B.Spec(["x", "z"], "y", trees=1, depth=1, bins=64, spatial=[["x", "z"]])).trees[0]["splits"]["0"]
    return _split_row(spark, split | {"sign": split["n"][1]}, "sign t gain").withColumn("gain", rounded("gain", 4))


RADIAL = "CASE WHEN (c_custkey % 17 - 8) ** 2 + (c_custkey * 5 % 19 - 9) ** 2 < 20 THEN 6.0 ELSE 1.0 END"


@query(f"""{_root(RADIAL)}, box AS (SELECT sqrt((max(x) - min(x)) ** 2 + (max(z) - min(z)) ** 2) / 32 AS step FROM t),
ce AS (SELECT k, avg(x) AS cx, avg(z) AS cz FROM (SELECT 0 AS k, x, z FROM t UNION ALL SELECT CASE WHEN y >= m THEN 1 ELSE 2 END, x, z FROM t, m) GROUP BY k),
dd AS (SELECT k, cx, cz, least(greatest(ceil(sqrt((x - cx) ** 2 + (z - cz) ** 2) / step) - 1, 0), 31)::INTEGER AS b, y - m AS g FROM t, m, ce, box),
c AS (SELECT k, cx, cz, e.range AS e, sum(g) AS s, count(*) AS w FROM dd JOIN range(31) e ON b <= e.range GROUP BY ALL), g AS (SELECT *, {GAIN.format('s', 'w')} AS gain FROM c, m WHERE w < n)
SELECT {r('cx')} AS cx, {r('cz')} AS cz, {r('(e + 1) * step')} AS t, {r('gain', 4)} AS gain FROM g, box ORDER BY round(gain, 7) DESC, k, e LIMIT 1""")
def boost_radial_split(spark, sf_dir):
    d = _hours(spark, sf_dir, RADIAL.replace("** 2", "* 1").replace("(c_custkey % 17 - 8) * 1", "pow(c_custkey % 17 - 8, 2)").replace("(c_custkey * 5 % 19 - 9) * 1", "pow(c_custkey * 5 % 19 - 9, 2)"))
    split = B.fit(d, B.Spec([], "y", trees=1, depth=1, bins=32, spatial=[["x", "z"]])).trees[0]["splits"]["0"]
    split |= dict(zip(("cx", "cz"), split.get("at", (0.0, 0.0)), strict=True))
    row = _split_row(spark, split, "cx cz t gain")
    return row.select(rounded("cx").alias("cx"), rounded("cz").alias("cz"), rounded("t").alias("t"), rounded("gain", 4).alias("gain"))


STUMP = """t AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT avg(y) AS m FROM t), v AS (SELECT x, sum(y - m) AS g, count(*) AS n FROM t, m GROUP BY 1),
c AS (SELECT (x + lead(x) OVER w) / 2 AS cut, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER () AS g, sum(n) OVER () AS n FROM v WINDOW w AS (ORDER BY x)),
s AS (SELECT *, row_number() OVER (ORDER BY lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) DESC, cut) AS k FROM c WHERE cut IS NOT NULL)"""


def _stump(spark, sf_dir, **kw):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return d, B.fit(d, B.Spec(["x"], "y", trees=1, depth=1, bins=64, rate=1.0, **kw))


@query(f"WITH {STUMP} SELECT cut, {r('lg / (ln + 1)', 4)} AS below, {r('(g - lg) / (n - ln + 1)', 4)} AS above FROM s WHERE k = 1")
def boost_stump(spark, sf_dir):
    t = _stump(spark, sf_dir)[1].trees[0]
    row = (float(t["splits"]["0"]["t"]), round(t["leaves"]["1"], 4), round(t["leaves"]["2"], 4))
    return spark.createDataFrame([row], "cut double, below double, above double")


@query(f"WITH {STUMP}, b AS (SELECT cut, lg / (ln + 1) AS lo, (g - lg) / (n - ln + 1) AS hi, ln / n AS share FROM s WHERE k = 1), w AS (SELECT x, m, lo, hi, CASE WHEN abs(x - cut) >= 3 THEN 0 ELSE (1 - abs(x - cut) / 3) / 2 END AS o, x <= cut AS below FROM v, m, b) SELECT x, {r('m + CASE WHEN below THEN (1 - o) * lo + o * hi ELSE o * lo + (1 - o) * hi END', 4)} AS margin FROM w")
def boost_fuzzy(spark, sf_dir):
    d, model = _stump(spark, sf_dir)
    return d.select("x").distinct().select("x", rounded(B.fuzzy_margin(model, 3.0), 4).alias("margin"))


@query(f"WITH {STUMP}, b AS (SELECT cut, lg / (ln + 1) AS lo, (g - lg) / (n - ln + 1) AS hi, ln / n AS share FROM s WHERE k = 1) SELECT x, {r('m + share * lo + (1 - share) * hi', 4)} AS contribution_base, {r('CASE WHEN x <= cut THEN lo ELSE hi END - (share * lo + (1 - share) * hi)', 4)} AS contribution_x FROM v, m, b")
def boost_contributions(spark, sf_dir):
    d, model = _stump(spark, sf_dir)
    made = B.contributions(model, d.select("x").distinct())
    return made.select("x", rounded("contribution_base", 4).alias("contribution_base"), rounded("contribution_x", 4).alias("contribution_x"))


@query(f"""WITH {STUMP}, b AS (SELECT cut FROM s WHERE k = 1), f AS (SELECT x <= cut AS below, count(*) AS n, avg(x) AS ax, avg(y - m) AS ay, regr_sxx(y - m, x) AS sxx, regr_sxy(y - m, x) AS sxy FROM t, m, b GROUP BY 1)
SELECT below, {r('sxy / (sxx + 1)')} AS slope, {r('ay - ax * sxy / (sxx + 1)', 4)} AS bias FROM f""")
def boost_linear_leaves(spark, sf_dir):
    leaves = _stump(spark, sf_dir, linear=["x"])[1].trees[0]["leaves"]
    rows = [(n == "1", float(v["coef"]["x"]), float(v["bias"])) for n, v in leaves.items()]
    return spark.createDataFrame(rows, "below boolean, slope double, bias double").select("below", rounded("slope").alias("slope"), rounded("bias", 4).alias("bias"))


@query("""WITH n AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem)
SELECT 'l_linenumber' AS feature, e::DOUBLE AS edge FROM (VALUES (1.5), (2.5), (3.5), (4.5), (5.5), (6.5)) t(e) UNION ALL SELECT 'l_orderkey', round(lo + (range + 1) * (hi - lo) / 16.0, 6) FROM n, range(15)""")
def boost_bin_edges(spark, sf_dir):
    """Few values, and whole ones."""
    edges = B.bin_edges(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_orderkey"], 16)
    return spark.createDataFrame([(c, round(float(e), 6)) for c, es in edges.items() for e in es], "feature string, edge double")
