"""Queries that have no SQL, and recurrences, against versions of their own: dense algebra, enumeration, known values."""

import itertools
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import hashing
from loomgrid.operators import boosting as B
from loomgrid.operators import forecasting as X
from loomgrid.operators import graphs, hierarchies, joins, relations, spatial, splits
from loomgrid.operators import recurrences as R
from loomgrid.operators.panel import Panel
from loomgrid.plans import registry
from loomgrid.plans import views as V
from loomgrid.sources import scalars

FOLDER = "/root/testdata/sf0.001"
P = Panel(allow_irregular=True)


def series(spark):
    rows = V.daily(spark, FOLDER).toPandas().sort_values(["series_id", "ts"])
    return {k: g["y"].to_numpy(float) for k, g in rows.groupby("series_id")}


# Forecasts


def least_squares_arima(y, h, p, d, q):
    """ARIMA by lstsq on an explicit design, residual lags from the pass before."""
    z = np.diff(y, d) if d else y
    k = max(p, q)
    if len(z) <= k + 1:
        return np.full(h, y[-1])
    e = np.zeros(len(z))
    for _ in range(6 if q else 1):
        x = np.array([[1.0, *[z[t - i] for i in range(1, p + 1)], *[e[t - i] for i in range(1, q + 1)]] for t in range(k, len(z))])
        wide = np.vstack([x, np.sqrt(1e-8) * np.eye(x.shape[1])])  # the ridge as extra rows
        beta = np.linalg.lstsq(wide, np.concatenate([z[k:], np.zeros(x.shape[1])]), rcond=None)[0]
        e = np.concatenate([np.zeros(k), z[k:] - x @ beta])
    z, e, out = list(z), list(e), []
    for _ in range(h):
        z.append(beta[0] + sum(b * z[-1 - i] for i, b in enumerate(beta[1 : 1 + p])) + sum(b * e[-1 - i] for i, b in enumerate(beta[1 + p :])))
        e.append(0.0)
        out.append(z[-1])
    return y[-1] + np.cumsum(out) if d else np.array(out)


def test_auto_arima(spark):
    got = X.auto_arima(V.daily(spark, FOLDER), P, 7).toPandas()
    for k, y in series(spark).items():
        h = min(max(len(y) // 5, 1), 8)
        grid = [(p, d, q) for p in range(3) for d in range(2) for q in range(2) if p + q]
        loss = [np.mean((least_squares_arima(y[:-h], h, *g) - y[-h:]) ** 2) for g in grid]
        want = least_squares_arima(y, 7, *grid[int(np.argmin(np.round(loss, 6)))])
        assert got[got["series_id"] == k].sort_values("horizon")["mean"].to_numpy() == pytest.approx(want, rel=1e-5)


def test_huber_piecewise_meets_its_condition(spark):
    """At the optimum the clipped residuals balance the penalty."""
    for y in series(spark).values():
        n, t = len(y), np.arange(len(y), dtype=float)
        last = int(n * 0.8)
        cuts = np.array([float(int(k * (last - 1) / 6)) for k in range(1, 6)])
        design = lambda s: np.column_stack([np.ones(len(s)), s, *[np.maximum(0, s - c) for c in cuts], *[f(2 * np.pi * k * s / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]])
        x = design(t)
        beta, penalty = np.zeros(x.shape[1]), np.array([0.0] + [0.1] * (x.shape[1] - 1))
        for _ in range(3000):  # plain reweighting, far past the operator's stop
            w = np.minimum(1, 300 / np.maximum(np.abs(y - x @ beta), 1e-12))
            beta = np.linalg.solve((x * w[:, None]).T @ x + np.diag(penalty + 1e-10), (x * w[:, None]).T @ y)
        assert x.T @ np.clip(y - x @ beta, -300, 300) == pytest.approx(penalty * beta, abs=1e-4)
        assert R.piecewise(y, 5, huber=300.0) == pytest.approx(design(np.arange(n, n + 5, dtype=float)) @ beta, rel=2e-3, abs=1.0)


def test_auto_forecaster(spark):
    """Scores, weights and blend from the candidates' arrays."""
    d = V.daily(spark, FOLDER).drop("n")
    got = X.auto_forecast(d, P, 5, splits.rolling_origin(d, "ts", 5, 5, 15, 2)).toPandas()
    data = series(spark)
    n = len(next(iter(data.values())))
    cuts = [c for c in range(14, n - 5, 5)][-2:]
    scores = {}
    for name, kw in X.CANDIDATES:
        parts = []
        for c in cuts:
            e = np.concatenate([X.ARRAYS[name](y[: c + 1], 5, **kw) - y[c + 1 : c + 6] for y in data.values()])
            a = np.concatenate([y[c + 1 : c + 6] for y in data.values()])
            parts.append((np.sqrt(np.mean(e * e)), np.abs(e).sum() / np.abs(a).sum()))
        scores[name] = np.mean(parts, axis=0)
    best = np.min(list(scores.values()), axis=0)
    total = {k: float((v / best).sum()) for k, v in scores.items()}
    (a, sa), (b, sb) = sorted(total.items(), key=lambda kv: (kv[1], kv[0]))[:2]
    share = 1 / (1 + (sa / sb) ** 2)
    share = min(max(share, 0.15), 0.85)
    for k, y in data.items():
        want = np.maximum(share * X.ARRAYS[a](y, 5, **dict(X.CANDIDATES)[a]) + (1 - share) * X.ARRAYS[b](y, 5, **dict(X.CANDIDATES)[b]), 0)
        assert got[got["series_id"] == k].sort_values("horizon")["mean"].to_numpy() == pytest.approx(want, rel=1e-6)


def test_every_model_s_array_is_its_table(spark):
    """A model gives the same alone and among many."""
    d = V.daily(spark, FOLDER).drop("n")
    many = X.run_all(d, P, 7, [(n, dict(X.CANDIDATES).get(n, {})) for n in X.ARRAYS]).toPandas().set_index(["series_id", "horizon", "model"])["mean"]
    for name in X.ARRAYS:
        kw = dict(X.CANDIDATES).get(name, {}) or {"seasonal_naive": {"season": 7}, "window_average": {"size": 7}, "seasonal_window_average": {"season": 7, "cycles": 3}}.get(name, {})
        for r in X.MODELS[name](d, P, 7, **kw).collect():
            assert many[r.series_id, r.horizon, name] == pytest.approx(r["mean"], rel=1e-9), name


def test_rectified_and_mstl_boosted(spark):
    """On series that repeat exactly, corrections vanish and decompositions carry the season on."""
    rows = [(s, date(2026, 1, 1) + timedelta(days=k), 10.0 * (k % 2) + 1 + ord(s)) for s in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ts date, y double")
    spec = {"lags": (1, 2), "windows": (2,), "trees": 20, "depth": 2, "bins": 16, "rate": 0.5}
    made = X.rectified_lags(df, P, 4, **spec).toPandas()
    plain = X.boosted_lags(df, P, 4, **spec).toPandas()
    want = {(s, h): 10.0 * ((39 + h) % 2) + 1 + ord(s) for s in "ab" for h in range(1, 5)}
    assert {(r.series_id, r.horizon) for r in made.itertuples()} == set(want)
    off = lambda t: np.mean([abs(getattr(r, "mean") - want[r.series_id, r.horizon]) for r in t.itertuples()])  # noqa: B009, E731
    assert off(made) < 0.2 and off(made) <= off(plain) + 1e-6
    y = np.array([[0, 5, 9, 2, 7, 1, 3][k % 7] + [0, 4, 1, 3, 2][k % 5] + 50.0 for k in range(70)])
    df = spark.createDataFrame([(s, date(2026, 1, 1) + timedelta(days=k), float(y[k])) for s in "ab" for k in range(70)], "series_id string, ts date, y double")
    trend, parts, rest = R.mstl(y, [5, 7])
    for r in X.decomposed(df, P, 9, [5, 7], X.naive).collect():
        want = (trend + rest)[-1] + sum(v[70 - m + (r.horizon - 1) % m] for m, v in parts.items())
        assert r["mean"] == pytest.approx(want)
    boosted = X.decomposed(df, P, 3, [5, 7], X.boosted_lags, lags=(1, 2), windows=(3,), trees=5, depth=2, bins=16).toPandas()
    assert len(boosted) == 6 and set(boosted["model"]) == {"mstl_boosted_lag"}


# Filters and paths


def test_sequence_filters_on_a_straight_signal():
    """On a linear signal both filters are the Kalman filter; the smoother is the dense posterior of all states."""
    r = np.random.default_rng(3)
    n, noise, drift = 12, 4.0, (1e-3, 1e-4)
    y, pos = 5 + 0.5 * np.arange(n) * 3 + r.normal(0, 1, n), np.arange(n, dtype=float)
    y[4] = np.nan
    grid, signal = np.array([-1000.0, 1000.0]), np.array([-3000.0, 3000.0])
    f, q, h = np.array([[1.0, 1.0], [0, 1]]), np.diag(drift), np.array([3.0, 0.0])
    start = np.array([2.0, 0.4])
    # All states as one Gaussian: the prior by the moves, conditioned on what was seen after the first.
    mean, cov = np.zeros(2 * n), np.zeros((2 * n, 2 * n))
    step = np.eye(2)
    blocks, m = [np.eye(2)], start
    mean[:2] = start
    for k in range(1, n):
        m = f @ m
        mean[2 * k : 2 * k + 2] = m
        blocks.append(f @ blocks[-1] @ f.T + q)
    for a in range(n):
        step = np.eye(2)
        for b in range(a, n):
            cov[2 * a : 2 * a + 2, 2 * b : 2 * b + 2] = blocks[a] @ step.T
            cov[2 * b : 2 * b + 2, 2 * a : 2 * a + 2] = step @ blocks[a]
            step = f @ step

    def posterior(upto):
        seen = [k for k in range(1, upto + 1) if not np.isnan(y[k])]
        hm = np.zeros((len(seen), 2 * n))
        for i, k in enumerate(seen):
            hm[i, 2 * k : 2 * k + 2] = h
        s = hm @ cov @ hm.T + noise * np.eye(len(seen))
        return mean + cov @ hm.T @ np.linalg.solve(s, y[seen] - hm @ mean) if seen else mean

    smoothed = R.sequence_filter(pos, y, grid, signal, tuple(start), noise, drift)
    assert smoothed == pytest.approx(posterior(n - 1)[::2], rel=1e-6)
    filtered = [posterior(k)[2 * k] for k in range(n)]
    assert R.sequence_filter(pos, y, grid, signal, tuple(start), noise, drift, smooth=False) == pytest.approx(filtered, rel=1e-6)
    assert R.unscented_filter(pos, y, grid, signal, tuple(start), noise, drift) == pytest.approx(filtered, rel=1e-6)


def test_paths_by_enumeration():
    r = np.random.default_rng(4)
    signal, axis = np.array([1.0, 4.0, 6.0]), np.array([0.0, 10.0, 30.0])
    for _ in range(5):
        y = r.choice(signal, 5) + r.normal(0, 1.5, 5)
        y[2] = np.nan
        paths = list(itertools.product(range(3), repeat=5))
        cost = np.array([sum(0 if np.isnan(v) else (v - signal[s]) ** 2 / 2 / 1.5**2 for v, s in zip(y, p, strict=True)) + sum((a - b) ** 2 / 2 / 0.8**2 for a, b in itertools.pairwise(p)) for p in paths])
        assert tuple(R.viterbi(y, signal, 1.5, 0.8)) == paths[int(cost.argmin())]
        w = np.exp(cost.min() - cost)
        got_axis, got_signal = R.posterior_mean(y, axis, signal, 1.5, 0.8)
        for t in range(5):
            assert got_axis[t] == pytest.approx(sum(w[i] * axis[p[t]] for i, p in enumerate(paths)) / w.sum())
            assert got_signal[t] == pytest.approx(sum(w[i] * signal[p[t]] for i, p in enumerate(paths)) / w.sum())


# Space


def test_kriging_with_drift(spark):
    """A plane is met exactly, and weights solve the bordered system."""
    g = V.geo(spark, FOLDER).where("id <= 60")
    plane = g.withColumn("z", 3 + 2 * F.col("x") - F.col("y"))
    near = joins.nearest_any(plane, plane, "id", 8)
    for r in spatial.krige(near, "id", "z", "spherical", 40.0, 5.0, 0.1, drift=True).join(plane, "id").collect():
        assert r["mean"] == pytest.approx(r.z, abs=1e-5)
    real = joins.nearest_any(g, g, "id", 8)
    rows = real.toPandas()
    gamma = lambda h: np.where(h == 0, 0, 0.1 + 5 * np.where(h >= 40, 1, 1.5 * h / 40 - 0.5 * (h / 40) ** 3))
    for r in spatial.krige(real, "id", "z", "spherical", 40.0, 5.0, 0.1, drift=True).collect()[:10]:
        part = rows[rows["id"] == r.id]
        xy, at = part[["r_x", "r_y"]].to_numpy(float), part[["x", "y"]].iloc[0].to_numpy(float)
        f = np.column_stack([np.ones(8), xy])
        a = np.block([[gamma(np.linalg.norm(xy[:, None] - xy, axis=-1)), f], [f.T, np.zeros((3, 3))]])
        w = np.linalg.pinv(a) @ np.concatenate([gamma(np.linalg.norm(xy - at, axis=-1)), [1, *at]])
        assert r["mean"] == pytest.approx(w[:8] @ part["r_z"].to_numpy(float), rel=1e-6)


def test_spatial_likelihood(spark):
    """Each model's rho against a fine grid of the full likelihood, and effects against their definition."""
    from loomgrid.plans.space_queries import _nation_panel

    nodes, edges = _nation_panel(spark, FOLDER)
    rows = nodes.orderBy("node").toPandas()
    place = {v: k for k, v in enumerate(rows["node"])}
    w = np.zeros((len(rows), len(rows)))
    for r in edges.collect():
        w[place[r.src], place[r.dst]] = r.w
    y, one = rows["y"].to_numpy(float), np.ones(len(rows))
    x = np.column_stack([one, rows["x1"].to_numpy(float)])

    def likelihood(rho, model):
        a = np.eye(len(y)) - rho * w
        m, v = (a @ x, a @ y) if model == "error" else (np.column_stack([x, w @ x[:, 1:]]) if model == "durbin" else x, a @ y)
        e = v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
        return np.linalg.slogdet(a)[1] - len(y) / 2 * (np.log(2 * np.pi * e @ e / len(y)) + 1)

    for model in ("lag", "error", "durbin"):
        fit = spatial.spatial_ml(nodes, edges, "node", ["x1"], "y", model)
        grid = np.linspace(fit["rho"] - 0.05, fit["rho"] + 0.05, 101)
        assert abs(grid[int(np.argmax([likelihood(g, model) for g in grid]))] - fit["rho"]) <= 0.002
        assert fit["loglik"] == pytest.approx(likelihood(fit["rho"], model), abs=1e-6)
        k = 3 + (model == "durbin")
        assert fit["aic"] == pytest.approx(2 * (k + 1) - 2 * fit["loglik"])
        if model == "lag":
            s = np.linalg.inv(np.eye(len(y)) - fit["rho"] * w) * fit["beta"][1]
            assert fit["direct"][0] == pytest.approx(np.trace(s) / len(y)) and fit["total"][0] == pytest.approx(s.sum() / len(y))


def test_mint(spark):
    """Against generalised least squares with the shrunken covariance, entry by entry."""
    tree = spark.createDataFrame([("t", None), ("a", "t"), ("b", "t"), ("c", "t")], "node string, parent string")
    r = np.random.default_rng(5)
    names, e = ["a", "b", "c", "t"], {}
    for n in "abc":
        e[n] = list(r.normal(0, 1 + ord(n) % 3, 30))
    e["t"] = list(np.sum([e[n] for n in "abc"], axis=0) + r.normal(0, 0.5, 30))
    nodes, p = hierarchies.projection(joins.closure(tree, "node", "parent"), residuals=e)
    assert nodes == names
    m = np.array([e[n] for n in names])
    cov = m @ m.T / 30
    std = np.sqrt(np.diag(cov))
    top = bottom = 0.0
    for i, j in itertools.permutations(range(4), 2):
        x = m[i] / std[i] * m[j] / std[j]
        top += ((x - x.mean()) ** 2).sum() / (30 * 29)
        bottom += x.mean() ** 2
    lam = min(1.0, top / bottom)
    w = np.array([[cov[i, j] * (1 if i == j else 1 - lam) for j in range(4)] for i in range(4)])
    s = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]])
    half = np.linalg.cholesky(np.linalg.inv(w))
    want = s @ np.linalg.pinv(half.T @ s) @ half.T
    assert p == pytest.approx(want, abs=1e-8)


def test_environmental_folds_are_clusters(spark):
    g = V.geo(spark, FOLDER)
    made = splits.environmental(g, "id", ["x", "y"], 4).join(g, "id").toPandas()
    centres = made.groupby("fold")[["x", "y"]].mean().to_numpy()
    gap = np.linalg.norm(made[["x", "y"]].to_numpy()[:, None] - centres, axis=-1)
    assert len(centres) == 4 and (gap.argmin(1) == made["fold"]).mean() > 0.97


# Trees


def test_additive_values_by_enumeration(spark):
    """Shapley values from all coalitions of features, with expectations by the trees' covers."""
    r = np.random.default_rng(6)
    rows = pd.DataFrame(r.integers(0, 6, (300, 3)).astype(float), columns=["a", "b", "c"])
    rows["y"] = rows["a"] * (rows["b"] > 2) + rows["c"] ** 2 + r.normal(0, 0.1, 300)
    df = spark.createDataFrame(rows)
    model = B.fit(df, B.Spec(["a", "b", "c"], "y", trees=3, depth=3, bins=16, rate=0.5))

    def expected(tree, n, x, known):
        split = tree["splits"].get(str(n))
        if split is None:
            return tree["leaves"][str(n)]
        a, b = 2 * n + 1, 2 * n + 2
        if split["c"] in known:
            return expected(tree, a if x[split["c"]] <= split["t"] else b, x, known)
        wa, wb = tree["cover"][str(a)], tree["cover"][str(b)]
        return (wa * expected(tree, a, x, known) + wb * expected(tree, b, x, known)) / (wa + wb)

    names = ["a", "b", "c"]
    for row in B.contributions(model, df).withColumn("m", B.margin(model)).limit(12).collect():
        x = row.asDict()
        value = lambda known: model.init + sum(expected(t, 0, x, known) for t in model.trees)  # noqa: B023, E731
        for c in names:
            phi = np.mean([value(set(o[: o.index(c) + 1])) - value(set(o[: o.index(c)])) for o in itertools.permutations(names)])
            assert x[f"contribution_{c}"] == pytest.approx(phi, abs=1e-9)
        assert x["contribution_base"] + sum(x[f"contribution_{c}"] for c in names) == pytest.approx(x["m"], abs=1e-9)
        assert x["contribution_base"] == pytest.approx(value(set()))


def test_classes_and_ranks_are_learned(spark):
    df = spark.range(600).select((F.col("id") % 12).cast("double").alias("x"), (F.floor((F.col("id") % 12) / 4)).cast("int").alias("y"), (F.col("id") % 50).alias("q"), "id")
    model = B.fit_multiclass(df, B.Spec(["x"], "y", trees=8, depth=2, bins=16, rate=0.5), [0, 1, 2])
    made = B.predict_classes(model, df)
    assert made.where("predicted <> y").count() == 0
    assert made.where("abs(probability_0 + probability_1 + probability_2 - 1) > 1e-9").count() == 0
    ranker = B.fit_ranker(df, B.Spec(["x"], "y", trees=5, depth=2, bins=16, rate=0.5), "q", "id")
    best = {r.y: r.m for r in df.groupBy("y").agg(F.avg(B.margin(ranker)).alias("m")).collect()}
    assert best[0] < best[1] < best[2]


def test_families_in_deeper_trees(spark):
    """Arcs, sets and distances below the root, and scoring of one row as of a table."""
    rows = [(float(k % 24), float(k % 11), float(k * 7 % 13), [k % 5, 100 + k % 3], 3.0 * (k % 24 >= 21 or k % 24 < 3) + 2.0 * (k % 5 == 2) + 4.0 * ((k % 11 - 5) ** 2 + (k * 7 % 13 - 6) ** 2 < 9)) for k in range(1500)]
    df = spark.createDataFrame(rows, "hour double, x double, z double, ids array<long>, y double")
    model = B.fit(df, B.Spec([], "y", trees=12, depth=3, bins=24, rate=0.5, periodic={"hour": 24.0}, sets=["ids"], spatial=[["x", "z"]]))
    model = B.Model.from_json(model.to_json())
    assert model.history[-1] < 0.5 * model.history[0]
    assert {"arc", "set", "radial"} <= {s["kind"] for t in model.trees for s in t["splits"].values()}
    for r in B.predict(model, df).limit(40).collect():
        assert r.prediction == pytest.approx(model.init + sum(B.tree_score(t, r.asDict()) for t in model.trees), abs=1e-9)


def test_missing_values_go_right(spark):
    df = spark.createDataFrame([(float(k), float(k >= 5)) for k in range(10)] * 4 + [(None, 9.0)] * 8, "x double, y double")
    model = B.fit(df, B.Spec(["x"], "y", trees=1, depth=1, rate=1.0, bins=16))
    leaves = {r.x: r.m for r in df.withColumn("m", B.margin(model)).distinct().collect()}
    assert leaves[None] == leaves[9.0] != leaves[0.0]


# Graphs


def test_embeddings_explain_their_targets(spark):
    r = np.random.default_rng(7)
    means = r.normal(0, 1, 40)
    rows = [(int(k), float(means[k] + r.normal(0, 0.1))) for k in np.repeat(np.arange(40), 60)]
    made = graphs.fit_embeddings(spark.createDataFrame(rows, "k long, y double"), "k", "y", 6, strength=1.0, rounds=8)
    v = {x.key: np.array(x.v) for x in made.collect()}
    m = np.column_stack([np.array([v[k] for k in range(40)]), np.ones(40)])
    fit = m @ np.linalg.lstsq(m, means, rcond=None)[0]
    assert np.corrcoef(fit, means)[0, 1] > 0.9
    again = {x.key: x.v for x in graphs.fit_embeddings(spark.createDataFrame(rows[::-1], "k long, y double"), "k", "y", 6, strength=1.0, rounds=8).collect()}
    assert all(np.allclose(v[k], again[k]) for k in v)


def test_monotone_pairs():
    r = np.random.default_rng(8)
    for n in (1, 2, 17, 60):
        f, p, c = r.integers(0, 6, n).astype(float), r.integers(0, 9, n).astype(float), r.integers(1, 4, n).astype(float)
        want = sum(c[i] * c[j] * (p[i] - p[j]) for i in range(n) for j in range(n) if f[i] < f[j] and p[i] > p[j])
        assert relations._inversions(f, p, c) == pytest.approx(want)


# Values of public definitions


def test_hashes_and_checksums():
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C and hashing.fnv1a(b"foobar") == 0x85944171F73967E8
    assert hashing.splitmix64(0) == 0xE220A8397B1DCDAF
    assert len(hashing.stable_hex(b"x")) == 64
    draws = [hashing.normal(1, 2, k) for k in range(4000)]
    assert abs(np.mean(draws)) < 0.06 and abs(np.std(draws) - 1) < 0.06
    crc = scalars.masked_crc(b"123456789")
    assert ((crc - 0xA282EAD8) & 0xFFFFFFFF) == ((0xE3069283 >> 15 | 0xE3069283 << 17) & 0xFFFFFFFF)
    data = scalars.record(scalars.event(1.5, 300, "loss", 0.25))
    assert scalars.parse_scalars(data) == [(300, "loss", 0.25)]
    with pytest.raises(ValueError):
        scalars.parse_scalars(data[:-1] + bytes([data[-1] ^ 1]))


#: Queries without SQL, and the test that stands for it.
TESTED = {
    "forecast_auto_arima": test_auto_arima, "forecast_piecewise_huber": test_huber_piecewise_meets_its_condition, "forecast_auto_forecaster": test_auto_forecaster,
    "forecast_rectified_recursive": test_rectified_and_mstl_boosted, "forecast_mstl_boosted": test_rectified_and_mstl_boosted, "filter_sequence": test_sequence_filters_on_a_straight_signal,
    "filter_sequence_unscented": test_sequence_filters_on_a_straight_signal, "spatial_kriging_drift": test_kriging_with_drift, "spatial_lag_ml": test_spatial_likelihood,
    "hierarchy_mint": test_mint, "split_environmental": test_environmental_folds_are_clusters,
}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set(TESTED)
