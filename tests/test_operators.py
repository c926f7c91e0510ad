"""Edge cases and properties of the operators that SQL doesn't check."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid.operators import boosting as B
from loomgrid.operators import conformal, forecasting, hierarchies, joins, metrics, ordered, spatial, splits, windows
from loomgrid.operators import recurrences as R
from loomgrid.operators.panel import Panel, series_diagnostics, validate
from loomgrid.sources import files
from loomgrid.streaming import detectors


def panel(spark, series):
    rows = [(s, date(2026, 1, 1) + timedelta(days=k), float(v)) for s, ys in series.items() for k, v in enumerate(ys)]
    return spark.createDataFrame(rows, "series_id string, ts date, y double")


def test_validate(spark):
    good = panel(spark, {"a": [1, 2, 3]})
    assert validate(good, Panel()).count() == 3
    with pytest.raises(ValueError, match="duplicate"):
        validate(good.unionByName(good), Panel())
    with pytest.raises(ValueError, match="finite"):
        validate(good.withColumn("y", F.lit(float("inf"))), Panel())
    with pytest.raises(ValueError, match="irregular"):
        validate(good.where("y <> 2"), Panel())
    with pytest.raises(ValueError, match="role"):
        Panel(static=("x",), historical=("x",))


def test_short_history_is_dropped(spark):
    df = panel(spark, {"a": [1, 2, 3], "b": [5]})
    assert windows.lag_features(df, Panel(), lags=(2,)).select("series_id", "target_lag_2").collect() == [("a", 1.0)]


def test_all_zero_series(spark):
    row = series_diagnostics(panel(spark, {"a": [0, 0, 0]}), Panel()).first()
    assert (row.zero_ratio, row.mean_nonzero_gap, row.longest_zero_run) == (None, None, 3)


def test_zero_denominators(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0)], "g string, mean double, y double")
    row = metrics.forecast_metrics(df, ["g"]).first()
    assert (row.wape, row.smape, row.nrmse) == (0.0, 0.0, 0.0)


def test_one_class_and_ties(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.roc_auc(one, "y", "p").first().auc is None
    two = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.roc_auc(two, "y", "p").first().auc == 0.5


def test_aligned_keys_must_match(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, mean double")
    b = spark.createDataFrame([(2, 1.0)], "k int, y double")
    with pytest.raises(ValueError, match="differ"):
        metrics.aligned(a, b, ["k"])


def test_too_few_calibration_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "r double")
    assert conformal.split_radius(df, [], F.col("r"), 0.1).first().radius is None
    assert conformal.split_radius(df, [], F.col("r"), 0.1, clamp=True).first().radius == 2.0
    with pytest.raises(ValueError):
        conformal.rank_needed(2, 0.1)
    with pytest.raises(ValueError):
        conformal.check_split_order(5, 4, 6, 7)


def test_running_sums_over_many_ties(spark):
    df = spark.range(1000).select((F.col("id") % 5).cast("double").alias("v"), "id")
    got = [r.i for r in ordered.numbered(df, "v", ("id",)).orderBy("v", "id").collect()]
    assert got == list(range(1000))


def test_closure_finds_cycles(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, parent string")
    with pytest.raises(ValueError):
        joins.closure(tree, "node", "parent", rounds=8)


def test_cutoffs():
    assert splits.cutoffs(20, 5, 5, 10) == [9, 14]
    assert splits.cutoffs(20, 5, 1, 10, 2) == [13, 14]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=3, max_size=30))
def test_recurrences_are_finite(ys):
    y = np.array(ys)
    for f in (R.croston, R.tsb, R.sba, R.adida):
        assert np.isfinite(f(y))
    for f in (R.theta, R.ets, R.piecewise):
        assert np.isfinite(f(y, 4)).all()
    assert len(R.cusum(y, 50, 1, 10)) == len(y)


def test_constant_series_stay_constant():
    y = np.full(28, 5.0)
    for f in (R.theta, R.ets, lambda a, h: R.arima(a, h, 1, 0, 1)):
        assert np.allclose(f(y, 3), 5.0, atol=1e-3)
    trend, seasonal, rest = R.stl(y, 7)
    assert np.allclose(trend, 5.0) and np.allclose(seasonal, 0) and np.allclose(rest, 0)


def test_registry_and_specs(spark):
    df = panel(spark, {"a": [1, 2, 3, 4, 5, 6, 7, 8]})
    specs = files.model_specs('[[models]]\nname = "naive"\n[[models]]\nname = "window_average"\nsize = 2\n')
    got = {(r.model, r["mean"]) for r in files.run_specs(df, Panel(), 1, specs).collect()}
    assert got == {("naive", 8.0), ("window_average", 7.5)}
    with pytest.raises(ValueError):
        files.model_specs(json.dumps({"models": [{"name": "none"}]}))
    with pytest.raises(ValueError):
        forecasting.register("naive", forecasting.naive)


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ts,y\n2026-01-01,1\n2026-01-02T00:00:00,2\n")
    assert [r.series_id for r in files.read_panel_csv(spark, str(tmp_path / "p.csv"), Panel()).collect()] == ["__single__"] * 2
    shapes = {"features": [{"cartometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"id": "a"}}, {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}, "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(shapes))
    a, b = files.read_geojson(spark, str(tmp_path / "g.json")).collect()
    assert (a.x, a.y, len(b.ring)) == (1.0, 2.0, 4)
    df = forecasting.naive(panel(spark, {"a": [1, 2]}), Panel(), 2)
    files.write_forecast(df, f"file://{tmp_path}/f", "naive", 2)
    manifest, back = files.read_forecast(spark, f"file://{tmp_path}/f")
    assert manifest["horizon"] == 2 and back.count() == 2


def test_boosting_learns_a_step_and_keeps_monotone(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 20 >= 10, 5.0).otherwise(1.0).alias("y"))
    model = B.fit(df, B.Spec(["x"], "y", trees=20, depth=1, rate=0.5))
    got = {r.x: r.prediction for r in B.predict(model, df).collect()}
    assert abs(got[0.0] - 1) < 0.1 and abs(got[19.0] - 5) < 0.1
    assert model.history == sorted(model.history, reverse=True)
    falling = B.fit(df, B.Spec(["x"], "y", trees=3, depth=2, monotone={"x": -1}))
    assert all(not t["splits"] for t in falling.trees)
    parts = B.contributions(model, df).withColumn("m", B.margin(model)).first()
    assert abs(parts.contribution_base + parts.contribution_x - parts.m) < 1e-9


def test_reconciled_values_are_coherent(spark):
    tree = spark.createDataFrame([("t", None), ("a", "t"), ("b", "t")], "node string, parent string")
    cl = joins.closure(tree, "node", "parent")
    f = spark.createDataFrame([("t", 1, 10.0), ("a", 1, 3.0), ("b", 1, 4.0)], "node string, k int, mean double")
    out = hierarchies.reconcile(cl, f, ["k"])
    assert hierarchies.incoherent(cl, out, ["k"]).count() == 0
    assert {r.node: round(r["mean"], 6) for r in out.collect()} == {"a": 4.0, "b": 5.0, "t": 9.0}


def test_streaming_cusum_keeps_state_between_batches(spark, tmp_path):
    schema = "key string, ts timestamp, x double"
    y = [1.0, 4.0, 5.0, 0.0, 6.0, 7.0]
    for part in (0, 1):
        rows = [("a", k, y[k]) for k in range(3 * part, 3 * part + 3)]
        spark.createDataFrame(rows, "key string, s long, x double").select("key", F.timestamp_seconds("s").alias("ts"), "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detectors.cusum(stream, 2.0, 0.5, 4.0).writeStream.format("memory").queryName("cusum_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.score, r.triggered) for r in spark.table("cusum_out").orderBy("ts").collect()]
    assert got == R.cusum(np.array(y), 2.0, 0.5, 4.0)


def _crowd(spark, places: int, copies: int):
    """(id, x, y, z): copies of few places."""
    n = places * copies
    return spark.range(n).select("id", (F.col("id") % places % 5).cast("double").alias("x"), F.floor(F.col("id") % places / 5).cast("double").alias("y"), (F.col("id") * 37 % 101).cast("double").alias("z"))


def _counted(monkeypatch, module):
    """Pairs that ``within`` makes from here on."""
    made, within = [], module.within
    monkeypatch.setattr(module, "within", lambda *a, **k: made.append(within(*a, **k)) or made[-1])
    return lambda: sum(p.count() for p in made)


@pytest.mark.parametrize("radius", [1.0, None])
def test_nearest_of_copies_makes_few_pairs(spark, monkeypatch, radius):
    g = _crowd(spark, 20, 50)
    pairs = _counted(monkeypatch, joins)
    left, right = g.where("id % 3 > 0"), g.where("id % 2 = 0")
    near = joins.nearest_any(left, right, "id", 30) if radius is None else joins.nearest(left, right, "id", 30, radius, least=3)
    got = {(r.id, r.r_id, r["rank"]) for r in near.collect()}
    rows = [tuple(r) for r in g.collect()]
    want = set()
    for i, x, y, _ in rows:
        if i % 3:
            others = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v, _ in rows if j % 2 == 0 and j != i)
            want |= {(i, j, k + 1) for k, (d, j) in enumerate(others[:30]) if radius is None or d <= 1.0}
    assert got == want
    assert pairs() < 20 * 20 * 31 * 3


@pytest.mark.parametrize("drift", [False, True])
def test_kriging_over_copies_of_places(spark, drift):
    """Copies of a place share its weight, as the system of distinct places has it."""
    g = _crowd(spark, 25, 2).select("id", ((F.col("x") * 13 + F.col("y") * 5) % 23 + 60).alias("x"), ((F.col("x") * 7 + F.col("y") * 11) % 19 + 50).alias("y"), F.col("z") * 100)
    g = g.toDF("id", "x", "y", "z")
    rows = {r.id: (r.x, r.y) for r in g.collect()}
    near = joins.nearest(g, g, "id", 8, 40.0)
    by: dict = {}
    for r in near.collect():
        by.setdefault(r.id, []).append((r.r_x, r.r_y, r.r_z))
    shape = (lambda h: np.where(h >= 9, 1.0, h / 6 - (h / 9) ** 3 / 2)) if drift else (lambda h: 1 - np.exp(-h / 5))
    gamma = lambda h: np.where(h == 0, 0.0, 1e5 + 8e6 * shape(h)) / 8.1e6
    solved = spatial.krige(near, "id", "z", "spherical" if drift else "exponential", 9.0 if drift else 5.0, 8e6, 1e5, drift)
    assert "GroupsInPandas" not in solved._jdf.queryExecution().optimizedPlan().toString()  # no call a target
    made = {r.id: r for r in solved.collect()}
    assert set(made) == set(rows)
    for i, found in by.items():
        at = np.array(rows[i])
        xy = np.array(sorted({f[:2] for f in found}))
        z = np.array([np.mean([f[2] for f in found if f[:2] == tuple(p)]) for p in xy])
        n, f = len(xy), np.column_stack([np.ones(len(xy)), *((xy - at).T if drift else [])])
        a = np.zeros((n + f.shape[1],) * 2)
        a[:n, :n], a[:n, n:], a[n:, :n] = gamma(np.sqrt(((xy[:, None] - xy) ** 2).sum(-1))), f, f.T
        b = np.concatenate([gamma(np.sqrt(((xy - at) ** 2).sum(-1))), [1.0, 0.0, 0.0][: f.shape[1]]])
        w = np.linalg.solve(a, b)
        assert made[i].mean == pytest.approx(w[:n] @ z, abs=1e-6)
        assert made[i].variance == pytest.approx(max(0.0, w @ b * 8.1e6), abs=1e-2)


def test_statistics_of_copies_make_few_pairs(spark, monkeypatch):
    g = _crowd(spark, 20, 50)
    pairs = _counted(monkeypatch, spatial)
    v = {r.bin: r for r in spatial.variogram(g, "id", "z", 3, 3.0).collect()}
    moran = spatial.morans_i_within(g, "z", 1.5).first()[0]
    assert pairs() <= 2 * 20 * 20
    inverse = spatial.morans_i_inverse(g, "id", "z", epsilon=1e-3, block=7).first()[0]
    x, y, z = (np.array(c) for c in zip(*[(r.x, r.y, r.z) for r in g.orderBy("id").collect()], strict=True))
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    i, j = np.triu_indices(len(x), 1)
    near, half = d[i, j] <= 3.0, (z[i] - z[j]) ** 2 / 2
    at = np.minimum(np.floor(d[i, j]), 2)
    for b in range(3):
        some = near & (at == b)
        assert v[b].n == some.sum() and v[b].gamma == pytest.approx(half[some].mean()) and v[b].mean_distance == pytest.approx(d[i, j][some].mean())
    c = z - z.mean()
    index = lambda w: len(z) / w.sum() * (c @ w @ c) / (c @ c)
    assert moran == pytest.approx(index(((d > 0) & (d <= 1.5)).astype(float)))
    w = 1 / np.maximum(d, 1e-3)
    np.fill_diagonal(w, 0.0)
    assert inverse == pytest.approx(index(w))


def test_inverse_moran_counts_copies_before_they_meet(spark):
    """A block holds places: 60,000 rows of 20 places are one block, where a block of rows would hold their square."""
    g = _crowd(spark, 20, 3000)
    assert spatial.morans_i_inverse(g, "id", "z", epsilon=1e-3, block=100_000).first()[0] is not None


def test_distance_joins_of_copies_make_few_pairs(spark, monkeypatch):
    g = _crowd(spark, 20, 50)
    pairs = _counted(monkeypatch, joins)
    far = {r.id for r in joins.beyond(g, g.where("x = 0"), 2.0, "id").collect()}
    assert far == {r.id for r in g.where("x > 2").collect()}
    got = joins.self_pairs(g, "id", 1.0).agg(F.count(F.lit(1)), F.countDistinct("id", "r_id"), F.max(F.abs(F.col("x") - F.col("r_x")) + F.abs(F.col("y") - F.col("r_y"))), F.max(F.col("id") - F.col("r_id"))).first()
    # 31 neighbouring pairs of places in a lattice of 5 by 4, and each place with itself.
    assert tuple(got)[:3] == (31 * 50 * 50 + 20 * 50 * 49 // 2,) * 2 + (1.0,) and got[3] < 0
    assert pairs() <= 2 * 20 * 20


def test_buffered_folds_of_copies_make_few_pairs(spark, monkeypatch):
    g = _crowd(spark, 20, 50)
    assigned = g.select("id", (F.col("x") % 2).cast("int").alias("fold"))
    pairs = _counted(monkeypatch, splits)
    made = splits.buffered(g, assigned, "id", 2, 1.0)
    assert made.where("role = 'train'").count() == 0 and made.where("role = 'test'").count() == 1000
    assert pairs() <= 20 * 20


def test_distance_report_of_many_treated_units(spark):
    from loomgrid.operators import causal

    u = spark.range(12_300).select("id", (F.col("id") % 40).cast("double").alias("lat"), (F.col("id") % 3).cast("double").alias("lng"), (F.col("id") % 41 > 0).alias("treated"))
    by_copies = causal.treated_control_distance(u, "id").first()
    parted = causal.treated_control_distance(u, "id", most=5).first()
    rows = [tuple(r) for r in u.groupBy("lat", "lng", "treated").count().collect()]
    t, c = ([r for r in rows if r[2] == k] for k in (True, False))
    a, b = (np.radians(np.array([r[:2] for r in k])) for k in (t, c))
    h = np.sin((a[:, None, 0] - b[:, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[:, 0]) * np.sin((a[:, None, 1] - b[:, 1]) / 2) ** 2
    d = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    w = np.outer([r[3] for r in t], [r[3] for r in c])
    for made in (by_copies, parted):
        assert made.min_km == pytest.approx(d.min(), abs=1e-6) and made.mean_km == pytest.approx((d * w).sum() / w.sum())


def test_intermittent_takes_the_first_of_losses_that_differ_by_rounding(monkeypatch):
    """Three holdout values above the levels and three below: every level between them loses the same, but for rounding."""
    y = np.array([1.0] * 24 + [0.1, 0.7, 0.3, 2.1, 2.2, 2.3])
    levels = {"tsb": 1.1, "sba": 1.3, "croston": 1.7, "adida": 1.9}
    losses = {n: np.abs(v - y[24:]).sum() / y[24:].sum() for n, v in levels.items()}
    assert len(set(losses.values())) > 1 and min(losses, key=losses.get) != "tsb"
    for n, v in levels.items():
        monkeypatch.setattr(R, n, lambda y, v=v: v)
    assert R.intermittent(y) == 1.1


@pytest.mark.parametrize("buckets", [8, 700])
def test_bucket_of_works_a_value_out_once(spark, buckets):
    df = spark.range(5000).select("id", F.when(F.col("id") != 7, F.exp(F.col("id") * 37 % 1009 / 100)).alias("v"))
    out = df.select("id", "v", ordered.bucket_of(df, "v", buckets).alias("b"))
    assert "< CASE" not in out.select("b")._jdf.queryExecution().optimizedPlan().toString()
    edges = sorted(set(df.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.005)))
    assert (len(edges) > 64) == (buckets > 64)
    for r in out.collect():
        assert r.b == (0 if r.v is None else np.searchsorted(edges, r.v, "left"))


@pytest.mark.parametrize("sign", [1, -1])
def test_monotone_penalty_of_many_ranges_and_missing_values(spark, sign):
    from loomgrid.operators import relations

    df = spark.range(900).select("id", F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 211).cast("double").alias("x"), F.when(F.col("id") % 13 > 0, F.col("id") * 53 % 307).cast("double").alias("z"))
    rows = [(r.x, r.z) for r in df.collect() if r.x is not None and r.z is not None]
    x, z = np.array(rows).T
    pairs = (sign * x[:, None] < sign * x) * np.maximum(0.0, z[:, None] - z)
    assert relations.monotone_penalty(df, "x", "z", sign, rows_a_bucket=5).first().penalty == pytest.approx(pairs.sum())


def test_ranking_groups_are_dealt_to_tasks_by_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_TASK", 50)
    df = spark.range(1000).select((F.col("id") % 300).alias("grp"), "id", (F.col("id") % 4).cast("int").alias("rel"), (F.col("id") * 37 % 101).cast("double").alias("score"))
    assert metrics._ranked(df, "grp", "rel", "score", "id").rdd.getNumPartitions() == 20
    made = B.pair_gradients(df, "grp", "id", "rel", "score")
    assert made.rdd.getNumPartitions() == 20 and made.count() == 1000


def test_pair_gradients_keep_rows_without_a_pair(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.5), (1, 2, 0.0, 0.1), (2, 1, 1.0, 0.0), (2, 2, 0.0, 0.0)], "grp long, id long, rel double, f double")
    got = {(r.grp, r.id): (r.g, r.h) for r in B.pair_gradients(df, "grp", "id", "rel", "f").collect()}
    assert got == {(1, 1): (0.0, 1e-12), (1, 2): (0.0, 1e-12), (2, 1): (-0.5, 0.25), (2, 2): (0.5, 0.25)}
