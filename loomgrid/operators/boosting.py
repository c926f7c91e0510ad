"""Gradient-boosted trees by distributed histograms.

Features are cut at edges found once.  A level of a tree is one aggregation: every row adds its weight, gradient and
hessian to (node, family, bin) cells, combined before the shuffle, so what reaches the driver is nodes x families x
bins sums, whatever the number of rows.  The driver picks the splits; rows move to children by a column expression.
Leaves are made from the sums of their split, so a tree is as many passes as it is deep.  Margins of finished trees are
kept in a written table every few trees, so lineage stays short and lost executors only cost a reread.

Families of splits: thresholds on a column; arcs of a periodic column, from every ordered pair of its bins' edges;
membership of an id in a column of sets; for a pair of coordinates, thresholds on x + y and x - y and on the distance to
the weighted centroids of a node's rows, of those at or above its mean target, and of those below.  A spatial split needs
a tenth more gain than the best other one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from math import log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.columns import total
from loomgrid.operators.ordered import dealt, exact_quantile, tasks_of
from loomgrid.sources.shared import Tables

LOSSES = ("l2", "l1", "huber", "quantile", "log_l2", "logistic", "poisson", "negative_binomial", "tweedie")
SPATIAL_EDGE = 1.1


@dataclass
class Spec:
    """What to fit."""

    features: list[str]
    y: str
    weight: str | None = None
    loss: str = "l2"
    trees: int = 10
    depth: int = 3
    bins: int = 32
    rate: float = 0.1
    ridge: float = 1.0
    least: float = 1.0  # weight of a leaf
    gain: float = 1e-9
    alpha: float = 0.5  # quantile level, Huber width, dispersion or offset of the logarithm, by loss
    power: float = 1.5  # Tweedie
    monotone: dict[str, int] = field(default_factory=dict)  # 1 rising, -1 falling
    groups: list[list[str]] | None = None  # features that may share a branch
    periodic: dict[str, float] = field(default_factory=dict)  # columns with arcs, and their periods
    sets: list[str] = field(default_factory=list)  # columns of arrays of ids
    spatial: list[list[str]] = field(default_factory=list)  # pairs of coordinates
    linear: list[str] = field(default_factory=list)  # columns of linear ridge leaves


@dataclass
class Model:
    spec: Spec
    init: float
    trees: list[dict]
    history: list[float] = field(default_factory=list)  # training root mean square error after each tree, where it has a meaning

    def to_json(self) -> str:
        return json.dumps({"version": 2, "spec": self.spec.__dict__, "init": self.init, "trees": self.trees, "history": self.history})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        if d.get("version") not in (1, 2):
            raise ValueError("an unknown model version")
        if d["version"] == 1:  # splits were lists of column, threshold and gain
            for t in d["trees"]:
                t["splits"] = {n: {"kind": "axis", "c": c, "t": cut, "gain": g} for n, (c, cut, g) in t["splits"].items()}
        return Model(Spec(**d["spec"]), d["init"], d["trees"], d["history"])


def gradients(s: Spec, f: Column, y: Column) -> tuple[Column, Column]:
    """First and second derivative of the loss by the margin."""
    one = F.lit(1.0)
    if s.loss == "l2":
        return f - y, one
    if s.loss == "log_l2":
        return f - F.log(y + s.alpha), one
    if s.loss == "l1":
        return F.signum(f - y), one
    if s.loss == "huber":
        return F.least(F.greatest(f - y, F.lit(-s.alpha)), F.lit(s.alpha)), one
    if s.loss == "quantile":
        return F.when(y > f, -s.alpha).otherwise(1 - s.alpha), one
    if s.loss == "logistic":
        p = 1 / (1 + F.exp(-f))
        return p - y, F.greatest(p * (1 - p), F.lit(1e-12))
    mu = F.exp(f)
    if s.loss == "poisson":
        return mu - y, F.greatest(mu, F.lit(1e-12))
    if s.loss == "negative_binomial":
        return (mu - y) / (1 + mu * s.alpha), F.greatest(mu * (1 + y * s.alpha) / F.pow(1 + mu * s.alpha, F.lit(2.0)), F.lit(1e-12))
    if s.loss == "tweedie":
        a, b = F.exp(f * (2 - s.power)), F.exp(f * (1 - s.power))
        return a - y * b, F.greatest(a * (2 - s.power) + y * b * (s.power - 1), F.lit(1e-12))
    raise ValueError(f"loss {s.loss}")


def transform(s: Spec, f: Column) -> Column:
    """A margin as a prediction."""
    if s.loss == "logistic":
        return 1 / (1 + F.exp(-f))
    if s.loss == "log_l2":
        return F.exp(f) - s.alpha
    return F.exp(f) if s.loss in ("poisson", "negative_binomial", "tweedie") else f


def _initial(df: DataFrame, s: Spec, w: Column) -> float:
    if s.loss in ("l1", "quantile", "huber"):
        return float(exact_quantile(df, s.y, w, s.alpha if s.loss == "quantile" else 0.5))
    y = F.log(F.col(s.y) + s.alpha) if s.loss == "log_l2" else F.col(s.y)
    mean = float(df.agg(F.sum(w * y) / F.sum(w)).first()[0])
    if s.loss == "logistic":
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return log(p / (1 - p))
    return log(max(mean, 1e-9)) if s.loss in ("poisson", "negative_binomial", "tweedie") else mean


def bin_edges(df: DataFrame, features: list[str], bins: int, error: float = 0.001) -> dict[str, list[float]]:
    """Rising cut points of each feature: midpoints between distinct values where these are at most ``bins``; even widths
    where values are whole, or repeat ten times in the mean; else quantiles."""
    out = {}
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[x for k, c in enumerate(features) for x in (F.approx_count_distinct(c).alias(f"d{k}"), F.min(F.col(c).cast("double")).alias(f"a{k}"), F.max(F.col(c).cast("double")).alias(f"b{k}"), F.min((F.abs(F.col(c) - F.round(F.col(c).cast("double"))) < 1e-12).cast("int")).alias(f"i{k}"))]).first()
    need = []
    for k, c in enumerate(features):
        if stats[f"d{k}"] <= 2 * bins:
            values = sorted(r[0] for r in df.select(F.col(c).cast("double")).distinct().limit(4 * bins + 1).collect() if r[0] is not None)
            if len(values) <= bins:
                out[c] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
                continue
        if stats[f"d{k}"] * 10 <= stats["n"] or stats[f"i{k}"]:
            lo, hi = stats[f"a{k}"], stats[f"b{k}"]
            out[c] = [x for x in (lo + (i + 1) * (hi - lo) / bins for i in range(bins - 1)) if x < hi]
            continue
        need.append(c)
    if need:
        for c, q in zip(need, df.approxQuantile(need, [i / bins for i in range(1, bins)], error), strict=True):
            out[c] = sorted(set(q))
    return out


def _bin(c: str | Column, edges: list[float]) -> Column:
    """The number of edges below the value; a missing value is above all of them, as a split sends it right."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull(), len(edges)).otherwise(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))) if edges else F.lit(0)


def _families(df: DataFrame, s: Spec) -> list[dict]:
    """The families of splits with their edges; radial ones have edges of even width over the coordinates' box."""
    edges = bin_edges(df, s.features, s.bins) if s.features else {}
    out = [{"kind": "axis", "c": c, "edges": edges[c]} for c in s.features]
    for c, period in s.periodic.items():
        phases = df.select(F.pmod(F.col(c).cast("double"), F.lit(float(period))).alias("p"))
        found = bin_edges(phases, ["p"], s.bins)["p"]
        ends = phases.agg(F.min("p"), F.max("p")).first()
        # The cut across the end of the period, between the last and the first phase.
        across = ((ends[0] + period + ends[1]) / 2) % period if ends[0] is not None else 0.0
        out.append({"kind": "arc", "c": c, "period": float(period), "edges": sorted({*found, across})})
    out += [{"kind": "set", "c": c} for c in s.sets]
    for x, y in s.spatial:
        sums = df.select((F.col(x) + F.col(y)).alias("p"), (F.col(x) - F.col(y)).alias("m"))
        cuts = bin_edges(sums, ["p", "m"], s.bins)
        out += [{"kind": "diagonal", "c": [x, y], "n": n, "edges": cuts[k]} for n, k in (([1.0, 1.0], "p"), ([1.0, -1.0], "m"))]
        a, b, c, d = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        width = sqrt((b - a) ** 2 + (d - c) ** 2) / s.bins
        out += [{"kind": "radial", "c": [x, y], "which": k, "edges": [width * (i + 1) for i in range(s.bins - 1)] if width else []} for k in range(3)]
    return out


def _distance(c: list[str], at: list[float]) -> Column:
    dx, dy = F.col(c[0]) - float(at[0]), F.col(c[1]) - float(at[1])
    return F.sqrt(dx * dx + dy * dy)


def goes_left(split: dict) -> Column:
    """Whether a row goes to the left child: at or below a threshold, on an arc, or in a set."""
    kind, c = split["kind"], split["c"]
    if kind == "axis":
        return F.col(c) <= split["t"]
    if kind == "arc":
        phase = F.pmod(F.col(c).cast("double"), F.lit(split["period"]))
        above, below = phase > split["lo"], phase <= split["hi"]
        return above & below if split["lo"] < split["hi"] else above | below
    if kind == "set":
        return F.array_contains(c, split["id"])
    if kind == "diagonal":
        return F.col(c[0]) * split["n"][0] + F.col(c[1]) * split["n"][1] <= split["t"]
    return _distance(c, split["at"]) <= split["t"]


def _value_goes_left(split: dict, x: dict) -> bool:
    kind, c = split["kind"], split["c"]
    if kind == "axis":
        return x[c] <= split["t"]
    if kind == "arc":
        p = x[c] % split["period"]
        return split["lo"] < p <= split["hi"] if split["lo"] < split["hi"] else p > split["lo"] or p <= split["hi"]
    if kind == "set":
        return split["id"] in x[c]
    if kind == "diagonal":
        return x[c[0]] * split["n"][0] + x[c[1]] * split["n"][1] <= split["t"]
    return sqrt((x[c[0]] - split["at"][0]) ** 2 + (x[c[1]] - split["at"][1]) ** 2) <= split["t"]


def tree_score(tree: dict, x: dict) -> float:
    """A tree's value of one row given as a mapping."""
    n = 0
    while str(n) in tree["splits"]:
        n = 2 * n + 1 if _value_goes_left(tree["splits"][str(n)], x) else 2 * n + 2
    leaf = tree["leaves"][str(n)]
    return leaf["bias"] + sum(b * x[c] for c, b in leaf["coef"].items()) if isinstance(leaf, dict) else leaf


def _children(node: Column, splits: dict[int, dict]) -> Column:
    """Rows' nodes after the splits: 2n + 1 left, 2n + 2 right; unsplit nodes stay."""
    out = node
    for n, split in splits.items():
        out = F.when(node == n, F.when(goes_left(split), 2 * n + 1).otherwise(2 * n + 2)).otherwise(out)
    return out


def _score(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _binned(df: DataFrame, s: Spec, families: list[dict], *more: Column) -> DataFrame:
    """The columns that splits and leaves read, with the bins of what doesn't depend on a node."""
    used = dict.fromkeys([*s.features, *s.periodic, *s.sets, *(c for p in s.spatial for c in p), *s.linear])
    cols = []
    for k, f in enumerate(families):
        x = {"axis": lambda f=f: f["c"], "arc": lambda f=f: F.pmod(F.col(f["c"]).cast("double"), F.lit(f["period"])), "diagonal": lambda f=f: F.col(f["c"][0]) * f["n"][0] + F.col(f["c"][1]) * f["n"][1]}.get(f["kind"])
        if x:
            cols.append(_bin(x(), f["edges"]).cast("int").alias(f"__b{k}"))
    return df.select(*used, *more, *cols)


def _centres(live: DataFrame, s: Spec, means: dict[int, float]) -> dict[tuple[int, str], list[list[float] | None]]:
    """(node, x column) -> weighted centroids of a node's rows, of those at or above its mean target, and of those below."""
    target = -F.col("__g") / F.col("__h")
    mean = reduce(lambda a, kv: F.when(F.col("__n") == kv[0], F.lit(float(kv[1]))).otherwise(a), means.items(), F.lit(0.0))
    sides = (F.lit(True), target >= mean, target < mean)
    sums = [F.sum(F.when(c, F.col("__w") * v)) for c in sides for p in s.spatial for v in (F.lit(1.0), F.col(p[0]), F.col(p[1]))]
    found = live.groupBy("__n").agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).collect()
    out = {}
    for r in found:
        v = list(r)[1:]
        for k, p in enumerate(s.spatial):
            parts = [v[(side * len(s.spatial) + k) * 3 :][:3] for side in range(3)]
            out[r[0], p[0]] = [[x / w, y / w] if w is not None and w >= (s.least if side else 0) and w > 0 else None for side, (w, x, y) in enumerate(parts)]
    return out


def _grow(rows: DataFrame, s: Spec, families: list[dict], g: Column, h: Column, history: list | None = None, error: Column | None = None) -> dict:
    """One tree on rows with ``__w`` and the bins: splits, leaves (times the rate) and covers, by node."""
    state = rows.withColumns({"__g": F.col("__w") * g, "__h": F.col("__w") * h, "__n": F.lit(0)})
    tree: dict = {"splits": {}, "leaves": {}, "cover": {}}
    bounds: dict[int, tuple[float, float]] = {0: (-np.inf, np.inf)}
    allowed: dict[int, set | None] = {0: None}
    sums_of: dict[int, tuple[float, float, float]] = {}
    last: dict[int, tuple[float, float]] = {}
    for level in range(max(1, s.depth)):
        live = state.where(F.col("__n").isin(list(bounds))) if level else state
        if level == 0 and s.spatial:
            w, a, b = live.agg(F.sum("__w"), F.sum("__g"), F.sum("__h")).first()
            sums_of[0] = (w, a, b)
        centres = _centres(live, s, {n: -sums_of[n][1] / (sums_of[n][2] or 1.0) for n in bounds}) if s.spatial else {}
        cells = [F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("b"))]
        for j, f in enumerate(families):
            if f["kind"] == "radial":
                at = {n: c[f["which"]] for (n, x), c in centres.items() if x == f["c"][0] and c[f["which"]]}
                if at and f["edges"]:
                    gap = reduce(lambda a, kv, f=f: F.when(F.col("__n") == kv[0], _distance(f["c"], kv[1])).otherwise(a), at.items(), F.lit(None).cast("double"))
                    step = f["edges"][0]
                    b = F.coalesce(F.least(F.greatest(F.ceil(gap / step) - 1, F.lit(0)), F.lit(len(f["edges"]))), F.lit(len(f["edges"])))
                    cells.append(F.struct(F.lit(j).alias("j"), b.cast("long").alias("b")))
            elif f["kind"] != "set":
                cells.append(F.struct(F.lit(j).alias("j"), F.col(f"__b{j}").cast("long").alias("b")))
        cells = F.array(*cells)
        for j, f in enumerate(families):
            if f["kind"] == "set":
                cells = F.concat(cells, _id_cells(f["c"], j))
        more = [F.sum(F.when(F.col("__cell.j") == -1, error)).alias("e")] if history is not None and level == 0 else []
        got = live.select("*", F.explode(cells).alias("__cell")).groupBy("__n", F.col("__cell.j").alias("j"), F.col("__cell.b").alias("b"))
        sums = got.agg(F.sum("__w").alias("w"), F.sum("__g").alias("g"), F.sum("__h").alias("h"), *more).toPandas()
        if more:
            own = sums[sums["j"] == -1]
            history.append(float(np.sqrt(own["e"].sum() / own["w"].sum())))
        splits: dict[int, dict] = {}
        fresh: dict[int, tuple[float, float]] = {}
        for n in sorted(bounds):
            part = sums[sums["__n"] == n]
            own = part[part["j"] == -1][["w", "g", "h"]].sum()
            sums_of[n] = (own["w"], own["g"], own["h"])
            tree["cover"][n] = float(own["w"])
            pick = None if s.depth < 1 else _best(part, sums_of[n], families, s, bounds[n], allowed[n], {x: c for (m, x), c in centres.items() if m == n})
            if pick is None:
                last[n] = bounds[n]
                continue
            split, (lw, lg, lh), left, right = pick
            splits[n] = tree["splits"][n] = split
            sums_of[2 * n + 1], sums_of[2 * n + 2] = (lw, lg, lh), tuple(a - b for a, b in zip(sums_of[n], (lw, lg, lh), strict=True))
            lo, hi = bounds[n]
            mid, sign = (left + right) / 2, s.monotone.get(split["c"], 0) if split["kind"] == "axis" else 0
            fresh[2 * n + 1] = (lo, min(hi, mid)) if sign > 0 else (max(lo, mid), hi) if sign < 0 else (lo, hi)
            fresh[2 * n + 2] = (max(lo, mid), hi) if sign > 0 else (lo, min(hi, mid)) if sign < 0 else (lo, hi)
            names = _names(split)
            inside = None if s.groups is None else set.union(names, *(set(x) for x in s.groups if names <= set(x)))
            for child in (2 * n + 1, 2 * n + 2):
                allowed[child] = inside if allowed[n] is None else (inside & allowed[n] if inside else allowed[n])
        if splits:
            state = state.withColumn("__n", _children(F.col("__n"), splits))
        bounds = fresh
        if not splits:
            break
    last |= bounds
    for n in last:
        tree["cover"][n] = float(sums_of[n][0])
    tree["leaves"] = _leaves(state, s, {n: sums_of[n] for n in last}, last)
    return {k: {str(n): v for n, v in sorted(tree[k].items())} for k in tree}


def _id_cells(c: str, j: int) -> Column:
    """A cell of family ``j`` for each id of a set."""
    ids = F.array_distinct(F.coalesce(F.col(c).cast("array<long>"), F.array().cast("array<long>")))
    return F.transform(ids, lambda i: F.struct(F.lit(j).alias("j"), i.alias("b")))


def _names(split: dict) -> set[str]:
    return {split["c"]} if isinstance(split["c"], str) else set(split["c"])


def _leaves(state: DataFrame, s: Spec, sums: dict[int, tuple], bounds: dict[int, tuple]) -> dict[int, float | dict]:
    """The leaves' values, times the rate: a Newton step; the residuals' quantile for L1 and quantile losses; a ridge
    regression of the step's target where linear columns are named."""
    means = {n: float(np.clip(-g / (h + s.ridge), *bounds[n])) * s.rate for n, (_, g, h) in sums.items()}
    if s.loss in ("l1", "quantile"):
        level = s.alpha if s.loss == "quantile" else 0.5
        by = state.select("__n", (F.col("__y") - F.col("__f")).alias("r"), "__w").groupBy("__n", "r").agg(F.sum("__w").alias("w"))
        up = W.partitionBy("__n").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
        cum = by.withColumn("c", F.sum("w").over(up)).withColumn("t", F.sum("w").over(W.partitionBy("__n")))
        found = cum.where(F.col("c") >= level * F.col("t") - 1e-9 * F.col("t")).groupBy("__n").agg(F.min("r").alias("v")).collect()
        return means | {r[0]: float(np.clip(r.v, *bounds[r[0]])) * s.rate for r in found if r[0] in means}
    if not s.linear:
        return means
    cols = [F.lit(1.0), *[F.col(c) for c in s.linear]]
    k, target = len(cols), -F.col("__g") / F.col("__h")
    parts = [F.sum(F.col("__h") * cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(F.col("__h") * c * target) for c in cols]
    out: dict[int, float | dict] = dict(means)
    for r in state.groupBy("__n").agg(*[x.alias(f"s{i}") for i, x in enumerate(parts)]).collect():
        if r[0] not in means:
            continue
        it, xx = iter(list(r)[1:]), np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                xx[i, j] = xx[j, i] = next(it)
        beta = np.linalg.solve(xx + s.ridge * np.diag([0.0] + [1.0] * (k - 1)) + 1e-12 * np.eye(k), np.array(list(it)))
        out[r[0]] = {"bias": float(beta[0]) * s.rate, "coef": {c: float(b) * s.rate for c, b in zip(s.linear, beta[1:], strict=True)}}
    return out


def _best(part, whole: tuple, families: list[dict], s: Spec, bound: tuple[float, float], allowed, centres: dict) -> tuple | None:
    """The split of most gain, its left sums and both sides' values; ties go to the family listed first, then to the lower
    threshold, and between arcs to the narrower one."""
    best, pick, plain = s.gain, None, None
    w0, g0, h0 = whole
    for j, f in enumerate(families):
        names = _names(f)
        if allowed is not None and not names <= allowed:
            continue
        cells = part[part["j"] == j]
        if f["kind"] == "set":
            at = cells.sort_values("b")
            ids, lw, lg, lh = at["b"].to_numpy(), *(at[k].to_numpy() for k in ("w", "g", "h"))
        else:
            n = len(f["edges"]) + 1
            w, g, h = (np.bincount(cells["b"], weights=cells[k], minlength=n) for k in ("w", "g", "h"))
            lw, lg, lh = (np.cumsum(v)[:-1] for v in (w, g, h))
            if f["kind"] == "arc":  # left: the bins from i + 1 to k, in the circle of n - 1 edges
                if n < 3:
                    continue
                lo, hi = (x.ravel() for x in np.meshgrid(np.arange(n - 1), np.arange(n - 1), indexing="ij"))
                keep = lo != hi
                lo, hi = lo[keep], hi[keep]
                lw, lg, lh = (np.where(hi > lo, c[hi] - c[lo], c[hi] - c[lo] + t) for c, t in ((lw, w.sum()), (lg, g.sum()), (lh, h.sum())))
        if not len(lw):
            continue
        rw, rg, rh = w0 - lw, g0 - lg, h0 - lh
        gain = _score(lg, lh, s.ridge) + _score(rg, rh, s.ridge) - g0 * g0 / (h0 + s.ridge)
        left, right = np.clip(-lg / (lh + s.ridge), *bound), np.clip(-rg / (rh + s.ridge), *bound)
        ok = (lw >= s.least) & (rw >= s.least)
        if f["kind"] == "axis" and (sign := s.monotone.get(f["c"], 0)):
            ok &= sign * (right - left) >= 0
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain))
        if f["kind"] == "arc" and np.isfinite(gain[at]):
            edges = np.array(f["edges"])
            width = (edges[hi] - edges[lo]) % f["period"]
            near = np.flatnonzero(gain >= gain[at] - 1e-12 * abs(gain[at]))
            at = int(near[np.argmin(width[near])])
        need = best * (1 + 1e-12)
        if f["kind"] in ("diagonal", "radial") and plain is not None:
            need = max(need, plain * SPATIAL_EDGE)
        if gain[at] <= need:
            continue
        split = {"kind": f["kind"], "c": f["c"], "gain": float(gain[at])}
        if f["kind"] == "arc":
            split |= {"period": f["period"], "lo": f["edges"][lo[at]], "hi": f["edges"][hi[at]]}
        elif f["kind"] == "set":
            split |= {"id": int(ids[at])}
        else:
            split |= {"t": float(f["edges"][at])}
        if f["kind"] == "diagonal":
            split |= {"n": f["n"]}
        if f["kind"] == "radial":
            split |= {"at": centres[f["c"][0]][f["which"]]}
        best = float(gain[at])
        plain = best if f["kind"] not in ("diagonal", "radial") else plain
        pick = (split, (float(lw[at]), float(lg[at]), float(lh[at])), float(left[at]), float(right[at]))
    return pick


class _Margins:
    """Rows whose margins go on as columns, written every few trees."""

    def __init__(self, rows: DataFrame, keep, every: int = 5):
        self.tables = None if keep else Tables(rows.sparkSession, "boost")
        self.keep = keep or self.tables.save
        self.every, self.n, self.rows = every, 0, self.keep(rows)

    def add(self, column: str, tree: dict) -> None:
        self.rows = self.rows.withColumn(column, F.col(column) + tree_value(tree))

    def cut(self) -> None:
        self.n += 1
        if self.n % self.every == 0:
            self.rows = self.keep(self.rows)

    def close(self) -> None:
        if self.tables:
            self.tables.close()


def fit(df: DataFrame, s: Spec, keep=None) -> Model:
    """A model of ``df``.  ``keep(df)`` writes and rereads a table to cut lineage; by default that is the shared folder,
    which is freed at the end."""
    w = F.col(s.weight).cast("double") if s.weight else F.lit(1.0)
    model = Model(s, _initial(df, s, w), [])
    families = _families(df, s)
    m = _Margins(_binned(df, s, families, F.col(s.y).cast("double").alias("__y"), w.alias("__w"), F.lit(model.init).alias("__f")), keep)
    g, h = gradients(s, F.col("__f"), F.col("__y"))
    y = F.log(F.col("__y") + s.alpha) if s.loss == "log_l2" else F.col("__y")
    error = F.col("__w") * (F.col("__f") - y) * (F.col("__f") - y)
    history: list[float] | None = [] if s.loss in ("l2", "log_l2", "huber", "l1", "quantile") else None
    for _ in range(s.trees):
        model.trees.append(_grow(m.rows, s, families, g, h, history, error))
        m.add("__f", model.trees[-1])
        m.cut()
    if history is not None and s.trees:  # each tree's first pass has the error before it
        model.history = [*history[1:], float(m.rows.agg(F.sqrt(F.sum(error) / F.sum("__w"))).first()[0])]
    m.close()
    return model


def tree_value(tree: dict) -> Column:
    """A tree as one nested expression: whole-stage code, no Python."""

    def at(n: int) -> Column:
        if split := tree["splits"].get(str(n)):
            return F.when(goes_left(split), at(2 * n + 1)).otherwise(at(2 * n + 2))
        leaf = tree["leaves"][str(n)]
        if isinstance(leaf, dict):
            return reduce(lambda a, cb: a + F.col(cb[0]) * cb[1], leaf["coef"].items(), F.lit(leaf["bias"]))
        return F.lit(float(leaf))

    return at(0)


def margin(model: Model) -> Column:
    return reduce(lambda a, t: a + tree_value(t), model.trees, F.lit(model.init))


def predict(model: Model, df: DataFrame, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, transform(model.spec, margin(model)))


def fuzzy_margin(model: Model, width: float, kind: str = "linear") -> Column:
    """The margin with soft thresholds: within ``width`` of an axis threshold a row takes both branches, weighted by its
    distance to the threshold; other splits stay hard."""

    def share(split: dict) -> Column:
        """How much of the row goes left."""
        if split["kind"] != "axis":
            return F.when(goes_left(split), 1.0).otherwise(0.0)
        d = F.col(split["c"]) - split["t"]
        near = F.abs(d) / width
        far = {"linear": 1 - near, "cosine": (1 + F.cos(near * np.pi)) / 2, "gaussian": F.exp(-4.5 * near * near)}[kind]
        other = F.when(near >= 1, 0.0).otherwise(far / 2)
        return F.when(d <= 0, 1 - other).otherwise(other)

    def at(tree: dict, n: int) -> Column:
        if split := tree["splits"].get(str(n)):
            a = share(split)
            return a * at(tree, 2 * n + 1) + (1 - a) * at(tree, 2 * n + 2)
        leaf = tree["leaves"][str(n)]
        return tree_value({"splits": {}, "leaves": {"0": leaf}})

    return reduce(lambda a, t: a + at(t, 0), model.trees, F.lit(model.init))


def tree_mean(tree: dict, n: int = 0) -> float:
    """The mean of a tree over its training rows, by cover."""
    if str(n) not in tree["splits"]:
        return tree["leaves"][str(n)]
    a, b = (tree["cover"][str(k)] for k in (2 * n + 1, 2 * n + 2))
    return (a * tree_mean(tree, 2 * n + 1) + b * tree_mean(tree, 2 * n + 2)) / (a + b)


def additive(model: Model) -> dict[str, Column]:
    """Exact Shapley values of a tree's path, by feature: with the base they add up to the margin.

    A leaf is reached through conditions on some features.  A coalition that knows a feature multiplies by whether the row
    meets its conditions, one that doesn't by the share of training rows that do; the leaf's part of a feature is the
    weighted sum over coalitions of the others.  Only for hard threshold trees with constant leaves.
    """
    parts: dict[str, list[Column]] = {c: [] for c in model.spec.features}

    def walk(tree: dict, n: int, met: dict[str, tuple[Column, float]]) -> None:
        split = tree["splits"].get(str(n))
        if split is None:
            leaf = tree["leaves"][str(n)]
            if isinstance(leaf, dict):
                raise ValueError("linear leaves have no additive values")
            size = len(met)
            for c, (ok, share) in met.items():
                # Elementary sums over the others: coefficient k is that of coalitions with k known features.
                coef = [F.lit(1.0)]
                for other, (o, z) in met.items():
                    if other != c:
                        known = o.cast("double")
                        coef = [total([x for x in ((coef[k] * z) if k < len(coef) else None, (coef[k - 1] * known) if k else None) if x is not None]) for k in range(len(coef) + 1)]
                weight = [1.0 / (size * _choose(size - 1, k)) for k in range(size)]
                parts[c].append((ok.cast("double") - share) * total([x * w for x, w in zip(coef, weight, strict=True)]) * float(leaf))
            return
        if split["kind"] != "axis":
            raise ValueError("additive values are of threshold splits")
        c, left = split["c"], F.coalesce(goes_left(split), F.lit(False))
        for child, cond in ((2 * n + 1, left), (2 * n + 2, ~left)):
            ok, z = met.get(c, (F.lit(True), 1.0))
            walk(tree, child, met | {c: (ok & cond, z * tree["cover"][str(child)] / tree["cover"][str(n)])})

    for t in model.trees:
        walk(t, 0, {})
    return {c: total(x) if x else F.lit(0.0) for c, x in parts.items()}


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def contributions(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with contribution_base (the mean margin of the training rows) and a contribution_<feature> each, its exact
    Shapley value; together they are the margin."""
    out = df.withColumn("contribution_base", F.lit(model.init + sum(tree_mean(t) for t in model.trees)))
    return out.withColumns({f"contribution_{c}": x for c, x in additive(model).items()})


def tree_parts(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with base and tree_<k>: each tree's own part of the margin."""
    return df.withColumn("base", F.lit(model.init)).withColumns({f"tree_{k}": tree_value(t) for k, t in enumerate(model.trees)})


@dataclass
class MultiModel:
    """One tree a class and round, on softmax gradients."""

    spec: Spec
    classes: list
    init: list[float]
    rounds: list[list[dict]]

    def margins(self) -> list[Column]:
        return [reduce(lambda a, t: a + tree_value(t), [r[k] for r in self.rounds], F.lit(self.init[k])) for k in range(len(self.classes))]


def softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins)
    powers = [F.exp(x - top) for x in margins]
    return [p / total(powers) for p in powers]


def softmax_gradients(margins: list[Column], y: Column, classes: list) -> list[tuple[Column, Column]]:
    """(p - [y is the class], p (1 - p)) of each class."""
    return [(p - F.when(y == c, 1.0).otherwise(0.0), F.greatest(p * (1 - p), F.lit(1e-12))) for p, c in zip(softmax(margins), classes, strict=True)]


def fit_multiclass(df: DataFrame, s: Spec, classes: list, keep=None) -> MultiModel:
    """A model of a target with the given classes, at least two; a round's trees share the margins before it."""
    w = F.col(s.weight).cast("double") if s.weight else F.lit(1.0)
    share = df.agg(*[F.sum(F.when(F.col(s.y) == c, w).otherwise(0.0)).alias(f"c{k}") for k, c in enumerate(classes)]).first()
    init = [log(max(x / max(sum(share), 1e-300), 1e-12)) for x in share]
    families = _families(df, s)
    more = [F.col(s.y).alias("__y"), w.alias("__w"), *[F.lit(x).alias(f"__f{k}") for k, x in enumerate(init)]]
    m, model = _Margins(_binned(df, s, families, *more), keep), MultiModel(s, classes, init, [])
    plain = Spec(**(s.__dict__ | {"loss": "l2"}))
    for _ in range(s.trees):
        pairs = softmax_gradients([F.col(f"__f{k}") for k in range(len(classes))], F.col("__y"), classes)
        model.rounds.append([_grow(m.rows, plain, families, g, h) for g, h in pairs])
        for k, t in enumerate(model.rounds[-1]):
            m.add(f"__f{k}", t)
        m.cut()
    m.close()
    return model


def predict_classes(model: MultiModel, df: DataFrame) -> DataFrame:
    """``df`` with probability_<class> each and the likeliest class, the first of equally likely ones."""
    p = softmax(model.margins())
    out = df.withColumns({f"probability_{c}": x for c, x in zip(model.classes, p, strict=True)})
    names = [f"probability_{c}" for c in model.classes]
    return out.withColumn("predicted", F.coalesce(*[F.when(F.col(n) == F.greatest(*names), F.lit(c)) for n, c in zip(names, model.classes, strict=True)]))


def pair_gradients(rows: DataFrame, group: str, ident: str, y: str, f: str, weight: Column | None = None, by_ndcg: bool = False) -> DataFrame:
    """(group, ident, g, h): logistic gradients over a group's pairs of different targets; with ``by_ndcg`` a pair counts
    what swapping it would change of the NDCG (gain 2^y - 1, positions by falling margin, ties by id).

    A group is one query's candidates.  Pairs stream from the join into a row's sums.
    """
    wide = dealt(rows, group).select(F.col(group).alias("q"), F.col(ident).alias("i"), F.col(y).cast("double").alias("t"), F.col(f).alias("f"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    ww = W.partitionBy("q")
    gain = F.pow(F.lit(2.0), F.col("t")) - 1
    wide = wide.withColumn("gain", gain).withColumn("disc", 1 / F.log2(F.row_number().over(ww.orderBy(F.desc("f"), "i")) + 1.0))
    wide = wide.withColumn("best", 1 / F.log2(F.row_number().over(ww.orderBy(F.desc("t"), "i")) + 1.0)).withColumn("ideal", F.sum(F.col("gain") * F.col("best")).over(ww))
    other = wide.select(F.col("q").alias("p"), *[F.col(c).alias(f"o_{c}") for c in ("t", "f", "w", "gain", "disc")])
    pairs = wide.join(other, (F.col("q") == F.col("p")) & (F.col("t") != F.col("o_t")), "left")  # rows without a pair stay
    sign = F.when(F.col("t") > F.col("o_t"), -1.0).otherwise(1.0)  # the higher target's gradient falls
    rho = 1 / (1 + F.exp(F.when(F.col("t") > F.col("o_t"), F.col("f") - F.col("o_f")).otherwise(F.col("o_f") - F.col("f"))))
    size = (F.col("w") + F.col("o_w")) / 2
    if by_ndcg:
        swap = F.abs(F.col("gain") - F.col("o_gain")) * F.abs(F.col("disc") - F.col("o_disc"))
        size = size * F.when(F.col("ideal") > 0, swap / F.col("ideal")).otherwise(1.0)
    apart = F.col("p").isNotNull()
    out = pairs.groupBy("q", "i").agg(F.sum(F.when(apart, sign * size * rho)).alias("g"), F.sum(F.when(apart, size * rho * (1 - rho))).alias("h")).na.fill(0.0, ["g", "h"])
    return out.select(F.col("q").alias(group), F.col("i").alias(ident), "g", F.greatest("h", F.lit(1e-12)).alias("h"))


def fit_ranker(df: DataFrame, s: Spec, group: str, ident: str, by_ndcg: bool = True, keep=None) -> Model:
    """A ranker by pairwise gradients within groups; (group, ident) names a row."""
    w = F.col(s.weight).cast("double") if s.weight else F.lit(1.0)
    families = _families(df, s)
    plain = Spec(**(s.__dict__ | {"loss": "l2"}))
    cols = [F.col(group).alias("__q"), F.col(ident).alias("__i"), F.col(s.y).cast("double").alias("__y"), w.alias("__v"), F.lit(1.0).alias("__w"), F.lit(0.0).alias("__f")]
    m, model = _Margins(_binned(df, s, families, *cols), keep), Model(s, 0.0, [])
    tasks = tasks_of(m.rows)
    for _ in range(s.trees):
        pairs = pair_gradients(m.rows, "__q", "__i", "__y", "__f", F.col("__v"), by_ndcg).withColumnsRenamed({"g": "__pg", "h": "__ph"})
        rows = m.keep(dealt(m.rows, "__q", "__i", tasks=tasks).join(dealt(pairs, "__q", "__i", tasks=tasks), ["__q", "__i"]))
        model.trees.append(_grow(rows, plain, families, F.col("__pg"), F.col("__ph")))
        if m.tables:
            m.tables.drop(rows)
        m.add("__f", model.trees[-1])
        m.cut()
    m.close()
    return model


def quantile_set(df: DataFrame, s: Spec, levels: list[float], keep=None) -> dict[float, Model]:
    """One model a level."""
    return {q: fit(df, Spec(**(s.__dict__ | {"loss": "quantile", "alpha": q})), keep) for q in sorted(levels)}


def predict_quantiles(models: dict[float, Model], df: DataFrame) -> DataFrame:
    """Columns q<percent>, repaired to be non-decreasing by the running maximum."""
    out, seen = {}, []
    for q, m in sorted(models.items()):
        seen.append(margin(m))
        out[f"q{round(q * 100)}"] = F.greatest(*seen) if len(seen) > 1 else seen[0]
    return df.withColumns(out)


def histogram(df: DataFrame, features: list[str], y: str, weight: str, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, n, w, wy, wyy): the sums that a node's split search reads."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _bin(c, edges[c]).cast("int").alias("bin")) for c in features])).alias("c")
    rows = df.select(F.col(y).alias("y"), F.col(weight).alias("w"), cells)
    return rows.groupBy("c.feature", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"))


def weighted_sse(w: Column, wy: Column, wyy: Column) -> Column:
    return wyy - wy * wy / w


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """A sibling's histogram: the parent's less the other child's."""
    names = ["n", "w", "wy", "wyy"]
    c = child.select("feature", "bin", *[F.col(k).alias(f"__{k}") for k in names])
    return parent.join(c, ["feature", "bin"], "left").select("feature", "bin", *[(F.col(k) - F.coalesce(f"__{k}", F.lit(0))).alias(k) for k in names])
