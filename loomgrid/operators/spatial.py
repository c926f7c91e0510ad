"""Spatial weights, statistics, variograms, kriging and regressions."""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import ratio
from loomgrid.functions.geometry import semivariogram
from loomgrid.operators.joins import nearest, spatial_lag, within
from loomgrid.operators.ordered import running

MOST_POINTS, MOST_LINKS = 4000, 1_000_000  # for what is solved as one dense system on the driver


def weights(edges: DataFrame, row_normalize: bool = False, symmetric: bool = False, zero_diagonal: bool = True) -> DataFrame:
    """(src, dst, w): repeated edges summed; optionally both directions, without loops, rows scaled to 1."""
    rows = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    if rows.where("w < 0 OR isnan(w) OR abs(w) = double('inf')").take(1):
        raise ValueError("weights are finite and not negative")
    if symmetric:
        rows = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    if zero_diagonal:
        rows = rows.where("src <> dst")
    out = rows.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0")
    if not row_normalize:
        return out
    sums = out.groupBy("src").agg(F.sum("w").alias("__s"))
    return out.join(sums, "src").select("src", "dst", (F.col("w") / F.col("__s")).alias("w"))


def isolates(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias(node)).unionByName(edges.select(F.col("dst").alias(node))).distinct()
    return nodes.select(node).join(ends, node, "left_anti")


def is_symmetric(edges: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether every edge has its reverse of equal weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    off = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))) > tolerance
    return edges.join(back, ["src", "dst"], "full_outer").agg((F.coalesce(F.max(off.cast("int")), F.lit(0)) == 0).alias("symmetric"))


def radius_weights(df: DataFrame, ident: str, radius: float) -> DataFrame:
    """(src, dst, w = 1) for 0 < distance <= radius."""
    return within(df, df, radius).where((F.col(ident) != F.col(f"r_{ident}")) & (F.col("distance") > 0)).select(F.col(ident).alias("src"), F.col(f"r_{ident}").alias("dst"), F.lit(1.0).alias("w"))


def morans_i(df: DataFrame, ident: str, value: str, edges: DataFrame) -> DataFrame:
    """One row (moran): n / sum w times the weighted autocovariance over the variance."""
    mean = df.agg(F.avg(value).alias("__m"))
    z = df.crossJoin(F.broadcast(mean)).select(F.col(ident).alias("node"), (F.col(value) - F.col("__m")).alias("z"))
    cross = edges.join(z.withColumnRenamed("node", "src").withColumnRenamed("z", "a"), "src").join(z.withColumnRenamed("node", "dst").withColumnRenamed("z", "b"), "dst")
    top = cross.agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("top"), F.sum("w").alias("w"))
    var = z.agg(F.sum(F.col("z") * F.col("z")).alias("var"), F.count(F.lit(1)).alias("n"))
    return top.crossJoin(var).select((F.col("n") / F.col("w") * F.col("top") / F.col("var")).alias("moran"))


def _places(df: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """A row a place (x, y): its rows __n, values __m, their mean __a, variance __v and sum __s."""
    z = F.col(value).cast("double")
    return df.groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.count(z).cast("double").alias("__m"), F.coalesce(F.avg(z), F.lit(0.0)).alias("__a"), F.coalesce(F.var_pop(z), F.lit(0.0)).alias("__v"), F.coalesce(F.sum(z), F.lit(0.0)).alias("__s"))


def morans_i_within(df: DataFrame, value: str, radius: float) -> DataFrame:
    """One row (moran): ``morans_i`` with ``radius_weights``, from sums a place, so copies of a place make no pairs."""
    mean = df.agg(F.avg(value).alias("__m"))
    z = df.crossJoin(F.broadcast(mean)).select("x", "y", (F.col(value) - F.col("__m")).alias("z"))
    at = _places(z, "z").select("x", "y", "__n", "__s")
    top = within(at, at, radius).where("distance > 0").agg(F.sum(F.col("__s") * F.col("r___s")).alias("top"), F.sum(F.col("__n") * F.col("r___n")).alias("w"))
    var = z.agg(F.sum(F.col("z") * F.col("z")).alias("var"), F.count(F.lit(1)).alias("n"))
    return top.crossJoin(var).select((F.col("n") / F.col("w") * F.col("top") / F.col("var")).alias("moran"))


def morans_i_inverse(df: DataFrame, ident: str, value: str, x: str = "x", y: str = "y", epsilon: float = 1e-12, block: int = 2000) -> DataFrame:
    """One row (moran) with weights 1 / max(distance, epsilon) between all rows, for evaluation samples: the work grows
    with the square of the places.  Places meet in pairs of blocks inside tasks, and only each pair's sums leave them; rows of
    one place are counted and summed before."""
    import pandas as pd

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("z"))
    n, mean, var = rows.agg(F.count(F.lit(1)), F.avg("z"), F.var_pop("z")).first()
    known = rows.where("x IS NOT NULL AND y IS NOT NULL").withColumn("z", F.col("z") - float(mean or 0.0))
    at = known.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("q"))
    blocks = max(1, -(-at.count() // block))
    own = F.pmod(F.xxhash64("x", "y"), F.lit(blocks))
    tiles = at.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tiles = tiles.select("x", "y", "n", "s", "q", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["own"] == key[0]], part[part["own"] == key[1]]
        gap = np.sqrt((a["x"].to_numpy()[:, None] - b["x"].to_numpy()) ** 2 + (a["y"].to_numpy()[:, None] - b["y"].to_numpy()) ** 2)
        w = 1 / np.maximum(gap, epsilon)
        sums = lambda c: float(a[c].to_numpy() @ w @ b[c].to_numpy())
        if key[0] != key[1]:
            return pd.DataFrame({"w": [2 * sums("n")], "top": [2 * sums("s")]})
        # Of a place with itself the pairs of different rows are left.
        np.fill_diagonal(w, 0.0)
        same, cross = float((a["n"] * (a["n"] - 1)).sum()), float((a["s"] * a["s"] - a["q"]).sum())
        return pd.DataFrame({"w": [sums("n") + same / epsilon], "top": [sums("s") + cross / epsilon]})

    sums = tiles.groupBy("lo", "hi").applyInPandas(run, "w double, top double").agg(F.sum("top").alias("top"), F.sum("w").alias("w"))
    # The sum of squares is n times the variance.
    return sums.select(ratio(F.col("top"), F.col("w") * F.lit(float(var or 0.0))).alias("moran"))


def variogram(df: DataFrame, ident: str, value: str, bins: int, reach: float) -> DataFrame:
    """(bin, centre, mean_distance, gamma, n) over pairs at most ``reach`` apart; the last bin is closed.

    Of the pairs of two places, or of one, the squared differences sum up from means and variances, so copies of a place
    make no pairs."""
    at = _places(df.where(F.col(ident).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()), value)
    pairs = within(at, at, reach).where((F.col("x") < F.col("r_x")) | ((F.col("x") == F.col("r_x")) & (F.col("y") < F.col("r_y"))))
    m = F.col("__m") * F.col("r___m")
    square = F.pow(F.col("__a") - F.col("r___a"), F.lit(2.0)) + F.col("__v") + F.col("r___v")
    apart = pairs.select("distance", (F.col("__n") * F.col("r___n")).alias("n"), m.alias("m"), (m * square / 2).alias("g"))
    here = lambda c: F.col(c) * (F.col(c) - 1) / 2
    alike = at.where("__n > 1 AND NOT isnan(x) AND NOT isnan(y)").select(F.lit(0.0).alias("distance"), here("__n").alias("n"), here("__m").alias("m"), (F.col("__m") * F.col("__m") * F.col("__v") / 2).alias("g"))
    b = F.least(F.floor(F.col("distance") / (reach / bins)), F.lit(bins - 1)).cast("int")
    sums = apart.unionByName(alike).groupBy(b.alias("bin")).agg(F.sum(F.col("distance") * F.col("n")).alias("d"), F.sum("g").alias("g"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    out = sums.select("bin", (F.col("d") / F.col("n")).alias("mean_distance"), ratio(F.col("g"), F.col("m")).alias("gamma"), F.col("n").cast("long").alias("n"))
    return out.withColumn("centre", (F.col("bin") + 0.5) * (reach / bins))


def fit_variogram(empirical: DataFrame, kind: str, ranges: list[float], sills: list[float], nuggets: list[float], abscissa: str = "mean_distance") -> DataFrame:
    """One row: the grid's least count-weighted squared error (first of equal ones)."""
    grid = [(i, float(a), float(s), float(g)) for i, (a, s, g) in enumerate((a, s, g) for a in ranges for s in sills for g in nuggets)]
    spec = empirical.sparkSession.createDataFrame(grid, "k int, scale double, sill double, nugget double")
    shape = semivariogram(F.col(abscissa) / F.col("scale"), kind, 1.0)  # of unit range, sill and no nugget
    err = F.col("nugget") + F.col("sill") * shape - F.col("gamma")
    scored = empirical.crossJoin(F.broadcast(spec)).groupBy("k", "scale", "sill", "nugget").agg(F.sum(F.col("n") * err * err).alias("sse"))
    return scored.orderBy(F.round("sse", 9), "k").limit(1).drop("k")


def _gamma(h: np.ndarray, kind: str, scale: float, sill: float, nugget: float) -> np.ndarray:
    r = h / scale
    shape = {"exponential": 1 - np.exp(-r), "gaussian": 1 - np.exp(-r * r), "spherical": np.where(r >= 1, 1.0, 1.5 * r - 0.5 * r**3), "linear": r}[kind]
    return np.where(h == 0, 0.0, nugget + sill * shape)


def _solved(near: DataFrame, ident: str, value: str, solve) -> DataFrame:
    """(ident, mean, variance) of each target by ``solve(xy, at, z)`` of stacks of targets with equally many neighbours: an
    array of neighbours a target goes to Python, so a batch is a few calls of linear algebra and not one a target."""
    import pandas as pd

    by = F.array_sort(F.collect_list(F.struct(F.col("r_x").cast("double").alias("x"), F.col("r_y").cast("double").alias("y"), F.col(f"r_{value}").cast("double").alias("z"))))
    part = lambda c: F.transform("__near", lambda s: s[c])
    rows = near.groupBy(ident).agg(F.first("x").cast("double").alias("__x"), F.first("y").cast("double").alias("__y"), by.alias("__near"))
    rows = rows.select(ident, "__x", "__y", *[part(c).alias(f"__r{c}") for c in "xyz"])

    def run(batches):
        for batch in batches:
            sizes = batch["__rz"].map(len).to_numpy()
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for some in np.array_split(at, -(-len(at) * int(n) ** 2 // 1_000_000)):
                    own = batch.iloc[some]
                    xy = np.stack([np.stack(own["__rx"].tolist()), np.stack(own["__ry"].tolist())], -1).astype(float)
                    mean, variance = solve(xy, own[["__x", "__y"]].to_numpy(float), np.stack(own["__rz"].tolist()).astype(float))
                    yield pd.DataFrame({ident: own[ident].to_numpy(), "mean": mean, "variance": variance})

    kind_of = near.schema[ident].dataType.simpleString()
    return rows.mapInPandas(run, f"{ident} {kind_of}, mean double, variance double")


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(-1))


def krige(near: DataFrame, ident: str, value: str, kind: str, scale: float, sill: float, nugget: float, drift: bool = False) -> DataFrame:
    """(ident, mean, variance) of each target from its neighbours (``nearest`` rows): the system of one target is of
    its neighbourhood's size, so all targets are solved side by side on the executors; the least weights where copies of a
    place leave them open."""
    unit = (nugget + sill) or 1.0  # semivariances of about 1 beside the borders of 1

    def solve(xy: np.ndarray, at: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, n = z.shape
        one = np.ones((t, n, 1))
        f = np.concatenate([one, xy], -1) if drift and n > 3 else one
        g = np.concatenate([one[:, 0], at], -1) if drift and n > 3 else one[:, 0]
        m = f.shape[2]
        a = np.zeros((t, n + m, n + m))
        a[:, :n, :n] = _gamma(_gaps(xy, xy), kind, scale, sill, nugget) / unit
        a[:, :n, n:], a[:, n:, :n] = f, f.transpose(0, 2, 1)
        b = np.concatenate([_gamma(_gaps(xy, at[:, None])[:, :, 0], kind, scale, sill, nugget) / unit, g], -1)
        u, s, v = np.linalg.svd(a)
        s = np.where(s > s[:, :1] * (np.finfo(float).eps * (n + m)), s, np.inf)
        w = (v.transpose(0, 2, 1) @ (u.transpose(0, 2, 1) @ b[:, :, None] / s[:, :, None]))[:, :, 0]
        return (w[:, :n] * z).sum(-1), np.maximum(0.0, (w * b).sum(-1) * unit)

    return _solved(near, ident, value, solve)


def nngp(near: DataFrame, ident: str, value: str, scale: float, sill: float, nugget: float, mean: float) -> DataFrame:
    """(ident, mean, variance) by an exponential covariance over each target's neighbours."""

    def solve(xy: np.ndarray, at: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cov = lambda h: sill * np.exp(-h / scale)
        k = cov(_gaps(xy, xy)) + nugget * np.eye(z.shape[1])
        c = cov(_gaps(xy, at[:, None])[:, :, 0])
        w = np.linalg.solve(k, c[:, :, None])[:, :, 0]
        return mean + (w * (z - mean)).sum(-1), sill + nugget - (w * c).sum(-1)

    return _solved(near, ident, value, solve)


def normal_equations(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n with an intercept, by one aggregation."""
    cols = [F.lit(1.0), *[F.col(c) for c in x]]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)) for c in cols] + [F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))]
    row = [float(v) for v in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    xtx = np.zeros((k, k))
    it = iter(row)
    for i in range(k):
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = next(it)
    xty = np.array([next(it) for _ in range(k)])
    return xtx, xty, next(it), int(next(it))


def ols(df: DataFrame, x: list[str], y: str) -> dict:
    """Coefficients, sigma squared (by n), log-likelihood and AIC with k = coefficients and sigma squared."""
    xtx, xty, yty, n = normal_equations(df, x, y)
    beta = np.linalg.solve(xtx, xty)
    sigma2 = max((yty - beta @ xty) / n, 1e-300)
    like = -0.5 * n * (np.log(2 * pi * sigma2) + 1)
    return {"beta": beta, "sigma2": float(sigma2), "loglik": float(like), "aic": float(2 * (len(beta) + 1) - 2 * like), "n": n}


def s2sls(nodes: DataFrame, edges: DataFrame, node: str, x: list[str], y: str) -> np.ndarray:
    """Spatial two-stage least squares of y on its lag and X, with instruments X and WX: [intercept, X..., rho].

    Both stages are sums of products, so nothing of the nodes' size leaves the executors.
    """
    lags = spatial_lag(edges, nodes, node, [y, *x])
    rows = nodes.join(lags, node)
    z = [*x, *[f"lag_{c}" for c in x]]
    first = ols(rows, z, f"lag_{y}")["beta"]
    fitted = F.lit(float(first[0]))
    for b, c in zip(first[1:], z, strict=True):
        fitted = fitted + F.col(c) * float(b)
    return ols(rows.withColumn("__wy", fitted), [*x, "__wy"], y)["beta"]


def spatial_ml(nodes: DataFrame, edges: DataFrame, node: str, x: list[str], y: str, model: str = "lag") -> dict:
    """Spatial lag, error or Durbin model by concentrated likelihood: 201 points of rho within 0.999 of the bound,
    then 80 golden-section steps; an error if the best point is an end.  Dense, for at most MOST_POINTS nodes."""
    rows = nodes.select(node, *x, y).orderBy(node).limit(MOST_POINTS + 1).toPandas()
    n = len(rows)
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} nodes; use s2sls")
    place = {v: k for k, v in enumerate(rows[node])}
    w = np.zeros((n, n))
    links = edges.select("src", "dst", "w").limit(MOST_LINKS + 1).toPandas()
    if len(links) > MOST_LINKS:
        raise ValueError(f"more than {MOST_LINKS} edges; use s2sls")
    for a, b, v in links.itertuples(index=False):
        w[place[a], place[b]] = v
    mat = np.column_stack([np.ones(n), rows[x].to_numpy(float)])
    if model == "durbin":
        mat = np.column_stack([mat, w @ mat[:, 1:]])
    v = rows[y].to_numpy(float)
    eig = np.linalg.eigvals(w)
    bound = 0.999 / w.sum(1).max()

    def fit(rho: float):
        a = v - rho * (w @ v)
        m = mat - rho * (w @ mat) if model == "error" else mat
        beta = np.linalg.lstsq(m, a, rcond=None)[0]
        s2 = float(((a - m @ beta) ** 2).mean())
        like = -0.5 * n * (np.log(2 * pi * s2) + 1) + float(np.log(np.abs(1 - rho * eig)).sum())
        return like, beta, s2

    grid = np.linspace(-bound, bound, 201)
    best = int(np.argmax([fit(g)[0] for g in grid]))
    if best in (0, 200):
        raise ValueError("the likelihood has no inner maximum")
    lo, hi, gold = grid[best - 1], grid[best + 1], (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, d) if fit(c)[0] > fit(d)[0] else (c, hi)
    rho = (lo + hi) / 2
    like, beta, s2 = fit(rho)
    out = {"rho": float(rho), "beta": beta, "sigma2": s2, "loglik": like, "aic": 2 * (len(beta) + 2) - 2 * like}
    if model != "error":
        s = np.linalg.inv(np.eye(n) - rho * w)
        k = len(x)
        theta = beta[1 + k :] if model == "durbin" else np.zeros(k)
        total = beta[1 : 1 + k] * s.sum() / n + theta * (s @ w).sum() / n
        direct = beta[1 : 1 + k] * np.trace(s) / n + theta * np.trace(s @ w) / n
        out |= {"direct": direct, "indirect": total - direct, "total": total}
    return out


def overlay(points: DataFrame, ident: str, parts: dict[str, float], priority: Column, kernel: Column, alpha: float) -> DataFrame:
    """(ident, score, rank): the weighted sum times priority and (1 + alpha * kernel), rounded half to even, ranked from 1 by
    falling score, then id, in ranges of the score."""
    from loomgrid.functions.columns import total
    from loomgrid.functions.scalars import half_even

    raw = total([F.col(c) * w for c, w in parts.items()]) * priority * (1 + kernel * alpha)
    scored = points.select(ident, half_even(raw, 6).alias("score"))
    return running(scored, "score", {"rank": F.lit(1).cast("long")}, (ident,), descending=True).withColumn("rank", F.col("rank").cast("int"))


def third_nearest(points: DataFrame, ident: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(ident, bandwidth): the distance to the third nearest point, the overlay's default bandwidth; to the farthest
    of fewer within the radius."""
    near = nearest(points, points, ident, 3, radius, x, y)
    return near.groupBy(ident).agg(F.max("distance").alias("bandwidth"))
