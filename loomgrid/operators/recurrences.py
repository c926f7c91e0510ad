"""Recurrences over one series' values, as plain functions of arrays."""

from __future__ import annotations

from math import ceil

import numpy as np


def ses(y: np.ndarray, alpha: float) -> float:
    """The last level of simple exponential smoothing from the first value."""
    level = y[0]
    for v in y[1:]:
        level = alpha * v + (1 - alpha) * level
    return float(level)


def phase_means(y: np.ndarray, season: int, multiplicative: bool = False) -> np.ndarray:
    """Seasonal factors by phase from index 0: mean differences from, or ratios to, the overall mean."""
    level = y.mean()
    means = np.array([y[k::season].mean() for k in range(season)])
    return means / level if multiplicative else means - level


def theta(y: np.ndarray, horizon: int, alpha: float = 0.5, theta_: float = 2.0, season: int | None = None, multiplicative: bool = False) -> np.ndarray:
    """Level by smoothing, with the drift (1 - 1/theta) times the linear trend."""
    n = len(y)
    factors = None
    if season and n >= 2 * season:
        factors = phase_means(y, season, multiplicative)
        f = factors[np.arange(n) % season]
        y = y / f if multiplicative else y - f
    t = np.arange(n)
    slope = float(np.polyfit(t, y, 1)[0]) if n > 1 else 0.0
    steps = np.arange(1, horizon + 1)
    out = ses(y, alpha) + (1 - 1 / theta_) * slope * ((steps - 1) + 1 / alpha - (1 - alpha) ** n / alpha)
    if factors is not None:
        f = factors[(n + steps - 1) % season]
        out = out * f if multiplicative else out + f
    return out


def ets(y: np.ndarray, horizon: int, alpha: float = 0.3, beta: float = 0.1, gamma: float | None = None, phi: float = 1.0, season: int | None = None) -> np.ndarray:
    """Additive Holt-Winters with damped trend; the season is updated with the new level."""
    n = len(y)
    seasonal = bool(season and gamma is not None and n >= 2 * season)
    s = phase_means(y[:season], season) if seasonal else np.zeros(1)
    m = season if seasonal else 1
    level = y[0] - s[0]
    if n < 2:
        trend = 0.0
    elif seasonal:
        trend = float(np.mean((y[season : 2 * season] - y[:season]) / season))
    else:
        trend = float(y[1] - y[0])
    for t in range(1, n):
        old, k = level, t % m
        level = alpha * (y[t] - s[k]) + (1 - alpha) * (level + phi * trend)
        trend = beta * (level - old) + (1 - beta) * phi * trend
        if seasonal:
            s[k] = gamma * (y[t] - level) + (1 - gamma) * s[k]
    steps = np.arange(1, horizon + 1)
    damped = steps if phi == 1 else phi * (1 - phi**steps) / (1 - phi)
    return level + damped * trend + s[(n + steps - 1) % m]


def croston(y: np.ndarray, alpha: float = 0.1) -> float:
    """Demand size over demand interval, both smoothed at demands; 0 without demand."""
    at = np.flatnonzero(y > 0)
    if not len(at):
        return 0.0
    size, gap = float(y[at[0]]), float(at[0] + 1)
    for before, now in zip(at, at[1:], strict=False):
        size += alpha * (y[now] - size)
        gap += alpha * ((now - before) - gap)
    return size / gap


def sba(y: np.ndarray, alpha: float = 0.1) -> float:
    return croston(y, alpha) * (1 - alpha / 2)


def tsb(y: np.ndarray, alpha: float = 0.1, beta: float = 0.1) -> float:
    """Demand size times demand probability; the probability is updated every period, from 0."""
    p, size = 0.0, None
    for v in y:
        p += beta * ((v > 0) - p)
        if v > 0:
            size = v if size is None else size + alpha * (v - size)
    return p * (size or 0.0)


def adida(y: np.ndarray, bucket: int = 7, alpha: float = 0.1) -> float:
    """Croston over sums of trailing complete buckets, a period's share."""
    n = len(y) // bucket * bucket
    return croston(y[len(y) - n :].reshape(-1, bucket).sum(1), alpha) / bucket if n else croston(y, alpha)


def intermittent(y: np.ndarray) -> float:
    """Zero, TSB, SBA, Croston or ADIDA, whichever loses least on the holdout (first of equal ones, which losses within 1e-12 a
    place in that order are: levels that stand between as many of the values above as below lose alike)."""
    models = [lambda y: 0.0, tsb, sba, croston, adida]
    k = holdout(len(y))
    if len(y) <= k:
        return croston(y)
    train, test = y[:-k], y[-k:]
    level = np.abs(test).sum()
    losses = [np.abs(m(train) - test).sum() / level if level else abs(m(train)) * k for m in models]
    return models[int(np.argmin([1e9 * loss + 1e-3 * (k + 1) for k, loss in enumerate(losses)]))](y)


def holdout(n: int, least: int = 5, most: int = 8) -> int:
    """Rows held out to choose parameters: a fifth, from 1 to ``most``."""
    return min(max(n // 5, 1), most)


def difference(y: np.ndarray, d: int) -> np.ndarray:
    for _ in range(d):
        y = np.diff(y)
    return y


def arima(y: np.ndarray, horizon: int, p: int = 1, d: int = 0, q: int = 0, ridge: float = 1e-8) -> np.ndarray:
    """Least squares on own lags and residual lags; residuals come from the pass before, six passes with q > 0."""
    z = difference(y, d)
    k = max(p, q)
    if len(z) <= k + 1:
        return np.full(horizon, y[-1])
    resid = np.zeros(len(z))
    rows = np.arange(k, len(z))
    coef = np.zeros(1 + p + q)
    for _ in range(6 if q else 1):
        x = np.column_stack([np.ones(len(rows)), *[z[rows - i] for i in range(1, p + 1)], *[resid[rows - i] for i in range(1, q + 1)]])
        coef = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ z[rows])
        resid = np.zeros(len(z))
        resid[rows] = z[rows] - x @ coef
    hist, noise = list(z), list(resid)
    for _ in range(horizon):
        hist.append(coef[0] + sum(coef[i] * hist[-i] for i in range(1, p + 1)) + sum(coef[p + i] * noise[-i] for i in range(1, q + 1)))
        noise.append(0.0)
    out = np.array(hist[len(z) :])
    for level in reversed(range(d)):
        out = difference(y, level)[-1] + np.cumsum(out)
    return out


def kalman_level(y: np.ndarray, process: float = 0.1, noise: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered levels, their variances and the log-likelihood of a local level from the first value; NaN is no observation."""
    level, var = float(y[0]), noise
    levels, variances, like = [level], [var], 0.0
    for v in y[1:]:
        prior = var + process
        if np.isnan(v):
            var = prior
        else:
            s = prior + noise
            gain, err = prior / s, v - level
            level += gain * err
            var = (1 - gain) ** 2 * prior + gain**2 * noise
            like -= 0.5 * (np.log(2 * np.pi * s) + err * err / s)
        levels.append(level)
        variances.append(var)
    return np.array(levels), np.array(variances), like


def smooth_level(levels: np.ndarray, variances: np.ndarray, process: float) -> np.ndarray:
    """Fixed-interval smoothing of ``kalman_level``'s result."""
    out = levels.copy()
    for t in range(len(levels) - 2, -1, -1):
        out[t] = levels[t] + variances[t] / (variances[t] + process) * (out[t + 1] - levels[t])
    return out


def kalman_trend(y: np.ndarray, level_noise: float = 0.1, trend_noise: float = 0.01, noise: float = 1.0) -> tuple[float, float]:
    """Last level and trend of a local linear trend that starts at 0."""
    x, cov = np.array([y[0], 0.0]), np.eye(2) * noise
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    for v in y[1:]:
        x, cov = f @ x, f @ cov @ f.T + np.diag([level_noise, trend_noise])
        if not np.isnan(v):
            gain = cov @ h.T / (h @ cov @ h.T + noise)
            keep = np.eye(2) - gain @ h
            x, cov = x + gain[:, 0] * (v - x[0]), keep @ cov @ keep.T + gain @ gain.T * noise
    return float(x[0]), float(x[1])


def trend_distribution(y: np.ndarray, horizon: int, level_noise: float = 0.1, trend_noise: float = 0.01, noise: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the next observations of ``kalman_trend``."""
    x, cov = np.array([y[0], 0.0]), np.eye(2) * noise
    f, q = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level_noise, trend_noise])
    for v in y[1:]:
        x, cov = f @ x, f @ cov @ f.T + q
        if not np.isnan(v):
            gain = cov[:, 0] / (cov[0, 0] + noise)
            x, cov = x + gain * (v - x[0]), cov - np.outer(gain, cov[0])
    means, variances = [], []
    for _ in range(horizon):
        x, cov = f @ x, f @ cov @ f.T + q
        means.append(x[0])
        variances.append(cov[0, 0] + noise)
    return np.array(means), np.array(variances)


def cusum(x: np.ndarray, mean: float, drift: float, limit: float) -> list[tuple[float, bool]]:
    """(score, triggered) a value; both sums start again after a trigger."""
    up = down = 0.0
    out = []
    for v in x:
        up, down = max(0.0, up + (v - mean) - drift), max(0.0, down - (v - mean) - drift)
        score = max(up, down)
        out.append((score, score > limit))
        if score > limit:
            up = down = 0.0
    return out


def page_hinkley(x: np.ndarray, delta: float, limit: float) -> list[tuple[float, bool]]:
    """(score, triggered) a value: the cumulated excess over the running mean, above its minimum (0 at first)."""
    n, mean, cum, low, out = 0, 0.0, 0.0, 0.0, []
    for v in x:
        n += 1
        mean += (v - mean) / n
        cum += v - mean - delta
        low = min(low, cum)
        out.append((cum - low, cum - low > limit))
        if cum - low > limit:
            n, mean, cum, low = 0, 0.0, 0.0, 0.0
    return out


def ewma_volatility(r: np.ndarray, alpha: float) -> np.ndarray:
    var, out = r[0] ** 2, []
    for k, v in enumerate(r):
        var = v * v if k == 0 else alpha * v * v + (1 - alpha) * var
        out.append(var**0.5)
    return np.array(out)


def regime_width(triggered: np.ndarray, scores: np.ndarray, vol: np.ndarray, window: int, mult: float) -> np.ndarray:
    """Extra half-width for ``window`` rows from a trigger on: mult * max(volatility, trigger's or current score)."""
    out, left, held = np.zeros(len(scores)), 0, 0.0
    for k in range(len(scores)):
        if triggered[k]:
            left, held = window, scores[k]
        if left:
            out[k] = mult * max(vol[k], held, scores[k])
            left -= 1
    return out


def loess(y: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """Tricube local linear fit at positions ``at`` (default: each)."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    q = min(window, n)
    out = np.empty(len(at))
    for k, p in enumerate(at):
        dist = np.abs(x - p)
        h = max(np.partition(dist, q - 1)[q - 1] * (window / q if window > n else 1.0), 1.0)
        w = np.clip(1 - (dist / (h * 1.0000001)) ** 3, 0, None) ** 3
        sw = w.sum()
        mx, my = (w @ x) / sw, (w @ y) / sw
        var = w @ (x - mx) ** 2
        out[k] = my + (p - mx) * ((w @ ((x - mx) * (y - my))) / var if var > 1e-12 else 0.0)
    return out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def stl(y: np.ndarray, season: int, seasonal_window: int = 7, trend_window: int | None = None, passes: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by alternating local fits."""
    n = len(y)
    if trend_window is None:
        trend_window = ceil(1.5 * season / (1 - 1.5 / seasonal_window))
        trend_window += 1 - trend_window % 2
    low = season + 1 - season % 2
    trend = np.zeros(n)
    for _ in range(passes):
        d = y - trend
        cycle = np.empty(n + 2 * season)
        for k in range(season):
            part = d[k::season]
            fit = loess(part, seasonal_window, np.arange(-1, len(part) + 1, dtype=float))
            cycle[k::season][: len(fit)] = fit
        smooth = loess(_moving(_moving(_moving(cycle, season), season), 3), low)
        seasonal = cycle[season : season + n] - smooth[:n]
        trend = loess(y - seasonal, trend_window)
    return trend, seasonal, y - trend - seasonal


def mstl(y: np.ndarray, seasons: list[int], passes: int = 2) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Trend, a seasonal part a period, and remainder."""
    parts = {m: np.zeros(len(y)) for m in sorted(seasons)}
    trend = np.zeros(len(y))
    for _ in range(passes):
        for m in parts:
            rest = y - sum(v for k, v in parts.items() if k != m)
            trend, parts[m], _ = stl(rest, m)
    left = y - sum(parts.values())
    trend = loess(left, max(3, len(y) // 3 * 2 + 1))
    return trend, parts, left - trend


def piecewise_design(t: np.ndarray, changepoints: np.ndarray, season: float | None, order: int) -> np.ndarray:
    cols = [np.ones(len(t)), t, *[np.maximum(0, t - c) for c in changepoints]]
    if season:
        for k in range(1, order + 1):
            cols += [np.sin(2 * np.pi * k * t / season), np.cos(2 * np.pi * k * t / season)]
    return np.column_stack(cols)


def piecewise(y: np.ndarray, horizon: int, changepoints: int = 5, reach: float = 0.8, season: float | None = 7, order: int = 3, ridge: float = 0.1, huber: float | None = None, extra: tuple[np.ndarray, np.ndarray] | None = None, extra_ridge: float = 1.0, growth: str = "linear", cap: float | None = None) -> np.ndarray:
    """Piecewise linear trend with Fourier season by ridge least squares (free intercept), with Huber weights if asked for.

    ``extra`` holds regressors of the history and of the steps ahead, with a penalty of their own; ``growth`` may be flat
    (no trend), or logistic below ``cap`` (the trend is of the logit).
    """
    n = len(y)
    t = np.arange(n, dtype=float)
    if growth == "logistic":
        share = np.clip(y / cap, 1e-6, 1 - 1e-6)
        y = np.log(share / (1 - share))
    last = max(1, int(n * reach))
    at = t[np.unique(np.linspace(0, last - 1, changepoints + 2).astype(int)[1:-1])] if n > changepoints + 2 else np.zeros(0)

    def design(t: np.ndarray, more: np.ndarray | None) -> np.ndarray:
        x = piecewise_design(t, at, season, order)
        if growth == "flat":
            x = np.delete(x, np.s_[1 : 2 + len(at)], axis=1)
        return x if more is None else np.hstack([x, more])

    x = design(t, extra[0] if extra else None)
    pen = np.full(x.shape[1], ridge)
    pen[0] = 0
    if extra:
        pen[x.shape[1] - extra[0].shape[1] :] = extra_ridge
    w, coef = np.ones(n), np.zeros(x.shape[1])
    for _ in range(50 if huber else 1):
        fresh = np.linalg.solve((x * w[:, None]).T @ x + np.diag(pen + 1e-10), (x * w[:, None]).T @ y)
        moved, coef = np.abs(fresh - coef).max(), fresh
        if huber:
            res = np.abs(y - x @ coef)
            w = np.where(res <= huber, 1.0, huber / np.maximum(res, 1e-12))
            if moved < 1e-8:
                break
    out = design(np.arange(n, n + horizon, dtype=float), extra[1] if extra else None) @ coef
    return cap / (1 + np.exp(-out)) if growth == "logistic" else out


def interpolate(grid: np.ndarray, signal: np.ndarray, at: float) -> tuple[float, float]:
    """The reference signal and its slope at an axis position, clamped to the reference's range."""
    at = float(np.clip(at, grid[0], grid[-1]))
    k = int(np.clip(np.searchsorted(grid, at) - 1, 0, len(grid) - 2))
    slope = (signal[k + 1] - signal[k]) / (grid[k + 1] - grid[k])
    return float(signal[k] + slope * (at - grid[k])), float(slope)


def sequence_filter(position: np.ndarray, y: np.ndarray, grid: np.ndarray, signal: np.ndarray, start: tuple[float, float], noise: float = 1.0, drift: tuple[float, float] = (1e-3, 1e-4), smooth: bool = True) -> np.ndarray:
    """Axis positions by an extended Kalman filter whose state (axis, rate) moves with the position's gaps and is
    measured through the reference signal; a missing value isn't assimilated; smoothed backwards on request."""
    x, cov = np.array(start, float), np.eye(2)
    states, covs, priors, moves = [x], [cov], [cov], [np.eye(2)]
    for k in range(1, len(y)):
        f = np.array([[1.0, position[k] - position[k - 1]], [0.0, 1.0]])
        x = f @ x
        x[0] = np.clip(x[0], grid[0], grid[-1])
        prior = cov = f @ cov @ f.T + np.diag(drift)
        if not np.isnan(y[k]):
            value, slope = interpolate(grid, signal, x[0])
            h = np.array([slope, 0.0])
            gain = cov @ h / (h @ cov @ h + noise)
            keep = np.eye(2) - np.outer(gain, h)
            x = x + gain * (y[k] - value)
            x[0] = np.clip(x[0], grid[0], grid[-1])
            cov = keep @ cov @ keep.T + np.outer(gain, gain) * noise
        states.append(x)
        covs.append(cov)
        priors.append(prior)
        moves.append(f)
    if smooth:
        for k in range(len(y) - 2, -1, -1):
            c = covs[k] @ moves[k + 1].T @ np.linalg.pinv(priors[k + 1])
            states[k] = states[k] + c @ (states[k + 1] - moves[k + 1] @ states[k])
            states[k][0] = np.clip(states[k][0], grid[0], grid[-1])
    return np.array([s[0] for s in states])


def viterbi(y: np.ndarray, signal: np.ndarray, noise: float = 1.0, step: float = 1.0) -> np.ndarray:
    """The likeliest path of reference states: Gaussian errors, and a cost of (state change / step)^2 / 2."""
    m = len(signal)
    move = -0.5 * ((np.arange(m)[:, None] - np.arange(m)[None]) / step) ** 2
    emit = lambda v: np.zeros(m) if np.isnan(v) else -0.5 * ((v - signal) / noise) ** 2
    best, back = emit(y[0]), []
    for v in y[1:]:
        scores = best[:, None] + move
        back.append(scores.argmax(0))
        best = scores.max(0) + emit(v)
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def posterior_mean(y: np.ndarray, axis: np.ndarray, signal: np.ndarray, noise: float = 1.0, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Each value's mean axis position and signal over all reference paths, by forward and backward sums of ``viterbi``'s
    costs; a missing value says nothing."""
    m = len(signal)
    move = np.exp(-0.5 * ((np.arange(m)[:, None] - np.arange(m)[None]) / step) ** 2)
    emit = lambda v: np.ones(m) if np.isnan(v) else np.exp(-0.5 * (((v - signal) / noise) ** 2 - (((v - signal) / noise) ** 2).min()))
    forward, backward = [emit(y[0])], [np.ones(m)]
    for v in y[1:]:
        now = (forward[-1] / forward[-1].sum()) @ move * emit(v)
        forward.append(now)
    for v in y[:0:-1]:
        now = move @ (backward[-1] / backward[-1].sum() * emit(v))
        backward.append(now)
    p = np.array(forward) * np.array(backward[::-1])
    p /= p.sum(1, keepdims=True)
    return p @ axis, p @ signal


def unscented_filter(position: np.ndarray, y: np.ndarray, grid: np.ndarray, signal: np.ndarray, start: tuple[float, float], noise: float = 1.0, drift: tuple[float, float] = (1e-3, 1e-4), spread: tuple[float, float, float] = (1.0, 0.0, 1.0)) -> np.ndarray:
    """Axis positions as ``sequence_filter``'s without smoothing, but measured at five sigma points instead of by the
    signal's slope; ``spread`` is (alpha, beta, kappa)."""
    alpha, beta, kappa = spread
    x, cov, out = np.array(start, float), np.eye(2), [float(start[0])]
    lam = alpha * alpha * (2 + kappa) - 2
    w = np.full(5, 1 / (2 * (2 + lam)))
    wm, wc = w.copy(), w.copy()
    wm[0], wc[0] = lam / (2 + lam), lam / (2 + lam) + 1 - alpha * alpha + beta
    for k in range(1, len(y)):
        f = np.array([[1.0, position[k] - position[k - 1]], [0.0, 1.0]])
        x, cov = f @ x, f @ cov @ f.T + np.diag(drift)
        x[0] = np.clip(x[0], grid[0], grid[-1])
        if not np.isnan(y[k]):
            root = np.linalg.cholesky((2 + lam) * cov + 1e-12 * np.eye(2))
            points = np.vstack([x, x + root.T, x - root.T])
            z = np.array([interpolate(grid, signal, p[0])[0] for p in points])
            mean = wm @ z
            var = wc @ (z - mean) ** 2 + noise
            gain = ((points - x).T * wc) @ (z - mean) / var
            x = x + gain * (y[k] - mean)
            x[0] = np.clip(x[0], grid[0], grid[-1])
            cov = cov - np.outer(gain, gain) * var
        out.append(float(x[0]))
    return np.array(out)
