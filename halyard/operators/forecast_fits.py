"""Numerics of one series, called inside grouped Spark tasks: the MAP fit with
sparse changepoints (I8) and the seasonal ARIMA with chosen differencing (I10).
A series has one value a day, so its length is bounded by its dates.
"""

from __future__ import annotations

import math

import numpy as np

# ------------------------------------------------------- sparse changepoints
#: Rounds of (coefficients, noise), sweeps of the coordinate descent, and its tolerance.
OUTER, SWEEPS, CLOSE = 12, 4000, 1e-9
LEAST_NOISE = 1e-4


def laplace_map(x: np.ndarray, y: np.ndarray, sparse: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, noise) that maximise the posterior of y = x b + noise.

    Columns with `sparse` have a Laplace prior of their scale, the others a
    normal one; an infinite scale is no prior. Given the noise, the normal part
    is eliminated exactly and coordinate descent solves for the sparse part,
    where soft thresholding leaves exact zeros; then the noise follows from the
    residuals."""
    gram, moment = x.T @ x, x.T @ y
    dense = ~sparse
    noise = max(float(np.std(y)), LEAST_NOISE)
    delta = np.zeros(int(sparse.sum()))
    coef = np.zeros(x.shape[1])
    for _ in range(OUTER):
        v = noise * noise
        inner = gram[np.ix_(dense, dense)] + np.diag(v / scales[dense] ** 2) + 1e-9 * np.eye(int(dense.sum()))
        cross = gram[np.ix_(dense, sparse)]
        solved = np.linalg.solve(inner, np.column_stack([cross, moment[dense]]))
        left, own = solved[:, :-1], solved[:, -1]
        g = gram[np.ix_(sparse, sparse)] - cross.T @ left
        m = moment[sparse] - cross.T @ own
        delta = _soft_descent(g, m, v / scales[sparse], delta)
        coef[sparse], coef[dense] = delta, own - left @ delta
        now = max(float(np.sqrt(np.mean((y - x @ coef) ** 2))), LEAST_NOISE)
        if abs(now - noise) <= 1e-5 * noise:
            break
        noise = now
    return coef, noise


def _soft_descent(g: np.ndarray, m: np.ndarray, cost: np.ndarray, start: np.ndarray) -> np.ndarray:
    """argmin of b'gb/2 - m'b + cost'|b|, one coordinate after the other."""
    b, push = start.copy(), m - g @ start
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(b)):
            if g[j, j] <= 1e-12:
                continue
            z = push[j] + g[j, j] * b[j]
            new = math.copysign(max(abs(z) - cost[j], 0.0), z) / g[j, j]
            step = new - b[j]
            if step:
                push -= g[:, j] * step
                b[j] = new
                most = max(most, abs(step))
        if most < CLOSE:
            break
    return b


def trend_spread(delta: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Standard deviation of the trend so far `ahead` of the history (in units
    of its span), if changes go on as often and as strongly as they did."""
    size = float(np.mean(np.abs(delta))) if len(delta) else 0.0
    return np.sqrt(len(delta) * 2 * size**2 * np.maximum(ahead, 0.0) ** 3 / 3)


# ----------------------------------------------------------- seasonal ARIMA
SEASON, LONG_AR = 7, 21
MAX_ORDER = {"p": 3, "q": 3, "P": 2, "Q": 2}
MAX_D = 2
#: 5 % point of the level-stationarity statistic, and the seasonal strength from which a season is differenced.
KPSS_5, STRONG = 0.463, 0.64
#: Weeks over which a weekday's level is smoothed.
WEEKS = 5
START = ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))


def kpss(y: np.ndarray) -> float:
    """Statistic of the hypothesis that y varies about a constant level, with
    a Bartlett window of 3 sqrt(n) / 13 lags."""
    n = len(y)
    e = y - y.mean()
    lags = int(3 * math.sqrt(n) / 13)
    long_run = float(e @ e) / n + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return float(np.sum(np.cumsum(e) ** 2)) / (n * n * long_run) if long_run > 1e-12 else 0.0


def seasonal_strength(y: np.ndarray, season: int = SEASON) -> float:
    """1 - var(rest) / var(season + rest), both without the trend; weekday
    levels may move, as each is smoothed over WEEKS weeks."""
    n = len(y)
    if n < 3 * season:
        return 0.0
    half = season // 2
    trend = np.convolve(np.pad(y, half, mode="edge"), np.ones(season) / season, "valid")
    rest = y - trend
    level = np.empty(n)
    for k in range(season):
        own = rest[k::season]
        w = min(WEEKS, len(own))
        ones = np.ones(w)
        level[k::season] = np.convolve(own, ones, "same") / np.convolve(np.ones(len(own)), ones, "same")
    whole = float(np.var(rest))
    return max(0.0, 1 - float(np.var(rest - level)) / whole) if whole > 1e-12 else 0.0


def differencing(y: np.ndarray) -> tuple[int, int]:
    """(d, D): a season that is strong is differenced once, then the series as
    long as it isn't level."""
    seasonal = int(seasonal_strength(y) > STRONG and len(y) > 5 * SEASON)
    z = y[SEASON:] - y[:-SEASON] if seasonal else y
    d = 0
    while d < MAX_D - seasonal and len(z) > 20 and kpss(z) > KPSS_5:
        z, d = np.diff(z), d + 1
    return d, seasonal


def difference(y: np.ndarray, d: int, seasonal: int) -> np.ndarray:
    for _ in range(seasonal):
        y = y[SEASON:] - y[:-SEASON]
    return np.diff(y, n=d) if d else y


def _fit_arma(z: np.ndarray, order: tuple[int, int, int, int], constant: bool) -> dict:
    """Hannan-Rissanen: residuals of a long autoregression, then least squares
    on lags of both."""
    n, (p, q, seasonal_p, seasonal_q) = len(z), order
    long = min(LONG_AR, max(1, n // 4))
    if n <= long + 10:
        raise ValueError("series too short")
    past = np.column_stack([np.ones(n - long), *[z[long - k : n - k] for k in range(1, long + 1)]])
    first, *_ = np.linalg.lstsq(past, z[long:], rcond=None)
    e = np.concatenate([np.zeros(long), z[long:] - past @ first])
    ar = [*range(1, p + 1), *[SEASON * k for k in range(1, seasonal_p + 1)]]
    ma = [*range(1, q + 1), *[SEASON * k for k in range(1, seasonal_q + 1)]]
    rows = np.arange(max([*ar, *ma, long]), n)
    columns = [np.ones(len(rows))] * constant + [z[rows - a] for a in ar] + [e[rows - b] for b in ma]
    if len(rows) <= len(columns) + 2:
        raise ValueError("series too short")
    x = np.column_stack(columns) if columns else np.empty((len(rows), 0))
    beta = np.linalg.lstsq(x, z[rows], rcond=None)[0] if columns else np.empty(0)
    s2 = float(np.mean((z[rows] - x @ beta) ** 2))
    c = int(constant)
    return {"c": beta[0] if c else 0.0, "ar": dict(zip(ar, beta[c : c + len(ar)])), "ma": dict(zip(ma, beta[c + len(ar) :])), "s2": s2,
            "aic": len(rows) * math.log(max(s2, 1e-12)) + 2 * (x.shape[1] + 1), "e": e, "order": order}


def stepwise(z: np.ndarray, constant: bool) -> tuple[dict, int]:
    """(best fit by AIC, orders tried): from four starts to the best
    neighbour, until none is better."""
    tried: dict[tuple, dict | None] = {}

    def fit(order):
        if order not in tried:
            try:
                tried[order] = _fit_arma(z, order, constant)
            except (ValueError, np.linalg.LinAlgError):
                tried[order] = None
        return tried[order]

    found = [f for f in map(fit, START) if f]
    if not found:
        raise ValueError("no order fits")
    best = min(found, key=lambda f: f["aic"])
    while True:
        p, q, sp, sq = best["order"]
        moves = [(a, b, 0, 0) for a in (-1, 0, 1) for b in (-1, 0, 1)] + [(0, 0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        near = [(p + a, q + b, sp + c, sq + d) for a, b, c, d in moves]
        near = [o for o in near if all(0 <= v <= m for v, m in zip(o, MAX_ORDER.values()))]
        better = min((f for f in map(fit, near) if f), key=lambda f: f["aic"])
        if better["aic"] >= best["aic"] - 1e-9:
            return best, len(tried)
        best = better


def arima(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray, str]:
    """(forecast, standard errors, order): differencing by test, orders by
    stepwise AIC. With the lag polynomial of all differences and
    autoregressions the forecast runs on y itself, and so do the psi weights."""
    d, seasonal = differencing(y)
    z = difference(y, d, seasonal)
    best, _ = stepwise(z, constant=d + seasonal < 2)
    lag = np.zeros(max([0, *best["ar"]]) + 1)
    lag[0] = 1.0
    for k, v in best["ar"].items():
        lag[k] -= v
    for _ in range(d):
        lag = np.convolve(lag, [1.0, -1.0])
    for _ in range(seasonal):
        lag = np.convolve(lag, [1.0, *[0.0] * (SEASON - 1), -1.0])
    values, shocks = list(y), [0.0] * (len(y) - len(z)) + list(best["e"])
    for _ in range(horizon):
        values.append(best["c"] - sum(v * values[-k] for k, v in enumerate(lag) if k) + sum(v * shocks[-k] for k, v in best["ma"].items()))
        shocks.append(0.0)
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = (1.0 if j == 0 else best["ma"].get(j, 0.0)) - sum(lag[k] * psi[j - k] for k in range(1, min(j, len(lag) - 1) + 1))
    p, q, sp, sq = best["order"]
    forecast = np.array(values[len(y) :])
    if not np.isfinite(forecast).all():
        raise ValueError("unstable fit")
    return forecast, np.sqrt(best["s2"] * np.cumsum(psi**2)), f"({p},{d},{q})({sp},{seasonal},{sq}){SEASON}"
