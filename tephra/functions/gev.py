"""Generalized extreme value distribution: closed forms as columns, and a numpy kernel for maximum likelihood.

Shape convention: c = -xi, so that quantiles are loc + scale (1 - (-ln q)^c) / c, and the Gumbel limit at c = 0.
Fits start from probability-weighted moments (Hosking, Wallis and Wood 1985) and go through Nelder-Mead simplexes (1965),
many of them at once in the same numpy calls, so that hundreds of bootstrap replicates cost little more than one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = 1e-8
_EULER = 0.5772156649015329


def return_level(c: Column, loc: Column, scale: Column, period: Column) -> Column:
    """The level that is exceeded once in ``period`` blocks on average."""
    y = -F.log(1 - 1 / period)
    return F.when(F.abs(c) < _SMALL, loc - scale * F.log(y)).otherwise(loc + scale * (1 - F.pow(y, c)) / c)


def exceedance(c: Column, loc: Column, scale: Column, value: Column) -> Column:
    """Probability of a block maximum above ``value``: 1 above an upper bound's CDF of 1 and below a lower bound's of 0."""
    z = (value - loc) / scale
    inside = 1 - c * z
    t = F.when(F.abs(c) < _SMALL, F.exp(-z)).when(inside > 0, F.pow(inside, 1 / c))
    return F.when(t.isNotNull(), 1 - F.exp(-t)).otherwise(F.when(c > 0, 0.0).otherwise(1.0))


def return_period(c: Column, loc: Column, scale: Column, value: Column) -> Column:
    """Blocks between maxima above ``value`` on average; infinity where there are none."""
    p = exceedance(c, loc, scale, value)
    return F.when(p <= 0, float("inf")).otherwise(1 / p)


def quantile(q, c, loc, scale):
    """Level below which a share q lies; all arguments may be arrays."""
    y = -np.log(q)
    shape = np.where(np.abs(c) < _SMALL, 1.0, c)
    return np.where(np.abs(c) < _SMALL, loc - scale * np.log(y), loc + scale * (1 - y**shape) / shape)


def negative_log_likelihood(y: np.ndarray, c: np.ndarray, loc: np.ndarray, log_scale: np.ndarray) -> np.ndarray:
    """Of each row of ``y`` under its own shape, location (one, or one for each value) and log scale; infinity off the support."""
    loc = loc if loc.ndim == 2 else loc[:, None]
    n = y.shape[1]
    with np.errstate(all="ignore"):
        z = (y - loc) * np.exp(-log_scale)[:, None]
        gumbel = np.abs(c) < _SMALL
        shape = np.where(gumbel, 1.0, c)[:, None]
        inside = np.where(gumbel[:, None], 1.0, 1 - shape * z)
        bad = (log_scale > 700) | (inside.min(axis=1) <= 0)
        log = np.log(np.where(inside > 0, inside, 1.0))
        power = log / shape
        bad |= power.max(axis=1) > 700
        total = log_scale * n - (1 / shape[:, 0] - 1) * log.sum(axis=1) + np.exp(np.minimum(power, 701)).sum(axis=1)
        if gumbel.any():
            total = np.where(gumbel, log_scale * n + z.sum(axis=1) + np.exp(-np.maximum(z, -700)).sum(axis=1), total)
    return np.where(bad | ~np.isfinite(total), np.inf, total)


def moments_start(y: np.ndarray) -> tuple[float, float, float]:
    """Shape, location and scale from probability-weighted moments."""
    x = np.sort(np.asarray(y, float))
    n = len(x)
    i = np.arange(1, n + 1)
    b0 = x.mean()
    b1 = ((i - 1) * x).sum() / (n * max(n - 1, 1))
    b2 = ((i - 1) * (i - 2) * x).sum() / (n * max((n - 1) * (n - 2), 1))
    spread = 2 * b1 - b0
    if spread <= 0:
        return 0.0, float(b0), max(float(x.std()), 1e-6 * max(abs(b0), 1.0))
    skew = spread / (3 * b2 - b0) if 3 * b2 != b0 else 0.5
    t = skew - math.log(2) / math.log(3)
    c = float(np.clip(7.8590 * t + 2.9554 * t * t, -0.9, 0.9))
    if abs(c) < 1e-4:
        scale = spread / math.log(2)
        return 0.0, float(b0 - _EULER * scale), float(scale)
    gamma = math.gamma(1 + c)
    scale = spread * c / (gamma * (1 - 2.0**-c))
    return c, float(b0 - scale * (1 - gamma) / c), float(abs(scale))


def simplexes(
    f, start: np.ndarray, step: np.ndarray, x_tol: float = 1e-7, f_tol: float = 1e-10, most: int = 5000
) -> tuple[np.ndarray, np.ndarray]:
    """Nelder-Mead minima of many problems at once: one simplex for each row of ``start``, all moved in the same numpy calls.

    ``f`` takes points and the row of the problem that each belongs to. What a simplex does depends on its own problem alone.
    """
    many, n = start.shape
    points = np.repeat(start[:, None, :], n + 1, axis=1)
    points[:, np.arange(1, n + 1), np.arange(n)] += step
    values = f(points.reshape(-1, n), np.repeat(np.arange(many), n + 1)).reshape(many, n + 1)
    live = np.arange(many)
    for _ in range(most):
        p, v = points[live], values[live]
        order = np.argsort(v, axis=1, kind="stable")
        p, v = np.take_along_axis(p, order[:, :, None], axis=1), np.take_along_axis(v, order, axis=1)
        points[live], values[live] = p, v
        with np.errstate(invalid="ignore"):
            flat = (v[:, -1] - v[:, 0] <= f_tol) | ~np.isfinite(v[:, 0])
        moving = ~(flat & (np.abs(p[:, 1:] - p[:, :1]).max(axis=(1, 2)) <= x_tol))
        live, p, v = live[moving], p[moving], v[moving]
        if not len(live):
            break
        center = p[:, :-1].mean(axis=1)
        away = center - p[:, -1]
        tried = center + away
        value = f(tried, live)
        new, got = tried.copy(), value.copy()
        grow = np.flatnonzero(value < v[:, 0])
        if len(grow):
            further = center[grow] + 2 * away[grow]
            best = f(further, live[grow])
            better = best < value[grow]
            new[grow[better]], got[grow[better]] = further[better], best[better]
        shrink = np.zeros(0, np.int64)
        near = np.flatnonzero(value >= v[:, -2])
        near = near[value[near] >= v[near, 0]]
        if len(near):
            half = np.where(value[near] < v[near, -1], 0.5, -0.5)
            closer = center[near] + half[:, None] * away[near]
            best = f(closer, live[near])
            better = best < np.minimum(value[near], v[near, -1])
            new[near[better]], got[near[better]] = closer[better], best[better]
            shrink = near[~better]
        stay = np.ones(len(live), bool)
        stay[shrink] = False
        p[stay, -1], v[stay, -1] = new[stay], got[stay]
        if len(shrink):
            p[shrink, 1:] = p[shrink, :1] + 0.5 * (p[shrink, 1:] - p[shrink, :1])
            v[shrink, 1:] = f(p[shrink, 1:].reshape(-1, n), np.repeat(live[shrink], n)).reshape(-1, n)
        points[live], values[live] = p, v
    at = values.argmin(axis=1)
    return points[np.arange(many), at], values[np.arange(many), at]


def _bounded(value: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(np.abs(c) < 1, value, np.inf)


def fits(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape, location, scale and log-likelihood of the stationary fit of each row; |c| < 1.

    Each starts at its moments; one whose moments lie off the support starts from fixed shapes, and the best counts.
    """
    y = np.asarray(samples, float)
    c, loc, scale = (np.array(x) for x in zip(*(moments_start(row) for row in y)))
    spread = np.maximum(y.std(axis=1), 1e-6)
    log_scale = np.log(np.maximum(scale, 1e-9))
    point = np.column_stack([c, loc, log_scale])
    value = np.full(len(y), np.inf)

    def objective(p, who):
        return _bounded(negative_log_likelihood(y[who], p[:, 0], p[:, 1], p[:, 2]), p[:, 0])

    todo = np.arange(len(y))
    for shape in (c, np.zeros(len(y)), np.full(len(y), 0.1), np.full(len(y), -0.1)):
        start = np.column_stack([shape, loc, log_scale])[todo]
        can = np.isfinite(objective(start, todo))
        who = todo[can]
        if len(who):
            step = np.column_stack([np.full(len(who), 0.05), 0.1 * spread[who], np.full(len(who), 0.1)])
            found, least = simplexes(lambda p, k, who=who: objective(p, who[k]), start[can], step)
            better = least < value[who] - 1e-9
            point[who[better]], value[who[better]] = found[better], least[better]
        if shape is c:
            todo = todo[~can]
        if not len(todo):
            break
    known = np.isfinite(value)
    return point[:, 0], point[:, 1], np.where(known, np.exp(point[:, 2]), scale), -value


def fit(y: np.ndarray) -> tuple[float, float, float, float]:
    """:func:`fits` of one sample."""
    return tuple(float(x[0]) for x in fits(np.asarray(y, float)[None, :]))


def trend_fits(samples: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((c, location at x = 0, slope, ln scale), log-likelihood) of each row: the location drifts with the centred covariate x.

    All start from ``start``, one point or one for each row.
    """
    y = np.asarray(samples, float)
    spread = np.maximum(y.std(axis=1), 1e-6)
    reach = max(float(np.abs(x).max()) if len(x) else 1.0, 1.0)

    def objective(p, who):
        return _bounded(negative_log_likelihood(y[who], p[:, 0], p[:, 1:2] + p[:, 2:3] * x, p[:, 3]), p[:, 0])

    step = np.column_stack([np.full(len(y), 0.05), 0.1 * spread, 0.1 * spread / reach, np.full(len(y), 0.1)])
    point, value = simplexes(objective, np.broadcast_to(np.asarray(start, float), (len(y), 4)).copy(), step)
    return point, -value


def fit_trend(y: np.ndarray, covariate: np.ndarray, stationary=None) -> dict:
    """Drifting-location fit and its likelihood-ratio test against the stationary one (chi-squared, one degree)."""
    y, x = np.asarray(y, float), np.asarray(covariate, float)
    if y.size != x.size:
        raise ValueError(f"{y.size} maxima and {x.size} covariates")
    mean = float(x.mean())
    c, loc, scale, likelihood = stationary or fit(y)
    found, likelihoods = trend_fits(y[None, :], x - mean, [c, loc, 0.0, math.log(scale)])
    (tc, mu0, slope, log_scale), drifting = found[0], float(likelihoods[0])
    ratio = max(0.0, 2 * (drifting - likelihood)) if math.isfinite(likelihood) else 0.0
    return {
        "c": float(tc), "mu0": float(mu0), "slope": float(slope), "sigma": float(math.exp(log_scale)), "x_mean": mean,
        "lr_statistic": ratio, "p_value": math.erfc(math.sqrt(ratio / 2))
    }


def draws(c: float, loc, scale: float, n: int, seed) -> np.ndarray:
    """n draws by inversion; ``seed`` is a sequence of ints, one stream for each replicate."""
    u = np.random.default_rng(np.random.SeedSequence(list(seed))).uniform(1e-12, 1 - 1e-12, n)
    return quantile(u, c, loc, scale)
