"""Tail probabilities for model tables, in numpy.

These run on aggregated rows (a model table has tens of rows), never on data cells.
"""

from __future__ import annotations

import functools
import math

import numpy as np


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral, modified Lentz evaluation; places that have settled are left out
    of further terms."""
    floor = 1e-300
    out, (a, b, x) = np.empty(x.shape), (np.ravel(v) for v in (a, b, x))
    flat, place = out.reshape(-1), np.arange(x.size)
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < floor, floor, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < floor, floor, d)
            c = 1 + term / np.where(np.abs(c) < floor, floor, c)
            step = c * d
            h = h * step
        going = ~(np.abs(step - 1) < 1e-15)
        if m % 8 == 0 or not going.any():
            flat[place[~going]] = h[~going]
            place, a, b, x, c, d, h = (v[going] for v in (place, a, b, x, c, d, h))
            if not place.size:
                break
    flat[place] = h
    return out


def log_beta_scale(a, b) -> np.ndarray:
    """Logarithm of the factor of a beta density."""
    return _lgamma(a + b) - _lgamma(a) - _lgamma(b)


def beta_quantile(p, a, b) -> np.ndarray:
    """x with I_x(a, b) = p: Halley steps on the log odds of both, kept inside a bracket that every step narrows."""
    p, a, b = np.broadcast_arrays(np.clip(np.asarray(p, float), 0.0, 1.0), np.asarray(a, float), np.asarray(b, float))
    out = p.copy()
    place = np.flatnonzero((p > 0) & (p < 1))
    p, a, b = p.flat[place], a.flat[place], b.flat[place]
    # The far lower part matters for shapes well below one, whose mass sits next to zero.
    lo, hi = np.full(p.shape, -690.0), np.full(p.shape, 37.0)
    odds, scale, z = np.log(p) - np.log1p(-p), log_beta_scale(a, b), np.clip(np.log(a / b), -600, 36)
    while place.size:
        x = 1 / (1 + np.exp(-z))
        cdf = beta_cdf(x, a, b, scale)
        lo, hi = np.where(cdf < p, z, lo), np.where(cdf < p, hi, z)
        with np.errstate(all="ignore"):
            gap = np.log(cdf) - np.log1p(-cdf) - odds
            slope = np.exp(scale + a * np.log(x) - b * np.logaddexp(0, z)) / (cdf * (1 - cdf))
            step = gap / slope
            bend = a - (a + b) * x - slope * (1 - 2 * cdf)
            better = z - step / np.maximum(1 - step * bend / 2, 0.5)
        inside = (better > lo) & (better < hi)
        # The error after a step goes with the cube of the one before it.
        near = np.abs(gap) < 1e-5
        z = np.where(inside, better, np.where(near, z, (lo + hi) / 2))
        out.flat[place] = 1 / (1 + np.exp(-z))
        going = ~near & (hi - lo > 4e-16 * np.abs(z))
        place, p, a, b, lo, hi, odds, scale, z = (v[going] for v in (place, p, a, b, lo, hi, odds, scale, z))
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_cdf(x, a, b, scale=None) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); ``scale`` is the logarithm of its factor, where it is at hand."""
    x, a, b = (np.asarray(v, float) for v in (x, a, b))
    x, a, b, norm = np.broadcast_arrays(x, a, b, log_beta_scale(a, b) if scale is None else scale)
    inside = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(norm + a * np.log(inside) + b * np.log1p(-inside))
        flip = inside > (a + 1) / (a + b + 2)
        p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
        part = front * _beta_fraction(p, q, y) / p
    out = np.where(flip, 1 - part, part)
    return np.where(inside <= 0, 0.0, np.where(inside >= 1, 1.0, out))


def f_sf(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f = np.asarray(f, float)
    return beta_cdf(df2 / (df2 + df1 * f), np.asarray(df2, float) / 2, np.asarray(df1, float) / 2)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided P(|T| > |t|)."""
    return f_sf(np.square(np.asarray(t, float)), 1.0, df)


def gamma_sf(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x): the series below the mean, the continued fraction above it.
    The number of steps goes with the root of a."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    out = np.ones(a.shape)
    steps = int(60 + 12 * math.sqrt(float(a.max()))) if a.size else 0
    low, high = (x > 0) & (x < a + 1), x >= a + 1
    if low.any():
        p, y = a[low], x[low]
        term = total = 1 / p
        for n in range(1, steps):
            term = term * y / (p + n)
            total = total + term
        out[low] = 1 - np.exp(p * np.log(y) - y - _lgamma(p)) * total
    if high.any():
        p, y = a[high], x[high]
        b = y + 1 - p
        c, d = np.full(p.shape, 1e300), 1 / b
        h = d
        for n in range(1, steps):
            an = n * (p - n)
            b = b + 2
            d = 1 / np.where(np.abs(b + an * d) < 1e-300, 1e-300, b + an * d)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
        out[high] = np.exp(p * np.log(y) - y - _lgamma(p)) * h
    return np.where(np.isnan(a) | np.isnan(x), np.nan, np.clip(out, 0.0, 1.0))


def chi2_sf(x, df) -> np.ndarray:
    """P(chi-squared > x), for any positive degrees of freedom."""
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_pdf(x) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


_STEP = 0.01
_GRID = np.arange(-900, 901) * _STEP
_GRID_CDF = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID])


def normal_cdf(x) -> np.ndarray:
    """Standard normal distribution function: third-order expansion around the nearest point of a
    table, good to about 1e-11 (``hazard`` keeps relative precision in the far lower tail)."""
    x = np.clip(np.asarray(x, float), -9.0, 9.0)
    at = np.rint(x / _STEP).astype(int) + 900
    z = _GRID[at]
    d = x - z
    return _GRID_CDF[at] + normal_pdf(z) * d * (1 - z * d / 2 + (z * z - 1) * d * d / 6)


def hazard(t) -> np.ndarray:
    """pdf(t) / cdf(t), stable far into the lower tail."""
    t = np.asarray(t, float)
    x = np.maximum(-t, 3.0)
    fraction = x + 60.0
    for k in range(60, 0, -1):
        fraction = x + k / fraction
    near = np.maximum(t, -3.0)
    return np.where(t < -3, fraction, normal_pdf(near) / normal_cdf(near))


def digamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    shift = 0.0
    while x < 10:
        shift += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def trigamma_inverse(v: float) -> float:
    """x with trigamma(x) = v, by bisection on the logarithm (trigamma falls)."""
    lo, hi = -20.0, 20.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if trigamma(math.exp(mid)) > v else (lo, mid)
    return math.exp(0.5 * (lo + hi))


_nodes = functools.cache(np.polynomial.legendre.leggauss)


def _range_cdf_normal(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    nodes, weights = _nodes(96)
    z = 8.0 * nodes
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    spread = normal_cdf(z[None, :] + w[:, None]) - normal_cdf(z)[None, :]
    return np.clip(k * 8.0 * np.sum(weights * phi * spread ** (k - 1), axis=1), 0.0, 1.0)


def _chi_constant(df: float) -> float:
    """0.5 df log(df / 2) - lgamma(df / 2) - df / 2; by Stirling's series where the terms themselves are large."""
    x = df / 2
    if x < 100:
        return x * math.log(x) - math.lgamma(x) - x
    return 0.5 * math.log(x / (2 * math.pi)) - 1 / (12 * x) + 1 / (360 * x ** 3)


def tukey_cdf(q, k: int, df: float) -> np.ndarray:
    """P(studentised range of k means on df degrees of freedom <= q)."""
    q = np.atleast_1d(np.asarray(q, float))
    nodes, weights = _nodes(96)
    width = 10.0 / math.sqrt(2 * df)
    lo, hi = max(0.0, 1 - width), 1 + width
    if df < 4:
        hi = 12.0
    u = 0.5 * (hi - lo) * nodes + 0.5 * (hi + lo) - 1
    # Log density of s = 1 + u, arranged around s = 1 so that nothing large cancels, however many degrees of freedom.
    logd = math.log(2) + _chi_constant(df) + df * (np.log1p(u) - u - 0.5 * u * u) - np.log1p(u)
    dens = 0.5 * (hi - lo) * weights * np.exp(logd)
    inner = np.stack([_range_cdf_normal(q * (1 + ui), k) for ui in u])
    return np.clip(dens @ inner, 0.0, 1.0)


def tukey_quantile(p: float, k: int, df: float) -> float:
    """The studentised range value with cumulative probability p."""
    lo, hi = 0.0, 4.0
    f_lo, f_hi = -p, tukey_cdf(hi, k, df)[0] - p
    while f_hi < 0:
        lo, f_lo = hi, f_hi
        hi *= 2
        f_hi = tukey_cdf(hi, k, df)[0] - p
    # False position; the weight of an end that stays is halved so that both close in.
    side = 0
    for _ in range(100):
        at = (lo * f_hi - hi * f_lo) / (f_hi - f_lo)
        f = tukey_cdf(at, k, df)[0] - p
        if abs(f) < 1e-10 or hi - lo < 1e-10:
            return at
        if f < 0:
            lo, f_lo = at, f
            f_hi *= 0.5 if side < 0 else 1.0
            side = -1
        else:
            hi, f_hi = at, f
            f_lo *= 0.5 if side > 0 else 1.0
            side = 1
    return at
