"""Special functions over numpy arrays: gamma and beta families, the normal integral, and root finding."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_TINY = 1e-300


def gammaln(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def erfc(x) -> np.ndarray:
    return np.asarray(_erfc(np.asarray(x, float)), float)


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x)."""
    return _gamma_both(a, x)[0]


def gammaincc(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x)."""
    return _gamma_both(a, x)[1]


def _gamma_both(a, x):
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    shape, a, x = a.shape, a.ravel().copy(), x.ravel().copy()
    p, q = np.full(a.size, np.nan), np.full(a.size, np.nan)
    ok = (a > 0) & (x >= 0)
    zero, inf = ok & (x == 0), ok & np.isinf(x)
    p[zero], q[zero], p[inf], q[inf] = 0.0, 1.0, 1.0, 0.0
    low = ok & ~zero & ~inf & (x < a + 1)
    high = ok & ~zero & ~inf & ~low
    if low.any():
        b, y = a[low], x[low]
        term = 1 / b
        total, n = term.copy(), b.copy()
        for _ in range(100_000):
            n += 1
            term = term * y / n
            total += term
            if (term < total * 1e-17).all():
                break
        p[low] = total * np.exp(b * np.log(y) - y - gammaln(b))
        q[low] = 1 - p[low]
    if high.any():
        b, y = a[high], x[high]
        d = y + 1 - b
        c, d = np.full(b.size, 1 / _TINY), 1 / d
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - b)
            base = y + 1 - b + 2 * i
            d = an * d + base
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = base + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h *= step
            if (np.abs(step - 1) < 1e-16).all():
                break
        q[high] = h * np.exp(b * np.log(y) - y - gammaln(b))
        p[high] = 1 - q[high]
    return p.reshape(shape), q.reshape(shape)


def betaln(a, b):
    return gammaln(a) + gammaln(b) - gammaln(np.asarray(a, float) + np.asarray(b, float))


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    shape, a, b, x = a.shape, a.ravel(), b.ravel(), x.ravel()
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    out[np.isnan(x) | ~(a > 0) | ~(b > 0)] = np.nan
    todo = np.flatnonzero((x > 0) & (x < 1) & (a > 0) & (b > 0))
    if todo.size:
        p, q, y = a[todo], b[todo], x[todo]
        turned = y > (p + 1) / (p + q + 2)
        p, q, y = np.where(turned, q, p), np.where(turned, p, q), np.where(turned, 1 - y, y)
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - betaln(p, q)) / p
        c = np.ones(todo.size)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        for m in range(1, 20_000):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                step = c * d
                h *= step
            if (np.abs(step - 1) < 1e-15).all():
                break
        found = front * h
        out[todo] = np.where(turned, 1 - found, found)
    return out.reshape(shape)


def norm_cdf(z):
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p) -> np.ndarray:
    """Quantile of the standard normal distribution."""
    p = np.asarray(p, float)
    lo = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        t = np.sqrt(-2 * np.log(np.where(lo > 0, lo, 0.5)))
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
        for _ in range(4):  # Halley steps on the upper tail
            e = 0.5 * erfc(z / math.sqrt(2)) - lo
            u = -e * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
            z = z - u / (1 + z * u / 2)
        z = np.where(p < 0.5, -z, z)
    return np.where((p < 0) | (p > 1) | np.isnan(p), np.nan, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.where(p == 0.5, 0.0, z))))


def bisect(f, p, lo, hi, steps: int = 200) -> np.ndarray:
    """x with f(x) = p, for increasing f, between lo and hi (which may be infinite)."""
    p = np.asarray(p, float)
    lo, hi = (np.broadcast_to(np.asarray(v, float), p.shape).copy() for v in (lo, hi))
    low, high = np.isinf(lo), np.isinf(hi)
    a = np.where(low, np.where(high, -1.0, hi - 1), lo)
    b = np.where(high, np.where(low, 1.0, lo + 1), hi)
    for _ in range(1100):
        grow = high & (f(b) < p)
        if not grow.any():
            break
        b = np.where(grow, b + 2 * np.maximum(1e-3, np.abs(b - np.where(low, 0, lo))), b)
    for _ in range(1100):
        grow = low & (f(a) > p)
        if not grow.any():
            break
        a = np.where(grow, a - 2 * np.maximum(1e-3, np.abs(a)), a)
    for _ in range(steps):
        m = (a + b) / 2
        if ((m == a) | (m == b)).all():
            break
        less = f(m) < p
        a, b = np.where(less, m, a), np.where(less, b, m)
    return (a + b) / 2
