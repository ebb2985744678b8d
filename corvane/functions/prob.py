"""Probability distributions: cdf, pdf or pmf, and quantile of 29 families.

Each is a function of columns or numbers and gives a double column. Closed forms are column expressions;
the rest are vectorised pandas functions. Outside of its support a cdf is 0 or 1 and a density 0; quantiles
of 0 and 1 are the ends of the support; bad parameters and probabilities raise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import special as S

INF = math.inf


def _poisson_weights(half: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a Poisson law of mean `half`, but for a tail of 1e-17."""
    spread = 12 * math.sqrt(half) + 40
    j = np.arange(max(0, int(half - spread)), int(half + spread) + 1)
    return j, np.exp(-half + (j * math.log(half) if half > 0 else np.where(j == 0, 0.0, -np.inf)) - S.gammaln(j + 1))


def _mixed(f):
    """Mixture over Poisson weights of ncp / 2, one parameter set at a time."""

    def g(x, *args):
        *rest, ncp = args
        x, ncp, *rest = np.broadcast_arrays(np.asarray(x, float), np.asarray(ncp, float), *[np.asarray(r, float) for r in rest])
        out = np.empty(x.shape)
        for i in np.ndindex(x.shape):
            j, w = _poisson_weights(ncp[i] / 2)
            out[i] = np.sum(w * f(x[i], j, *[r[i] for r in rest]))
        return out

    return g


def _beta_pdf(x, a, b):
    with np.errstate(all="ignore"):
        y = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - S.betaln(a, b))
        edge0 = np.where(a < 1, INF, np.where(a == 1, b * 1.0, 0.0))
        edge1 = np.where(b < 1, INF, np.where(b == 1, a * 1.0, 0.0))
    return np.where((x < 0) | (x > 1), 0.0, np.where(x == 0, edge0, np.where(x == 1, edge1, y)))


def _gamma_pdf(x, k, s):
    with np.errstate(all="ignore"):
        y = np.exp((k - 1) * np.log(x / s) - x / s - S.gammaln(k)) / s
        edge = np.where(k < 1, INF, np.where(k == 1, 1 / s, 0.0))
    return np.where(x < 0, 0.0, np.where(x == 0, edge, y))


def _t_cdf(x, df):
    with np.errstate(all="ignore"):
        tail = 0.5 * S.betainc(df / 2, 0.5, df / (df + x * x))
    tail = np.where(np.isinf(df), S.norm_cdf(-np.abs(x)), tail)
    return np.where(np.isinf(x), (x > 0) * 1.0, np.where(x > 0, 1 - tail, tail))


def _t_pdf(x, df):
    y = np.exp(S.gammaln((df + 1) / 2) - S.gammaln(df / 2) - (df + 1) / 2 * np.log1p(x * x / df)) / np.sqrt(df * math.pi)
    return np.where(np.isinf(x), 0.0, y)


def _f_cdf(x, m, n):
    x = np.maximum(x, 0)
    with np.errstate(all="ignore"):
        return np.where(np.isinf(x), 1.0, S.betainc(m / 2, n / 2, m * x / (m * x + n)))


def _f_pdf(x, m, n):
    with np.errstate(all="ignore"):
        y = np.exp(m / 2 * np.log(m / n) + (m / 2 - 1) * np.log(x) - (m + n) / 2 * np.log1p(m * x / n) - S.betaln(m / 2, n / 2))
    return np.where(x < 0, 0.0, np.where(x == 0, np.where(m < 2, INF, np.where(m == 2, 1.0, 0.0)), y))


def _ncx2_cdf(x, j, df):
    return S.gammainc(df / 2 + j, max(x, 0) / 2)


def _ncx2_pdf(x, j, df):
    return _gamma_pdf(x, df / 2 + j, 2.0)


def _ncb_cdf(x, j, a, b):
    return S.betainc(a + j, b * np.ones_like(a + j), x)


def _ncb_pdf(x, j, a, b):
    return _beta_pdf(x, a + j, b)


def _ncf_cdf(x, m, n, ncp):
    x = np.maximum(x, 0)
    return _mixed(_ncb_cdf)(m * x / (m * x + n), m / 2, n / 2, ncp)


def _ncf_pdf(x, m, n, ncp):
    y = m * x / (m * x + n)
    return np.where(x < 0, 0.0, _mixed(_ncb_pdf)(y, m / 2, n / 2, ncp) * m * n / (m * x + n) ** 2)


def _nct_cdf(x, df, delta):
    x, df, delta = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, df, delta)))
    out = np.empty(x.shape)
    for i in np.ndindex(x.shape):
        t, n, d = x[i], df[i], delta[i]
        flip = t < 0
        t, d = (-t, -d) if flip else (t, d)
        half = d * d / 2
        j, w = _poisson_weights(half)
        y = t * t / (n + t * t)
        with np.errstate(all="ignore"):
            second = np.sign(d) * np.exp(-half + (j + 0.5) * (math.log(half) if half else -np.inf) - S.gammaln(j + 1.5)) if d else np.zeros(len(j))
        total = S.norm_cdf(-d) + 0.5 * np.sum(w * S.betainc(j + 0.5, n / 2, y) + second * S.betainc(j + 1.0, n / 2, y))
        out[i] = 1 - total if flip else total
    return out


def _nct_pdf(x, df, delta):
    x, df, delta = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, df, delta)))
    zero = np.exp(S.gammaln((df + 1) / 2) - S.gammaln(df / 2) - delta * delta / 2) / np.sqrt(math.pi * df)
    with np.errstate(all="ignore"):
        y = df / x * (_nct_cdf(x * np.sqrt(1 + 2 / df), df + 2, delta) - _nct_cdf(x, df, delta))
    return np.where(np.abs(x) < 1e-9, zero, y)


def _kolmogorov_cdf(x):
    x = np.maximum(np.asarray(x, float), 0)
    i = np.arange(1, 101)[:, None]
    with np.errstate(all="ignore"):
        small = np.sqrt(2 * math.pi) / x * np.exp(-((2 * i - 1) ** 2) * math.pi**2 / (8 * x * x)).sum(axis=0)
        large = 1 - 2 * ((-1.0) ** (i - 1) * np.exp(-2 * i * i * x * x)).sum(axis=0)
    return np.where(x < 0.05, 0.0, np.where(x < 1, small, large))


def _hyper(x, r, n, N):
    """pmf: x of n draws are among the r marked ones of N."""
    lc = lambda a, b: S.gammaln(a + 1) - S.gammaln(b + 1) - S.gammaln(a - b + 1)
    ok = (x >= np.maximum(0, n + r - N)) & (x <= np.minimum(r, n)) & (x == np.floor(x))
    y = np.where(ok, x, np.maximum(0, n + r - N))
    return np.where(ok, np.exp(lc(r, y) + lc(N - r, n - y) - lc(N, n)), 0.0)


def _hyper_cdf(x, r, n, N):
    x, r, n, N = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, r, n, N)))
    out = np.empty(x.shape)
    for i in np.ndindex(x.shape):
        out[i] = min(1.0, _hyper(np.arange(max(0, n[i] + r[i] - N[i]), math.floor(min(x[i], r[i], n[i])) + 1), r[i], n[i], N[i]).sum()) if x[i] >= 0 else 0.0
    return out


def _binom_pmf(x, n, p):
    with np.errstate(all="ignore"):
        y = np.exp(S.gammaln(n + 1) - S.gammaln(np.clip(x, 0, n) + 1) - S.gammaln(n - np.clip(x, 0, n) + 1) + np.where(x > 0, x * np.log(p), 0) + np.where(n > x, (n - x) * np.log1p(-p), 0))
    return np.where((x < 0) | (x > n), 0.0, y)


def _nbinom_pmf(x, r, p):
    with np.errstate(all="ignore"):
        z = np.maximum(x, 0)
        y = np.exp(S.gammaln(r + z) - S.gammaln(r) - S.gammaln(z + 1) + r * np.log(p) + np.where(z > 0, z * np.log1p(-p), 0))
    return np.where(x < 0, 0.0, y)


def _step(cdf, least, most=lambda *a: INF):
    """Quantile of a discrete law, rounded outwards: down below one half, up from there."""

    def q(p, *args):
        lo, hi = least(*args) + 0.0 * p, most(*args) + 0.0 * p
        b = np.where(np.isinf(hi), np.maximum(lo, 1), hi)
        for _ in range(1100):
            grow = np.isinf(hi) & (cdf(b, *args) < p)
            if not grow.any():
                break
            b = np.where(grow, 2 * b, b)
        a = lo - 1  # cdf(a) < p <= cdf(b)
        while (b - a > 1).any():
            m = np.floor((a + b) / 2)
            less = cdf(m, *args) < p
            a, b = np.where(less & (b - a > 1), m, a), np.where(~less & (b - a > 1), m, b)
        down = (p < 0.5) & (cdf(b, *args) > p)
        return np.where(down, np.maximum(b - 1, lo), b)

    return q


def _root(cdf, lo, hi):
    def q(p, *args):
        a, b = lo(*args) + 0.0 * p, hi(*args) + 0.0 * p
        x = S.bisect(lambda v: cdf(v, *args), np.where((p > 0) & (p < 1), p, 0.5), a, b)
        return np.where(p == 0, a, np.where(p == 1, b, x))

    return q


_zero, _one, _inf, _minf = (lambda v: lambda *a: v)(0.0), (lambda v: lambda *a: v)(1.0), (lambda v: lambda *a: v)(INF), (lambda v: lambda *a: v)(-INF)
_positive = lambda *a: [v > 0 for v in a]

#: family: cdf, density, quantile, conditions on its parameters
NUMERIC = {
    "beta": (lambda x, a, b: S.betainc(a, b, np.clip(x, 0, 1)), _beta_pdf, None, _positive),
    "binomial": (lambda x, n, p: np.where(x < 0, 0.0, np.where(x >= n, 1.0, S.betainc(np.maximum(n - np.floor(x), 1e-300), np.floor(x) + 1, 1 - p))), _binom_pmf, _step(lambda x, n, p: NUMERIC["binomial"][0](x, n, p), _zero, lambda n, p: n), lambda n, p: [n >= 0, (p >= 0) & (p <= 1)]),
    "chi_squared": (lambda x, df: S.gammainc(df / 2, np.maximum(x, 0) / 2), lambda x, df: _gamma_pdf(x, df / 2, 2.0), None, _positive),
    "fisher_f": (_f_cdf, _f_pdf, None, _positive),
    "gamma": (lambda x, k, s: S.gammainc(k, np.maximum(x, 0) / s), _gamma_pdf, None, _positive),
    "hypergeometric": (_hyper_cdf, _hyper, _step(_hyper_cdf, lambda r, n, N: np.maximum(0, n + r - N), lambda r, n, N: np.minimum(r, n)), lambda r, n, N: [r <= N, n <= N, r >= 0, n >= 0]),
    "inverse_gamma": (lambda x, k, s: np.where(x <= 0, 0.0, S.gammaincc(k, s / np.where(x > 0, x, 1))), lambda x, k, s: np.where(x <= 0, 0.0, np.exp(k * np.log(s) - S.gammaln(k) - (k + 1) * np.log(np.where(x > 0, x, 1)) - s / np.where(x > 0, x, 1))), None, _positive),
    "kolmogorov": (_kolmogorov_cdf, None, None, lambda: []),
    "negative_binomial": (lambda x, r, p: np.where(x < 0, 0.0, S.betainc(r, np.floor(np.maximum(x, 0)) + 1, p)), _nbinom_pmf, _step(lambda x, r, p: NUMERIC["negative_binomial"][0](x, r, p), _zero), lambda r, p: [r > 0, (p > 0) & (p <= 1)]),
    "non_central_beta": (lambda x, a, b, c: _mixed(_ncb_cdf)(np.clip(x, 0, 1), a, b, c), lambda x, a, b, c: np.where((x < 0) | (x > 1), 0.0, _mixed(_ncb_pdf)(np.clip(x, 0, 1), a, b, c)), None, lambda a, b, c: [a > 0, b > 0, c >= 0]),
    "non_central_chi_squared": (_mixed(_ncx2_cdf), lambda x, df, c: np.where(x < 0, 0.0, _mixed(_ncx2_pdf)(x, df, c)), None, lambda df, c: [df > 0, c >= 0]),
    "non_central_f": (_ncf_cdf, _ncf_pdf, None, lambda m, n, c: [m > 0, n > 0, c >= 0]),
    "non_central_t": (_nct_cdf, _nct_pdf, None, lambda df, d: [df > 0]),
    "normal": (lambda x, m, s: S.norm_cdf((x - m) / s), lambda x, m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)), lambda p, m, s: m + s * S.norm_ppf(p), lambda m, s: [s > 0]),
    "lognormal": (lambda x, m, s: np.where(x <= 0, 0.0, S.norm_cdf((np.log(np.where(x > 0, x, 1)) - m) / s)), lambda x, m, s: np.where(x <= 0, 0.0, np.exp(-0.5 * ((np.log(np.where(x > 0, x, 1)) - m) / s) ** 2) / (np.where(x > 0, x, 1) * s * math.sqrt(2 * math.pi))), lambda p, m, s: np.exp(m + s * S.norm_ppf(p)), lambda m, s: [s > 0]),
    "poisson": (lambda x, m: np.where(x < 0, 0.0, S.gammaincc(np.floor(np.maximum(x, 0)) + 1, m)), lambda x, m: np.where(x < 0, 0.0, np.exp(np.maximum(x, 0) * np.log(m) - m - S.gammaln(np.maximum(x, 0) + 1))), _step(lambda x, m: NUMERIC["poisson"][0](x, m), _zero), _positive),
    "students_t": (_t_cdf, _t_pdf, None, _positive),
}
_ENDS = {"beta": (_zero, _one), "non_central_beta": (_zero, _one), "students_t": (_minf, _inf), "non_central_t": (_minf, _inf)}


def evaluate(family: str, what: str, x, *args) -> np.ndarray:
    """A numeric family's function over numpy arrays; NaN where an input is NaN."""
    cdf, density, quantile, conditions = NUMERIC[family]
    x = np.asarray(x, float)
    args = [np.broadcast_to(np.asarray(a, float), x.shape) for a in args]
    gap = np.isnan(x)
    for a in args:
        gap = gap | np.isnan(a)
    good = ~gap
    out = np.full(x.shape, np.nan)
    if good.any():
        x, args = x[good], [a[good] for a in args]
        if not all(np.all(c) for c in conditions(*args)):
            raise ValueError(f"{family}: bad parameter")
        if what == "quantile":
            if ((x < 0) | (x > 1)).any():
                raise ValueError(f"{family}: a probability lies outside 0..1")
            f = quantile or _root(cdf, *_ENDS.get(family, (_zero, _inf)))
        else:
            f = cdf if what == "cdf" else density
        with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
            out[good] = f(x, *args)
    return out


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _numeric(family: str, what: str):
    def f(x, *args):
        n = 1 + len(args)

        def run(*cols: pd.Series) -> pd.Series:
            found = evaluate(family, what, *[c.to_numpy(float, na_value=np.nan) for c in cols])
            return pd.Series(found).where(~np.isnan(found), None)

        wrapped = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d)}[n]
        for name in "abcd"[:n]:
            wrapped.__annotations__[name] = pd.Series
        wrapped.__annotations__["return"] = pd.Series
        return F.pandas_udf(wrapped, "double")(*[_column(v).cast("double") for v in (x, *args)])

    f.__name__ = f"{family}_{what}"
    f.__doc__ = f"{what} of the {family.replace('_', ' ')} distribution."
    return f


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def _prob(p: Column, value: Column) -> Column:
    return F.when((p < 0) | (p > 1), _raise("a probability lies outside 0..1")).otherwise(value)


# closed forms: cdf, density, quantile as column expressions


def _pick(*pairs, last) -> Column:
    out = None
    for c, v in pairs:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(last)


_EXP, _LN = F.exp, F.log

CLOSED = {
    "bernoulli": (
        lambda x, p: _pick((x < 0, 0.0), (x < 1, 1 - p), last=F.lit(1.0)),
        lambda x, p: _pick((x == 0, 1 - p), (x == 1, p), last=F.lit(0.0)),
        lambda q, p: _pick((q <= 1 - p, 0.0), last=F.lit(1.0)),
        lambda p: (p >= 0) & (p <= 1),
    ),
    "cauchy": (
        lambda x, m, s: 0.5 + F.atan((x - m) / s) / math.pi,
        lambda x, m, s: 1 / (math.pi * s * (1 + ((x - m) / s) * ((x - m) / s))),
        lambda q, m, s: _pick((q == 0, -INF), (q == 1, INF), (q == 0.5, m), last=m + s * F.tan(math.pi * (q - 0.5))),
        lambda m, s: s > 0,
    ),
    "exponential": (
        lambda x, r: _pick((x <= 0, 0.0), last=-F.expm1(-r * x)),
        lambda x, r: _pick((x < 0, 0.0), last=r * _EXP(-r * x)),
        lambda q, r: _pick((q == 1, INF), last=-F.log1p(-q) / r),
        lambda r: r > 0,
    ),
    "extreme_value": (
        lambda x, m, s: _EXP(-_EXP((m - x) / s)),
        lambda x, m, s: _EXP((m - x) / s) * _EXP(-_EXP((m - x) / s)) / s,
        lambda q, m, s: _pick((q == 0, -INF), (q == 1, INF), last=m - s * _LN(-_LN(q))),
        lambda m, s: s > 0,
    ),
    "geometric": (
        lambda x, p: _pick((x < 0, 0.0), last=-F.expm1((F.floor(x) + 1) * F.log1p(-p))),
        lambda x, p: _pick((x < 0, 0.0), last=p * F.pow(1 - p, x)),
        lambda q, p: _pick((q < p, 0.0), (q == 1, INF), last=F.log1p(-q) / F.log1p(-p) - 1),
        lambda p: (p > 0) & (p <= 1),
    ),
    "laplace": (
        lambda x, m, s: _pick((x < m, 0.5 * _EXP((x - m) / s)), last=1 - 0.5 * _EXP(-(x - m) / s)),
        lambda x, m, s: _EXP(-F.abs(x - m) / s) / (2 * s),
        lambda q, m, s: _pick((q == 0, -INF), (q == 1, INF), (q < 0.5, m + s * _LN(2 * q)), last=m - s * _LN(2 - 2 * q)),
        lambda m, s: s > 0,
    ),
    "logistic": (
        lambda x, m, s: 1 / (1 + _EXP((m - x) / s)),
        lambda x, m, s: _EXP(-F.abs(x - m) / s) / (s * F.pow(1 + _EXP(-F.abs(x - m) / s), F.lit(2))),
        lambda q, m, s: _pick((q == 0, -INF), (q == 1, INF), last=m - s * _LN(1 / q - 1)),
        lambda m, s: s > 0,
    ),
    "pareto": (
        lambda x, k, a: _pick((x <= k, 0.0), last=1 - F.pow(k / x, a)),
        lambda x, k, a: _pick((x < k, 0.0), last=a * F.pow(k, a) / F.pow(x, a + 1)),
        lambda q, k, a: _pick((q == 1, INF), last=k / F.pow(1 - q, 1 / a)),
        lambda k, a: (k > 0) & (a > 0),
    ),
    "rayleigh": (
        lambda x, s: _pick((x <= 0, 0.0), last=-F.expm1(-x * x / (2 * s * s))),
        lambda x, s: _pick((x <= 0, 0.0), last=x / (s * s) * _EXP(-x * x / (2 * s * s))),
        lambda q, s: _pick((q == 1, INF), last=F.sqrt(-2 * s * s * F.log1p(-q))),
        lambda s: s > 0,
    ),
    "triangular": (
        lambda x, a, c, b: _pick((x <= a, 0.0), (x >= b, 1.0), (x <= c, (x - a) * (x - a) / ((b - a) * F.nullif(c - a, F.lit(0.0)))), last=1 - (b - x) * (b - x) / ((b - a) * F.nullif(b - c, F.lit(0.0)))),
        lambda x, a, c, b: _pick((x < a, 0.0), (x > b, 0.0), (x == c, 2 / (b - a)), (x < c, 2 * (x - a) / ((b - a) * F.nullif(c - a, F.lit(0.0)))), last=2 * (b - x) / ((b - a) * F.nullif(b - c, F.lit(0.0)))),
        lambda q, a, c, b: _pick((q < (c - a) / (b - a), a + F.sqrt((b - a) * (c - a) * q)), last=b - F.sqrt((b - a) * (b - c) * (1 - q))),
        lambda a, c, b: (a < b) & (a <= c) & (c <= b),
    ),
    "uniform": (
        lambda x, a, b: _pick((x <= a, 0.0), (x >= b, 1.0), last=(x - a) / (b - a)),
        lambda x, a, b: _pick((x < a, 0.0), (x > b, 0.0), last=1 / (b - a)),
        lambda q, a, b: a + q * (b - a),
        lambda a, b: a < b,
    ),
    "weibull": (
        lambda x, k, s: _pick((x <= 0, 0.0), last=-F.expm1(-F.pow(x / s, k))),
        lambda x, k, s: _pick((x < 0, 0.0), ((x == 0) & (k > 1), 0.0), ((x == 0) & (k < 1), INF), last=k / s * F.pow(x / s, k - 1) * _EXP(-F.pow(x / s, k))),
        lambda q, k, s: _pick((q == 1, INF), last=s * F.pow(-F.log1p(-q), 1 / k)),
        lambda k, s: (k > 0) & (s > 0),
    ),
}


def _closed(family: str, what: str, expression, condition):
    def f(x, *args):
        x, args = _column(x).cast("double"), [_column(a).cast("double") for a in args]
        gap = x.isNull()
        for a in args:
            gap = gap | a.isNull()
        value = expression(x, *args)
        if what == "quantile":
            value = _prob(x, value)
        return F.when(gap, F.lit(None)).when(~condition(*args), _raise(f"{family}: bad parameter")).otherwise(value)

    f.__name__ = f"{family}_{what}"
    f.__doc__ = f"{what} of the {family.replace('_', ' ')} distribution."
    return f


DISCRETE = {"bernoulli", "binomial", "geometric", "hypergeometric", "negative_binomial", "poisson"}
FUNCTIONS = {}
for _family, (_c, _d, _q, _ok) in CLOSED.items():
    for _what, _e in (("cdf", _c), ("pmf" if _family in DISCRETE else "pdf", _d), ("quantile", _q)):
        FUNCTIONS[f"{_family}_{_what}"] = _closed(_family, _what, _e, _ok)
for _family in NUMERIC:
    for _what in ("cdf",) if _family == "kolmogorov" else ("cdf", "pmf" if _family in DISCRETE else "pdf", "quantile"):
        FUNCTIONS[f"{_family}_{_what}"] = _numeric(_family, _what)
globals().update(FUNCTIONS)
