"""Generalised linear models, multinomial and ordinal responses, by iteratively reweighted least squares."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import special as S
from corvane.functions.prob import FUNCTIONS
from corvane.operators.checks import expr, features, names, options, quoted
from corvane.operators.estimate import floats, iterate, model_frame, packed, sym_pinv, unpacked, width_of
from corvane.operators.regress import _dot, _newton, _prepared, _ratio, _t_two, _z_two, fit_mlogit

FAMILIES = {
    "poisson": ["log", "identity", "sqrt"],
    "gaussian": ["identity", "log", "inverse"],
    "gamma": ["inverse", "log", "identity"],
    "inverse_gaussian": ["sqr_inverse", "identity", "log", "inverse"],
    "binomial": ["logit", "probit"],
}

#: link: mean of the linear predictor, derivative of the mean, link of a mean
LINKS = {
    "identity": (lambda e: e, lambda e: np.ones_like(e), lambda m: m),
    "log": (np.exp, np.exp, np.log),
    "sqrt": (lambda e: e * e, lambda e: 2 * e, np.sqrt),
    "inverse": (lambda e: 1 / e, lambda e: -1 / (e * e), lambda m: 1 / m),
    "sqr_inverse": (lambda e: 1 / np.sqrt(e), lambda e: -0.5 * e**-1.5, lambda m: 1 / (m * m)),
    "logit": (lambda e: 0.5 * (1 + np.tanh(e / 2)), lambda e: 0.25 / np.cosh(e / 2) ** 2, lambda m: np.log(m / (1 - m))),
    "probit": (S.norm_cdf, lambda e: np.exp(-e * e / 2) / math.sqrt(2 * math.pi), S.norm_ppf),
}

VARIANCE = {"poisson": lambda m: m, "gaussian": lambda m: np.ones_like(m), "gamma": lambda m: m * m, "inverse_gaussian": lambda m: m**3, "binomial": lambda m: m * (1 - m)}


def _loglik(family, y, m, psi):
    if family == "poisson":
        return (y * np.log(m) - m - S.gammaln(y + 1)).sum()
    if family == "binomial":
        return np.log(np.where(y > 0, m, 1 - m)).sum()
    if family == "gaussian":
        return (-0.5 * ((y - m) ** 2 / psi + math.log(2 * math.pi * psi))).sum()
    if family == "gamma":
        a = 1 / psi
        return (a * np.log(a * y / m) - a * y / m - np.log(y) - S.gammaln(a)).sum()
    return (-0.5 * ((y - m) ** 2 / (psi * m * m * y) + np.log(2 * math.pi * psi * y**3))).sum()


def _start_mean(family, y):
    if family == "binomial":
        return (y + 0.5) / 2
    if family == "poisson":
        return np.where(y > 0, y, 0.1) if (y == 0).any() else y
    return y


def _kernel(family, link):
    mean, slope, of_mean = LINKS[link]

    def kernel(state, a):
        """[X'Wz, lower X'WX, n, Pearson chi-square, log-likelihood]."""
        x, y = a["_x"], a["_y"]
        if state["coef"] is None:
            m = _start_mean(family, y)
            eta = of_mean(m)
        else:
            eta = x @ state["coef"]
            m = mean(eta)
        d, v = slope(eta), VARIANCE[family](m)
        w = d * d / v
        z = eta + (y - m) / d
        with np.errstate(all="ignore"):
            ll = _loglik(family, y, m, state["psi"])
        return np.concatenate((x.T @ (w * z), packed((x * w[:, None]).T @ x), [len(y), ((y - m) ** 2 / v).sum(), ll]))

    return kernel


def glm(df: DataFrame, y: str, x, family: str, link: str | None = None, groups=None, optim_params=None) -> DataFrame:
    """A generalised linear model for each group: coef, log_likelihood, std_err, z or t stats, p_values, dispersion, counts."""
    links = FAMILIES[family]
    link = link or links[0]
    if link not in links:
        raise ValueError(f"{family} goes with {', '.join(links)}")
    opt = options(optim_params, {"max_iter": 100, "optimizer": "irls", "tolerance": 1e-6})
    groups = names(groups)
    rows, counts = _prepared(df, y, x, groups)
    k = width_of(rows, F.col("_x"))
    tri = k * (k + 1) // 2
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("boolean").cast("double") if family == "binomial" else F.col("_y").cast("double")}

    def step(state, s):
        b, h, (n, chi, ll) = s[:k], unpacked(s[k : k + tri], k), s[k + tri :]
        new = dict(state, iterations=state["iterations"] + 1)
        if not np.isfinite(s[: k + tri]).all():
            return new | {"failed": True, "done": True}
        inv, _ = sym_pinv(h)
        psi = chi / (n - k) if n > k and family not in ("poisson", "binomial") else 1.0
        first = state["coef"] is None
        if not first:
            new |= {"inv": inv, "psi": psi if psi > 0 else 1e-300, "ll": ll, "n": n}
            if state["ll"] is not None and abs(ll - state["ll"]) < opt["tolerance"] * (abs(ll) + opt["tolerance"]):
                return new | {"done": True}
        return new | {"coef": inv @ b}

    start = {key: {"coef": None, "ll": None, "psi": 1.0, "iterations": 0} for key, (n, _) in counts.items() if n}
    state = iterate(rows, groups, columns, _kernel(family, link), start, step, opt["max_iter"])
    out = []
    for key, s in state.items():
        base = {"_key": key, "num_rows_processed": counts[key][0], "num_rows_skipped": counts[key][1], "num_iterations": s["iterations"]}
        if s.get("failed") or "inv" not in s:
            out.append(base)
            continue
        n, psi = counts[key][0], s["psi"]
        se = np.sqrt(np.maximum(np.diag(s["inv"]) * psi, 0))
        t = _ratio(s["coef"], se)
        p = _z_two(t) if family in ("poisson", "binomial") else _t_two(t, n - k)
        out.append(base | {"coef": floats(s["coef"]), "log_likelihood": float(s["ll"]), "std_err": floats(se), "stats": floats(t), "p_values": floats(p), "dispersion": float(psi)})
    schema = "coef array<double>, log_likelihood double, std_err array<double>, stats array<double>, p_values array<double>, dispersion double, num_rows_processed long, num_rows_skipped long, num_iterations int"
    return model_frame(df, groups, out, schema)


def _mean_column(eta: Column, link: str) -> Column:
    return {
        "identity": lambda e: e, "log": F.exp, "sqrt": lambda e: e * e, "inverse": lambda e: 1 / e, "sqr_inverse": lambda e: 1 / F.sqrt(e),
        "logit": lambda e: 1 / (1 + F.exp(-e)), "probit": lambda e: FUNCTIONS["normal_cdf"](e, 0.0, 1.0),
    }[link](eta)


def glm_predict(coef, x, link: str) -> Column:
    """Column: the predicted mean."""
    return _mean_column(_dot(coef, x), link)


def glm_predict_poisson(coef, x, link: str) -> Column:
    """Column: the predicted mean, rounded."""
    return F.round(glm_predict(coef, x, link)).cast("double")


def glm_predict_binomial(coef, x, link: str) -> Column:
    """Column: whether the predicted mean is at least one half."""
    return glm_predict(coef, x, link) >= 0.5


def multinom(df: DataFrame, y: str, x, ref_category=None, groups=None, optim_params=None) -> DataFrame:
    """Multinomial logit model: a row for each group and category but the reference."""
    opt = options(optim_params, {"max_iter": 100, "optimizer": "irls", "tolerance": 1e-6})
    groups, order, rows, counts, k, state = fit_mlogit(df, y, x, groups, ref_category, opt["max_iter"], opt["tolerance"])
    out = []
    for key, s in state.items():
        inv, _ = sym_pinv(s["hessian"])
        for i, value in enumerate(order[1:]):
            part = slice(i * k, (i + 1) * k)
            coef, se = s["coef"][part], np.sqrt(np.diag(inv)[part])
            z = _ratio(coef, se)
            out.append({"_key": key, "category": str(value), "ref_category": str(order[0]), "coef": floats(coef), "log_likelihood": float(s["ll"]), "std_err": floats(se), "z_stats": floats(z), "p_values": floats(_z_two(z)), "num_rows_processed": counts[key][0], "num_iterations": s["iterations"]})
    return model_frame(df, groups, out, "category string, ref_category string, coef array<double>, log_likelihood double, std_err array<double>, z_stats array<double>, p_values array<double>, num_rows_processed long, num_iterations int")


def _ordinal_kernel(link, k, cuts):
    mean, slope, _ = LINKS[link]

    def kernel(state, a):
        """[log-likelihood, gradient, lower information] by thresholds, then coefficients: P(y <= j) = F(t_j - x b)."""
        x, y = a["_x"], a["_y"].astype(int)
        t, b = state["coef"][:cuts], state["coef"][cuts:]
        eta = x @ b
        padded = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = padded[y + 1] - eta, padded[y] - eta
        with np.errstate(all="ignore"):
            fh, fl = np.where(np.isinf(hi), 1.0, mean(np.where(np.isinf(hi), 0, hi))), np.where(np.isinf(lo), 0.0, mean(np.where(np.isinf(lo), 0, lo)))
            dh, dl = np.where(np.isinf(hi), 0.0, slope(np.where(np.isinf(hi), 0, hi))), np.where(np.isinf(lo), 0.0, slope(np.where(np.isinf(lo), 0, lo)))
        p = np.maximum(fh - fl, 1e-300)
        ll = np.log(p).sum()
        u = np.zeros((len(y), cuts + k))
        at = np.arange(len(y))
        top, low = y < cuts, y > 0
        u[at[top], y[top]] += (dh / p)[top]
        u[at[low], y[low] - 1] -= (dl / p)[low]
        u[:, cuts:] = -x * ((dh - dl) / p)[:, None]
        # expected information over all categories
        z = t[None, :] - eta[:, None]
        c, d = mean(z), slope(z)
        full = np.concatenate((np.zeros((len(y), 1)), c, np.ones((len(y), 1))), axis=1)
        probs = np.maximum(np.diff(full, axis=1), 1e-300)
        info = np.zeros((cuts + k, cuts + k))
        for j in range(cuts + 1):
            v = np.zeros((len(y), cuts + k))
            if j < cuts:
                v[:, j] += d[:, j]
                v[:, cuts:] -= x * d[:, [j]]
            if j > 0:
                v[:, j - 1] -= d[:, j - 1]
                v[:, cuts:] += x * d[:, [j - 1]]
            info += (v / probs[:, [j]]).T @ v
        return np.concatenate(([ll], u.sum(axis=0), packed(info)))

    return kernel


def ordinal(df: DataFrame, y: str, x, cat_order: list, link: str = "logit", groups=None, optim_params=None) -> DataFrame:
    """Proportional-odds model of ordered categories: thresholds and coefficients, with their errors.

    `x` must not hold an intercept.
    """
    opt = options(optim_params, {"max_iter": 100, "optimizer": "irls", "tolerance": 1e-6})
    groups = names(groups)
    code = F.coalesce(*[F.when(expr(y) == F.lit(v), F.lit(i)) for i, v in enumerate(cat_order)])
    rows, counts = _prepared(df.withColumn("_code", code), "_code", x, groups)
    k, cuts = width_of(rows, F.col("_x")), len(cat_order) - 1
    shares = {}
    for r in rows.groupBy(*[quoted(g) for g in groups], "_y").count().toLocalIterator():
        shares.setdefault(tuple(r[: len(groups)]), {})[r["_y"]] = r["count"]
    start = {}
    for key, c in shares.items():
        total = sum(c.values())
        cum = np.cumsum([c.get(i, 0) for i in range(cuts)]) / total
        start[key] = {"coef": np.concatenate((LINKS[link][2](np.clip(cum, 1e-6, 1 - 1e-6)), np.zeros(k))), "ll": None, "iterations": 0}
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}
    state = iterate(rows, groups, columns, _ordinal_kernel(link, k, cuts), start, _newton(cuts + k, opt["tolerance"]), opt["max_iter"])
    out = []
    for key, s in state.items():
        inv, _ = sym_pinv(s["hessian"])
        se = np.sqrt(np.maximum(np.diag(inv), 0))
        z = _ratio(s["coef"], se)
        p = _z_two(z)
        out.append(
            {"_key": key, "coef_threshold": floats(s["coef"][:cuts]), "std_err_threshold": floats(se[:cuts]), "z_stats_threshold": floats(z[:cuts]), "p_values_threshold": floats(p[:cuts]), "log_likelihood": float(s["ll"]),
             "coef_feature": floats(s["coef"][cuts:]), "std_err_feature": floats(se[cuts:]), "z_stats_feature": floats(z[cuts:]), "p_values_feature": floats(p[cuts:]), "num_rows_processed": counts[key][0], "num_iterations": s["iterations"]}
        )
    schema = ", ".join(f"{n}_{w} array<double>" for w in ("threshold", "feature") for n in ("coef", "std_err", "z_stats", "p_values"))
    return model_frame(df, groups, out, schema + ", log_likelihood double, num_rows_processed long, num_iterations int")


def ordinal_predict(model: DataFrame, df: DataFrame, id_col: str, x, cat_order: list, link: str = "logit", kind: str = "response") -> DataFrame:
    """(id, category) or with kind "prob" (id, category, probability). A model without groups."""
    m = model.first()
    eta = _dot(m.coef_feature, features(df, x))
    cum = [F.lit(0.0), *[_mean_column(F.lit(t) - eta, link) for t in m.coef_threshold], F.lit(1.0)]
    cells = F.array(*[F.struct((cum[i + 1] - cum[i]).alias("probability"), F.lit(-i).alias("i"), F.lit(str(v)).alias("category")) for i, v in enumerate(cat_order)])
    made = df.select(F.col(quoted(id_col)), cells.alias("s"))
    if kind == "response":
        return made.select(id_col, F.array_max("s")["category"].alias("category"))
    return made.select(id_col, F.explode("s").alias("e")).select(id_col, "e.category", "e.probability")


def multinom_predict(model: DataFrame, df: DataFrame, id_col: str, x, kind: str = "response") -> DataFrame:
    from corvane.operators.regress import mlogregr_predict

    return mlogregr_predict(model, df, id_col, x, kind)
