"""ARIMA models of a time series, one for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.checks import names, options, quoted

OPTIONS = {"max_iter": 100, "tau": 0.001, "e1": 1e-15, "e2": 1e-15, "e3": 1e-15, "hessian_delta": 1e-6}


def _residuals(z, mean, phi, theta):
    p, q = len(phi), len(theta)
    d = z - mean
    e = np.zeros(len(z))
    ar = np.zeros(len(z))
    for i in range(p):
        ar[i + 1 :] += phi[i] * d[: -i - 1]
    base = d - ar
    if not q:
        e[p:] = base[p:]
        return e
    for t in range(p, len(z)):
        e[t] = base[t] - sum(theta[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= 0)
    return e


def fit_arima(y: np.ndarray, p: int, d: int, q: int, include_mean: bool, opt: dict) -> dict:
    """Conditional least squares by Levenberg-Marquardt; the first p residuals are zero."""
    z = np.diff(np.asarray(y, float), n=d)
    use_mean = include_mean and d == 0
    k = p + q + use_mean
    b = np.zeros(k)
    if use_mean:
        b[0] = z.mean()

    def parts(b):
        return (b[0] if use_mean else 0.0), b[use_mean : use_mean + p], b[use_mean + p :]

    def res(b):
        return _residuals(z, *parts(b))[p:]

    def jac(b):
        out = np.empty((len(z) - p, k))
        for i in range(k):
            h = opt["hessian_delta"] * max(1.0, abs(b[i]))
            up, down = b.copy(), b.copy()
            up[i] += h
            down[i] -= h
            out[:, i] = (res(up) - res(down)) / (2 * h)
        return out

    e = res(b)
    ss, v, it = e @ e, 2.0, 0
    j = jac(b) if k else np.zeros((len(e), 0))
    u = opt["tau"] * max((j.T @ j).diagonal().max(initial=0), 1e-12)
    for it in range(1, opt["max_iter"] + 1 if k else 1):
        g, a = -(j.T @ e), j.T @ j
        if np.abs(g).max(initial=0) <= opt["e1"]:
            break
        step = np.linalg.lstsq(a + u * np.eye(k), g, rcond=None)[0]
        if np.linalg.norm(step) <= opt["e2"] * max(np.linalg.norm(b), 1e-12):
            break
        new = res(b + step)
        rho = (ss - new @ new) / max(step @ (u * step + g), 1e-300)
        if rho > 0 and np.isfinite(new @ new):
            small = ss - new @ new <= 1e-14 * ss
            b, e, ss = b + step, new, new @ new
            j = jac(b)
            u, v = u * max(1 / 3, 1 - (2 * rho - 1) ** 3), 2.0
            if small:
                break
        else:
            u, v = u * v, v * 2
            if not np.isfinite(u):
                break
    n = len(z) - p
    var = ss / max(n - k, 1)
    cov = np.linalg.pinv(j.T @ j) * var if k else np.zeros((0, 0))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    mean, phi, theta = parts(b)
    return {
        "mean": float(mean) if use_mean else None, "mean_std_error": float(se[0]) if use_mean else None, "ar_params": phi.tolist(), "ar_std_errors": se[use_mean : use_mean + p].tolist(),
        "ma_params": theta.tolist(), "ma_std_errors": se[use_mean + p :].tolist(), "residual_variance": float(var), "log_likelihood": float(-0.5 * n * (np.log(2 * np.pi * ss / max(n, 1)) + 1)), "iter_num": it,
        "residuals": _residuals(z, mean, phi, theta).tolist(), "tail": np.asarray(y, float)[-(p + d) :].tolist() if p + d else [],
    }


_FIELDS = ["mean", "mean_std_error", "ar_params", "ar_std_errors", "ma_params", "ma_std_errors", "residual_variance", "log_likelihood", "iter_num"]
_SCHEMA = "mean double, mean_std_error double, ar_params array<double>, ar_std_errors array<double>, ma_params array<double>, ma_std_errors array<double>, residual_variance double, log_likelihood double, iter_num int, p int, d int, q int, tail array<double>, tail_residuals array<double>"


def arima_train(df: DataFrame, time: str, value: str, groups=None, include_mean: bool = False, orders: tuple[int, int, int] = (1, 1, 1), optimizer_params=None) -> dict[str, DataFrame]:
    """{model, residual}: ARIMA(p, d, q) of each group's series, ordered by time; rows with nulls are left out.

    A series is fitted in one task: its order is what the model is about. With d > 0 there is no mean.
    """
    p, d, q = orders
    opt = options(optimizer_params, OPTIONS)
    groups = names(groups)
    kinds = [f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups]
    time_kind = df.schema[time].dataType.simpleString()
    rows = df.select(*[F.col(quoted(g)) for g in groups], F.col(quoted(time)).alias("_t"), F.col(quoted(value)).cast("double").alias("_v")).dropna()

    def fit(pdf):
        pdf = pdf.sort_values("_t")
        return pdf, fit_arima(pdf._v.to_numpy(), p, d, q, include_mean, opt)

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m = fit(pdf)
        tail = m["residuals"][-q:] if q else []
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in groups}, **{f: m[f] for f in _FIELDS}, "p": p, "d": d, "q": q, "tail": m["tail"], "tail_residuals": tail}])

    def residual(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m = fit(pdf)
        return pd.DataFrame({**{g: pdf[g].iloc[d:].to_numpy() for g in groups}, time: pdf._t.iloc[d:].to_numpy(), "residual": m["residuals"]})

    keyed = rows.groupBy(*[quoted(g) for g in groups])
    return {"model": keyed.applyInPandas(model, ", ".join([*kinds, _SCHEMA])), "residual": keyed.applyInPandas(residual, ", ".join([*kinds, f"{quoted(time)} {time_kind}, residual double"]))}


def forecast(m: dict, steps: int) -> np.ndarray:
    p, d, q = m["p"], m["d"], m["q"]
    levels = np.asarray(m["tail"], float)
    z = list(np.diff(levels, n=d)) if p else []
    mean = m["mean"] or 0.0
    e = list(m["tail_residuals"])
    out = []
    for _ in range(steps):
        v = mean + sum(m["ar_params"][i] * (z[-1 - i] - mean) for i in range(p)) + sum(m["ma_params"][j] * e[-1 - j] for j in range(q) if j < len(e))
        out.append(v)
        z.append(v)
        e.append(0.0)
    out = np.array(out)
    for k in range(d, 0, -1):  # add the differences up again
        out = np.diff(levels, n=k - 1)[-1] + np.cumsum(out)
    return out


def arima_forecast(model: DataFrame, steps_ahead: int, groups=None) -> DataFrame:
    """(groups, steps_ahead, forecast_value)."""
    groups = names(groups)
    kinds = [f"{quoted(g)} {model.schema[g].dataType.simpleString()}" for g in groups]

    def run(batches):
        for pdf in batches:
            for m in pdf.to_dict("records"):
                m["mean"] = None if m["mean"] is None or np.isnan(m["mean"]) else m["mean"]
                f = forecast(m, steps_ahead)
                yield pd.DataFrame({**{g: [m[g]] * steps_ahead for g in groups}, "steps_ahead": np.arange(1, steps_ahead + 1, dtype=np.int32), "forecast_value": f})

    return model.mapInPandas(run, ", ".join([*kinds, "steps_ahead int, forecast_value double"]))
