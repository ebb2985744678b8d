"""Elastic net and support vector machines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.checks import complete, expr, features, names, no_null_groups, options, quoted
from corvane.operators.estimate import floats, group_sums, iterate, model_frame, unpacked, width_of
from corvane.operators.regress import _dot, _gram_kernel, _prepared, _sigmoid

# elastic net: loss + lambda * ((1 - alpha) / 2 * |b|^2 + alpha * |b|_1), loss = mean squared error / 2 or mean log loss


def elastic_net_train(
    df: DataFrame,
    y: str,
    x,
    family: str = "gaussian",
    alpha: float = 1.0,
    lambda_value: float = 0.1,
    standardize: bool = True,
    optimizer: str = "fista",
    max_iter: int = 1000,
    tolerance: float = 1e-6,
    excluded: list[int] = (),
    groups=None,
    warmup: bool = False,
    warmup_lambdas: list[float] | None = None,
    warmup_tolerance: float = 1e-4,
    use_active_set: bool = False,
) -> DataFrame:
    """A model for each group: features (places from 1), coef_all, coef_nonzero, intercept, log_likelihood, standardize, iteration_run.

    The gaussian fit runs on the Gram matrix, which one pass over the data gives. `excluded` features (places from
    1) are left out. Optimizers: fista, igd (proximal gradient steps without momentum). With `warmup` the fit starts
    from those of falling penalties, `warmup_lambdas` or five from the least that leaves no coefficient on. With
    `use_active_set` steps between two full ones move the coefficients alone that aren't zero. Rows with nulls are left
    out; null group values raise.
    """
    if family in ("linear", "gaussian"):
        family = "gaussian"
    elif family in ("logistic", "binomial"):
        family = "binomial"
    else:
        raise ValueError("family is gaussian or binomial")
    if not 0 <= alpha <= 1 or lambda_value < 0:
        raise ValueError("alpha lies in 0..1, lambda isn't negative")
    groups = names(groups)
    no_null_groups(df, groups)
    xc = features(df, x)
    if excluded:
        xc = F.filter(xc, lambda e, i: ~i.isin([j - 1 for j in excluded]))
    rows = df.select(*[F.col(quoted(g)) for g in groups], (expr(y).cast("boolean").cast("double") if family == "binomial" else expr(y).cast("double")).alias("_y"), xc.alias("_x"))
    rows = rows.filter(complete(F.col("_y"), F.col("_x")))
    k = width_of(rows, F.col("_x"))
    columns = {"_x": F.col("_x"), "_y": F.col("_y")}
    ones = rows.select(*[quoted(g) for g in groups], F.concat(F.array(F.lit(1.0)), F.col("_x")).alias("_x"), "_y")
    moments = {key: _moments(s, k, standardize) for key, s in group_sums(ones, groups, columns, _gram_kernel).items()}
    path = {key: [lambda_value] for key in moments}
    if warmup:
        for key, m in moments.items():
            given = warmup_lambdas
            if given is None:
                top = np.abs(m["target"]).max(initial=0) / max(alpha, 1e-3)
                given = np.geomspace(max(top, lambda_value), max(lambda_value, 1e-3 * top), 5) if top > lambda_value > 0 else []
            path[key] = [*sorted({float(v) for v in given if v > lambda_value}, reverse=True), lambda_value]
    if family == "gaussian":
        found = {key: _gaussian_path(m, path[key], alpha, optimizer, max_iter, tolerance, warmup_tolerance, use_active_set) for key, m in moments.items()}
    else:
        found = _binomial_path(rows, groups, columns, moments, path, k, alpha, optimizer, max_iter, tolerance, warmup_tolerance, use_active_set)
    places = [i for i in range(1, k + len(excluded) + 1) if i not in set(excluded)]
    out = []
    for key, (b, b0, loglik, run) in found.items():
        m = moments[key]
        coef = b / m["sd"]
        intercept = (m["y_mean"] if family == "gaussian" else b0) - m["mean"] @ coef
        if family == "gaussian":
            s, xy, xx, n, mean = m["s"], m["xy"], m["xx"], m["n"], m["mean"]
            loglik = -0.5 * (s[2] - 2 * (intercept * s[1] + coef @ xy[1:]) + n * intercept**2 + 2 * intercept * n * (mean @ coef) + coef @ xx[1:, 1:] @ coef) / n
        chosen = [i for i, c in zip(places, coef) if c != 0]
        out.append({"_key": key, "family": family, "features": places, "features_selected": chosen, "coef_nonzero": [float(c) for c in coef if c != 0], "coef_all": floats(coef), "intercept": float(intercept), "log_likelihood": float(loglik), "standardize": standardize, "iteration_run": run})
    return model_frame(df, groups, out, "family string, features array<int>, features_selected array<int>, coef_nonzero array<double>, coef_all array<double>, intercept double, log_likelihood double, standardize boolean, iteration_run int")


def _moments(s: np.ndarray, k: int, standardize: bool) -> dict:
    """Means, deviations, and the standardized Gram matrix with its target, from sums over rows with a leading one."""
    n, xy, xx = s[0], s[3 : 4 + k], unpacked(s[4 + k :], k + 1)
    mean = xx[0, 1:] / n
    sd = np.sqrt(np.maximum(np.diag(xx)[1:] / n - mean * mean, 0)) if standardize else np.ones(k)
    sd[sd == 0] = 1.0
    y_mean = s[1] / n
    return {"s": s, "n": n, "xy": xy, "xx": xx, "mean": mean, "sd": sd, "y_mean": y_mean, "gram": (xx[1:, 1:] / n - np.outer(mean, mean)) / np.outer(sd, sd), "target": (xy[1:] / n - mean * y_mean) / sd}


def _soft(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0)


def _momentum(optimizer: str, t: float) -> tuple[float, float]:
    """The next momentum parameter, and the weight of the last move."""
    if optimizer != "fista":
        return 1.0, 0.0
    t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
    return t2, (t - 1) / t2


def _gaussian_path(m: dict, path: list[float], alpha: float, optimizer: str, max_iter: int, tolerance: float, warm_tolerance: float, active: bool):
    b, total = np.zeros(len(m["target"])), 0
    top = np.linalg.eigvalsh(m["gram"])[-1]
    for i, value in enumerate(path):
        l1, l2 = alpha * value, (1 - alpha) * value
        step, limit = 1 / max(top + l2, 1e-12), (tolerance if i == len(path) - 1 else warm_tolerance) * 1e-3
        z, t = b, 1.0
        for run in range(1, max_iter + 1):
            new = _soft(z - step * (m["gram"] @ z - m["target"] + l2 * z), step * l1)
            full = not active or run % 10 == 1
            if not full:
                new = np.where(b != 0, new, 0.0)
            t, weight = _momentum(optimizer, t)
            z = new + weight * (new - b)
            change = np.abs(new - b).max(initial=0)
            b = new
            total += 1
            if full and change < limit * max(1.0, np.abs(b).max(initial=0)):
                break
    return b, 0.0, 0.0, total


def _binomial_path(rows, groups, columns, moments, path, k, alpha, optimizer, max_iter, tolerance, warm_tolerance, active):
    def kernel(state, a):
        xs = (a["_x"] - state["mean"]) / state["sd"]
        zz = xs @ state["z"] + state["z0"]
        r = _sigmoid(zz) - a["_y"]
        return np.concatenate(([np.logaddexp(0, zz).sum() - a["_y"] @ zz, r.sum()], xs.T @ r))

    def step(state, sums):
        at, m = state["path"][state["at"]], moments[state["key"]]
        l1, l2 = alpha * at, (1 - alpha) * at
        size = 1 / (0.25 * (max(state["norm"], 0) + 1) + l2)
        g0, g = sums[1] / m["n"], sums[2:] / m["n"] + l2 * state["z"]
        new, new0 = _soft(state["z"] - size * g, size * l1), state["z0"] - size * g0
        full = not active or state["run"] % 10 == 0
        if not full:
            new = np.where(state["b"] != 0, new, 0.0)
        t, weight = _momentum(optimizer, state["t"])
        last = state["at"] == len(state["path"]) - 1
        settled = full and max(np.abs(new - state["b"]).max(initial=0), abs(new0 - state["b0"])) < (tolerance if last else warm_tolerance)
        now = state | {"b": new, "b0": new0, "z": new + weight * (new - state["b"]), "z0": new0 + weight * (new0 - state["b0"]), "t": t, "ll": -sums[0] / m["n"], "run": state["run"] + 1, "done": settled and last}
        return now | {"at": state["at"] + 1, "t": 1.0, "z": new, "z0": new0} if settled and not last else now

    start = {}
    for key, m in moments.items():
        start[key] = {"key": key, "mean": m["mean"], "sd": m["sd"], "norm": np.linalg.eigvalsh(m["gram"])[-1], "path": path[key], "at": 0, "b": np.zeros(k), "b0": 0.0, "z": np.zeros(k), "z0": 0.0, "t": 1.0, "run": 0}
    state = iterate(rows, groups, columns, kernel, start, step, max_iter * max(map(len, path.values()), default=1))
    return {key: (s["b"], s["b0"], s["ll"], s["run"]) for key, s in state.items()}


def elastic_net_gaussian_predict(coef, intercept: float, x) -> Column:
    return _dot(coef, x) + intercept


def elastic_net_binomial_predict(coef, intercept: float, x) -> Column:
    return _dot(coef, x) + intercept > 0


def elastic_net_binomial_prob(coef, intercept: float, x) -> Column:
    return 1 / (1 + F.exp(-(_dot(coef, x) + intercept)))


def elastic_net_predict(model: DataFrame, df: DataFrame, id_col: str, x) -> DataFrame:
    m = model.first()
    f = elastic_net_gaussian_predict if m.family == "gaussian" else elastic_net_binomial_predict
    return df.select(F.col(quoted(id_col)), f(m.coef_all, m.intercept, features(df, x)).alias("prediction"))


# support vector machines

#: The step size is that of steps over all rows, so that its default is larger than one for steps row by row. `lambda` may
#: hold several values, split by blanks or given as a list: with `n_folds` of 2 or more the best of them is taken.
SVM_OPTIONS = {"init_stepsize": 1.0, "decay_factor": 0.9, "max_iter": 100, "tolerance": 1e-10, "lambda": "0.01", "norm": "l2", "epsilon": 0.01, "n_folds": 0}


def _transform(kernel_func: str, kernel_params, k: int):
    """None for a linear kernel; for a gaussian one the random features' matrix and phases."""
    if "linear".startswith(kernel_func.lower()[:3]):
        return None
    if not "gaussian".startswith(kernel_func.lower()[:3]):
        raise ValueError("kernel is linear or gaussian")
    p = options(kernel_params, {"gamma": 1.0 / k, "n_components": 2 * k, "random_state": 1})
    rng = np.random.default_rng(p["random_state"])
    return rng.normal(0, np.sqrt(2 * p["gamma"]), (k, p["n_components"])), rng.uniform(0, 2 * np.pi, p["n_components"])


def _mapped(x, t):
    return x if t is None else np.sqrt(2 / t[0].shape[1]) * np.cos(x @ t[0] + t[1])


def _svm(df, y: Column, x, kernel_func, kernel_params, groups, params, classify, eps: dict | None = None):
    """State of each group's best coefficients, and its validation.

    A pass moves a coefficient vector for each combination of a penalty and a left-out fold.
    """
    opt = options(params, SVM_OPTIONS)
    lambdas = [float(v) for v in (opt["lambda"].split() if isinstance(opt["lambda"], str) else np.atleast_1d(opt["lambda"]))]
    folds = int(opt["n_folds"])
    if len(lambdas) > 1 and folds < 2:
        raise ValueError("several lambdas need n_folds of 2 or more")
    groups = names(groups)
    rows, counts = _prepared(df.withColumn("_label", y), "_label", x, groups)
    k = width_of(rows, F.col("_x"))
    t = _transform(kernel_func, kernel_params, k)
    width = k if t is None else t[0].shape[1]
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("double"), "_f": F.pmod(F.xxhash64("_x", "_y"), F.lit(max(folds, 1))).cast("double")}
    keys = [key for key, (n, _) in counts.items() if n]
    epsilon = {key: float((eps or {}).get(key, opt["epsilon"])) for key in keys}
    l2 = opt["norm"].lower() == "l2"

    def losses(state, xs, yy):
        z = xs @ state["coef"].T
        if classify:
            return np.maximum(0, 1 - yy[:, None] * z), -(yy[:, None] * (yy[:, None] * z < 1))
        r = z - yy[:, None]
        return np.maximum(0, np.abs(r) - state["epsilon"]), np.sign(r) * (np.abs(r) > state["epsilon"])

    def kernel(state, a):
        """[losses, rows, subgradients] of all combinations: hinge or epsilon-insensitive loss."""
        xs = _mapped(a["_x"], t)
        inside = a["_f"][:, None] != state["fold"][None]
        loss, slope = losses(state, xs, a["_y"])
        return np.concatenate(((loss * inside).sum(0), inside.sum(0), ((slope * inside).T @ xs).ravel()))

    def step(state, s):
        m = len(state["fold"])
        n, b, i = np.maximum(s[m : 2 * m], 1), state["coef"], state["iterations"]
        weight = state["lambda"]
        g = s[2 * m :].reshape(m, -1) / n[:, None] + weight[:, None] * (b if l2 else np.sign(b))
        loss = s[:m] / n + weight * (0.5 * (b * b).sum(1) if l2 else np.abs(b).sum(1))
        length = np.maximum(1.0, np.linalg.norm(g, axis=1))
        rate = state["rate"] if opt["decay_factor"] > 0 else opt["init_stepsize"] / (i + 1)
        done = state["loss"] is not None and bool((np.abs(state["loss"] - loss) < opt["tolerance"]).all())
        better = loss < state["best_loss"]
        move = rate * g * (1.0 if classify else (np.maximum(1.0, np.abs(b).max(axis=1)) / length)[:, None])
        return state | {
            "coef": b - move, "loss": loss, "iterations": i + 1, "rate": state["rate"] * (opt["decay_factor"] if opt["decay_factor"] > 0 else 1.0), "done": done,
            "best_loss": np.where(better, loss, state["best_loss"]), "best": np.where(better[:, None], b, state["best"]), "norm_of_gradient": float(np.linalg.norm(g[-1])),
        }

    def fit(by_group):
        """`by_group`: penalties and left-out folds (-1: none) of each group."""
        start = {}
        for key, (weight, fold) in by_group.items():
            zeros = np.zeros((len(fold), width))
            start[key] = {"coef": zeros, "best": zeros, "lambda": np.array(weight, float), "fold": np.array(fold, float), "epsilon": epsilon[key], "loss": None, "best_loss": np.full(len(fold), np.inf), "iterations": 0, "rate": opt["init_stepsize"]}
        return iterate(rows, groups, columns, kernel, start, step, opt["max_iter"])

    chosen, validation = {key: lambdas[0] for key in keys}, {key: None for key in keys}
    if folds >= 2:
        pairs = [(v, f) for v in lambdas for f in range(folds)]
        trained = fit({key: tuple(zip(*pairs)) for key in keys})
        shared = df.sparkSession.sparkContext.broadcast({key: {"coef": s["best"], "fold": s["fold"], "epsilon": s["epsilon"]} for key, s in trained.items()})

        def score(key, a):
            """Errors and rows of each combination's left-out fold: wrong signs, or squared errors."""
            state = shared.value[key]
            z = _mapped(a["_x"], t) @ state["coef"].T
            outside = a["_f"][:, None] == state["fold"][None]
            wrong = np.where(z >= 0, 1, -1) != a["_y"][:, None] if classify else (z - a["_y"][:, None]) ** 2
            return np.concatenate(((wrong * outside).sum(0), outside.sum(0)))

        for key, s in group_sums(rows, groups, columns, score).items():
            m = len(pairs)
            error = (s[:m] / np.maximum(s[m:], 1)).reshape(len(lambdas), folds)
            validation[key] = [(v, float(e.mean()), float(e.std(ddof=1))) for v, e in zip(lambdas, error)]
            chosen[key] = lambdas[int(np.argmin(error.mean(1)))]
    state = fit({key: ([chosen[key]], [-1]) for key in keys})
    return groups, counts, {key: s | {"validation": validation[key], "chosen": chosen[key]} for key, s in state.items()}, t


def _svm_table(df, groups, counts, state, t, extra=None):
    out = [
        {"_key": key, "coef": floats(s["best"][0]), "loss": float(s["best_loss"][0]), "norm_of_gradient": s.get("norm_of_gradient"), "num_iterations": s["iterations"], "num_rows_processed": counts[key][0], "num_rows_skipped": counts[key][1],
         "random_weights": None if t is None else [floats(r) for r in t[0]], "random_phases": None if t is None else floats(t[1]), "dep_var_mapping": extra, "lambda": s["chosen"], "validation": s["validation"]}
        for key, s in state.items()
    ]
    return model_frame(df, groups, out, "coef array<double>, loss double, norm_of_gradient double, num_iterations int, num_rows_processed long, num_rows_skipped long, random_weights array<array<double>>, random_phases array<double>, dep_var_mapping array<string>, lambda double, validation array<struct<lambda:double,mean_score:double,std_dev_score:double>>")


def svm_classification(df: DataFrame, y: str, x, kernel_func: str = "linear", kernel_params=None, groups=None, params=None) -> DataFrame:
    """A two-class support vector machine. Of the sorted labels the first counts as -1; not exactly two raise.

    Epochs are full subgradient steps, whose step size decays; the best coefficients seen are kept, so that
    results don't depend on how rows are partitioned. With `n_folds` in `params` the penalties in `lambda` are
    compared by their mean error over folds (by a hash of the row); `validation` has the errors.
    """
    labels = sorted(r[0] for r in df.select(expr(y).alias("v")).filter("v IS NOT NULL").distinct().limit(3).toLocalIterator())
    if len(labels) != 2:
        raise ValueError("a classification needs exactly two labels")
    code = F.when(expr(y) == F.lit(labels[0]), -1.0).when(expr(y) == F.lit(labels[1]), 1.0)
    return _svm_table(df, *_svm(df, code, x, kernel_func, kernel_params, groups, params, True), [str(v) for v in labels])


def svm_regression(df: DataFrame, y: str, x, kernel_func: str = "linear", kernel_params=None, groups=None, params=None, eps_table: DataFrame | None = None) -> DataFrame:
    """Epsilon-insensitive support vector regression. `eps_table` has the group columns and an `epsilon` for some groups."""
    eps = None
    if eps_table is not None:
        eps = {tuple(r[g] for g in names(groups)): r["epsilon"] for r in eps_table.toLocalIterator()}  # a row for each model
    return _svm_table(df, *_svm(df, expr(y).cast("double"), x, kernel_func, kernel_params, groups, params, False, eps))


def svm_predict(model: DataFrame, df: DataFrame, id_col: str, x) -> DataFrame:
    """(id, decision_function, prediction): a label by the sign of the decision, at zero the second; of a regression the value."""
    m = model.first()
    xc = features(df, x)
    if m.random_weights is not None:
        n = len(m.random_phases)
        weights = list(zip(*m.random_weights))
        xc = F.array(*[np.sqrt(2 / n) * F.cos(_dot(list(w), xc) + p) for w, p in zip(weights, m.random_phases)])
    score = _dot(m.coef, xc)
    label = score if m.dep_var_mapping is None else F.when(score >= 0, F.lit(m.dep_var_mapping[1])).otherwise(F.lit(m.dep_var_mapping[0]))
    return df.select(F.col(quoted(id_col)), score.alias("decision_function"), label.alias("prediction"))
