"""Linear, logistic and multinomial logistic regression, with robust and clustered variances.

Rows with nulls are skipped and counted; null grouping values raise. A model has a row for each group.
Features are an array column, a list of expressions, or text like ARRAY[1, a, b].
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.prob import evaluate
from corvane.operators.checks import complete, expr, features, names, no_null_groups, quoted
from corvane.operators.estimate import floats, group_sums, iterate, model_frame, packed, sym_pinv, unpacked, width_of

#: Features up to which the Gram matrix is a plain aggregate of the engine.
NATIVE = 16


def _t_two(t, df):
    return 2 * (1 - evaluate("students_t", "cdf", np.abs(t), df)) if df > 0 else np.full(len(t), np.nan)


def _z_two(z):
    return 2 * (1 - evaluate("normal", "cdf", np.abs(z), 0.0, 1.0))


def _ratio(coef, se):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((coef == 0) & (se == 0), 0.0, coef / se)


def _prepared(df: DataFrame, y: str, x, groups: list[str]):
    no_null_groups(df, groups)
    xc = features(df, x)
    rows = df.select(*[F.col(quoted(g)) for g in groups], expr(y).alias("_y"), xc.alias("_x"))
    good = complete(F.col("_y"), F.col("_x"))
    counts = {tuple(r[: len(groups)]): (r["n"], r["m"]) for r in rows.groupBy(*[quoted(g) for g in groups]).agg(F.count(F.when(good, 1)).alias("n"), F.count(F.when(~good, 1)).alias("m")).toLocalIterator()}
    return rows.filter(good), counts


def _native_gram(rows: DataFrame, groups: list[str], k: int) -> dict[tuple, np.ndarray]:
    """[n, sum y, sum yy, X'y, lower X'X] by plain aggregates, without Python on the executors."""
    x, y = [F.col("_x")[i] for i in range(k)], F.col("_y").cast("double")
    flat = rows.select(*[quoted(g) for g in groups], y.alias("_y"), *[c.alias(f"x{i}") for i, c in enumerate(x)], F.size("_x").alias("_k"))
    sums = [F.count("*").cast("double"), F.sum("_y"), F.sum(F.col("_y") * F.col("_y"))]
    sums += [F.sum(F.col("_y") * F.col(f"x{i}")) for i in range(k)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i + 1)]
    made = flat.groupBy(*[quoted(g) for g in groups]).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], F.min("_k").alias("k0"), F.max("_k").alias("k1"))
    out = {}
    for r in made.toLocalIterator():
        if r["k0"] is None:
            continue
        if r["k0"] != k or r["k1"] != k:
            raise ValueError("feature arrays differ in length")
        out[tuple(r[: len(groups)])] = np.array([r[f"s{i}"] for i in range(len(sums))])
    return out


def _gram_kernel(key, a):
    x, y = a["_x"], a["_y"]
    return np.concatenate(([len(y), y.sum(), y @ y], x.T @ y, packed(x.T @ x)))


def linregr_train(df: DataFrame, y: str, x, groups=None, heteroskedasticity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ordinary least squares: (model, summary).

    Model: group columns, coef, r2, std_err, t_stats, p_values, condition_no, bp_stats and bp_p_value (Breusch-Pagan,
    if asked for), num_rows_processed, num_missing_rows_skipped, variance_covariance.
    """
    groups = names(groups)
    rows, counts = _prepared(df, y, x, groups)
    k = width_of(rows, F.col("_x"))
    sums = _native_gram(rows, groups, k) if k <= NATIVE else group_sums(rows, groups, {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}, _gram_kernel)
    models = {}
    for key, s in sums.items():
        n, sy, syy, xy, xx = s[0], s[1], s[2], s[3 : 3 + k], unpacked(s[3 + k :], k)
        if not np.isfinite(s).all():
            raise ValueError("the dependent variable or the design matrix isn't finite")
        inv, condition = sym_pinv(xx)
        coef = inv @ xy
        ess, tss = coef @ xy - sy * sy / n, syy - sy * sy / n
        rss = max(tss - ess, 0.0)
        r2 = 1.0 if tss == 0 else min(max(ess / tss, 0.0), 1.0)
        var = rss / (n - k) if n > k else float("nan")
        se = np.sqrt(np.maximum(var * np.diag(inv), 0)) if n > k else np.full(k, np.nan)
        t = _ratio(coef, se)
        models[key] = {"coef": coef, "r2": r2, "std_err": se, "t_stats": t, "p_values": _t_two(t, n - k), "condition_no": float(np.sqrt(condition)), "n": n, "rss": rss, "inv": inv, "cov": inv * var}
    bp = {}
    if heteroskedasticity:
        states = {key: m["coef"] for key, m in models.items()}
        shared = df.sparkSession.sparkContext.broadcast(states)

        def kernel(key, a):
            u2 = (a["_y"] - a["_x"] @ shared.value[key]) ** 2
            return np.concatenate(([u2.sum(), (u2 * u2).sum()], a["_x"].T @ u2))

        for key, s in group_sums(rows, groups, {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}, kernel).items():
            m = models[key]
            mean = s[0] / m["n"]
            explained = s[2:] @ m["inv"] @ s[2:] - m["n"] * mean * mean
            total = s[1] - m["n"] * mean * mean
            stat = m["n"] * explained / total if total else 0.0
            bp[key] = (stat, 1 - float(evaluate("chi_squared", "cdf", np.array(max(stat, 0.0)), k - 1)) if k > 1 else None)
    out = []
    for key, m in models.items():
        out.append(
            {"_key": key, "coef": floats(m["coef"]), "r2": float(m["r2"]), "std_err": floats(m["std_err"]), "t_stats": floats(m["t_stats"]), "p_values": floats(m["p_values"]), "condition_no": m["condition_no"],
             "bp_stats": bp.get(key, (None, None))[0], "bp_p_value": bp.get(key, (None, None))[1], "num_rows_processed": int(m["n"]), "num_missing_rows_skipped": counts[key][1], "variance_covariance": [floats(r) for r in m["cov"]]}
        )
    schema = "coef array<double>, r2 double, std_err array<double>, t_stats array<double>, p_values array<double>, condition_no double, bp_stats double, bp_p_value double, num_rows_processed long, num_missing_rows_skipped long, variance_covariance array<array<double>>"
    return model_frame(df, groups, out, schema), _summary(df, "linregr", y, x, groups, counts)


def _summary(df, method, y, x, groups, counts, **more) -> DataFrame:
    row = {"method": method, "dependent_varname": str(y), "independent_varname": str(x), "num_rows_processed": sum(a for a, _ in counts.values()), "num_missing_rows_skipped": sum(b for _, b in counts.values()), "grouping_col": ",".join(groups) or None} | more
    kinds = {str: "string", int: "long", float: "double", type(None): "string", bool: "boolean"}
    return df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


def _dot(coef, x):
    return F.aggregate(F.zip_with(_column(coef), _column(x), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def _column(c):
    return F.col(c) if isinstance(c, str) else F.array(*[F.lit(float(v)) for v in c]) if isinstance(c, list | tuple | np.ndarray) else c


def linregr_predict(coef, x):
    """Column: the linear predictor."""
    return _dot(coef, x)


def logistic(x):
    """Column: 1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-_column(x)))


def logregr_predict(coef, x):
    return _dot(coef, x) >= 0


def logregr_predict_prob(coef, x):
    return logistic(_dot(coef, x))


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def _logit_kernel(state, a):
    """[log-likelihood, gradient, lower Hessian] with y in 0/1."""
    x, y = a["_x"], a["_y"]
    z = x @ state["coef"]
    p = _sigmoid(z)
    ll = -np.logaddexp(0, np.where(y > 0, -z, z)).sum()
    return np.concatenate(([ll], x.T @ (y - p), packed((x * (p * (1 - p))[:, None]).T @ x)))


def _newton(k, tolerance, per_row=False):
    """Newton steps by sums [log-likelihood, gradient, lower Hessian]; done when the log-likelihood moves less than `tolerance`."""

    def step(state, s):
        ll, g, h = s[0], s[1 : 1 + k], unpacked(s[1 + k : 1 + k + k * (k + 1) // 2], k)
        new = dict(state, ll=ll, hessian=h, iterations=state["iterations"] + 1)
        if not np.isfinite(s).all():
            return new | {"failed": True, "done": True}
        if state["ll"] is not None and abs(ll - state["ll"]) < tolerance:
            return new | {"done": True}
        inv, _ = sym_pinv(h)
        new["coef"] = state["coef"] + inv @ g
        return new

    return step


def _native_logit(rows: DataFrame, coef: np.ndarray) -> np.ndarray:
    """The kernel's sums over all rows by plain aggregates, without Python on the executors."""
    k = len(coef)
    x, y = [F.col("_x")[i] for i in range(k)], F.col("_y").cast("boolean").cast("double")
    flat = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"), sum((c * float(b) for c, b in zip(x, coef)), F.lit(0.0)).alias("z"), F.size("_x").alias("k"))
    flat = flat.withColumn("p", 0.5 * (1 + F.tanh(F.col("z") / 2))).withColumn("u", F.when(F.col("y") > 0, -F.col("z")).otherwise(F.col("z")))
    sums = [-F.sum(F.greatest("u", F.lit(0.0)) + F.log1p(F.exp(-F.abs("u"))))]
    sums += [F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))) for i in range(k)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * (F.col("p") * (1 - F.col("p")))) for i in range(k) for j in range(i + 1)]
    r = flat.agg(F.min("k"), F.max("k"), *sums).first()
    if r[0] != k or r[1] != k:
        raise ValueError("feature arrays differ in length")
    return np.array(r[2:], float)


def _passes(rows: DataFrame, groups: list[str], columns, start: dict, step, max_iter: int, k: int) -> dict:
    """`iterate` with the logistic kernel; a single narrow model is summed in the JVM."""
    if groups or k > NATIVE:
        return iterate(rows, groups, columns, _logit_kernel, start, step, max_iter)
    state = dict(start)
    for _ in range(max_iter):
        for key, s in state.items():
            if not s.get("done"):
                state[key] = step(s, _native_logit(rows, s["coef"]))
    return state


def _fit_logistic(rows: DataFrame, groups: list[str], keys, k: int, max_iter: int, optimizer: str, tolerance: float) -> dict:
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("boolean").cast("double")}
    start = {key: {"coef": np.zeros(k), "ll": None, "iterations": 0} for key in keys}
    if optimizer in ("newton", "irls"):
        state = _passes(rows, groups, columns, start, _newton(k, tolerance), max_iter, k)
    elif optimizer == "cg":
        state = _passes(rows, groups, columns, start, _conjugate(k, tolerance), max_iter, k)
    elif optimizer == "igd":
        state = _passes(rows, groups, columns, start, _descent(k, tolerance), max_iter, k)
    else:
        raise ValueError("optimizer is newton, irls, cg or igd")
    last = _passes(rows, groups, columns, {key: {"coef": s["coef"]} for key, s in state.items()}, lambda s, sums: s | {"sums": sums, "done": True}, 1, k)
    for key, s in state.items():
        sums = last[key].get("sums")
        if sums is None or not np.isfinite(sums).all():
            s["failed"] = True
            continue
        s["ll"], s["hessian"] = sums[0], unpacked(sums[1 + k :], k)
    return state


def _conjugate(k, tolerance):
    """Polak-Ribiere directions with an exact Newton step along each."""

    def step(state, s):
        ll, g, h = s[0], s[1 : 1 + k], unpacked(s[1 + k :], k)
        new = dict(state, ll=ll, iterations=state["iterations"] + 1)
        if state["ll"] is not None and abs(ll - state["ll"]) < tolerance:
            return new | {"done": True}
        old = state.get("g")
        beta = 0.0 if old is None or not old @ old else max(0.0, g @ (g - old) / (old @ old))
        d = g + beta * state.get("d", np.zeros(k))
        curve = d @ h @ d
        new["coef"] = state["coef"] + (g @ d / curve if curve > 0 else 0.0) * d
        return new | {"g": g, "d": d}

    return step


def _descent(k, tolerance):
    """Diagonally scaled gradient steps."""

    def step(state, s):
        ll, g, h = s[0], s[1 : 1 + k], unpacked(s[1 + k :], k)
        new = dict(state, ll=ll, iterations=state["iterations"] + 1)
        if state["ll"] is not None and abs(ll - state["ll"]) < tolerance:
            return new | {"done": True}
        worse = state["ll"] is not None and ll < state["ll"]
        rate = state.get("rate", 0.5) * (0.5 if worse else 1.0)
        d = np.diag(h)
        new["coef"] = state["coef"] + rate * np.divide(g, d, out=np.zeros(k), where=d > 0)
        return new | {"rate": rate}

    return step


def logregr_train(df: DataFrame, y: str, x, groups=None, max_iter: int = 20, optimizer: str = "irls", tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Binary logistic regression: (model, summary). The model of a group that can't be fitted has null coefficients."""
    groups = names(groups)
    rows, counts = _prepared(df, y, x, groups)
    k = width_of(rows, F.col("_x"))
    state = _fit_logistic(rows, groups, [key for key, (n, _) in counts.items() if n], k, max_iter, optimizer, tolerance)
    out = []
    for key, s in state.items():
        if s.get("failed"):
            out.append({"_key": key, "num_rows_processed": counts[key][0], "num_missing_rows_skipped": counts[key][1], "num_iterations": s["iterations"]})
            continue
        inv, condition = sym_pinv(s["hessian"])
        se = np.sqrt(np.diag(inv))
        z = _ratio(s["coef"], se)
        out.append(
            {"_key": key, "coef": floats(s["coef"]), "log_likelihood": float(s["ll"]), "std_err": floats(se), "z_stats": floats(z), "p_values": floats(_z_two(z)), "odds_ratios": floats(np.exp(s["coef"])), "condition_no": float(condition),
             "num_rows_processed": counts[key][0], "num_missing_rows_skipped": counts[key][1], "num_iterations": s["iterations"], "variance_covariance": [floats(r) for r in inv]}
        )
    schema = "coef array<double>, log_likelihood double, std_err array<double>, z_stats array<double>, p_values array<double>, odds_ratios array<double>, condition_no double, num_rows_processed long, num_missing_rows_skipped long, num_iterations int, variance_covariance array<array<double>>"
    return model_frame(df, groups, out, schema), _summary(df, "logregr", y, x, groups, counts, optimizer=f"optimizer={optimizer}, max_iter={max_iter}, tolerance={tolerance}")


# multinomial logistic


def _softmax(x, coef, levels, k):
    z = np.concatenate((np.zeros((len(x), 1)), x @ coef.reshape(levels - 1, k).T), axis=1)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _mlogit_kernel(state, a):
    """[log-likelihood, gradient, lower Hessian]; y is 0 for the reference category, else its place."""
    x, y, levels = a["_x"], a["_y"].astype(int), state["levels"]
    k = x.shape[1]
    p = _softmax(x, state["coef"], levels, k)
    ll = np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1
    g = ((hit - p)[:, 1:].T @ x).ravel()
    h = np.zeros((levels - 1, k, levels - 1, k))
    for i in range(levels - 1):
        for j in range(i + 1):
            w = p[:, i + 1] * ((i == j) - p[:, j + 1])
            block = (x * w[:, None]).T @ x
            h[i, :, j], h[j, :, i] = block, block
    return np.concatenate(([ll], g, packed(h.reshape((levels - 1) * k, -1))))


def _coded(df: DataFrame, y: str, ref):
    """Category values, the reference first, and the column of their places."""
    values = sorted(r[0] for r in df.select(expr(y).alias("v")).filter("v IS NOT NULL").distinct().toLocalIterator())
    ref = values[0] if ref is None else ref
    if ref not in values:
        raise ValueError("the reference category doesn't occur")
    order = [ref, *[v for v in values if v != ref]]
    code = F.coalesce(*[F.when(expr(y) == F.lit(v), F.lit(i)) for i, v in enumerate(order)])
    return order, code


def fit_mlogit(df: DataFrame, y: str, x, groups, ref, max_iter, tolerance):
    groups = names(groups)
    order, code = _coded(df, y, ref)
    rows, counts = _prepared(df.withColumn("_code", code), "_code", x, groups)
    k, levels = width_of(rows, F.col("_x")), len(order)
    width = (levels - 1) * k
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}
    start = {key: {"coef": np.zeros(width), "ll": None, "iterations": 0, "levels": levels} for key, (n, _) in counts.items() if n}
    state = iterate(rows, groups, columns, _mlogit_kernel, start, _newton(width, tolerance), max_iter)
    return groups, order, rows, counts, k, state


def mlogregr_train(df: DataFrame, y: str, x, ref_category=None, groups=None, max_iter: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Multinomial logistic regression against a reference category: a row for each group and other category."""
    groups, order, rows, counts, k, state = fit_mlogit(df, y, x, groups, ref_category, max_iter, tolerance)
    out = []
    for key, s in state.items():
        inv, condition = sym_pinv(s["hessian"])
        for i, value in enumerate(order[1:]):
            part = slice(i * k, (i + 1) * k)
            coef, se = s["coef"][part], np.sqrt(np.diag(inv)[part])
            z = _ratio(coef, se)
            out.append(
                {"_key": key, "category": str(value), "ref_category": str(order[0]), "coef": floats(coef), "log_likelihood": float(s["ll"]), "std_err": floats(se), "z_stats": floats(z), "p_values": floats(_z_two(z)),
                 "odds_ratios": floats(np.exp(coef)), "condition_no": float(condition), "num_rows_processed": counts[key][0], "num_missing_rows_skipped": counts[key][1], "num_iterations": s["iterations"]}
            )
    schema = "category string, ref_category string, coef array<double>, log_likelihood double, std_err array<double>, z_stats array<double>, p_values array<double>, odds_ratios array<double>, condition_no double, num_rows_processed long, num_missing_rows_skipped long, num_iterations int"
    return model_frame(df, groups, out, schema)


def mlogregr_predict(model: DataFrame, df: DataFrame, id_col: str, x, kind: str = "response") -> DataFrame:
    """(id, category) or with kind "prob" (id, category, probability) for each category. Models without groups."""
    found = [(r.category, r.coef, r.ref_category) for r in model.toLocalIterator()]
    xc = features(df, x)
    score = [F.struct(F.lit(0.0).alias("z"), F.lit(found[0][2]).alias("category"))] + [F.struct(_dot(c, xc).alias("z"), F.lit(v).alias("category")) for v, c, _ in found]
    made = df.select(F.col(quoted(id_col)), F.array(*score).alias("s"))
    if kind == "response":
        return made.select(id_col, F.array_max("s")["category"].alias("category"))
    total = F.aggregate("s", F.lit(0.0), lambda a, e: a + F.exp(e["z"]))
    return made.withColumn("t", total).select(id_col, "t", F.explode("s").alias("e")).select(id_col, "e.category", (F.exp("e.z") / F.col("t")).alias("probability"))


# robust and clustered variances


def _sandwich(df, groups, rows, states, kernel, columns, k, cluster=None):
    """Meat of the sandwich: sums of outer products of scores, by row or summed by cluster first."""
    shared = df.sparkSession.sparkContext.broadcast(states)
    if cluster is None:

        def outer(key, a):
            u = kernel(shared.value[key], a)
            return packed(u.T @ u)

        return {key: (unpacked(s, k), None) for key, s in group_sums(rows, groups, columns, outer).items()}
    import pyarrow as pa

    keys = [quoted(g) for g in groups]
    flat = rows.select(*keys, F.col("_c").cast("string").alias("_c"), *[c.alias(n) for n, c in columns.items()])
    kinds = [f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups]
    fields = list(columns)

    def scores(batches):
        from corvane.operators.estimate import to_numpy

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*[batch.column(g).to_pylist() for g in groups])) if groups else [()] * batch.num_rows
            arrays = {n: to_numpy(batch.column(n)) for n in fields}
            u = np.zeros((batch.num_rows, k))
            for key in set(ids):
                index = np.array([i for i, v in enumerate(ids) if v == key])
                u[index] = kernel(shared.value[key], {n: a[index] for n, a in arrays.items()})
            u = pa.ListArray.from_arrays(np.arange(0, u.size + 1, k).astype(np.int32), u.ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(g) for g in groups], batch.column("_c"), u], names=[*groups, "_c", "u"])

    made = flat.mapInArrow(scores, ", ".join([*kinds, "_c string", "u array<double>"]))
    summed = made.groupBy(*keys, "_c").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(k)]).alias("u"))
    sums = group_sums(summed, groups, {"u": F.col("u")}, lambda key, a: np.concatenate(([len(a["u"])], packed(a["u"].T @ a["u"]))))
    return {key: (unpacked(s[1:], k), s[0]) for key, s in sums.items()}


def _variance_table(df, groups, models, meat, bread, counts, clustered: bool, t_stats: bool) -> DataFrame:
    out = []
    for key, m in models.items():
        inv = bread[key]
        middle, clusters = meat[key]
        v = inv @ middle @ inv
        n, k = counts[key][0], len(inv)
        if clustered:
            v *= clusters / (clusters - 1) * (n - 1) / (n - k) if clusters > 1 and n > k else 1.0
        se = np.sqrt(np.maximum(np.diag(v), 0))
        t = _ratio(m, se)
        out.append({"_key": key, "coef": floats(m), "std_err": floats(se), "stats": floats(t), "p_values": floats(_t_two(t, n - k) if t_stats else _z_two(t)), "num_clusters": int(clusters) if clusters is not None else None})
    return model_frame(df, groups, out, "coef array<double>, std_err array<double>, stats array<double>, p_values array<double>, num_clusters long")


def _linear_states(rows, groups, k):
    states, bread = {}, {}
    for key, s in (_native_gram(rows, groups, k) if k <= NATIVE else group_sums(rows, groups, {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}, _gram_kernel)).items():
        inv, _ = sym_pinv(unpacked(s[3 + k :], k))
        states[key], bread[key] = inv @ s[3 : 3 + k], inv
    return states, bread


def _with_cluster(df, y, x, groups, cluster):
    no_null_groups(df, groups)
    rows = df.select(*[F.col(quoted(g)) for g in groups], expr(y).alias("_y"), features(df, x).alias("_x"), *([expr(cluster).alias("_c")] if cluster else []))
    good = complete(F.col("_y"), F.col("_x")) & (F.col("_c").isNotNull() if cluster else F.lit(True))
    rows = rows.filter(good)
    counts = {tuple(r[: len(groups)]): (r["count"], 0) for r in rows.groupBy(*[quoted(g) for g in groups]).count().toLocalIterator()}
    return rows, counts


def _variance_linregr(df, y, x, groups, cluster):
    groups = names(groups)
    rows, counts = _with_cluster(df, y, x, groups, cluster)
    k = width_of(rows, F.col("_x"))
    states, bread = _linear_states(rows, groups, k)
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}
    kernel = lambda coef, a: a["_x"] * (a["_y"] - a["_x"] @ coef)[:, None]
    meat = _sandwich(df, groups, rows, states, kernel, columns, k, cluster)
    if not cluster:  # HC1: scaled for the degrees of freedom
        meat = {key: (m * (counts[key][0] / (counts[key][0] - k) if counts[key][0] > k else 1.0), c) for key, (m, c) in meat.items()}
    return _variance_table(df, groups, states, meat, bread, counts, bool(cluster), True)


def robust_variance_linregr(df: DataFrame, y: str, x, groups=None) -> DataFrame:
    """Huber-White variance of a linear regression."""
    return _variance_linregr(df, y, x, groups, None)


def clustered_variance_linregr(df: DataFrame, y: str, x, cluster: str, groups=None) -> DataFrame:
    """Cluster-robust variance of a linear regression."""
    return _variance_linregr(df, y, x, groups, cluster)


def _variance_logregr(df, y, x, groups, cluster, max_iter, optimizer, tolerance):
    groups = names(groups)
    rows, counts = _with_cluster(df, y, x, groups, cluster)
    k = width_of(rows, F.col("_x"))
    state = _fit_logistic(rows, groups, list(counts), k, max_iter, optimizer, tolerance)
    states = {key: s["coef"] for key, s in state.items()}
    bread = {key: sym_pinv(s["hessian"])[0] for key, s in state.items()}
    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("boolean").cast("double")}
    kernel = lambda coef, a: a["_x"] * (a["_y"] - _sigmoid(a["_x"] @ coef))[:, None]
    meat = _sandwich(df, groups, rows, states, kernel, columns, k, cluster)
    return _variance_table(df, groups, states, meat, bread, counts, bool(cluster), False)


def robust_variance_logregr(df: DataFrame, y: str, x, groups=None, max_iter: int = 20, optimizer: str = "irls", tolerance: float = 1e-4) -> DataFrame:
    return _variance_logregr(df, y, x, groups, None, max_iter, optimizer, tolerance)


def clustered_variance_logregr(df: DataFrame, y: str, x, cluster: str, groups=None, max_iter: int = 20, optimizer: str = "irls", tolerance: float = 1e-4) -> DataFrame:
    return _variance_logregr(df, y, x, groups, cluster, max_iter, optimizer, tolerance)


def _variance_mlogregr(df, y, x, cluster, ref, groups, max_iter, tolerance):
    groups, order, rows, counts, k, state = fit_mlogit(df, y, x, groups, ref, max_iter, tolerance)
    levels = len(order)
    if cluster:
        coded = df.withColumn("_code", F.coalesce(*[F.when(expr(y) == F.lit(v), F.lit(i)) for i, v in enumerate(order)]))
        rows, counts = _with_cluster(coded, "_code", x, groups, cluster)
    states = {key: s["coef"] for key, s in state.items()}
    bread = {key: sym_pinv(s["hessian"])[0] for key, s in state.items()}

    def kernel(coef, a):
        x, y = a["_x"], a["_y"].astype(int)
        p = _softmax(x, coef, levels, k)
        hit = np.zeros_like(p)
        hit[np.arange(len(y)), y] = 1
        return ((hit - p)[:, 1:, None] * x[:, None, :]).reshape(len(x), -1)

    columns = {"_x": F.col("_x"), "_y": F.col("_y").cast("double")}
    meat = _sandwich(df, groups, rows, states, kernel, columns, (levels - 1) * k, cluster)
    return _variance_table(df, groups, states, meat, bread, counts, bool(cluster), False)


def robust_variance_mlogregr(df: DataFrame, y: str, x, ref_category=None, groups=None, max_iter: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Robust variance of a multinomial logistic regression; coefficients category by category, the reference left out."""
    return _variance_mlogregr(df, y, x, None, ref_category, groups, max_iter, tolerance)


def clustered_variance_mlogregr(df: DataFrame, y: str, x, cluster: str, ref_category=None, groups=None, max_iter: int = 20, tolerance: float = 1e-4) -> DataFrame:
    return _variance_mlogregr(df, y, x, cluster, ref_category, groups, max_iter, tolerance)


# marginal effects


def margins_logregr(df: DataFrame, y: str, x, groups=None, marginal_vars: list[int] | None = None, max_iter: int = 20, optimizer: str = "irls", tolerance: float = 1e-4) -> DataFrame:
    """Average marginal effects of a logistic regression, with standard errors by the delta method."""
    groups = names(groups)
    rows, counts = _prepared(df, y, x, groups)
    k = width_of(rows, F.col("_x"))
    state = _fit_logistic(rows, groups, [key for key, (n, _) in counts.items() if n], k, max_iter, optimizer, tolerance)
    shared = df.sparkSession.sparkContext.broadcast({key: s["coef"] for key, s in state.items()})

    def kernel(key, a):
        b, x = shared.value[key], a["_x"]
        p = _sigmoid(x @ b)
        w = p * (1 - p)
        return np.concatenate(([w.sum()], x.T @ (w * (1 - 2 * p))))

    sums = group_sums(rows, groups, {"_x": F.col("_x")}, kernel)
    out = []
    for key, s in state.items():
        n, b, t = counts[key][0], s["coef"], sums[key]
        v, _ = sym_pinv(s["hessian"])
        effect = b * t[0] / n
        delta = np.eye(k) * t[0] / n + np.outer(b, t[1:]) / n
        se = np.sqrt(np.maximum(np.diag(delta @ v @ delta.T), 0))
        z = _ratio(effect, se)
        keep = [i - 1 for i in marginal_vars] if marginal_vars else range(k)
        keep = list(keep)
        out.append({"_key": key, "variables": [i + 1 for i in keep], "margins": floats(effect[keep]), "std_err": floats(se[keep]), "z_stats": floats(z[keep]), "p_values": floats(_z_two(z)[keep])})
    return model_frame(df, groups, out, "variables array<int>, margins array<double>, std_err array<double>, z_stats array<double>, p_values array<double>")


def margins_linregr(df: DataFrame, y: str, x, groups=None) -> DataFrame:
    """Marginal effects of a linear regression: its coefficients."""
    model, _ = linregr_train(df, y, x, groups)
    variables = F.transform(F.sequence(F.lit(1), F.size("coef")), lambda i: i)
    return model.select(*[quoted(g) for g in names(groups)], variables.alias("variables"), F.col("coef").alias("margins"), "std_err", F.col("t_stats").alias("z_stats"), "p_values")


def margins_mlogregr(df: DataFrame, y: str, x, ref_category=None, groups=None, marginal_vars: list[int] | None = None, max_iter: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Average marginal effects of a multinomial logistic regression, a row for each category but the reference."""
    groups, order, rows, counts, k, state = fit_mlogit(df, y, x, groups, ref_category, max_iter, tolerance)
    levels = len(order)
    shared = df.sparkSession.sparkContext.broadcast({key: s["coef"] for key, s in state.items()})
    width = (levels - 1) * k

    def kernel(key, a):
        """Sums of the effects and of their derivatives by all coefficients."""
        x, b = a["_x"], shared.value[key]
        beta = np.concatenate((np.zeros((1, k)), b.reshape(levels - 1, k)))
        p = _softmax(x, b, levels, k)
        mean = p @ beta
        effect = p[:, :, None] * (beta[None] - mean[:, None, :])
        d = np.zeros((levels - 1, k, levels - 1, k))
        for j in range(1, levels):
            for c in range(1, levels):
                dp = p[:, j] * ((j == c) - p[:, c])  # times x, by coefficient of c
                first = (dp[:, None] * x).T @ (beta[j] - mean)  # [coefficient, effect]
                dmean = p[:, c]
                through = np.einsum("n,nq,nm->qm", p[:, j] * dmean, x, beta[c] - mean)
                d[j - 1, :, c - 1, :] = (first - through).T
                d[j - 1, :, c - 1, :] += np.eye(k) * (p[:, j] * ((j == c) - p[:, c])).sum()
        return np.concatenate((effect[:, 1:].sum(axis=0).ravel(), d.ravel()))

    sums = group_sums(rows, groups, {"_x": F.col("_x")}, kernel)
    out = []
    for key, s in state.items():
        n = counts[key][0]
        effect, delta = sums[key][:width] / n, sums[key][width:].reshape(width, width) / n
        v, _ = sym_pinv(s["hessian"])
        se = np.sqrt(np.maximum(np.diag(delta @ v @ delta.T), 0))
        keep = [i - 1 for i in marginal_vars] if marginal_vars else list(range(k))
        for j, value in enumerate(order[1:]):
            e, q = effect[j * k : (j + 1) * k][keep], se[j * k : (j + 1) * k][keep]
            z = _ratio(e, q)
            out.append({"_key": key, "category": str(value), "ref_category": str(order[0]), "variables": [i + 1 for i in keep], "margins": floats(e), "std_err": floats(q), "z_stats": floats(z), "p_values": floats(_z_two(z))})
    return model_frame(df, groups, out, "category string, ref_category string, variables array<int>, margins array<double>, std_err array<double>, z_stats array<double>, p_values array<double>")


def margins(df: DataFrame, kind: str, y: str, x, **more) -> DataFrame:
    """Average marginal effects: kind is linregr, logregr or mlogregr."""
    return {"linregr": margins_linregr, "logregr": margins_logregr, "mlogregr": margins_mlogregr}[kind](df, y, x, **more)
