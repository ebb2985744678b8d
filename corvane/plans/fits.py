"""Queries of model fits, each parameter a row, held against Newton's method in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import glm as G
from corvane.operators import penalized as PE
from corvane.operators import regress as R
from corvane.plans import laws
from corvane.plans import newton as N
from corvane.plans.registry import register, rounded, table

X = ["1", "l_quantity / 50", "l_discount"]
_ROWS = "1.0::DOUBLE AS x_0, l_quantity / 50 AS x_1, CAST(l_discount AS DOUBLE) AS x_2"
_X = ["x_0", "x_1", "x_2"]


def lineitem(spark, sf):
    return table(spark, sf, "lineitem").withColumn("hi", F.col("l_extendedprice") > 35000).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _data(y: str, g: str = "0", more: str = "", x: str = _ROWS) -> str:
    return f"SELECT {g} AS g, CAST({y} AS DOUBLE) AS y, {x}{more} FROM lineitem"


def spread(df, arrays: dict[str, str], keys=(), scalars=(), digits: int = 4):
    """One row for each parameter of each model: keys, p, the arrays' elements and the scalars."""
    z = df.select(*keys, *scalars, F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for c, n in arrays.items()])).alias("p", "z"))
    return rounded(z.select(*keys, "p", *[F.col(f"z.{n}").alias(n) for n in arrays.values()], *scalars), digits)


def _z_p(z: str) -> str:
    return f"CASE WHEN abs({z}) > 8 THEN 0 ELSE 2 * (1 - {laws._normal(f'abs({z})')}) END"


def _final(columns: dict[str, list[str]], k: int, source: str = "f", key: str | None = None, scalars: str = "", digits: int = 4) -> str:
    """The end of a query: rounded columns of each parameter."""
    inner = N.rows(columns, k, source, "g" + (f", {scalars}" if scalars else ""))
    names = [*columns, *[s.split(" AS ")[-1].strip() for s in scalars.split(", ") if s]]
    cells = ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" if n not in ("n", "num_rows", "num_clusters") else n for n in names)
    return f"SELECT {f'g AS {key}, ' if key else ''}p, {cells} FROM ({inner})"


def _b(k: int) -> list[str]:
    return [f"b_{i}" for i in range(k)]


def _se(k: int, by: str = "") -> list[str]:
    return [f"sqrt(v_{i}_{i}{by})" for i in range(k)]


# least squares

_OLS = dict(k=3, let=[("e", f"y - ({N.dot(_X)})")], score=[f"e * {x}" for x in _X], info=lambda i, j: f"x_{i} * x_{j}", start=["0.0::DOUBLE"] * 3, steps=2)
_MORE = {"rss": "sum(e * e)", "tss": "var_pop(y) * count(*)"}


def _ols(g: str = "0", more: str = "") -> str:
    return N.fit(_data("l_extendedprice", g, more), more=_MORE, **_OLS)


def _ratio(a: list[str], b: list[str]) -> list[str]:
    return [f"{x} / {y}" for x, y in zip(a, b)]


_S = _se(3, " * rss / (n - 3)")
register(
    "linregr_statistics",
    lambda s, f: spread(R.linregr_train(lineitem(s, f), "l_extendedprice", X, "l_returnflag")[0], {"coef": "coef", "std_err": "std_err", "t_stats": "t_stats"}, ["l_returnflag"], ["r2"]),
    f"WITH {_ols('l_returnflag')} {_final({'coef': _b(3), 'std_err': _S, 't_stats': _ratio(_b(3), _S)}, 3, key='l_returnflag', scalars='1 - rss / tss AS r2')}",
)
_U = f"SELECT d.g, d.x_0, d.x_1, d.x_2, power(y - ({N.dot(_X)}), 2) AS u FROM d JOIN f ON d.g = f.g"
_BP = f"SELECT g, count(*) AS m, sum(u) AS s, sum(u * u) AS q, {', '.join(f'sum(u * x_{i}) AS z_{i}' for i in range(3))} FROM ({_U}) GROUP BY g"
_EXPLAINED = " + ".join(f"z_{i} * v_{i}_{j} * z_{j}" for i in range(3) for j in range(3))
register(
    "heteroskedasticity_test_linregr",
    lambda s, f: rounded(R.linregr_train(lineitem(s, f), "l_extendedprice", X, "l_returnflag", True)[0].select("l_returnflag", "bp_stats", "bp_p_value")),
    f"WITH {_ols('l_returnflag')}, h AS (SELECT g, m * ({_EXPLAINED} - s * s / m) / (q - s * s / m) AS b FROM f JOIN ({_BP}) USING (g)) SELECT g AS l_returnflag, round(b, 4) AS bp_stats, round(exp(-b / 2), 4) AS bp_p_value FROM h",
)
register(
    "linregr_summary",
    lambda s, f: R.linregr_train(lineitem(s, f), "l_extendedprice", X, None, True)[1].select("method", "dependent_varname", "num_rows_processed", "num_missing_rows_skipped"),
    "SELECT 'linregr' AS method, 'l_extendedprice' AS dependent_varname, count(*) AS num_rows_processed, 0 AS num_missing_rows_skipped FROM lineitem",
)
_ROBUST = {"coef": "coef", "std_err": "std_err", "stats": "stats"}
_Q = [f"sqrt(q_{i})" for i in range(6)]


def _robust(name, f, fit, k, score, let, cluster=None, scale="1", more=()):
    columns = {"coef": _b(k), "std_err": _Q[:k], "stats": _ratio(_b(k), _Q[:k])}
    register(name, lambda s, sf: spread(f(lineitem(s, sf)), _ROBUST, scalars=more), f"WITH {fit}, {N.sandwich(k, score, let, cluster, scale)} {_final(columns, k, 'w', scalars='m AS num_clusters' if more else '')}")


_CLUSTERED = "m / (m - 1) * (n - 1) / (n - {})"
_SUPPLIER = ", l_suppkey AS c"
_robust("robust_variance_linregr", lambda d: R.robust_variance_linregr(d, "l_extendedprice", X), _ols(), 3, _OLS["score"], _OLS["let"], scale="n / (n - 3)")
_robust("clustered_variance_linregr", lambda d: R.clustered_variance_linregr(d, "l_extendedprice", X, "l_suppkey"), _ols(more=_SUPPLIER), 3, _OLS["score"], _OLS["let"], "c", _CLUSTERED.format(3), ["num_clusters"])
register(
    "margins",
    lambda s, f: spread(R.margins(lineitem(s, f), "linregr", "l_extendedprice", X), {"margins": "margins", "std_err": "std_err", "z_stats": "z_stats"}),
    f"WITH {_ols()} {_final({'margins': _b(3), 'std_err': _S, 'z_stats': _ratio(_b(3), _S)}, 3)}",
)

# logistic

_LOGIT = dict(k=3, let=[("eta", N.dot(_X)), ("q", "1 / (1 + exp(-eta))")], score=[f"(y - q) * {x}" for x in _X], info=lambda i, j: f"q * (1 - q) * x_{i} * x_{j}", start=["0.0::DOUBLE"] * 3, steps=9)


def _logit(g: str = "0", more: str = "", **sums) -> str:
    return N.fit(_data("l_extendedprice > 35000", g, more), more={"ll": "sum(ln(CASE WHEN y > 0 THEN q ELSE 1 - q END))"} | sums, **_LOGIT)


_Z = _ratio(_b(3), _se(3))
_LOGIT_COLUMNS = {"coef": _b(3), "std_err": _se(3), "z_stats": _Z, "p_values": [_z_p(z) for z in _Z], "odds_ratios": [f"exp({b})" for b in _b(3)]}
_TIGHT = dict(tolerance=1e-12, max_iter=40)
register(
    "logregr_train",
    lambda s, f: spread(R.logregr_train(lineitem(s, f), "hi", X, "l_returnflag", **_TIGHT)[0].withColumnRenamed("log_likelihood", "ll"), {c: c for c in _LOGIT_COLUMNS}, ["l_returnflag"], ["ll"], 3),
    f"WITH {_logit('l_returnflag')} {_final(_LOGIT_COLUMNS, 3, key='l_returnflag', scalars='ll', digits=3)}",
)
register(
    "logregr_train_cg",
    lambda s, f: spread(R.logregr_train(lineitem(s, f), "hi", X, None, 300, "cg", 1e-13)[0], {"coef": "coef", "std_err": "std_err"}, digits=2),
    f"WITH {_logit()} {_final({'coef': _b(3), 'std_err': _se(3)}, 3, digits=2)}",
)
_robust("robust_variance_logregr", lambda d: R.robust_variance_logregr(d, "hi", X, **_TIGHT), _logit(), 3, _LOGIT["score"], _LOGIT["let"])
_robust("clustered_variance_logregr", lambda d: R.clustered_variance_logregr(d, "hi", X, "l_suppkey", **_TIGHT), _logit(more=_SUPPLIER), 3, _LOGIT["score"], _LOGIT["let"], "c", _CLUSTERED.format(3), ["num_clusters"])
_W = {"w": "sum(q * (1 - q))"} | {f"w_{i}": f"sum(q * (1 - q) * (1 - 2 * q) * x_{i})" for i in range(3)}


def _delta(i: int, j: int) -> str:
    return f"({f'w + ' if i == j else ''}b_{i} * w_{j}) / n"


_MARGIN_SE = [f"sqrt({' + '.join(f'{_delta(i, a)} * v_{a}_{b} * {_delta(i, b)}' for a in range(3) for b in range(3))})" for i in range(3)]
_EFFECT = [f"b_{i} * w / n" for i in range(3)]
register(
    "margins_logregr",
    lambda s, f: spread(R.margins_logregr(lineitem(s, f), "hi", X, **_TIGHT), {"margins": "margins", "std_err": "std_err", "z_stats": "z_stats"}),
    f"WITH {_logit(**_W)} {_final({'margins': _EFFECT, 'std_err': _MARGIN_SE, 'z_stats': _ratio(_EFFECT, _MARGIN_SE)}, 3)}",
)

# multinomial, against the first category

_PARTS = [(c, i) for c in (1, 2) for i in range(3)]
_MULTI = dict(
    k=6, let=[("e_1", f"exp({N.dot(_X)})"), ("e_2", f"exp({N.dot(_X, 3)})"), ("q_1", "e_1 / (1 + e_1 + e_2)"), ("q_2", "e_2 / (1 + e_1 + e_2)")], score=[f"(CASE WHEN y = {c} THEN 1 ELSE 0 END - q_{c}) * x_{i}" for c, i in _PARTS],
    info=lambda a, b: f"q_{_PARTS[a][0]} * ({int(_PARTS[a][0] == _PARTS[b][0])} - q_{_PARTS[b][0]}) * x_{_PARTS[a][1]} * x_{_PARTS[b][1]}", start=["0.0::DOUBLE"] * 6, steps=7,
)
_FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _multi(more: str = "", **sums) -> str:
    return N.fit(_data(_FLAG, more=more), more={"ll": "sum(ln(CASE WHEN y = 1 THEN q_1 WHEN y = 2 THEN q_2 ELSE 1 - q_1 - q_2 END))"} | sums, **_MULTI)


_CATEGORY = "CASE WHEN p < 3 THEN 'N' ELSE 'R' END AS category, p % 3 AS p"
_MULTI_COLUMNS = {"coef": _b(6), "std_err": _se(6), "z_stats": _ratio(_b(6), _se(6))}


def _by_category(sql: str) -> str:
    return sql.replace("SELECT p, round", f"SELECT {_CATEGORY}, round")


_MULTI_SQL = f"WITH {_multi()} " + _by_category(_final(_MULTI_COLUMNS, 6, scalars="ll", digits=3))
for _name, _f in (("mlogregr_train", lambda d: R.mlogregr_train(d, "l_returnflag", X, **_TIGHT)), ("multinom", lambda d: G.multinom(d, "l_returnflag", X, optim_params="tolerance=1e-12"))):
    register(_name, lambda s, f, g=_f: spread(g(lineitem(s, f)).withColumnRenamed("log_likelihood", "ll"), {c: c for c in _MULTI_COLUMNS}, ["category"], ["ll"], 3), _MULTI_SQL)
_robust("robust_variance_mlogregr", lambda d: R.robust_variance_mlogregr(d, "l_returnflag", X, **_TIGHT), _multi(), 6, _MULTI["score"], _MULTI["let"])
_robust("clustered_variance_mlogregr", lambda d: R.clustered_variance_mlogregr(d, "l_returnflag", X, "l_suppkey", **_TIGHT), _multi(_SUPPLIER), 6, _MULTI["score"], _MULTI["let"], "c", _CLUSTERED.format(6), ["num_clusters"])
_MEAN = [f"(q_1 * b_{i} + q_2 * b_{3 + i})" for i in range(3)]
_MULTI_EFFECTS = {f"h_{c}_{i}": f"avg(q_{c} * (b_{i + 3 * (c - 1)} - {_MEAN[i]}))" for c, i in _PARTS}
register(
    "margins_mlogregr",
    lambda s, f: spread(R.margins_mlogregr(lineitem(s, f), "l_returnflag", X, **_TIGHT), {"margins": "margins"}, ["category"], digits=5),
    f"WITH {_multi(**_MULTI_EFFECTS)} " + _by_category(_final({"margins": list(_MULTI_EFFECTS)}, 6, digits=5)),
)
_PREDICTED = "SELECT id, e_1, e_2 FROM (SELECT l_orderkey * 10 + l_linenumber AS id, {} AS e_1, {} AS e_2 FROM (SELECT l.*, 1.0::DOUBLE AS x_0, l_quantity / 50 AS x_1, l_discount AS x_2 FROM lineitem l), f)".format(f"exp({N.dot(_X)})", f"exp({N.dot(_X, 3)})")
register(
    "mlogregr_predict",
    lambda s, f: rounded(R.mlogregr_predict(R.mlogregr_train(lineitem(s, f), "l_returnflag", X, **_TIGHT), lineitem(s, f), "id", X, "prob"), 5),
    f"WITH {_multi()} SELECT id, unnest(['A', 'N', 'R']) AS category, round(unnest([1 / (1 + e_1 + e_2), e_1 / (1 + e_1 + e_2), e_2 / (1 + e_1 + e_2)]), 5) AS probability FROM ({_PREDICTED})",
)
register(
    "multinom_predict",
    lambda s, f: G.multinom_predict(G.multinom(lineitem(s, f), "l_returnflag", X, optim_params="tolerance=1e-12"), lineitem(s, f), "id", X),
    f"WITH {_multi()} SELECT id, CASE WHEN e_1 > 1 AND e_1 > e_2 THEN 'N' WHEN e_2 > 1 THEN 'R' ELSE 'A' END AS category FROM ({_PREDICTED})",
)

# generalised linear models

_COUNT = ["ln(avg(y))", "0.0::DOUBLE", "0.0::DOUBLE"]
_GLM_COLUMNS = {"coef": "coef", "std_err": "std_err", "stats": "stats"}


def _glm(name, y, y_sql, x, x_sql, family, link, weight, slope, variance, dispersed, start=None):
    """`weight` is that of IRLS, `slope` the derivative of the mean over its variance."""
    k, columns = len(x), [f"x_{i}" for i in range(len(x))]
    mean = {"log": "exp(eta)", "logit": "1 / (1 + exp(-eta))"}[link]
    sql = N.fit(_data(y_sql, x=x_sql), k, [("eta", N.dot(columns)), ("mu", mean)], [f"(y - mu) * {slope} * {c}" for c in columns], lambda i, j: f"{weight} * x_{i} * x_{j}", (start or _COUNT)[:k], 12, {"chi": f"sum((y - mu) * (y - mu) / ({variance}))"})
    se = _se(k, f" * chi / (n - {k})" if dispersed else "")
    register(
        name,
        lambda s, f: spread(G.glm(lineitem(s, f), y, x, family, link, optim_params="tolerance=1e-14"), _GLM_COLUMNS, scalars=["dispersion"], digits=3),
        f"WITH {sql} {_final({'coef': _b(k), 'std_err': se, 'stats': _ratio(_b(k), se)}, k, scalars=f'chi / (n - {k}) AS dispersion' if dispersed else '1.0::DOUBLE AS dispersion', digits=3)}",
    )


_glm("glm_poisson", "l_linenumber", "l_linenumber", X, _ROWS, "poisson", "log", "mu", "1", "mu", False)
_glm("glm_gamma", "l_extendedprice / 1000", "l_extendedprice / 1000", X, _ROWS, "gamma", "log", "1", "1 / mu", "mu * mu", True)
_glm("glm_inverse_gaussian", "l_extendedprice / 1000", "l_extendedprice / 1000", ["1", "l_discount"], "1.0::DOUBLE AS x_0, CAST(l_discount AS DOUBLE) AS x_1", "inverse_gaussian", "log", "1 / mu", "1 / (mu * mu)", "mu * mu * mu", True)
_glm("glm_binomial", "hi", "l_extendedprice > 35000", X, _ROWS, "binomial", "logit", "mu * (1 - mu)", "1", "mu * (1 - mu)", False, ["0.0::DOUBLE"] * 3)
register("glm_binomial_probit", lambda s, f: spread(G.glm(lineitem(s, f), "hi", X, "binomial", "probit"), _GLM_COLUMNS), None)
register(
    "glm_gaussian",
    lambda s, f: spread(G.glm(lineitem(s, f), "l_extendedprice", X, "gaussian", None, "l_returnflag"), _GLM_COLUMNS, ["l_returnflag"], digits=3),
    f"WITH {_ols('l_returnflag')} {_final({'coef': _b(3), 'std_err': _S, 'stats': _ratio(_b(3), _S)}, 3, key='l_returnflag', digits=3)}",
)
register("glm_predict", lambda s, f: rounded(lineitem(s, f).select("id", G.glm_predict([0.5, 0.3], F.array(F.lit(1.0), F.col("l_quantity") / 50), "log").alias("mean"))), "SELECT l_orderkey * 10 + l_linenumber AS id, round(exp(0.5::DOUBLE + 0.3::DOUBLE * l_quantity / 50), 4) AS mean FROM lineitem")
register("glm_predict_poisson", lambda s, f: lineitem(s, f).select("id", G.glm_predict_poisson([0.5, 0.3], F.array(F.lit(1.0), F.col("l_quantity") / 10), "log").alias("mean")), "SELECT l_orderkey * 10 + l_linenumber AS id, round(exp(0.5::DOUBLE + 0.3::DOUBLE * l_quantity / 10)) AS mean FROM lineitem")
register("glm_predict_binomial", lambda s, f: lineitem(s, f).select("id", G.glm_predict_binomial([-1.0, 2.0], F.array(F.lit(1.0), F.col("l_quantity") / 50), "logit").alias("predicted")), "SELECT l_orderkey * 10 + l_linenumber AS id, -1 + 2 * l_quantity / 50 >= 0 AS predicted FROM lineitem")
register("logistic", lambda s, f: rounded(lineitem(s, f).select("id", R.logistic(F.col("l_quantity") / 10 - 2).alias("p")), 6), "SELECT l_orderkey * 10 + l_linenumber AS id, round(1 / (1 + exp(2 - l_quantity / 10)), 6) AS p FROM lineitem")

# ordered categories: six thresholds, then two coefficients

_CUTS = range(6)
_ODDS = [("eta", "b_6 * x_0 + b_7 * x_1"), *[(f"c_{j}", f"1 / (1 + exp(eta - b_{j}))") for j in _CUTS], *[(f"h_{j}", f"c_{j} * (1 - c_{j})") for j in _CUTS]]
_ODDS += [(f"q_{j}", f"greatest({'1' if j == 6 else f'c_{j}'} - {'0' if j == 0 else f'c_{j - 1}'}, 1e-300)") for j in range(7)]


def _slope(j: int, a: int) -> str | None:
    """Derivative of the probability of category j by parameter a."""
    if a < 6:
        return f"h_{a}" if a == j else f"(-h_{a})" if a == j - 1 else None
    return f"(-x_{a - 6} * ({f'h_{j}' if j < 6 else '0'} - {f'h_{j - 1}' if j else '0'}))"


def _information(a: int, b: int) -> str:
    return " + ".join(f"{_slope(j, a)} * {_slope(j, b)} / q_{j}" for j in range(7) if _slope(j, a) and _slope(j, b)) or "0.0::DOUBLE"


_ORDINAL = N.fit(
    _data("l_linenumber - 1", x="l_quantity / 50 AS x_0, CAST(l_discount AS DOUBLE) AS x_1"), 8, _ODDS, [f"CASE CAST(y AS INT) {' '.join(f'WHEN {j} THEN {_slope(j, a)} / q_{j}' for j in range(7) if _slope(j, a))} ELSE 0 END" for a in range(8)], _information,
    [f"ln(avg(CASE WHEN y <= {j} THEN 1.0 ELSE 0.0 END) / (1 - avg(CASE WHEN y <= {j} THEN 1.0 ELSE 0.0 END)))" for j in _CUTS] + ["0.0::DOUBLE"] * 2, 6,
)
_LINES = [1, 2, 3, 4, 5, 6, 7]


def _ordinal(df):
    return G.ordinal(df, "l_linenumber", X[1:], _LINES, optim_params="tolerance=1e-14")


register(
    "ordinal",
    lambda s, f: spread(_ordinal(lineitem(s, f)).select(F.concat("coef_threshold", "coef_feature").alias("coef"), F.concat("std_err_threshold", "std_err_feature").alias("std_err")), {"coef": "coef", "std_err": "std_err"}, digits=3),
    f"WITH {_ORDINAL} {_final({'coef': _b(8), 'std_err': _se(8)}, 8, digits=3)}",
)
_LEVELS = [f"1 / (1 + exp(b_6 * l_quantity / 50 + b_7 * l_discount - b_{j}))" for j in _CUTS]
_SHARES = [f"{(_LEVELS + ['1'])[j]} - {(['0'] + _LEVELS)[j]}" for j in range(7)]
register(
    "ordinal_predict",
    lambda s, f: rounded(G.ordinal_predict(_ordinal(lineitem(s, f)), lineitem(s, f), "id", X[1:], _LINES, kind="prob"), 4),
    f"WITH {_ORDINAL} SELECT l_orderkey * 10 + l_linenumber AS id, unnest(['1', '2', '3', '4', '5', '6', '7']) AS category, round(unnest([{', '.join(_SHARES)}]), 4) + 0.0 AS probability FROM lineitem, f",
)

# elastic net, by coordinate descent on the moments


def _elastic(features: list[str], l1: float, l2: float) -> str:
    """Common table expression r with c_i and intercept, for the price over 1000."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(k) if i != j]
    y = "l_extendedprice / 1000"
    moments = ", ".join([f"avg({y}) AS my"] + [f"avg({x}) AS m_{i}, stddev_pop({x}) AS sd_{i}, covar_pop({x}, {y}) / stddev_pop({x}) AS t_{i}" for i, x in enumerate(features)] + [f"corr({features[i]}, {features[j]}) AS r_{i}_{j}" for i, j in pairs])
    sql = "SELECT * FROM s WHERE n < 200"
    for i in range(k):
        rest = " - ".join([f"t_{i}", *[f"r_{i}_{j} * b_{j}" for j in range(k) if j != i]])
        sql = f"SELECT * REPLACE (sign({rest}) * greatest(abs({rest}) - {l1}, 0) / (1 + {l2}) AS b_{i}) FROM ({sql})"
    step = f"SELECT * REPLACE (n + 1 AS n) FROM ({sql})"
    coef = ", ".join(f"b_{i} / sd_{i} AS c_{i}" for i in range(k))
    return f"WITH RECURSIVE s AS (SELECT 0 AS n, {', '.join(f'0.0::DOUBLE AS b_{i}' for i in range(k))}, {moments} FROM lineitem UNION ALL {step}), r AS (SELECT {coef}, my - {' - '.join(f'm_{i} * b_{i} / sd_{i}' for i in range(k))} AS intercept FROM s WHERE n = 200)"


_NET = ["l_quantity", "l_discount", "l_tax"]
register(
    "elastic_net_gaussian",
    lambda s, f: rounded(PE.elastic_net_train(table(s, f, "lineitem"), "l_extendedprice / 1000", _NET, "gaussian", 0.5, 0.1, tolerance=1e-9).select("intercept", F.posexplode("coef_all").alias("p", "coef"))),
    _elastic(_NET, 0.05, 0.05) + " SELECT round(intercept, 4) AS intercept, CAST(unnest(range(3)) AS INT) AS p, round(unnest([c_0, c_1, c_2]), 4) + 0.0 AS coef FROM r",
)
register(
    "elastic_net_predict",
    lambda s, f: rounded(PE.elastic_net_predict(PE.elastic_net_train(lineitem(s, f), "l_extendedprice / 1000", ["l_quantity", "l_tax"], "gaussian", 0.5, 0.1, tolerance=1e-9), lineitem(s, f), "id", ["l_quantity", "l_tax"])),
    _elastic(["l_quantity", "l_tax"], 0.05, 0.05) + " SELECT l_orderkey * 10 + l_linenumber AS id, round(intercept + c_0 * l_quantity + c_1 * l_tax, 4) AS prediction FROM lineitem, r",
)
