"""Queries of decompositions, clusterings, survival models and rules, by properties that SQL can state.

A decomposition is multiplied together again, a clustering is iterated in SQL from the same centroids, a Cox
model is fitted by Newton's method over window sums.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import checks as CH
from corvane.operators import cluster as CL
from corvane.operators import factor as FA
from corvane.operators import matrix as M
from corvane.operators import patterns as PA
from corvane.operators import penalized as PE
from corvane.operators import survival as SU
from corvane.plans import laws
from corvane.plans import newton as N
from corvane.plans.fits import lineitem, spread
from corvane.plans.registry import register, rounded, table

# matrices: total quantity by supplier class and line number, 7 x 7

_M = "SELECT l_suppkey % 7 + 1 AS r, l_linenumber AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_ENTRIES = f"SELECT r AS row_id, c AS col_id, round(v, 3) AS val FROM ({_M})"
#: Elements of an embedding.
WIDTH = 64
_CELLS = [(i, j) for i in range(7) for j in range(7)]


def matrix(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7 + 1).cast("long").alias("row_id"), F.col("l_linenumber").cast("long").alias("col_id")).agg(F.sum("l_quantity").alias("val"))


def dense(spark, sf):
    return table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("row_id"), F.col("embedding").cast("array<double>").alias("row_vec"))


def system(spark, sf):
    """A symmetric positive definite system of seven equations."""
    a = M.densify(M.add(M.square(matrix(spark, sf)), M.scalar_mult(M.identity(spark, 7), 1e6)), 7, 7)
    return a.select("row_id", F.col("row_vec").alias("a"), F.col("row_id").cast("double").alias("b"))


def _sparse_system(spark, sf):
    s = system(spark, sf)
    e = M.entries(s.select("row_id", F.col("a").alias("row_vec")))
    return e.select((F.col("row_id") - 1).alias("row_id"), (F.col("col_id") - 1).alias("col_id"), "val"), s.select((F.col("row_id") - 1).alias("row_id"), F.col("b").alias("val"))


def _wide(entries: str) -> str:
    return f"SELECT {', '.join(f'sum(CASE WHEN r = {i + 1} AND c = {j + 1} THEN v ELSE 0 END) AS a_{i}_{j}' for i, j in _CELLS)} FROM ({entries})"


def _entries_of(df, digits):
    return rounded(M.entries(df), digits)


_INVERSE = f"SELECT CAST(unnest(range(49)) // 7 + 1 AS BIGINT) AS row_id, CAST(unnest(range(49)) % 7 + 1 AS BIGINT) AS col_id, round(unnest([{', '.join(f'v_{i}_{j}' for i, j in _CELLS)}]), 7) + 0.0 AS val FROM ({N.inverse(_wide(_M), 7, [])})"
register("matrix_inverse", lambda s, f: _entries_of(M.inverse(matrix(s, f)), 7), _INVERSE)
register("matrix_pinv", lambda s, f: _entries_of(M.pinv(matrix(s, f)), 7), _INVERSE)


def _product(*parts):
    """Entries of a product of dense matrices."""
    out = M.sparsify(parts[0])
    for p in parts[1:]:
        out = M.mult(out, M.sparsify(p))
    return _entries_of(out, 3)


def _lu(m):
    d = M.lu(m)
    return _product(M.trans(d["p"]), d["l"], d["u"], M.trans(d["q"]))


def _qr(m):
    d = M.qr(m)
    return _product(d["q"], d["r"])


def _cholesky(m):
    d = M.cholesky(M.square(m))
    return _product(d["l"], d["d"], M.trans(d["l"]))


register("matrix_lu", lambda s, f: _lu(matrix(s, f)), _ENTRIES)
register("matrix_qr", lambda s, f: _qr(matrix(s, f)), _ENTRIES)
register("matrix_cholesky", lambda s, f: _cholesky(matrix(s, f)), f"SELECT a.r AS row_id, b.r AS col_id, round(sum(a.v * b.v), 3) AS val FROM ({_M}) a JOIN ({_M}) b ON a.c = b.c GROUP BY 1, 2")
register(
    "matrix_eigen",
    lambda s, f: rounded(M.eigen(matrix(s, f)).select(F.col("eigen_value.re").alias("re"), F.col("eigen_value.im").alias("im")).agg(F.sum("re").alias("total"), F.sum(F.col("re") * F.col("re") - F.col("im") * F.col("im")).alias("squares")), 2),
    f"WITH m AS ({_M}) SELECT round((SELECT sum(v) FROM m WHERE r = c), 2) AS total, round((SELECT sum(a.v * b.v) FROM m a JOIN m b ON a.r = b.c AND a.c = b.r), 2) AS squares",
)
register("matrix_rank", lambda s, f: s.createDataFrame([(M.rank(matrix(s, f)), M.rank(M.ones(s, 4, 3)))], "rank long, of_ones long"), f"SELECT count(DISTINCT r) AS rank, 1 AS of_ones FROM ({_M})")
register("matrix_nuclear_norm", lambda s, f: rounded(s.createDataFrame([(M.nuclear_norm(M.square(matrix(s, f))),)], "norm double"), 2), f"SELECT round(sum(v * v), 2) AS norm FROM ({_M})")

_A = f"SELECT a.r AS r, b.r AS c, sum(a.v * b.v) + CASE WHEN a.r = b.r THEN 1e6 ELSE 0 END AS v FROM ({_M}) a JOIN ({_M}) b ON a.c = b.c GROUP BY 1, 2"


def _solution(b: list[float]) -> str:
    x = ", ".join(" + ".join(f"v_{i}_{j} * {b[j]}" for j in range(7)) for i in range(7))
    return f"SELECT CAST(unnest(range(7)) AS INT) AS p, round(1e6 * unnest([{x}]), 3) + 0.0 AS value FROM ({N.inverse(_wide(_A), 7, [])})"


def _solved(df):
    return rounded(df.select(F.posexplode("solution").alias("p", "x")).select("p", (F.col("x") * 1e6).alias("value")), 3)


_ORDER = [float(i) for i in range(1, 8)]
_EXACT = "toler=1e-14"
register("linear_solver_dense", lambda s, f: _solved(FA.linear_solver_dense(system(s, f), "row_id", "a", "b")), _solution(_ORDER))
register("linear_solver_dense_cg", lambda s, f: _solved(FA.linear_solver_dense(system(s, f), "row_id", "a", "b", optimizer="cg", optimizer_options=_EXACT)), _solution(_ORDER))
register("linear_solver_sparse", lambda s, f: _solved(FA.linear_solver_sparse(*_sparse_system(s, f), optimizer="cg", optimizer_options=_EXACT)), _solution(_ORDER))
register("sparse_direct_linear_system", lambda s, f: _solved(FA.linear_solver_sparse(*_sparse_system(s, f), optimizer="direct")), _solution(_ORDER))
register(
    "conjugate_gradient",
    lambda s, f: _solved(s.createDataFrame([(FA.conjugate_gradient(system(s, f).select("row_id", F.col("a").alias("row_vec")), [1.0] * 7, 1e-14).tolist(),)], "solution array<double>")),
    _solution([1.0] * 7),
)
register(
    "dense_residual_norm",
    lambda s, f: rounded(FA.dense_residual_norm(system(s, f), "a", "b", [0.1] * 7), 2),
    f"SELECT round(sqrt(sum(e * e)), 2) AS residual_norm, round(sqrt(sum(e * e)) / sqrt(140), 2) AS relative_residual_norm FROM (SELECT 0.1::DOUBLE * sum(v) - r AS e FROM ({_A}) GROUP BY r)",
)


# singular values and principal components: all of them, put together again


def _recomposed(d, digits):
    u, v = M.sparsify(d["u"]), M.sparsify(d["v"])
    return rounded(M.entries(M.mult(M.mult(u, d["s"]), v, trans_b=True)), digits)




def _scaled_lengths(spark, sf):
    """Squares of each row's coordinates times the singular values, all of them: the row's own square."""
    d = FA.svd(dense(spark, sf), WIDTH)
    values = [r.val for r in d["s"].orderBy("row_id").toLocalIterator()]  # one for each column
    square = F.aggregate(F.zip_with("row_vec", F.array(*map(F.lit, values)), lambda u, s: u * u * s * s), F.lit(0.0), lambda s, e: s + e)
    return rounded(d["u"].select("row_id", square.alias("square")), 5)


register("svd", _scaled_lengths, "SELECT vec_id + 1 AS row_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * e)), 5) AS square FROM embeddings")
register("svd_sparse", lambda s, f: _recomposed(FA.svd(matrix(s, f), 7), 3), _ENTRIES)
register("svd_block", lambda s, f: _recomposed(FA.svd(M.blockize(matrix(s, f), 3, 3), 7), 3), _ENTRIES)


def _covariance(d, digits):
    p = d["components"].select("std_dev", F.posexplode("principal_components").alias("i", "a"), F.col("principal_components").alias("pc"))
    q = p.select("i", "std_dev", "a", F.posexplode("pc").alias("j", "b"))
    return rounded(q.groupBy("i", "j").agg(F.sum(F.col("std_dev") * F.col("std_dev") * F.col("a") * F.col("b")).alias("value")), digits)


_PAIRS = "(SELECT CAST(unnest(range({0})) // {1} AS INT) AS i, CAST(unnest(range({0})) % {1} AS INT) AS j)"
register(
    "pca_train",
    lambda s, f: _covariance(FA.pca_train(dense(s, f), WIDTH), 6),
    f"SELECT i, j, round(covar_samp(x[i + 1], x[j + 1]), 6) + 0.0 AS value FROM (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings), {_PAIRS.format(4096, 64)} GROUP BY i, j",
)
register(
    "pca_sparse_train",
    lambda s, f: _covariance(FA.pca_train(matrix(s, f), 7), 2),
    f"SELECT CAST(a.c - 1 AS INT) AS i, CAST(b.c - 1 AS INT) AS j, round(covar_samp(a.v, b.v), 2) + 0.0 AS value FROM ({_M}) a JOIN ({_M}) b ON a.r = b.r GROUP BY 1, 2",
)


def _lengths(projected, digits):
    return rounded(projected.select("row_id", F.aggregate("row_vec", F.lit(0.0), lambda s, e: s + e * e).alias("square")), digits)


register(
    "pca_project",
    lambda s, f: _lengths(FA.pca_project(dense(s, f), FA.pca_train(dense(s, f), WIDTH))["projected"], 5),
    "SELECT vec_id + 1 AS row_id, round(sum(e * e), 5) AS square FROM (SELECT vec_id, CAST(embedding[i] AS DOUBLE) - avg(CAST(embedding[i] AS DOUBLE)) OVER (PARTITION BY i) AS e FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) GROUP BY 1",
)
register(
    "pca_sparse_project",
    lambda s, f: _lengths(FA.pca_project(matrix(s, f), FA.pca_train(matrix(s, f), 7))["projected"], 2),
    f"SELECT r AS row_id, round(sum(e * e), 2) AS square FROM (SELECT r, v - avg(v) OVER (PARTITION BY c) AS e FROM ({_M})) GROUP BY 1",
)
_U = [f"u{i} AS (SELECT r, sum(v * q) / sum(q * q) AS p FROM m JOIN w{i - 1} USING (c) GROUP BY r), w{i} AS (SELECT c, sum(v * p) / sum(p * p) AS q FROM m JOIN u{i} USING (r) GROUP BY c)" for i in (1, 2, 3)]
register(
    "svdmf_run",
    lambda s, f: rounded(FA.svdmf(matrix(s, f), "row_id", "col_id", "val", 1, 3, -1.0)["error"], 3),
    f"WITH m AS ({_M}), w0 AS (SELECT DISTINCT c, 0.1::DOUBLE AS q FROM m), {', '.join(_U)} SELECT round(sqrt(avg((v - p * q) * (v - p * q))), 3) AS error FROM m JOIN u3 USING (r) JOIN w3 USING (c)",
)

# clustering, from the first three vectors

_DISTANCE = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_POINTS = "p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), c0 AS (SELECT vec_id AS k, x AS c FROM p WHERE vec_id < 3)"
_LLOYD = ", ".join(f"a{n} AS (SELECT vec_id, any_value(x) AS x, arg_min(k, d) AS k FROM (SELECT *, {_DISTANCE} AS d FROM p, c{n - 1}) GROUP BY vec_id), c{n} AS (SELECT k, [{', '.join(f'avg(x[{i}])' for i in range(1, 65))}] AS c FROM a{n} GROUP BY k)" for n in range(1, 5))


def _firsts(spark, sf):
    return [r.v for r in table(spark, sf, "embeddings").filter("vec_id < 3").orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("v")).toLocalIterator()]


def _clusters(df):
    rows = df.select("objective_fn", F.posexplode(F.arrays_zip("centroids", "cluster_sizes")).alias("k", "z"))
    return rounded(rows.select(F.col("k").cast("long").alias("k"), F.col("z.cluster_sizes").alias("size"), "objective_fn", F.posexplode("z.centroids").alias("p", "value")), 4)


register(
    "kmeans",
    lambda s, f: _clusters(CL.kmeans(table(s, f, "embeddings"), "embedding", _firsts(s, f), max_num_iterations=4, min_frac_reassigned=-1.0)),
    f"WITH {_POINTS}, {_LLOYD}, n AS (SELECT vec_id, arg_min(k, d) AS k, min(d) AS d FROM (SELECT vec_id, k, {_DISTANCE} AS d FROM p, c4) GROUP BY vec_id), t AS (SELECT k, count(*) AS size FROM n GROUP BY k) "
    "SELECT k, size, (SELECT round(sum(d), 4) FROM n) AS objective_fn, CAST(unnest(range(64)) AS INT) AS p, round(unnest(c), 4) + 0.0 AS value FROM c4 JOIN t USING (k)",
)


def _settled(spark, sf, model):
    """Points in clusters, and how far the model's objective is from the sum of squared distances to its centroids."""
    m = model.first()
    near = CL.assign(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", m.centroids)
    sizes = F.lit(sum(m.cluster_sizes)).cast("long")
    return rounded(near.agg(F.count("*").alias("points"), sizes.alias("in_clusters"), F.abs(F.sum("distance") / F.lit(m.objective_fn) - 1).alias("gap")), 6)


for _name, _f, _k in (("kmeanspp", CL.kmeanspp, 4), ("kmeans_random", CL.kmeans_random, 3)):
    register(_name, lambda s, f, g=_f, k=_k: _settled(s, f, g(table(s, f, "embeddings"), "embedding", k, max_num_iterations=6)), "SELECT count(*) AS points, count(*) AS in_clusters, 0.0::DOUBLE AS gap FROM embeddings")
for _name, _f in (("kmeanspp_seeding", CL.kmeanspp_seeding), ("kmeans_random_seeding", CL.kmeans_random_seeding)):
    register(
        _name,
        lambda s, f, g=_f: M.table(s, g(table(s, f, "embeddings"), "embedding", 3)).join(dense(s, f).select("row_vec").distinct(), "row_vec").agg(F.count("*").alias("seeds"), F.countDistinct("row_vec").alias("points")),
        "SELECT 3 AS seeds, 3 AS points",
    )
register(
    "simple_silhouette",
    lambda s, f: rounded(CL.simple_silhouette(table(s, f, "embeddings"), "embedding", _firsts(s, f)), 6),
    f"WITH {_POINTS}, d AS (SELECT vec_id, list(sqrt({_DISTANCE}) ORDER BY {_DISTANCE}) AS d FROM p, c0 GROUP BY vec_id) SELECT round(avg(CASE WHEN d[2] = 0 THEN 0 ELSE (d[2] - d[1]) / d[2] END), 6) AS silhouette FROM d",
)

# proportional hazards


def _cox(strata: str = "0", more: str = "0") -> str:
    """Common table expressions d (rows), f (coefficients b_i, inverse information v_i_j, ll) and k (risk-set sums by time)."""

    def risk(step: str) -> str:
        e = f"SELECT d.*, exp(b_0 * x_0 + b_1 * x_1) AS e FROM d, {step}"
        sums = ["sum(e) AS s0", *[f"sum(e * x_{i}) AS s_{i}" for i in (0, 1)], *[f"sum(e * x_{i} * x_{j}) AS s_{i}_{j}" for i in (0, 1) for j in (0, 1)], "sum(v) AS n", *[f"sum(v * x_{i}) AS n_{i}" for i in (0, 1)]]
        own = f"SELECT g, t, {', '.join(sums)} FROM ({e}) GROUP BY g, t"
        window = "OVER (PARTITION BY g ORDER BY t DESC)"
        names = ["s0", "s_0", "s_1", *[f"s_{i}_{j}" for i in (0, 1) for j in (0, 1)]]
        return f"SELECT g, t, n, n_0, n_1, {', '.join(f'sum({c}) {window} AS {c}' for c in names)} FROM ({own})"

    def sums(step: str) -> str:
        score = ", ".join(f"sum(n_{i} - n * s_{i} / s0) AS u_{i}" for i in (0, 1))
        info = ", ".join(f"sum(n * (s_{i}_{j} / s0 - s_{i} * s_{j} / (s0 * s0))) AS a_{i}_{j}" for i in (0, 1) for j in (0, 1))
        total = f"SELECT any_value(b_0) AS b_0, any_value(b_1) AS b_1, sum(n_0) * any_value(b_0) + sum(n_1) * any_value(b_1) - sum(n * ln(s0)) AS ll, sum(n) AS m, {score}, {info} FROM ({risk(step)}), {step}"
        return N.inverse(total, 2, ["b_0", "b_1", "ll", "m", "u_0", "u_1"])

    parts = [
        f"d AS MATERIALIZED (SELECT {strata} AS g, l_quantity AS t, CAST(l_discount AS DOUBLE) AS x_0, CAST(l_tax AS DOUBLE) AS x_1, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS v, {more} AS c FROM lineitem)",
        "t0 AS (SELECT 0.0::DOUBLE AS b_0, 0.0::DOUBLE AS b_1)",
    ]
    for n in range(6):
        parts.append(f"t{n + 1} AS MATERIALIZED (SELECT b_0 + v_0_0 * u_0 + v_0_1 * u_1 AS b_0, b_1 + v_1_0 * u_0 + v_1_1 * u_1 AS b_1 FROM ({sums(f't{n}')}))")
    return ", ".join([*parts, f"f AS MATERIALIZED ({sums('t6')})", f"k AS MATERIALIZED ({risk('t6')})"])


_B2, _SE2 = ["b_0", "b_1"], ["sqrt(v_0_0)", "sqrt(v_1_1)"]
_EACH = "SELECT CAST(unnest(range(2)) AS INT) AS p, {} FROM {}"


def _each(columns: dict[str, list[str]], source: str = "f", scalars: str = "") -> str:
    lists = ", ".join(f"round(unnest([{', '.join(e)}]), 4) + 0.0 AS {n}" for n, e in columns.items())
    return _EACH.format(lists + scalars, source)


_COX_ARGS = ("l_quantity", ["l_discount", "l_tax"], "l_linestatus = 'F'")
_COX_FIT = "tolerance=1e-15"
_COX_COLUMNS = {"coef": _B2, "std_err": _SE2, "z_stats": ["b_0 / sqrt(v_0_0)", "b_1 / sqrt(v_1_1)"]}
_COX_SPREAD = {"coef": "coef", "std_err": "std_err", "z_stats": "z_stats"}
for _name, _strata, _g in (("coxph_train", "l_returnflag", "l_returnflag"), ("coxph_train_plain", None, "0")):
    register(
        _name,
        lambda s, f, st=_strata: spread(SU.coxph_train(table(s, f, "lineitem"), *_COX_ARGS, st, _COX_FIT).withColumn("ll", F.round("loglikelihood", 2)), _COX_SPREAD, scalars=["ll"]),
        f"WITH {_cox(_g)} " + _each(_COX_COLUMNS, scalars=", round(ll, 2) AS ll"),
    )
register("cox_prop_hazards", lambda s, f: spread(SU.cox_prop_hazards(table(s, f, "lineitem"), *_COX_ARGS), {"coef": "coef", "std_err": "std_err"}, digits=3), f"WITH {_cox()} " + _each({"coef": _B2, "std_err": _SE2}).replace(", 4)", ", 3)"))
register(
    "coxph_predict",
    lambda s, f: rounded(SU.coxph_predict(SU.coxph_train(lineitem(s, f), *_COX_ARGS, None, _COX_FIT), lineitem(s, f), "id", ["l_discount", "l_tax"], "risk"), 5),
    f"WITH {_cox()} SELECT l_orderkey * 10 + l_linenumber AS id, round(exp(b_0 * (l_discount - (SELECT avg(x_0) FROM d)) + b_1 * (l_tax - (SELECT avg(x_1) FROM d))), 5) AS prediction FROM lineitem, f",
)
_WALK = "SELECT g, t, s0, s_0, s_1, sum(n / s0) OVER w AS a, sum(n * s_0 / (s0 * s0)) OVER w AS a_0, sum(n * s_1 / (s0 * s0)) OVER w AS a_1 FROM k WINDOW w AS (PARTITION BY g ORDER BY t)"
_SCORES = "SELECT c, " + ", ".join(f"v * (x_{i} - s_{i} / s0) - exp(b_0 * x_0 + b_1 * x_1) * (x_{i} * a - a_{i}) AS u_{i}" for i in (0, 1)) + f" FROM d JOIN ({_WALK}) USING (g, t), t6"
_MEAT = ", ".join(f"sum(u_{i} * u_{j}) AS m_{i}_{j}" for i in (0, 1) for j in (0, 1))
_ROBUST = [f"sqrt({' + '.join(f'v_{i}_{a} * m_{a}_{b} * v_{b}_{i}' for a in (0, 1) for b in (0, 1))})" for i in (0, 1)]
_ROBUST_COLUMNS = {"coef": _B2, "std_err": _SE2, "robust_se": _ROBUST, "robust_z": [f"b_{i} / {r}" for i, r in enumerate(_ROBUST)]}
_ROBUST_SPREAD = {c: c for c in _ROBUST_COLUMNS}
register(
    "robust_variance_coxph",
    lambda s, f: spread(SU.robust_variance_coxph(table(s, f, "lineitem"), *_COX_ARGS, optimizer_params=_COX_FIT), _ROBUST_SPREAD),
    f"WITH {_cox()}, h AS (SELECT {_MEAT} FROM ({_SCORES})) " + _each(_ROBUST_COLUMNS, "f, h"),
)
register(
    "clustered_variance_coxph",
    lambda s, f: spread(SU.clustered_variance_coxph(table(s, f, "lineitem"), _COX_ARGS[0], _COX_ARGS[1], "l_suppkey", _COX_ARGS[2], optimizer_params=_COX_FIT), _ROBUST_SPREAD),
    f"WITH {_cox(more='l_suppkey')}, h AS (SELECT {_MEAT} FROM (SELECT c, sum(u_0) AS u_0, sum(u_1) AS u_1 FROM ({_SCORES}) GROUP BY c)) " + _each(_ROBUST_COLUMNS, "f, h"),
)
_RESIDUALS = "SELECT t, x_0 - s_0 / s0 AS r_0, x_1 - s_1 / s0 AS r_1, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS q FROM d JOIN k USING (g, t) WHERE v = 1"
_SCALED = f"SELECT q, v_0_0, v_1_1, m, (v_0_0 * r_0 + v_0_1 * r_1) * m AS z_0, (v_1_0 * r_0 + v_1_1 * r_1) * m AS z_1 FROM ({_RESIDUALS}), f"
_RHO = ", ".join(f"corr(z_{i}, q) AS rho_{i}, power(covar_pop(z_{i}, q) * any_value(m), 2) / (any_value(v_{i}_{i}) * any_value(m) * var_pop(q) * any_value(m)) AS chi_{i}" for i in (0, 1))
register(
    "cox_zph",
    lambda s, f: rounded(SU.cox_zph(table(s, f, "lineitem"), *_COX_ARGS, optimizer_params=_COX_FIT), 4),
    f"WITH {_cox()}, h AS (SELECT {_RHO} FROM ({_SCALED})) SELECT CAST(unnest([1, 2]) AS INT) AS covariate, round(unnest([rho_0, rho_1]), 4) + 0.0 AS rho, round(unnest([chi_0, chi_1]), 4) AS chi2, round(unnest([{', '.join(f'2 * (1 - {laws._normal(f'sqrt(chi_{i})')})' for i in (0, 1))}]), 4) AS p_value FROM h",
)

# naive Bayes: values unseen in training, repeated keys, null attributes


def _bayes(spark, sf, key):
    d = lineitem(spark, sf).withColumn("key", F.expr(key))
    third = F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("string"))
    return d.select("key", "l_returnflag", "l_linenumber", F.array("l_linestatus", F.col("l_linenumber").cast("string"), third).alias("a"))


_REPEATED = "l_orderkey * 10 + l_linenumber % 4"


def _nb_sql(key: str) -> str:
    rows = f"r AS (SELECT row_number() OVER () AS i, {key} AS key, l_returnflag AS class, l_linestatus AS a_1, l_linenumber AS a_2, l_quantity AS a_3 FROM lineitem WHERE l_tax <> 0), t AS (SELECT * FROM r WHERE a_2 <> 7)"
    prior = "q AS (SELECT class, count(*) AS n, log10(count(*) / sum(count(*)) OVER ()) AS prior, avg(a_3) AS mean, var_samp(a_3) AS var FROM t GROUP BY class)"
    counts = ", ".join(
        f"w_{i} AS (SELECT q.class, x.a_{i}, log10((coalesce(c.n, 0) + 1) / (q.n + (SELECT count(DISTINCT a_{i}) FROM t))) AS l FROM q CROSS JOIN (SELECT DISTINCT a_{i} FROM t) x LEFT JOIN (SELECT class, a_{i}, count(*) AS n FROM t GROUP BY 1, 2) c ON c.class = q.class AND c.a_{i} = x.a_{i})"
        for i in (1, 2)
    )
    score = "s AS (SELECT i, key, q.class, prior + coalesce(w_1.l, 0) + coalesce(w_2.l, 0) + (-0.5 * ln(2 * pi() * var) - (r.a_3 - mean) * (r.a_3 - mean) / (2 * var)) / ln(10) AS log_prob FROM r CROSS JOIN q LEFT JOIN w_1 ON w_1.class = q.class AND w_1.a_1 = r.a_1 LEFT JOIN w_2 ON w_2.class = q.class AND w_2.a_2 = r.a_2)"
    return f"WITH {rows}, {prior}, {counts}, {score}"


def _nb(spark, sf, key):
    rows = _bayes(spark, sf, key)
    return PA.nb_train(rows.filter("l_linenumber <> 7"), "l_returnflag", "a", [3]), rows


register("nb_probs", lambda s, f: rounded(PA.nb_probs(*_nb(s, f, _REPEATED), "key", "a"), 5), _nb_sql("l_orderkey * 10 + l_linenumber % 4") + " SELECT key, class, round(log_prob, 5) AS log_prob, round(pow(10, log_prob - m) / sum(pow(10, log_prob - m)) OVER (PARTITION BY i), 5) AS nb_prob FROM (SELECT *, max(log_prob) OVER (PARTITION BY i) AS m FROM s)")
register("nb_classify", lambda s, f: PA.nb_classify(*_nb(s, f, "id"), "key", "a"), _nb_sql("l_orderkey * 10 + l_linenumber") + " SELECT key, list(class ORDER BY class) AS class FROM (SELECT *, max(log_prob) OVER (PARTITION BY key) AS m FROM s) WHERE log_prob = m GROUP BY key")

# rules of up to three items

_ITEMS = "SELECT DISTINCT l_orderkey AS t, CAST(l_suppkey % 8 AS VARCHAR) AS i FROM lineitem"
_SETS = f"b AS ({_ITEMS}), n AS (SELECT CAST(count(DISTINCT t) AS DOUBLE) AS n FROM b), s AS (SELECT [i] AS s, count(*) AS f FROM b GROUP BY i UNION ALL SELECT [x.i, y.i], count(*) FROM b x JOIN b y ON x.t = y.t AND x.i < y.i GROUP BY x.i, y.i UNION ALL SELECT [x.i, y.i, z.i], count(*) FROM b x JOIN b y ON x.t = y.t AND x.i < y.i JOIN b z ON x.t = z.t AND y.i < z.i GROUP BY x.i, y.i, z.i)"
_RULE_SQL = (
    f"WITH {_SETS}, e AS (SELECT s, f FROM s, n WHERE f >= ceil(0.02 * n)), r AS (SELECT a.s AS pre, b.s AS post, w.f, a.f AS fa, b.f AS fb FROM e w JOIN e a ON len(a.s) < len(w.s) AND list_has_all(w.s, a.s) JOIN e b ON len(a.s) + len(b.s) = len(w.s) AND list_has_all(w.s, b.s) AND NOT list_has_any(a.s, b.s)) "
    "SELECT array_to_string(pre, ',') AS pre, array_to_string(post, ',') AS post, f AS count, round(f / n, 5) AS support, round(f / fa, 5) AS confidence, round((f / fa) / (fb / n), 4) AS lift, round(CASE WHEN f = fa THEN 0 ELSE (1 - fb / n) / (1 - f / fa) END, 4) AS conviction FROM r, n WHERE f / fa >= 0.1"
)


def _rules(spark, sf):
    r = PA.assoc_rules(table(spark, sf, "lineitem").withColumn("item", F.col("l_suppkey") % 8), "l_orderkey", "item", 0.02, 0.1, 3)
    digits = {"support": 5, "confidence": 5, "lift": 4, "conviction": 4}
    return r.select(F.array_join("pre", ",").alias("pre"), F.array_join("post", ",").alias("post"), "count", *[(F.round(c, n) + 0.0).alias(c) for c, n in digits.items()])


register("assoc_rules_full", _rules, _RULE_SQL)
register("gen_rules_from_cfp", lambda s, f: s.createDataFrame([(["a", "b", "c"],), (["x", "y"],), (["z"],)], "items array<string>").select(F.explode(PA.rules_of("items")).alias("r")).select(F.array_join("r.pre", ",").alias("pre"), F.array_join("r.post", ",").alias("post")), "SELECT unnest(['a', 'b', 'c', 'a,b', 'a,c', 'b,c', 'x', 'y']) AS pre, unnest(['b,c', 'a,c', 'a,b', 'c', 'b', 'a', 'y', 'x']) AS post")

# predictions by given coefficients, and utilities

_XQ = lambda: F.array("l_quantity", "l_discount")
register("elastic_net_gaussian_predict", lambda s, f: rounded(lineitem(s, f).select("id", PE.elastic_net_gaussian_predict([0.2, 3.0], 1.5, _XQ()).alias("value"))), "SELECT l_orderkey * 10 + l_linenumber AS id, round(0.2::DOUBLE * l_quantity + 3 * l_discount + 1.5, 4) AS value FROM lineitem")
register("elastic_net_binomial_predict", lambda s, f: lineitem(s, f).select("id", PE.elastic_net_binomial_predict([0.2, 3.0], -5.05, _XQ()).alias("value")), "SELECT l_orderkey * 10 + l_linenumber AS id, 0.2::DOUBLE * l_quantity + 3 * l_discount - 5.05 > 0 AS value FROM lineitem")
register("elastic_net_binomial_prob", lambda s, f: rounded(lineitem(s, f).select("id", PE.elastic_net_binomial_prob([0.2, 3.0], -5.0, _XQ()).alias("value")), 5), "SELECT l_orderkey * 10 + l_linenumber AS id, round(1 / (1 + exp(5 - 0.2::DOUBLE * l_quantity - 3 * l_discount)), 5) AS value FROM lineitem")
register("logregr_accuracy", lambda s, f: rounded(lineitem(s, f).agg(F.avg(PA.logregr_accuracy([-2.0, 0.1], F.array(F.lit(1.0), F.col("l_quantity")), F.col("hi"))).alias("accuracy")), 6), "SELECT round(avg(CASE WHEN (-2 + 0.1::DOUBLE * l_quantity >= 0) = (l_extendedprice > 35000) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem")
register("check_if_col_exists", lambda s, f: s.createDataFrame([(CH.column_exists(table(s, f, "orders"), "o_orderkey"), CH.column_exists(table(s, f, "orders"), "none"))], "found boolean, missing boolean"), "SELECT true AS found, false AS missing")
register("check_if_raises_error", lambda s, f: s.createDataFrame([(CH.raises_error(s, "SELECT raise_error('x')"), CH.raises_error(s, "SELECT 1"))], "bad boolean, good boolean"), "SELECT true AS bad, false AS good")


def _cleaned(spark, sf):
    spark.range(1).createOrReplaceTempView("corvane_temp_clean")
    found = CH.cleanup_temp_tables(spark, "corvane_temp_clean")
    return spark.createDataFrame([(len(found), CH.raises_error(spark, "SELECT * FROM corvane_temp_clean"))], "dropped long, gone boolean")


register("cleanup_temp_tables", _cleaned, "SELECT 1 AS dropped, true AS gone")


def _asserted(spark, sf):
    try:
        CH.assert_(False, "told")
    except AssertionError as e:
        CH.assert_(True, "never told")
        return spark.createDataFrame([(str(e),)], "message string")


register("assert", _asserted, "SELECT 'told' AS message")
register("version", lambda s, f: s.createDataFrame([(CH.version().split(" ")[0],)], "name string"), "SELECT 'corvane' AS name")
