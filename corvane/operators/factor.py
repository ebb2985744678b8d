"""Singular values, principal components, matrix factorisation, linear systems."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import matrix as M
from corvane.operators.checks import options, quoted
from corvane.operators.estimate import group_sums, packed, to_numpy, unpacked

#: Columns up to which the Gram matrix is decomposed on the driver.
GRAM_COLUMNS = 5000


def _rows(m: DataFrame) -> DataFrame:
    return m if M.is_dense(m) else M.densify(m)


def _gram(m: DataFrame):
    """[n, column sums, X'X] of the rows."""

    def kernel(key, a):
        x = a["row_vec"]
        return np.concatenate(([len(x)], x.sum(axis=0), packed(x.T @ x)))

    s = group_sums(_rows(m), [], {"row_vec": F.col("row_vec").cast("array<double>")}, kernel)[()]
    d = int((np.sqrt(9 + 8 * (len(s) - 1)) - 3) / 2)
    return s[0], s[1 : 1 + d], unpacked(s[1 + d :], d)


def svd(m: DataFrame, k: int) -> dict[str, DataFrame]:
    """{u, s, v, summary} of the k largest singular values, from the Gram matrix of the narrow side.

    m is dense, sparse or in blocks; u and v have rows (row_id, row_vec). Columns must be at most
    GRAM_COLUMNS; rows are unlimited.
    """
    dense = M.densify(M.entries(m)) if not M.is_dense(m) else m
    _, _, gram = _gram(dense)
    if len(gram) > GRAM_COLUMNS:
        raise ValueError(f"more than {GRAM_COLUMNS} columns")
    w, v = np.linalg.eigh(gram)
    order = np.argsort(-w)[:k]
    s, v = np.sqrt(np.maximum(w[order], 0)), v[:, order]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    spark = m.sparkSession
    scaled = v / np.where(s > 1e-12 * max(s.max(initial=0), 1e-300), s, np.inf)
    u = _times(dense, scaled)
    sv = spark.createDataFrame([(i + 1, i + 1, float(x)) for i, x in enumerate(s)], "row_id long, col_id long, val double")
    rows, cols = M.ndims(dense)
    err = float(np.sqrt(max(np.trace(gram) - (s * s).sum(), 0)))
    summary = spark.createDataFrame([(rows, len(s), err, err / max(float(np.sqrt(np.trace(gram))), 1e-300))], "rows_used long, num_singular_values int, recon_error double, relative_recon_error double")
    return {"u": u, "s": sv, "v": M.table(spark, v), "summary": summary}


def _times(rows: DataFrame, a: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """(row_id, row_vec): row vectors (less a mean) times a matrix, which is broadcast: it has at most GRAM_COLUMNS squared elements."""
    shared = rows.sparkSession.sparkContext.broadcast((a, np.zeros(len(a)) if mean is None else mean))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, mean = shared.value
                x = (to_numpy(batch.column("row_vec")) - mean) @ a
                vectors = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), vectors], names=["row_id", "row_vec"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.select("row_id", F.col("row_vec").cast("array<double>").alias("row_vec")).mapInArrow(run, f"row_id {kind}, row_vec array<double>")


def pca_train(m: DataFrame, k: int | None = None, variance: float | None = None) -> dict[str, DataFrame]:
    """{components, mean}: (row_id, principal_components, std_dev, proportion), and the column means.

    k components, or as many as explain the share `variance`.
    """
    if (k is None) == (variance is None):
        raise ValueError("give k or variance")
    n, sums, gram = _gram(m)
    mean = sums / n
    w, v = np.linalg.eigh(gram - n * np.outer(mean, mean))
    order = np.argsort(-w)
    w, v = np.maximum(w[order], 0), v[:, order]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    share = w / w.sum() if w.sum() else w
    k = k if k is not None else int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1)
    rows = [(i + 1, [float(x) for x in v[:, i]], float(np.sqrt(w[i] / (n - 1))), float(share[i])) for i in range(min(k, len(w)))]
    spark = m.sparkSession
    return {
        "components": spark.createDataFrame(rows, "row_id int, principal_components array<double>, std_dev double, proportion double"),
        "mean": spark.createDataFrame([([float(x) for x in mean],)], "column_mean array<double>"),
    }


def pca_project(m: DataFrame, model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """{projected, residual, summary}: rows on the components, what is left of them, and its norm."""
    v = np.array([r.principal_components for r in model["components"].orderBy("row_id").toLocalIterator()]).T
    mean = np.array(model["mean"].first()[0])
    rows = _rows(m).select("row_id", F.col("row_vec").cast("array<double>").alias("row_vec"))
    projected = _times(rows, v, mean)
    residual = _times(rows, np.eye(len(mean)) - v @ v.T, mean)
    squared = F.aggregate("row_vec", F.lit(0.0), lambda s, e: s + e * e)
    whole = rows.agg(F.sqrt(F.sum(squared)).alias("whole"))
    summary = residual.agg(F.sqrt(F.sum(squared)).alias("residual_norm")).crossJoin(F.broadcast(whole))  # one row each
    return {"projected": projected, "residual": residual, "summary": summary.select("residual_norm", (F.col("residual_norm") / F.col("whole")).alias("relative_residual_norm"))}


def lmf(df: DataFrame, row: str, column: str, value: str, max_rank: int = 20, num_iterations: int = 10, regularization: float = 0.01, seed: int = 0) -> dict[str, DataFrame]:
    """Low-rank factorisation of a sparse matrix: {u, v, rmse}, by alternating least squares (ids are integers)."""
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=max_rank, maxIter=num_iterations, regParam=regularization, userCol="row", itemCol="col", ratingCol="val", seed=seed, coldStartStrategy="drop")
    rows = df.select(F.col(quoted(row)).cast("int").alias("row"), F.col(quoted(column)).cast("int").alias("col"), F.col(quoted(value)).cast("float").alias("val")).dropna()
    model = als.fit(rows)
    rmse = model.transform(rows).agg(F.sqrt(F.avg((F.col("prediction") - F.col("val")) ** 2)).alias("rmse"))
    u = model.userFactors.select(F.col("id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("row_vec"))
    v = model.itemFactors.select(F.col("id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("row_vec"))
    return {"u": u, "v": v, "rmse": rmse}


def svdmf(df: DataFrame, row: str, column: str, value: str, num_features: int = 1, num_iterations: int = 80, min_error: float = 0.0) -> dict[str, DataFrame]:
    """Incremental factorisation, one feature after the other by alternating projections of the residual: {u, v, error}.

    Each half step is a join with one vector and sums by id, over the given entries alone.
    """
    spark = df.sparkSession
    left = df.select(F.col(quoted(row)).alias("r"), F.col(quoted(column)).alias("c"), F.col(quoted(value)).cast("double").alias("x")).dropna()
    u_all, v_all, error = [], [], None
    from corvane.operators.iteration import cut

    for f in range(num_features):
        v = left.select("c").distinct().withColumn("v", F.lit(0.1))
        last = None
        for _ in range(num_iterations):
            u = cut(left.join(v, "c").groupBy("r").agg((F.sum(F.col("x") * F.col("v")) / F.greatest(F.sum(F.col("v") * F.col("v")), F.lit(1e-12))).alias("u")))
            v = cut(left.join(u, "r").groupBy("c").agg((F.sum(F.col("x") * F.col("u")) / F.greatest(F.sum(F.col("u") * F.col("u")), F.lit(1e-12))).alias("v")))
            error = left.join(u, "r").join(v, "c").agg(F.sqrt(F.avg((F.col("x") - F.col("u") * F.col("v")) ** 2))).first()[0]
            if last is not None and last - error <= max(min_error, 1e-9):
                break
            last = error
        u_all.append(u.withColumn("feature", F.lit(f + 1)))
        v_all.append(v.withColumn("feature", F.lit(f + 1)))
        left = cut(left.join(u, "r").join(v, "c").select("r", "c", (F.col("x") - F.col("u") * F.col("v")).alias("x")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return {"u": union(u_all), "v": union(v_all), "error": spark.createDataFrame([(float(error),)], "error double")}


# linear systems


def _solve_group(optimizer: str, a: np.ndarray, b: np.ndarray, opt: dict) -> tuple[np.ndarray, int]:
    name = optimizer.lower()
    if name in ("householderqr", "partialpivlu", "fullpivlu", "colpivhouseholderqr", "fullpivhouseholderqr", "llt", "ldlt", "direct"):
        return (np.linalg.solve(a, b) if a.shape[0] == a.shape[1] and np.linalg.matrix_rank(a) == len(a) else np.linalg.lstsq(a, b, rcond=None)[0]), 0
    if name.startswith(("cg", "bicgstab")):
        return (_cg if name.startswith("cg") else _bicgstab)(lambda v: a @ v, b, opt["max_iter"], opt["toler"], np.diag(a) if name.endswith("precond-diag") else None)
    raise ValueError(f"unknown optimizer {optimizer}")


def _cg(mul, b, max_iter, tolerance, diagonal=None):
    x = np.zeros(len(b))
    r = b.copy()
    scale = 1 / diagonal if diagonal is not None else 1.0
    z = r * scale
    p, rz, i = z.copy(), r @ z, 0
    for i in range(1, max_iter + 1):
        if np.linalg.norm(r) <= tolerance * np.linalg.norm(b):
            break
        q = mul(p)
        alpha = rz / (p @ q)
        x, r = x + alpha * p, r - alpha * q
        z = r * scale
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x, i


def _bicgstab(mul, b, max_iter, tolerance, diagonal=None):
    x, r = np.zeros(len(b)), b.copy()
    scale = 1 / diagonal if diagonal is not None else 1.0
    r0, p = r.copy(), r.copy()
    rho, i = r0 @ r, 0
    for i in range(1, max_iter + 1):
        if np.linalg.norm(r) <= tolerance * np.linalg.norm(b):
            break
        v = mul(p * scale)
        alpha = rho / (r0 @ v)
        s = r - alpha * v
        t = mul(s * scale)
        w = t @ s / (t @ t) if t @ t else 0.0
        x = x + scale * (alpha * p + w * s)
        r = s - w * t
        new = r0 @ r
        p = r + new / rho * (alpha / w if w else 0) * (p - w * v)
        rho = new
    return x, i


def linear_solver_dense(df: DataFrame, row_id: str, lhs: str, rhs: str, groups: list[str] = (), optimizer: str = "direct", optimizer_options=None) -> DataFrame:
    """Solves A x = b, a system for each group: solution, residual_norm, iters. Rows are ordered by row_id."""
    opt = options(optimizer_options, {"max_iter": 1000, "toler": 1e-10})
    groups = list(groups)
    kinds = [f"{quoted(g)} {df.schema[g].dataType.simpleString()}" for g in groups]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        a, b = np.vstack(pdf._a).astype(float), pdf._b.to_numpy(float)
        x, iters = _solve_group(optimizer, a, b, opt)
        norm = float(np.linalg.norm(a @ x - b))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "solution": [x.tolist()], "residual_norm": [norm], "iters": [iters]})

    rows = df.select(*[F.col(quoted(g)) for g in groups], F.col(quoted(row_id)).alias("_i"), F.col(quoted(lhs)).alias("_a"), F.col(quoted(rhs)).alias("_b"))
    return rows.groupBy(*[quoted(g) for g in groups]).applyInPandas(solve, ", ".join([*kinds, "solution array<double>, residual_norm double, iters int"]))


def linear_solver_sparse(lhs: DataFrame, rhs: DataFrame, lhs_row: str = "row_id", lhs_col: str = "col_id", lhs_value: str = "val", rhs_row: str = "row_id", rhs_value: str = "val", num_vars: int | None = None, optimizer: str = "bicgstab", optimizer_options=None) -> DataFrame:
    """Solves A x = b of sparse entries with ids from 0: solution, residual_norm, iters. Products run over the entries in Spark."""
    opt = options(optimizer_options, {"max_iter": 1000, "toler": 1e-10})
    b_rows = [(r[0], r[1]) for r in rhs.select(F.col(rhs_row), F.col(rhs_value).cast("double")).toLocalIterator()]
    n = num_vars or max(r for r, _ in b_rows) + 1
    b = np.zeros(n)
    for i, v in b_rows:
        b[i] = v
    entries = lhs.select(F.col(lhs_row).cast("long").alias("r"), F.col(lhs_col).cast("long").alias("c"), F.col(lhs_value).cast("double").alias("v"))
    if optimizer.lower() in ("llt", "ldlt", "direct"):
        if n * n > M.LIMIT:
            raise ValueError("the system is too large for a direct solver")
        pdf = entries.toPandas()
        a = np.zeros((n, n))
        np.add.at(a, (pdf.r, pdf.c), pdf.v)
        x, iters = np.linalg.solve(a, b), 0
        mul = lambda v: a @ v
    else:
        from corvane.operators.iteration import cut

        entries = cut(entries)

        def mul(v):
            shared = entries.sparkSession.sparkContext.broadcast(v)

            def part(batches):
                out = np.zeros(n)
                for pdf in batches:
                    np.add.at(out, pdf.r.to_numpy(), pdf.v.to_numpy() * shared.value[pdf.c.to_numpy()])
                some = np.flatnonzero(out)
                yield pd.DataFrame({"r": some, "v": out[some]})

            found = entries.mapInPandas(part, "r long, v double").groupBy("r").agg(F.sum("v").alias("v")).toPandas()
            out = np.zeros(n)
            out[found.r.to_numpy(int)] = found.v
            shared.unpersist()
            return out

        x, iters = (_cg if optimizer.lower().startswith("cg") else _bicgstab)(mul, b, opt["max_iter"], opt["toler"])
    norm = float(np.linalg.norm(mul(x) - b))
    return lhs.sparkSession.createDataFrame([([float(v) for v in x], norm, iters)], "solution array<double>, residual_norm double, iters int")


def dense_residual_norm(df: DataFrame, lhs: str, rhs: str, solution: list[float]) -> DataFrame:
    """(residual_norm, relative_residual_norm) of A x = b."""
    x = F.array(*[F.lit(float(v)) for v in solution])
    r = F.aggregate(F.zip_with(F.col(lhs), x, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) - F.col(rhs)
    return df.agg(F.sqrt(F.sum(r * r)).alias("residual_norm"), F.sqrt(F.sum(F.col(rhs) * F.col(rhs))).alias("b")).select("residual_norm", (F.col("residual_norm") / F.col("b")).alias("relative_residual_norm"))


def conjugate_gradient(matrix: DataFrame, b: list[float], precision_limit: float = 1e-10, max_iter: int = 1000) -> np.ndarray:
    """x of A x = b for a symmetric positive definite dense matrix table; each product is one pass."""
    rows = matrix.select(F.col("row_id").cast("long").alias("row_id"), "row_vec")

    def mul(v):
        out = np.zeros(len(v))
        for r in M.vec_mult(rows, [float(e) for e in v]).toLocalIterator():
            out[r.row_id - 1] = r.val
        return out

    return _cg(mul, np.asarray(b, float), max_iter, precision_limit)[0]
