"""Matrix operations over tables.

A dense matrix has rows (row_id, row_vec), ids from 1; a sparse one entries (row_id, col_id, val), whose largest
ids give the shape: constructors and `sparsify` keep an explicit zero in the last corner. All operations
run on entries (joins and sums); only decompositions gather the matrix, up to `LIMIT` elements.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Elements of a matrix that a decomposition gathers at most.
LIMIT = 25_000_000
#: Elements of products that a task adds up before it passes them on.
HELD = 1 << 21
SPARSE = ["row_id", "col_id", "val"]


def is_dense(m: DataFrame) -> bool:
    return "row_vec" in m.columns


def entries(m: DataFrame) -> DataFrame:
    """All entries of a dense, sparse or block matrix."""
    if is_dense(m):
        return m.select(F.col("row_id").cast("long"), F.posexplode("row_vec").alias("p", "val")).select("row_id", (F.col("p") + 1).cast("long").alias("col_id"), F.col("val").cast("double"))
    if "block" in m.columns:
        return unblockize(m)
    return m.select(F.col("row_id").cast("long"), F.col("col_id").cast("long"), F.col("val").cast("double"))


def from_columns(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Dense matrix from a table with a column for each matrix column."""
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("row_vec"))


def ndims(m: DataFrame) -> tuple[int, int]:
    if is_dense(m):
        r = m.agg(F.max("row_id"), F.max(F.size("row_vec"))).first()
    else:
        r = entries(m).agg(F.max("row_id"), F.max("col_id")).first()
    return int(r[0] or 0), int(r[1] or 0)


def ndims_table(m: DataFrame) -> DataFrame:
    if is_dense(m):
        return m.agg(F.max("row_id").cast("long").alias("rows"), F.max(F.size("row_vec")).cast("long").alias("cols"))
    return entries(m).agg(F.max("row_id").alias("rows"), F.max("col_id").alias("cols"))


def _corner(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Non-zero entries, and a zero in the last corner if there is none."""
    spark = m.sparkSession
    corner = spark.createDataFrame([(rows, cols, 0.0)], "row_id long, col_id long, val double")
    return m.filter("val <> 0").unionByName(corner).groupBy("row_id", "col_id").agg(F.sum("val").alias("val"))


def sparsify(m: DataFrame) -> DataFrame:
    return _corner(entries(m), *ndims(m))


def densify(m: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Row vectors; rows and elements without entries are zero."""
    shape = ndims(m) if rows is None or cols is None else (rows, cols)
    e = entries(m)
    filled = e.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "val"))).alias("m"))
    ids = m.sparkSession.range(1, shape[0] + 1).withColumnRenamed("id", "row_id")
    vector = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(shape[1]).cast("long")), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0)))
    empty = F.array_repeat(F.lit(0.0), shape[1])
    return ids.join(filled, "row_id", "left").select("row_id", F.when(F.col("m").isNull(), empty).otherwise(vector).alias("row_vec"))


def trans(m: DataFrame) -> DataFrame:
    e = entries(m).select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "val")
    return densify(e) if is_dense(m) else e


def _same_shape(a: DataFrame, b: DataFrame) -> tuple[int, int]:
    x, y = ndims(a), ndims(b)
    if x != y:
        raise ValueError(f"matrices of {x[0]} x {x[1]} and {y[0]} x {y[1]} don't fit")
    return x


def _combine(a: DataFrame, b: DataFrame, scale_b: float) -> DataFrame:
    shape = _same_shape(a, b)
    both = entries(a).unionByName(entries(b).withColumn("val", F.col("val") * scale_b)).groupBy("row_id", "col_id").agg(F.sum("val").alias("val"))
    return densify(both, *shape) if is_dense(a) and is_dense(b) else _corner(both, *shape)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, 1.0)


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combine(a, b, -1.0)


def scale_and_add(a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    return _combine(a, b, scale)


def elem_mult(a: DataFrame, b: DataFrame) -> DataFrame:
    shape = _same_shape(a, b)
    e = entries(a).join(entries(b).withColumnRenamed("val", "w"), ["row_id", "col_id"]).select("row_id", "col_id", (F.col("val") * F.col("w")).alias("val"))
    return densify(e, *shape) if is_dense(a) and is_dense(b) else _corner(e, *shape)


def scalar_mult(m: DataFrame, scalar: float) -> DataFrame:
    if is_dense(m):
        return m.select("row_id", F.transform("row_vec", lambda e: e * F.lit(float(scalar))).alias("row_vec"))
    return m.withColumn("val", F.col("val") * float(scalar))


def mult_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of the product: a join on the inner index, then sums."""
    left = entries(a).filter("val <> 0").select("row_id", F.col("col_id").alias("k"), F.col("val").alias("x"))
    right = entries(b).filter("val <> 0").select(F.col("row_id").alias("k"), "col_id", F.col("val").alias("y"))
    return left.join(right, "k").groupBy("row_id", "col_id").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def mult(a: DataFrame, b: DataFrame, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    a2, b2 = trans(a) if trans_a else a, trans(b) if trans_b else b
    (n, k), (k2, m) = ndims(a2), ndims(b2)
    if k != k2:
        raise ValueError(f"matrices of {n} x {k} and {k2} x {m} can't be multiplied")
    if is_dense(a) and is_dense(b):
        return block_mult_dense(a2, b2, (n, k, m))
    return _corner(mult_entries(a2, b2), n, m)


def square(m: DataFrame) -> DataFrame:
    """The matrix times its transpose."""
    return mult(m, trans(m))


def vec_mult(m: DataFrame, vector: list[float]) -> DataFrame:
    """(row_id, val): the matrix times a vector."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    if is_dense(m):
        dot = F.aggregate(F.zip_with("row_vec", v, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
        return m.select(F.col("row_id").cast("long"), dot.alias("val"))
    return entries(m).groupBy("row_id").agg(F.sum(F.col("val") * F.element_at(v, F.col("col_id").cast("int"))).alias("val"))


def extract_row(m: DataFrame, index: int) -> DataFrame:
    return entries(m).filter(F.col("row_id") == index).select("col_id", "val")


def extract_col(m: DataFrame, index: int) -> DataFrame:
    return entries(m).filter(F.col("col_id") == index).select("row_id", "val")


def extract_diag(m: DataFrame) -> DataFrame:
    return entries(m).filter("row_id = col_id").select("row_id", "val")


def _reduced(m: DataFrame, dim: int, f) -> DataFrame:
    """dim 1 goes over rows and leaves a value for each column; 2 the other way."""
    if dim not in (1, 2):
        raise ValueError("dim is 1 or 2")
    by = "col_id" if dim == 1 else "row_id"
    rows, cols = ndims(m)
    e = entries(m)
    return f(e, by, rows if dim == 1 else cols)


def sum_(m: DataFrame, dim: int) -> DataFrame:
    return _reduced(m, dim, lambda e, by, n: e.groupBy(by).agg(F.sum("val").alias("val")))


def mean(m: DataFrame, dim: int) -> DataFrame:
    return _reduced(m, dim, lambda e, by, n: e.groupBy(by).agg((F.sum("val") / n).alias("val")))


def _extremum(m: DataFrame, dim: int, fetch_index: bool, sign: int) -> DataFrame:
    def f(e, by, n):
        other = "row_id" if by == "col_id" else "col_id"
        key = F.struct((F.col("val") * sign).alias("v"), (-F.col(other)).alias("i"))
        best = e.groupBy(by).agg(F.max(key).alias("b"), F.count("*").alias("n"))
        value = F.col("b.v") * sign
        missing = F.col("n") < n  # an entry that isn't stored is zero
        out = F.when(missing & (F.col("b.v") < 0), F.lit(0.0)).otherwise(value)
        return best.select(by, *([(-F.col("b.i")).alias("index")] if fetch_index else []), out.alias("val"))

    return _reduced(m, dim, f)


def max_(m: DataFrame, dim: int, fetch_index: bool = False) -> DataFrame:
    return _extremum(m, dim, fetch_index, 1)


def min_(m: DataFrame, dim: int, fetch_index: bool = False) -> DataFrame:
    return _extremum(m, dim, fetch_index, -1)


def norm(m: DataFrame, kind: str = "fro") -> float:
    """one, inf, max, spectral, fro, or a number p (p-norm of all elements); prefixes will do."""
    e, kind = entries(m), str(kind).lower()
    for name in ("one", "inf", "max", "spectral", "fro"):
        if name.startswith(kind) or kind.startswith(name):
            if name in ("one", "inf"):
                by = "col_id" if name == "one" else "row_id"
                return e.groupBy(by).agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s")).first()[0]
            if name == "max":
                return e.agg(F.max(F.abs("val"))).first()[0]
            if name == "fro":
                return e.agg(F.sqrt(F.sum(F.col("val") * F.col("val")))).first()[0]
            return float(np.linalg.norm(collect(m), 2))
    p = float(kind)
    return e.agg(F.pow(F.sum(F.pow(F.abs("val"), F.lit(p))), F.lit(1 / p))).first()[0]


def zeros(spark: SparkSession, rows: int, cols: int, sparse: bool = False) -> DataFrame:
    return _constant(spark, rows, cols, 0.0) if not sparse else spark.createDataFrame([(rows, cols, 0.0)], "row_id long, col_id long, val double")


def ones(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return _constant(spark, rows, cols, 1.0)


def _constant(spark, rows, cols, value) -> DataFrame:
    return spark.range(1, rows + 1).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(value), cols).alias("row_vec"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("row_id"), F.col("id").alias("col_id"), F.lit(1.0).alias("val"))


def diag(spark: SparkSession, elements: list[float]) -> DataFrame:
    return spark.createDataFrame([(i + 1, i + 1, float(x)) for i, x in enumerate(elements)], "row_id long, col_id long, val double")


def random(spark: SparkSession, rows: int, cols: int, distribution: str = "normal", seed: int = 0, **p) -> DataFrame:
    """normal (mean, sd), uniform (low, high) or bernoulli (p)."""
    at = F.posexplode(F.sequence(F.lit(1), F.lit(cols))).alias("p", "col")
    cells = spark.range(1, rows + 1).select(F.col("id").alias("row_id"), at)
    if distribution.startswith("norm"):
        value = F.randn(seed) * p.get("sd", 1.0) + p.get("mean", 0.0)
    elif distribution.startswith("unif"):
        value = F.rand(seed) * (p.get("high", 1.0) - p.get("low", 0.0)) + p.get("low", 0.0)
    elif distribution.startswith("bern"):
        value = (F.rand(seed) < p.get("p", 0.5)).cast("double")
    else:
        raise ValueError("unknown distribution")
    return cells.select("row_id", F.col("col").cast("long").alias("col_id"), value.alias("val")).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "val"))).alias("l")).select("row_id", F.col("l.val").alias("row_vec"))


# blocks


def blockize(m: DataFrame, rsize: int, csize: int) -> DataFrame:
    """(row_id, col_id, block): block ids from 1; blocks at the end may be smaller."""
    e = entries(m)
    cell = F.struct(((F.col("row_id") - 1) % rsize).alias("r"), ((F.col("col_id") - 1) % csize).alias("c"), "val")
    blocks = e.select(F.floor((F.col("row_id") - 1) / rsize + 1).cast("long").alias("row_id"), F.floor((F.col("col_id") - 1) / csize + 1).cast("long").alias("col_id"), cell.alias("cell")).groupBy("row_id", "col_id").agg(F.collect_list("cell").alias("cells"))
    height, width = F.array_max(F.transform("cells", lambda x: x["r"])) + 1, F.array_max(F.transform("cells", lambda x: x["c"])) + 1
    lookup = F.map_from_entries(F.transform("cells", lambda x: F.struct((x["r"] * csize + x["c"]).alias("k"), x["val"].alias("v"))))
    made = blocks.select("row_id", "col_id", height.alias("h"), width.alias("w"), lookup.alias("m"))
    return made.select(
        "row_id", "col_id",
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), lambda r: F.transform(F.sequence(F.lit(0).cast("long"), F.col("w") - 1), lambda c: F.coalesce(F.col("m")[r * csize + c], F.lit(0.0)))).alias("block"),
    )


def unblockize(m: DataFrame) -> DataFrame:
    """Entries of a block matrix; all blocks but the last have the size of the first."""
    size = m.filter("row_id = 1 AND col_id = 1").select(F.size("block"), F.size(F.col("block")[0])).first()
    rows = m.select(F.col("row_id").alias("br"), F.col("col_id").alias("bc"), F.posexplode("block").alias("r", "row"))
    cells = rows.select("br", "bc", "r", F.posexplode("row").alias("c", "val"))
    return cells.select(((F.col("br") - 1) * size[0] + F.col("r") + 1).alias("row_id"), ((F.col("bc") - 1) * size[1] + F.col("c") + 1).alias("col_id"), F.col("val").cast("double"))


def block_trans(m: DataFrame) -> DataFrame:
    from corvane.functions.arrays import matrix_mem_trans

    return m.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), matrix_mem_trans("block").alias("block"))


def block_mult(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of block matrices: blocks meet on the inner index and are multiplied by numpy.

    A task adds up products of the same place as it goes (HELD of them at a time); the rest is summed element by element.
    """
    import pandas as pd

    pairs = a.select("row_id", F.col("col_id").alias("k"), F.col("block").alias("x")).join(b.select(F.col("row_id").alias("k"), "col_id", F.col("block").alias("y")), "k")

    def multiply(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for r, c, x, y in zip(pdf.row_id, pdf.col_id, pdf.x, pdf.y):
                made = np.vstack(x).astype(float) @ np.vstack(y).astype(float)
                held[r, c] = held[r, c] + made if (r, c) in held else made
                if sum(v.size for v in held.values()) > HELD:
                    yield from _cells(held)
                    held = {}
        yield from _cells(held)

    def _cells(held):
        for (r, c), v in held.items():
            i, j = np.indices(v.shape)
            yield pd.DataFrame({"row_id": r, "col_id": c, "i": i.ravel(), "j": j.ravel(), "v": v.ravel()})

    cells = pairs.mapInPandas(multiply, "row_id long, col_id long, i int, j int, v double").groupBy("row_id", "col_id", "i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("row_id", "col_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    whole = rows.groupBy("row_id", "col_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("r.v").alias("v")))).alias("b"))  # one block
    return whole.select("row_id", "col_id", F.col("b.v").alias("block"))


def block_square(m: DataFrame) -> DataFrame:
    return block_mult(m, block_trans(m))


def block_mult_dense(a: DataFrame, b: DataFrame, shape: tuple[int, int, int], block: int = 256) -> DataFrame:
    """Product of dense matrices over blocks."""
    n, _, m = shape
    return densify(unblockize(block_mult(blockize(a, block, block), blockize(b, block, block))), n, m)


# decompositions of matrices that fit one machine


def collect(m: DataFrame) -> np.ndarray:
    """The matrix as a numpy array; more than LIMIT elements raise."""
    rows, cols = ndims(m)
    if rows * cols > LIMIT:
        raise ValueError(f"a matrix of {rows} x {cols} is too large to be decomposed in one place")
    out = np.zeros((rows, cols))
    pdf = entries(m).toPandas()
    np.add.at(out, (pdf.row_id.to_numpy() - 1, pdf.col_id.to_numpy() - 1), pdf.val.to_numpy())
    return out


def table(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i + 1, [float(v) for v in row]) for i, row in enumerate(np.atleast_2d(a))], "row_id long, row_vec array<double>")


def inverse(m: DataFrame) -> DataFrame:
    return table(m.sparkSession, np.linalg.inv(collect(m)))


def pinv(m: DataFrame) -> DataFrame:
    return table(m.sparkSession, np.linalg.pinv(collect(m)))


def eigen(m: DataFrame) -> DataFrame:
    """(row_id, eigen_value struct<re, im>), by falling absolute value."""
    values = np.linalg.eigvals(collect(m)).astype(complex)
    values = values[np.argsort(-np.abs(values), kind="stable")]
    return m.sparkSession.createDataFrame([(i + 1, (float(v.real), float(v.imag))) for i, v in enumerate(values)], "row_id long, eigen_value struct<re:double,im:double>")


def cholesky(m: DataFrame) -> dict[str, DataFrame]:
    """{p, l, d}: P A P' = L D L' without pivoting (P is the identity)."""
    a = collect(m)
    lower = np.linalg.cholesky(a)
    d = np.diag(lower)
    return {"p": table(m.sparkSession, np.eye(len(a))), "l": table(m.sparkSession, lower / d), "d": table(m.sparkSession, np.diag(d * d))}


def qr(m: DataFrame) -> dict[str, DataFrame]:
    q, r = np.linalg.qr(collect(m), mode="complete")
    return {"q": table(m.sparkSession, q), "r": table(m.sparkSession, r)}


def lu(m: DataFrame) -> dict[str, DataFrame]:
    """{p, l, u, q}: P A Q = L U with full pivoting."""
    a = collect(m).copy()
    n, k = a.shape
    p, q = np.arange(n), np.arange(k)
    for i in range(min(n, k)):
        r, c = np.unravel_index(np.argmax(np.abs(a[i:, i:])), a[i:, i:].shape)
        a[[i, i + r]], p[[i, i + r]] = a[[i + r, i]], p[[i + r, i]]
        a[:, [i, i + c]], q[[i, i + c]] = a[:, [i + c, i]], q[[i + c, i]]
        if a[i, i] == 0:
            break
        a[i + 1 :, i] /= a[i, i]
        a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :])
    d = min(n, k)
    spark = m.sparkSession
    return {"p": table(spark, np.eye(n)[p]), "l": table(spark, np.tril(a[:, :d], -1) + np.eye(n, d)), "u": table(spark, np.triu(a[:d])), "q": table(spark, np.eye(k)[:, q])}


def rank(m: DataFrame) -> int:
    return int(np.linalg.matrix_rank(collect(m)))


def nuclear_norm(m: DataFrame) -> float:
    return float(np.linalg.svd(collect(m), compute_uv=False).sum())


def gather_columns(df: DataFrame, vector: str, order: str) -> DataFrame:
    """(matrix): the vectors as the columns of one in-memory matrix, in order."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v")))), lambda e: e["v"]).alias("matrix"))


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """Numbers rows from 1 in order; for tables that fit one task."""
    return df.withColumn("row_id", F.row_number().over(Window.orderBy(order)).cast("long"))
