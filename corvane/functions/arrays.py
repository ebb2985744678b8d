"""Array functions as column expressions; all run in the JVM.

Binary functions raise on arrays of different lengths and on null elements, as do functions that say so;
a null array gives null. Reductions ignore null elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _pair(x: ColumnOrName, y: ColumnOrName) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    has_null = F.exists(x, lambda e: e.isNull()) | F.exists(y, lambda e: e.isNull())
    x = F.when(x.isNull() | y.isNull(), F.lit(None)).when(F.size(x) != F.size(y), F.raise_error(F.lit("arrays differ in length"))).when(has_null, F.raise_error(F.lit("array has a null element"))).otherwise(x)
    return x, y


def _zip(x, y, f) -> Column:
    return let(F.struct(col(x).alias("x"), col(y).alias("y")), lambda z: F.zip_with(*_pair(z["x"], z["y"]), f))


def array_add(x, y):
    return _zip(x, y, lambda a, b: a + b)


def array_sub(x, y):
    return _zip(x, y, lambda a, b: a - b)


def array_mult(x, y):
    return _zip(x, y, lambda a, b: a * b)


def array_div(x, y):
    """Quotients; a zero divisor raises."""
    return _zip(x, y, lambda a, b: F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / b))


def _fold(x: Column, zero: str, f) -> Column:
    return F.aggregate(x, F.lit(0).cast(zero), f)


def array_dot(x, y):
    return F.when(col(x).isNull() | col(y).isNull(), F.lit(None)).otherwise(_fold(_zip(x, y, lambda a, b: a.cast("double") * b), "double", lambda s, e: s + e))


def array_contains_all(x, y):
    """Whether each non-zero y[i] equals x[i] (not membership)."""
    return F.forall(_zip(x, y, lambda a, b: (b == 0) | (a == b)), lambda e: e)


def _valid(x: ColumnOrName) -> Column:
    return F.filter(col(x), lambda e: e.isNotNull())


def array_max(x):
    return F.array_max(col(x))


def array_min(x):
    return F.array_min(col(x))


def array_max_index(x):
    """[largest element, its first place from 1]."""
    m = F.array_max(col(x)).cast("double")
    return F.array(m, F.array_position(col(x).cast("array<double>"), m).cast("double"))


def array_min_index(x):
    m = F.array_min(col(x)).cast("double")
    return F.array(m, F.array_position(col(x).cast("array<double>"), m).cast("double"))


def array_sum(x, kind: str = "double"):
    return _fold(_valid(x).cast(f"array<{kind}>"), kind, lambda s, e: s + e)


def array_sum_big(x):
    return array_sum(x, "double")


def array_abs_sum(x):
    return _fold(_valid(x).cast("array<double>"), "double", lambda s, e: s + F.abs(e))


def array_abs(x):
    return F.transform(col(x), F.abs)


def _mean_of(v: Column) -> Column:
    return F.when(F.size(v) > 0, _fold(v.cast("array<double>"), "double", lambda s, e: s + e) / F.size(v))


def array_mean(x):
    return let(_valid(x), _mean_of)


def array_stddev(x):
    """Sample standard deviation of the elements."""

    def of(z):
        v, m = z["v"], z["m"]
        squares = F.aggregate(v, F.lit(0.0), lambda s, e: s + (e - m) * (e - m))
        return F.when(F.size(v) == 1, F.lit(0.0)).when(F.size(v) > 1, F.sqrt(squares / (F.size(v) - 1)))

    return let(let(_valid(x), lambda v: F.struct(v.alias("v"), _mean_of(v).alias("m"))), of)


def array_of_float(k):
    return F.array_repeat(F.lit(0.0), col(k) if isinstance(k, str | Column) else F.lit(k))


def array_of_bigint(k):
    return F.array_repeat(F.lit(0).cast("long"), col(k) if isinstance(k, str | Column) else F.lit(k))


def _lit(k) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def array_fill(x, k):
    """The array with every element set to k."""
    return F.transform(col(x), lambda e: _lit(k))


def array_cos(x):
    return F.transform(col(x), F.cos)


def array_scalar_mult(x, k):
    return F.transform(col(x), lambda e: e * _lit(k))


def array_scalar_add(x, k):
    return F.transform(col(x), lambda e: e + _lit(k))


_KEEP = {"<": lambda e, k: e < k, "<=": lambda e, k: e <= k, ">": lambda e, k: e > k, ">=": lambda e, k: e >= k, "=": lambda e, k: e == k, "==": lambda e, k: e == k, "!=": lambda e, k: e != k, "<>": lambda e, k: e != k}


def array_filter(x, k=0, op: str = "!="):
    """The elements for which `element op k` holds; as it is given, those that aren't zero."""
    return F.filter(col(x), lambda e: _KEEP[op](e, _lit(k)))


def array_sqrt(x):
    return F.transform(col(x), lambda e: F.when(e < 0, F.raise_error(F.lit("square root of a negative number")).cast("double")).otherwise(F.sqrt(e)))


def array_pow(x, k):
    return F.transform(col(x), lambda e: F.pow(e, _lit(k)))


def array_square(x):
    return F.transform(col(x), lambda e: e * e)


def normalize(x):
    """The array over its 2-norm; of norm zero as it is."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    pair = let(col(x), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return let(pair, lambda z: F.transform(z["v"], lambda e: F.when(z["n"] > 0, e / z["n"]).otherwise(e.cast("double"))))


def array_contains_null(x):
    return F.exists(col(x), lambda e: e.isNull())


def array_collapse(x):
    """A two-dimensional array as text, [a:b, a:b]."""
    return F.concat(F.lit("["), F.array_join(F.transform(col(x), lambda e: F.array_join(e, ":")), ", "), F.lit("]"))


def deconstruct_2d_array(x):
    """Generator: one row for each row of a two-dimensional array."""
    return F.explode(col(x))


def array_to_1d(x):
    """Rows, columns, then all elements row by row."""
    x = col(x)
    return F.concat(F.array(F.size(x).cast("double"), F.size(x[0]).cast("double")), F.flatten(x).cast("array<double>"))


def array_to_2d(x):
    """Inverse of array_to_1d."""
    x = col(x)
    n = x[1].cast("int")
    return F.transform(F.sequence(F.lit(0), x[0].cast("int") - 1), lambda i: F.slice(x, i * n + 3, n))


def get_row(x, i: int):
    """Row i, from 1."""
    return F.element_at(col(x), i)


index_2d_array = get_row


def get_col(x, j: int):
    """Column j, from 1."""
    return F.transform(col(x), lambda r: F.element_at(r, j))


def matrix_column(x, j: int):
    """Column j of a matrix that is stored as its columns."""
    return F.element_at(col(x), j)


def matrix_mem_trans(x):
    x = col(x)
    return F.transform(F.sequence(F.lit(1), F.size(x[0])), lambda j: F.transform(x, lambda r: F.element_at(r, j)))


def matrix_mem_mult(a, b, trans_b: bool = False):
    a, b = col(a), col(b)
    columns = b if trans_b else matrix_mem_trans(b)
    return F.transform(a, lambda r: F.transform(columns, lambda c: F.aggregate(F.zip_with(r, c, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)))


# aggregates over rows of arrays: `width` elements each


def sum_arrays(x, width: int):
    """Aggregate: element-wise sum."""
    return F.array(*[F.sum(col(x)[i]) for i in range(width)])


def avg_arrays(x, width: int):
    """Aggregate: element-wise mean."""
    return F.array(*[F.avg(col(x)[i]) for i in range(width)])


def normalized_avg(x, width: int):
    """Aggregate: mean of the unit-normed arrays, normed again."""
    return normalize(avg_arrays(normalize(x), width))


def array_element_min(x, width: int):
    return F.array(*[F.min(col(x)[i]) for i in range(width)])


def array_element_max(x, width: int):
    return F.array(*[F.max(col(x)[i]) for i in range(width)])


def array_avg(x, width: int, use_abs: bool = False):
    """Aggregate: element-wise mean, of absolute values if asked for."""
    return F.array(*[F.avg(F.abs(col(x)[i]) if use_abs else col(x)[i]) for i in range(width)])


def crossprod(x, y, width_x: int, width_y: int):
    """Aggregate: sum of outer products, row by row."""
    return F.array(*[F.sum(col(x)[i] * col(y)[j]) for i in range(width_x) for j in range(width_y)])


def crossprod_sym(x, width: int):
    """Aggregate: sum of x times itself, the lower triangle row by row."""
    return F.array(*[F.sum(col(x)[i] * col(x)[j]) for i in range(width) for j in range(i + 1)])


def var_scales(x, width: int):
    """Aggregate: struct of element-wise means and population standard deviations."""
    return F.struct(avg_arrays(x, width).alias("mean"), F.array(*[F.stddev_pop(col(x)[i]) for i in range(width)]).alias("std"))


def normalize_data(x, mean, std):
    """(x - mean) / std; where std is zero, x - mean."""
    z = F.arrays_zip(col(x).alias("x"), col(mean).alias("m"), col(std).alias("s"))
    return F.transform(z, lambda e: (e["x"] - e["m"]) / F.when(e["s"] == 0, F.lit(1.0)).otherwise(e["s"]))


def vectorized_distribution(x, levels: list[int]):
    """Aggregate: for each element of an integer array the counts of the values 0..levels[i]-1."""
    return F.array(*[F.array(*[F.count(F.when(col(x)[i] == v, 1)) for v in range(n)]) for i, n in enumerate(levels)])


def discrete_distribution(index, weight, levels: int):
    """Aggregate: share of the weight at each of the values 0..levels-1."""
    total = F.sum(F.when((col(index) >= 0) & (col(index) < levels), col(weight)))
    return F.array(*[F.coalesce(F.sum(F.when(col(index) == v, col(weight))), F.lit(0.0)) / total for v in range(levels)])


def array_elem_corr(x, y, width: int):
    """Aggregate: correlation of each element with y."""
    return F.array(*[F.corr(col(x)[i], col(y)) for i in range(width)])


def array_union(x, order):
    """Aggregate: arrays one after the other, in order."""
    found = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(x).alias("x"))))
    return F.flatten(F.transform(found, lambda e: e["x"]))


def array_agg(x):
    """Aggregate: all values, nulls too."""
    return F.expr(f"array_agg({x})") if isinstance(x, str) else F.array_agg(x)
