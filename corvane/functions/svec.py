"""Sparse vectors: runs of equal values, struct<n: array<long>, v: array<double>>.

Two runs that follow each other have different values. Text form: {counts}:{values}, NVP for null. A vector
of dimension 1 is a scalar and is broadcast by binary operators; other dimensions must agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.arrays import col, let
from corvane.functions.metrics import cosine_similarity  # noqa: F401

KIND = "struct<n:array<bigint>,v:array<double>>"


def to_array(s) -> Column:
    """All elements."""
    return let(col(s), lambda s: F.flatten(F.zip_with(s["n"], s["v"], lambda n, v: F.array_repeat(v, n.cast("int")))))


def from_array(x) -> Column:
    """The runs of an array."""
    return let(col(x).cast("array<double>"), _runs_of)


def _runs_of(x: Column) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | ~F.element_at(x, i).eqNullSafe(F.get(x, i - 2)))

    def of(starts):
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(x) + 1))
        return F.struct(F.zip_with(starts, ends, lambda a, b: (b - a).cast("long")).alias("n"), F.transform(starts, lambda i: F.element_at(x, i)).alias("v"))

    made = let(starts, of)
    empty = F.struct(F.array().cast("array<bigint>").alias("n"), F.array().cast("array<double>").alias("v"))
    return F.when(x.isNull(), F.lit(None).cast(KIND)).when(F.size(x) == 0, empty).otherwise(made)


def from_scalar(x) -> Column:
    x = col(x).cast("double")
    return F.when(x.isNotNull(), F.struct(F.array(F.lit(1).cast("long")).alias("n"), F.array(x).alias("v")))


def from_positions(positions, values, length, base=0.0) -> Column:
    """Positions (from 1) and their values in a vector of `length` elements that are otherwise `base`."""
    m = F.map_from_arrays(col(positions).cast("array<int>"), col(values).cast("array<double>"))
    n = F.lit(length) if isinstance(length, int) else col(length)
    return let(F.struct(m.alias("m"), n.cast("int").alias("n"), F.lit(float(base)).alias("b")), _runs_at)


def _runs_at(z: Column) -> Column:
    """The runs of z.n elements that are z.b but where the map z.m has a value, by its entries alone."""
    piece = lambda at, v: F.struct(at.cast("long").alias("at"), v.alias("v"))
    held = F.filter(F.map_entries(z["m"]), lambda e: (e["key"] >= 1) & (e["key"] <= z["n"]))
    held = F.array_sort(F.transform(F.coalesce(held, F.array().cast("array<struct<key:int,value:double>>")), lambda e: piece(e["key"], F.coalesce(e["value"], z["b"]))))

    def pieces(h):
        """Where values start: each entry, and the base after an entry that no other one follows."""
        after = F.transform(h, lambda e, i: F.when((e["at"] < z["n"]) & ~F.coalesce(F.get(h, i + 1)["at"] == e["at"] + 1, F.lit(False)), F.array(e, piece(e["at"] + 1, z["b"]))).otherwise(F.array(e)))
        first = F.when(F.coalesce(F.get(h, F.lit(0))["at"] == 1, F.lit(False)), F.array().cast("array<struct<at:bigint,v:double>>")).otherwise(F.array(piece(F.lit(1), z["b"])))
        return F.concat(first, F.flatten(after))

    def merged(p):
        starts = F.filter(p, lambda e, i: (i == 0) | ~F.get(p, i - 1)["v"].eqNullSafe(e["v"]))
        return let(starts, lambda s: F.struct(F.transform(s, lambda e, i: F.coalesce(F.get(s, i + 1)["at"], z["n"] + F.lit(1).cast("long")) - e["at"]).alias("n"), F.transform(s, lambda e: e["v"]).alias("v")))

    return F.when(z["n"].isNotNull(), let(let(held, pieces), merged))


def to_string(s) -> Column:
    s = col(s)
    number = lambda e: F.when(e.isNull(), F.lit("NVP")).when(e == F.floor(e), e.cast("decimal(38,0)").cast("string")).otherwise(e.cast("string"))
    return F.when(s.isNotNull(), F.concat(F.lit("{"), F.array_join(s["n"].cast("array<string>"), ","), F.lit("}:{"), F.array_join(F.transform(s["v"], number), ","), F.lit("}")))


def from_string(x) -> Column:
    x = col(x)
    part = lambda k: F.split(F.regexp_extract(x, r"^\s*\{([^}]*)\}\s*:\s*\{([^}]*)\}\s*$", k), ",")
    values = F.transform(part(2), lambda e: F.when(F.trim(e) == "NVP", F.lit(None)).otherwise(F.trim(e).cast("double")))
    return F.when(x.isNotNull(), F.struct(F.transform(part(1), lambda e: F.trim(e).cast("long")).alias("n"), values.alias("v")))


def send(s) -> Column:
    """Binary form: the text form's bytes."""
    return F.encode(to_string(s), "UTF-8")


def recv(x) -> Column:
    return from_string(F.decode(col(x), "UTF-8"))


def dmin(a, b) -> Column:
    """The lesser of two numbers; a null gives way to a number."""
    return F.least(col(a), col(b))


def dmax(a, b) -> Column:
    return F.greatest(col(a), col(b))


def dimension(s) -> Column:
    return F.aggregate(col(s)["n"], F.lit(0).cast("long"), lambda a, e: a + e)


def _binary(a, b, f) -> Column:
    """Element by element; both may be a svec or an array."""
    return let(F.struct(_dense(a).alias("x"), _dense(b).alias("y")), lambda z: _each(z["x"], z["y"], f))


def _each(x: Column, y: Column, f) -> Column:
    n = F.greatest(F.size(x), F.size(y))
    grow = lambda z: F.when((F.size(z) == 1) & (n > 1), F.array_repeat(z[0], n)).otherwise(z)
    bad = (F.size(x) != F.size(y)) & (F.size(x) != 1) & (F.size(y) != 1)
    x2 = F.when(x.isNull() | y.isNull(), F.lit(None)).when(bad, F.raise_error(F.lit("vectors differ in dimension"))).otherwise(grow(x))
    return F.zip_with(x2, grow(y), f)


class Dense:
    """Marks an argument as a plain array."""

    def __init__(self, x):
        self.x = col(x)


def _dense(x) -> Column:
    return x.x.cast("array<double>") if isinstance(x, Dense) else to_array(x)


def plus(a, b):
    return from_array(_binary(a, b, lambda p, q: p + q))


def minus(a, b):
    return from_array(_binary(a, b, lambda p, q: p - q))


def mult(a, b):
    return from_array(_binary(a, b, lambda p, q: p * q))


def div(a, b):
    """IEEE quotients: x/0 is infinite, 0/0 NaN."""
    inf = F.lit(float("inf"))
    return from_array(_binary(a, b, lambda p, q: F.when(q != 0, p / F.when(q != 0, q)).when((p == 0) | F.isnan(p), F.lit(float("nan"))).otherwise(F.signum(p) * inf)))


def power(a, b):
    return from_array(_binary(a, b, lambda p, q: F.pow(p, q)))


def dot(a, b):
    return F.aggregate(_binary(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)


def concat(a, b):
    """One after the other; null counts as empty."""
    none = F.array().cast("array<double>")
    return from_array(F.concat(F.coalesce(to_array(a), none), F.coalesce(to_array(b), none)))


def replicate(times, a):
    times = F.lit(times) if isinstance(times, int) else col(times)
    return from_array(F.flatten(F.array_repeat(to_array(a), times)))


def _key(s) -> Column:
    """Elements such that arrays compare as vectors do: numbers, NaN above them, null above all."""
    return F.transform(to_array(s), lambda e: F.struct(e.isNull().alias("u"), F.coalesce(e, F.lit(0.0)).alias("e")))


def compare(a, b):
    """-1, 0 or 1, lexicographically."""
    return let(F.struct(_key(a).alias("x"), _key(b).alias("y")), lambda z: F.when(z["x"] < z["y"], -1).when(z["x"] == z["y"], 0).when(z["x"] > z["y"], 1))


def eq(a, b):
    return compare(a, b) == 0


def ne(a, b):
    return compare(a, b) != 0


def lt(a, b):
    return compare(a, b) < 0


def le(a, b):
    return compare(a, b) <= 0


def gt(a, b):
    return compare(a, b) > 0


def ge(a, b):
    return compare(a, b) >= 0


def _runs(s, f) -> Column:
    return let(col(s), lambda s: F.aggregate(F.zip_with(s["n"], s["v"], lambda n, v: n * f(v)), F.lit(0.0), lambda t, e: t + e))


def elsum(s):
    return _runs(s, lambda v: v)


def l1norm(s):
    return _runs(s, F.abs)


def l2norm(s):
    return F.sqrt(_runs(s, lambda v: v * v))


def l2norm_distance(a, b):
    return l2norm(minus(a, b))


def l1norm_distance(a, b):
    return l1norm(minus(a, b))


def l2_compare(a, b):
    """-1, 0 or 1 by 2-norm; null where a norm is."""
    x, y = l2norm(a), l2norm(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)


def angle(a, b):
    n = let(l2norm(a) * l2norm(b), lambda n: F.when(n != 0, n))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def tanimoto_distance(a, b):
    pair = F.struct((_runs(a, lambda v: v * v) + _runs(b, lambda v: v * v)).alias("s"), dot(a, b).alias("d"))
    return let(pair, lambda z: F.when(z["s"] == z["d"], F.lit(0.0)).otherwise(1 - z["d"] / F.when(z["s"] != z["d"], z["s"] - z["d"])))


def lapply(f, s):
    """f of each element."""
    s = col(s)
    f = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil}[f] if isinstance(f, str) else f
    return from_array(F.transform(to_array(s), lambda e: f(e).cast("double")))


def log(s):
    return lapply(F.log, s)


def normalize(s):
    pair = F.struct(to_array(s).alias("x"), l2norm(s).alias("n"))
    return from_array(let(pair, lambda z: F.transform(z["x"], lambda e: F.when(z["n"] > 0, e / z["n"]).otherwise(e))))


def count(a, b):
    """a plus 1 wherever b isn't zero."""
    return from_array(_binary(a, b, lambda p, q: p + F.when(q != 0, 1.0).otherwise(0.0)))


def eq_non_zero(a, b):
    """Equality with zero on either side as a wildcard."""
    return F.forall(_binary(a, b, lambda p, q: (p == 0) | (q == 0) | (p == q)), lambda e: e)


def contains(a, b):
    """Whether every non-zero element of b equals that of a."""
    return F.forall(_binary(a, b, lambda p, q: (q == 0) | (p == q)), lambda e: e)


def unnest(s):
    """Generator: one row for each element."""
    return F.explode(to_array(s))


def pivot(s, value):
    """The vector with one more element."""
    none = F.array().cast("array<double>")
    return from_array(F.concat(F.coalesce(to_array(s), none), F.array(col(value).cast("double"))))


def append(s, value: float, n: int):
    return from_array(F.concat(to_array(s), F.array_repeat(F.lit(float(value)), n)))


def proj(s, i: int):
    """Element i, from 1."""
    return F.element_at(to_array(s), i)


def subvec(s, start: int, end: int):
    """Elements start..end, from 1; reversed where start > end."""
    lo, hi = min(start, end), max(start, end)
    x = F.slice(to_array(s), lo, hi - lo + 1)
    return from_array(F.reverse(x) if start > end else x)


def reverse(s):
    return from_array(F.reverse(to_array(s)))


def change(s, start: int, other):
    """The vector with the elements from `start` on replaced by another's."""
    both = F.struct(to_array(s).alias("x"), to_array(other).alias("y"))
    return from_array(let(both, lambda z: F.concat(F.slice(z["x"], 1, start - 1), z["y"], F.slice(z["x"], F.size(z["y"]) + start, F.greatest(F.size(z["x"]), F.lit(1))))))


def hash_(s):
    s = col(s)
    return F.hash(s["n"], s["v"])


def nonbase_positions(s, base: float = 0.0):
    """Positions (from 1) of the elements that aren't `base`."""
    x = to_array(s)
    return F.transform(F.filter(F.transform(x, lambda e, i: F.struct(e.alias("e"), (i + 1).cast("long").alias("i"))), lambda z: z["e"] != base), lambda z: z["i"])


def nonbase_values(s, base: float = 0.0):
    runs = let(col(s), lambda s: F.filter(F.zip_with(s["n"], s["v"], lambda n, v: F.struct(n.alias("n"), v.alias("v"))), lambda r: r["v"] != base))
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["n"].cast("int"))))


def median(x):
    """Lower middle element of an array, or of a svec's elements."""
    return let(F.array_sort(_dense(x)), lambda v: F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int")))


def term_counts(dictionary, document):
    """Vector of the counts of a sorted dictionary's words in a document (array of words)."""
    words = col(document)
    return from_array(F.transform(col(dictionary), lambda t: F.size(F.filter(words, lambda w: w == t)).cast("double")))


def sort_words(x):
    return F.array_sort(col(x))


# aggregates


def agg_values(value, order) -> Column:
    """Aggregate: the values, in order, as a vector."""
    found = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(value).cast("double").alias("v"))))
    return from_array(F.transform(found, lambda e: e["v"]))


def sum_of(s, dim: int) -> Column:
    x = to_array(s)
    return from_array(F.array(*[F.sum(F.get(x, F.lit(i))) for i in range(dim)]))


def mean_of(s, dim: int) -> Column:
    x = to_array(s)
    return from_array(F.array(*[F.avg(F.get(x, F.lit(i))) for i in range(dim)]))


def count_nonzero(s, dim: int) -> Column:
    x = to_array(s)
    return from_array(F.array(*[F.count(F.when(F.get(x, F.lit(i)) != 0, 1)).cast("double") for i in range(dim)]))
