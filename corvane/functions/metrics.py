"""Norms and distances of vectors, as column expressions. Arrays of different lengths raise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.arrays import _zip, col


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e)


def _terms(x, y, f) -> Column:
    return _zip(col(x).cast("array<double>"), col(y).cast("array<double>"), f)


def norm1(x):
    return _sum(F.transform(col(x).cast("array<double>"), F.abs))


def norm2(x):
    return F.sqrt(_sum(F.transform(col(x).cast("array<double>"), lambda e: e * e)))


def dot(x, y):
    return _sum(_terms(x, y, lambda a, b: a * b))


def dist_inf_norm(x, y):
    return F.aggregate(_terms(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, e: F.greatest(s, e))


def dist_pnorm(x, y, p: float):
    """p must be positive; infinity is the maximum norm."""
    if not p > 0:
        raise ValueError("p must be positive")
    if math.isinf(p):
        return dist_inf_norm(x, y)
    return F.pow(_sum(_terms(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p)))), F.lit(1 / p))


def dist_norm1(x, y):
    return _sum(_terms(x, y, lambda a, b: F.abs(a - b)))


def squared_dist_norm2(x, y):
    return _sum(_terms(x, y, lambda a, b: (a - b) * (a - b)))


def dist_norm2(x, y):
    return F.sqrt(squared_dist_norm2(x, y))


def cosine_similarity(x, y):
    """-1 where a norm is zero."""
    n = norm2(x) * norm2(y)
    return F.when(n == 0, F.lit(-1.0)).otherwise(dot(x, y) / n)


def dist_angle(x, y):
    """Pi where a norm is zero."""
    n = norm2(x) * norm2(y)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / n))
    return F.when(n == 0, F.lit(math.pi)).otherwise(F.acos(cos))


def dist_tanimoto(x, y):
    both, xy = norm2(x) * norm2(x) + norm2(y) * norm2(y), dot(x, y)
    return (both - 2 * xy) / (both - xy)


def dist_jaccard(x, y):
    """Of sets of texts: both empty 0, one empty 1."""
    x, y = F.array_distinct(col(x)), F.array_distinct(col(y))
    union = F.size(F.array_union(x, y))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)


DISTANCES = {f.__name__: f for f in (dist_norm1, dist_norm2, squared_dist_norm2, dist_inf_norm, dist_angle, dist_tanimoto)}


def closest_columns(matrix, x, num: int, dist="squared_dist_norm2"):
    """The `num` nearest of a matrix's columns (an array of vectors): array of (column_id from 0, distance), nearest first."""
    f = DISTANCES[dist] if isinstance(dist, str) else dist
    x = col(x)
    found = F.transform(col(matrix), lambda c, i: F.struct(f(c, x).alias("distance"), i.alias("column_id")))
    return F.transform(F.slice(F.array_sort(found), 1, num), lambda e: F.struct(e["column_id"].alias("column_id"), e["distance"].alias("distance")))


def closest_column(matrix, x, dist="squared_dist_norm2"):
    return closest_columns(matrix, x, 1, dist)[0]
