"""k-means: seeding, Lloyd iterations with any of the distances, silhouette."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.metrics import DISTANCES, closest_columns
from corvane.operators.checks import expr
from corvane.operators.estimate import group_sums

#: Rows from which a seeding draws at most.
SEED_ROWS = 20_000


def _distances(name: str):
    """Distances of points (n, d) to centroids (k, d), as an (n, k) matrix."""

    def squared(x, c):
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)

    def angle(x, c):
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None]
        return np.where(n == 0, np.pi, np.arccos(np.clip(x @ c.T / np.where(n == 0, 1, n), -1, 1)))

    def tanimoto(x, c):
        both, xy = (x * x).sum(1)[:, None] + (c * c).sum(1)[None], x @ c.T
        return (both - 2 * xy) / np.where(both == xy, 1, both - xy)

    return {
        "squared_dist_norm2": squared,
        "dist_norm2": lambda x, c: np.sqrt(squared(x, c)),
        "dist_norm1": lambda x, c: np.stack([np.abs(x - v).sum(1) for v in c], axis=1),
        "dist_inf_norm": lambda x, c: np.stack([np.abs(x - v).max(1) for v in c], axis=1),
        "dist_angle": angle,
        "dist_tanimoto": tanimoto,
    }[name]


def _points(df: DataFrame, point: str) -> DataFrame:
    """Points that aren't null and whose elements are all finite."""
    p = expr(point).cast("array<double>")
    good = ~F.exists(p, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.select(p.alias("_p")).filter(F.col("_p").isNotNull()).filter(good)


def kmeans(df: DataFrame, point: str, initial_centroids, fn_dist: str = "squared_dist_norm2", agg_centroid: str = "avg", max_num_iterations: int = 20, min_frac_reassigned: float = 0.001) -> DataFrame:
    """One row: centroids, cluster_sizes, objective_fn, frac_reassigned, num_iterations.

    agg_centroid is avg or normalized_avg. A cluster that loses all points keeps its centroid.
    """
    c = np.asarray(initial_centroids, float)
    if len(c) > 32767:
        raise ValueError("at most 32767 clusters")
    distance, points = _distances(fn_dist), _points(df, point)
    k, d = c.shape
    before = frac = None
    done = 0
    for done in range(1, max_num_iterations + 1):
        now, was = c, before

        def kernel(key, a, now=now, was=was):
            """[objective, n, reassigned, sizes, sums]."""
            x = a["_p"]
            dist = distance(x, now)
            near = dist.argmin(1)
            moved = len(x) if was is None else int((distance(x, was).argmin(1) != near).sum())
            sums = np.zeros((k, d))
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if agg_centroid == "normalized_avg" else x
            np.add.at(sums, near, unit)
            return np.concatenate(([dist[np.arange(len(x)), near].sum(), len(x), moved], np.bincount(near, minlength=k), sums.ravel()))

        found = group_sums(points, [], {"_p": F.col("_p")}, kernel)
        if not found:
            raise ValueError("no points")
        s = found[()]
        sizes, sums = s[3 : 3 + k], s[3 + k :].reshape(k, d)
        frac = s[2] / s[1]
        new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
        if agg_centroid == "normalized_avg":
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300)
        before, c = c, new
        if frac <= min_frac_reassigned:
            break
    last = c

    def final(key, a):
        dist = distance(a["_p"], last)
        near = dist.argmin(1)
        return np.concatenate(([dist[np.arange(len(near)), near].sum()], np.bincount(near, minlength=k)))

    s = group_sums(points, [], {"_p": F.col("_p")}, final)[()]
    row = ([[float(v) for v in r] for r in c], [int(v) for v in s[1:]], float(s[0]), float(frac), done)
    return df.sparkSession.createDataFrame([row], "centroids array<array<double>>, cluster_sizes array<long>, objective_fn double, frac_reassigned double, num_iterations int")


def kmeans_random_seeding(df: DataFrame, point: str, k: int, initial_centroids=None, seed: int = 0) -> np.ndarray:
    """k distinct points drawn at random; given centroids count among them."""
    given = [] if initial_centroids is None else [list(map(float, c)) for c in initial_centroids]
    points = _points(df, point).distinct()
    rows = points.orderBy(F.xxhash64("_p", F.lit(seed))).limit(k - len(given)).collect()  # at most k rows
    return np.array(given + [r[0] for r in rows])


def kmeanspp_seeding(df: DataFrame, point: str, k: int, fn_dist: str = "squared_dist_norm2", initial_centroids=None, seeding_sample_ratio: float = 1.0, seed: int = 0) -> np.ndarray:
    """k points drawn one after the other, each with a probability in proportion to its distance from those before.

    Draws are made by exponential keys: the smallest of -ln(u) / distance over all rows, u by a hash of the point.
    """
    points = _points(df, point)
    if seeding_sample_ratio < 1:
        points = points.filter(F.rand(seed) <= seeding_sample_ratio)
    chosen = [] if initial_centroids is None else [list(map(float, c)) for c in initial_centroids]
    f = DISTANCES[fn_dist]
    while len(chosen) < k:
        u = (F.pmod(F.xxhash64("_p", F.lit(seed + 7919 * len(chosen))), F.lit(2**52)) + 0.5) / float(2**52)
        if chosen:
            near = F.least(*[f("_p", F.array(*[F.lit(v) for v in c])) for c in chosen], F.lit(float("inf")))
            near = near * near if fn_dist in ("dist_norm1", "dist_norm2", "dist_inf_norm") else near
            drawn = points.withColumn("_w", near).filter("_w > 0")
        else:
            drawn = points.withColumn("_w", F.lit(1.0))
        r = drawn.agg(F.min_by("_p", -F.log(u) / F.col("_w"))).first()
        if r[0] is None:
            raise ValueError("fewer distinct points than clusters")
        chosen.append(r[0])
    return np.array(chosen)


def kmeanspp(df: DataFrame, point: str, k: int, fn_dist: str = "squared_dist_norm2", agg_centroid: str = "avg", max_num_iterations: int = 20, min_frac_reassigned: float = 0.001, seeding_sample_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    return kmeans(df, point, kmeanspp_seeding(df, point, k, fn_dist, None, seeding_sample_ratio, seed), fn_dist, agg_centroid, max_num_iterations, min_frac_reassigned)


def kmeans_random(df: DataFrame, point: str, k: int, fn_dist: str = "squared_dist_norm2", agg_centroid: str = "avg", max_num_iterations: int = 20, min_frac_reassigned: float = 0.001, seed: int = 0) -> DataFrame:
    return kmeans(df, point, kmeans_random_seeding(df, point, k, None, seed), fn_dist, agg_centroid, max_num_iterations, min_frac_reassigned)


def _matrix(centroids):
    return F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])


def assign(df: DataFrame, point: str, centroids, fn_dist: str = "squared_dist_norm2") -> DataFrame:
    """The table with cluster_id (from 0) and distance."""
    near = closest_columns(_matrix(centroids), expr(point), 1, fn_dist)[0]
    return df.withColumn("_n", near).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_n.column_id").alias("cluster_id"), F.col("_n.distance").alias("distance"))


def simple_silhouette(df: DataFrame, point: str, centroids, fn_dist: str = "dist_norm2") -> DataFrame:
    """(silhouette): mean of (b - a) / max(a, b) over the two closest centroids' distances a <= b."""
    near = closest_columns(_matrix(centroids), F.col("_p"), 2, fn_dist)
    made = _points(df, point).select(near[0]["distance"].alias("a"), near[1]["distance"].alias("b"))
    return made.agg(F.avg(F.when(F.col("b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("b"))).alias("silhouette"))
