"""Running sums and ranks over a whole table, without putting it into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least, and rows of a range.
BUCKETS, ROWS = 64, 1 << 20


def split_points(df: DataFrame, order: Column, rows: int = ROWS) -> list[float]:
    """Values that cut the rows into ranges of at most about `rows`; equal values stay together."""
    n = max(BUCKETS, -(-df.count() // rows))
    return sorted(set(df.select(order.cast("double").alias("o")).approxQuantile("o", [i / n for i in range(1, n)], 1 / (4 * n))))


def placed(df: DataFrame, order: Column, splits: list[float], name: str) -> DataFrame:
    """The table with the number of split points that aren't above `order`, by binary search; none for null.

    Not by a lambda: the optimizer can infer a filter from one that names a column of the join's other side.
    """
    inner = sorted({s + 0.0 for s in splits if abs(s) != float("inf")})
    if not inner:
        return df.withColumn(name, F.lit(0))
    x = order.cast("double") + 0.0  # the search tells the zeros apart
    found = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_x_of_range", outputCol="_k_of_range", handleInvalid="keep").transform(df.withColumn("_x_of_range", x))
    return found.withColumn(name, F.when(F.col("_x_of_range").isNull(), 0).otherwise(F.col("_k_of_range").cast("int"))).drop("_x_of_range", "_k_of_range")


def running(df: DataFrame, order: str, sums: dict[str, Column], groups: list[str] = ()) -> DataFrame:
    """The table with running sums over increasing `order` (peers share theirs), named as in `sums`.

    Without groups, split points from a quantile sketch cut the order into ranges; each range sums
    by itself, and gets the totals of the ranges before it from a table of a row for each range.
    """
    groups = list(groups)
    if groups:
        w = Window.partitionBy(*groups).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in sums.items()])
    splits = split_points(df, F.col(order))
    cut = placed(df, F.col(order), splits, "_bucket")
    totals = cut.groupBy("_bucket").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    w = Window.partitionBy("_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.select("*", *[F.sum(e).over(w).alias(n) for n, e in sums.items()])
    joined = own.join(F.broadcast(offsets), "_bucket")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
