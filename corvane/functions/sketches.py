"""Sketches: distinct counts, Count-Min over dyadic ranges, most frequent values.

A Count-Min sketch of integers is a map from (level, row, place) codes to counts: level l counts x >> l, so that
any range is a few nodes. `cmsketch` gives the sketch as JSON text, which the other functions read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.checks import quoted

LEVELS, DEPTH, WIDTH = 64, 8, 1024
_OFFSET = 1 << 63
_MASK = (1 << 64) - 1


def fmsketch_dcount(column) -> Column:
    """Aggregate: number of distinct values, approximately (exact for few)."""
    return F.approx_count_distinct(column, 0.01)


def exact_or_approx_dcount(df: DataFrame, column: str, exact_up_to: int = 12 * 1024) -> DataFrame:
    """(dcount): exact up to a number of distinct values, beyond it a sketch's estimate."""
    c = F.col(quoted(column))
    few = df.select(c).filter(c.isNotNull()).distinct().limit(exact_up_to + 1).count()
    if few <= exact_up_to:
        return df.sparkSession.createDataFrame([(few,)], "dcount long")
    return df.agg(fmsketch_dcount(c).alias("dcount"))


def _hash(level: int, row: int, value: int) -> int:
    x = (value * 0x9E3779B97F4A7C15 + (level * DEPTH + row + 1) * 0xD1B54A32D192ED03) & _MASK
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & _MASK
    return (x ^ x >> 32) % WIDTH


def cmsketch(df: DataFrame, column: str) -> str:
    """The sketch of an integer column: counters of 64 levels, 8 rows and 1024 places, as far as they aren't zero."""
    import numpy as np
    import pandas as pd

    def count(batches):
        out = np.zeros((LEVELS, DEPTH, WIDTH), np.int64)
        for pdf in batches:
            values, counts = np.unique(pdf.x.dropna().to_numpy(np.int64), return_counts=True)
            u = values.astype(np.uint64) ^ np.uint64(_OFFSET)
            for level in range(LEVELS):
                shifted = u >> np.uint64(level)
                for row in range(DEPTH):
                    x = shifted * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * DEPTH + row + 1) * 0xD1B54A32D192ED03 & _MASK)
                    x ^= x >> np.uint64(29)
                    x = x * np.uint64(0xBF58476D1CE4E5B9)
                    np.add.at(out[level, row], ((x ^ x >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64), counts)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"k": at, "n": out.ravel()[at]})

    cells = df.select(F.col(quoted(column)).cast("long").alias("x")).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return json.dumps({str(r.k): r.n for r in cells.toLocalIterator()})  # at most 64 * 8 * 1024 counters


def _load(sketch: str | dict) -> dict:
    return sketch if isinstance(sketch, dict) else json.loads(sketch)


def _node(cells: dict, level: int, value: int) -> int:
    return min(cells.get(str((level * DEPTH + row) * WIDTH + _hash(level, row, value)), 0) for row in range(DEPTH))


def cmsketch_count(sketch, value: int) -> int:
    return _node(_load(sketch), 0, (value ^ _OFFSET) & _MASK)


def cmsketch_rangecount(sketch, low: int, high: int) -> int:
    """Values in low..high, by the dyadic nodes that make up the range."""
    cells = _load(sketch)
    a, b, total, level = low + _OFFSET, high + _OFFSET, 0, 0
    while a <= b and level < LEVELS:
        if a & 1:
            total += _node(cells, level, a)
            a += 1
        if not b & 1:
            total += _node(cells, level, b)
            b -= 1
        a, b, level = a >> 1, b >> 1, level + 1
    return total


def cmsketch_centile(sketch, centile: int, count: int) -> int:
    """The value below or at which `centile` per cent of `count` values lie."""
    if not 0 < centile < 100:
        raise ValueError("a centile lies between 1 and 99")
    cells = _load(sketch)
    wanted, lo, hi = count * centile / 100, -_OFFSET, _OFFSET - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if cmsketch_rangecount(cells, -_OFFSET, mid) < wanted:
            lo = mid + 1
        else:
            hi = mid
    return lo


def cmsketch_median(sketch, count: int) -> int:
    return cmsketch_centile(sketch, 50, count)


def cmsketch_width_histogram(sketch, low: int, high: int, buckets: int) -> list[tuple[int, int, int]]:
    """(lo, hi, count) of buckets of equal width."""
    cells, step = _load(sketch), max(1, (high - low + 1) // buckets)
    out = []
    for i in range(buckets):
        a = low + i * step
        b = high if i == buckets - 1 else min(high, a + step - 1)
        if a <= b:
            out.append((a, b, cmsketch_rangecount(cells, a, b)))
    return out


def cmsketch_depth_histogram(sketch, buckets: int, count: int | None = None) -> list[tuple[int, int, int]]:
    """(lo, hi, count) of buckets of about equal counts."""
    cells = _load(sketch)
    count = cmsketch_rangecount(cells, -_OFFSET, _OFFSET - 1) if count is None else count
    edges = sorted({cmsketch_centile(cells, max(1, min(99, round(100 * i / buckets))), count) for i in range(1, buckets)})
    lows, highs = [-_OFFSET, *[e + 1 for e in edges]], [*edges, _OFFSET - 1]
    return [(a, b, cmsketch_rangecount(cells, a, b)) for a, b in zip(lows, highs)]


def big_or(a, b) -> Column:
    """Bitwise or of two binary strings of equal length."""
    from corvane.functions.arrays import col

    n = F.length(col(a))
    byte = lambda x, i: F.conv(F.hex(F.substring(col(x), i, F.lit(1))), 16, 10).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(byte(a, i).bitwiseOR(byte(b, i))), 2, "0")), ""))


def mfvsketch_top_histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """(value, count) of the n most frequent values; of equal counts the smaller values."""
    c = F.col(quoted(column))
    return df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def mfvsketch_quick_histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """The same by a sketch of bounded size, counts approximate."""
    c = F.col(quoted(column))
    top = df.filter(c.isNotNull()).agg(F.expr(f"approx_top_k({quoted(column)}, {n})").alias("t"))
    return top.select(F.explode("t").alias("e")).select(F.col("e.item").alias("value"), F.col("e.count").alias("count"))
