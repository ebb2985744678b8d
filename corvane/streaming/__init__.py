"""Streams.

The library's column functions (arrays, metrics, sparse vectors, closed-form distributions) and the predictions that
are columns work on streaming DataFrames as they are; `scored` is the common form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def scored(stream: DataFrame, **columns: Column) -> DataFrame:
    """A (streaming) table with further columns, such as predictions of a fitted model."""
    return stream.withColumns(columns)
