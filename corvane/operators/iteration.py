"""Cutting lineage between iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from corvane.sources.tables import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder that all executors share: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the folder that all executors share: for tables that are read many times."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
