"""Reading and writing tables, and where intermediate ones live."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_new(df: DataFrame, name: str) -> None:
    """Saves a table; an existing one is an error."""
    df.write.mode("errorifexists").saveAsTable(name)


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """(id): start, start + step, ... up to and including stop."""
    return spark.range(start, stop + (1 if step > 0 else -1), step)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where that is unset (tests, a single machine) a temporary folder takes its place and is set as
    the checkpoint directory.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corvane.shared.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, conf, True)
        spark.conf.set("corvane.shared.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")
