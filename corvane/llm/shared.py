"""Where intermediate tables live, and helpers that all operators use."""

from __future__ import annotations

import contextlib
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tables import shared_dir

#: Paths handed out so far, while somebody wants to know.
_MADE: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that are made inside, at the end: what is computed from them must be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes a table aside and moves it to `path` by one rename, so that it's there whole or not at all."""
    aside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(aside)
    drop_path(spark, path)
    fs, p = _file_system(spark, aside)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"can't move {aside} to {path}")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and `_row`, a number for each row.

    The number follows from the scan's partition and position, so that it is the same each time a
    stored table is scanned. Rows of other inputs must be written first (see `written`). Equal rows
    and null ids get numbers of their own.
    """
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias("_row"))


def need_skew_joins(spark: SparkSession) -> None:
    """Warns where hot keys of a join wouldn't be split at run time: some joins here rely on that."""
    off = [c for c in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled") if spark.conf.get(c, "true").lower() != "true"]
    if off:
        warnings.warn(f"{', '.join(off)} is off: a key that many rows share goes to one task", stacklevel=3)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_slice(df: DataFrame, run, schema: str, column: str = "text", limit: int | None = None) -> DataFrame:
    """Rows of `run(batch)`, which yields record batches for each piece of the input of a few MB of `column`."""

    def each(batches):
        from corvane.llm.arrays import SLICE_BYTES, release, slices

        for batch in batches:
            if batch.num_rows:
                for piece in slices(batch, column, limit or SLICE_BYTES):
                    yield from run(piece)
        release()

    return df.mapInArrow(each, schema)


def id_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()
