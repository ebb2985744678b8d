"""Units: runs of consecutive rows of a stored table, about a megabyte of text each.

Operators that look lines or windows up across the corpus send what a unit looks up (each distinct
hash once) to shards and get answers for the unit back. A passage that stands in a third of all
documents then costs one entry a unit instead of one a document, and no group depends on how often
a passage occurs. Units follow from the scan alone, so they are the same each time they are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import id_type, keyed

UNIT_BYTES = 1 << 20
#: Text whose lookups one shard holds: some 4 to 12 MB of hashes.
SHARD_BYTES = 16 << 20


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, _row and the `carry` columns (as _carry0, ...) of a stored table.

    All scans for one operation select the same columns, so that Arrow batches and units come out the same.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, carry_names(carry))])
    return keyed(own, "doc_id", "text", *carry_names(carry))


def carry_names(carry: tuple[str, ...]) -> list[str]:
    return [f"_carry{k}" for k in range(len(carry))]


def carry_of(batch: pa.RecordBatch, carry: tuple[str, ...]) -> list[pa.Array]:
    return [batch.column(c) for c in carry_names(carry)]


def carried(docs: DataFrame, carry: tuple[str, ...], names: list[str]) -> str:
    """The `carry` columns, as the end of a schema; they must not be called like the operator's own."""
    if len({*names, *carry}) < len(names) + len(carry):
        raise ValueError(f"can't carry {', '.join(carry)} beside {', '.join(names)}")
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)


def shards_of(rows: DataFrame) -> int:
    """How many shards the lookups of `source` rows need, so that one holds those of about SHARD_BYTES of text, however large the table."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-size // SHARD_BYTES))


def per_unit(rows: DataFrame, run, schema: str) -> DataFrame:
    """Rows of `run(unit, batch)` for each unit of `source` rows; a unit's number is its first row's."""

    def each(batches):
        from corvane.llm.arrays import release, slices

        for whole in batches:
            if whole.num_rows:
                for batch in slices(whole, "text", UNIT_BYTES):
                    yield from run(batch.column("_row")[0].as_py(), batch)
        release()

    return rows.mapInArrow(each, schema)


def packed(rows: DataFrame) -> DataFrame:
    """(unit, size, blob): each unit's rows as a compressed Arrow stream, which is cheap to shuffle, and the bytes of their texts."""

    def run(unit, batch):
        size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([size], pa.int64()), pa.array([freeze(batch)], pa.binary())], names=["unit", "size", "blob"])

    return per_unit(rows, run, "unit long, size long, blob binary")


def freeze(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def answered(units: DataFrame, answers: DataFrame) -> DataFrame:
    """Each packed unit with the list of its answers (shard, n, bits).

    Answers grow with the table, so they are hashed and not broadcast, at every size; texts aren't sorted.
    """
    lists = answers.groupBy("unit").agg(F.collect_list(F.struct("shard", "n", "bits")).alias("answers"))
    return units.join(lists.hint("shuffle_hash"), "unit", "left")


def answer_bits(shard: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The answer to each thing a unit looked up; `shard` tells where each was sent, in order."""
    out = np.zeros(len(shard), bool)
    for a in answers or []:
        at = np.flatnonzero(shard == a["shard"])
        if len(at) != a["n"]:
            raise ValueError("a unit changed between two scans: give a stored table")
        out[at] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool)
    return out


def split_by(shard: np.ndarray, n_shards: int) -> list[np.ndarray]:
    """Indices that go to each shard, in order."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, n_shards)))


def doc_type(rows: DataFrame) -> str:
    return id_type(rows, "doc_id")
