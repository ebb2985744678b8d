"""Packing into fixed windows: bounded-space online best fit.

Each partition streams its documents through a fixed number of open windows. A piece goes where it
leaves least room; when it fits nowhere and no further window may open, the fullest window is
emitted (topped up with the head of the piece if more than `waste` places would stay free). What
is open when a partition ends goes through the same packer again, in groups of `FAN_IN` partitions,
until one group is left. So no task ever holds more than a fixed number of windows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import id_type, per_slice, written

#: Partitions (or groups) whose leftovers are merged in one task.
FAN_IN = 64
#: Text that is held in expanded form at once.
SLICE = 3 << 20

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """Open windows of `size` places, at most `slots` at a time."""

    def __init__(self, size: int, slots: int, waste: int):
        self.size, self.slots, self.waste = size, slots, waste
        self.free: list[tuple[int, int]] = []  # (free places, window), sorted
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list[Piece]]:
        """Places some ids of a document; yields the windows that this completes."""
        at = 0
        while len(ids) - at >= self.size:
            yield [(doc_id, start + at, ids[at : at + self.size], doc_tokens)]
            at += self.size
        ids, start = ids[at:], start + at
        if not len(ids):
            return
        k = bisect.bisect_left(self.free, (len(ids), -1))
        if k == len(self.free) and len(self.free) >= self.slots:
            room, window = self.free.pop(0)
            pieces = self.held.pop(window)
            if room > self.waste:
                pieces.append((doc_id, start, ids[:room], doc_tokens))
                ids, start = ids[room:], start + room
            yield pieces
            k = bisect.bisect_left(self.free, (len(ids), -1))
        if k == len(self.free):
            room, window = self.size, self.made
            self.made += 1
            self.held[window] = []
        else:
            room, window = self.free.pop(k)
        self.held[window].append((doc_id, start, ids, doc_tokens))
        if room == len(ids):
            yield self.held.pop(window)
        else:
            bisect.insort(self.free, (room - len(ids), window))

    def rest(self) -> list[list[Piece]]:
        return [self.held[w] for w in sorted(self.held)]


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]


def _rows(kind: pa.DataType, windows: list[tuple[int, list[Piece]]], part: int | None, with_ids: bool) -> pa.RecordBatch:
    """One row for each piece; `part` is set for windows that are still open."""
    out: list[list] = [[] for _ in _NAMES]
    for sequence, pieces in windows:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            data = ids.tobytes()
            for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(data), doc_tokens, sequence, at, part, data if with_ids or part is not None else None)):
                column.append(value)
            at += len(ids)
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=_NAMES)


def pack(
    docs: DataFrame,
    encode: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]],
    size: int = 1024,
    slots: int = 64,
    waste: int = 16,
    end_id: int = 0,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `size` tokens.

    `encode()` gives, in a worker, a function from texts to their ids end to end and the number of
    ids of each; `end_id` follows each document. Returns one row for each piece: doc_id, start (ids
    of its document before it), length, ids_crc32 (of its ids as unsigned little-endian 32-bit
    integers), doc_tokens (the document's ids with the end id), sequence_id, offset (in its
    sequence, without gaps from 0), and ids (those bytes, if `with_ids`).

    A null or empty text is the end id alone. Rows are documents of their own even if ids repeat or
    are null; other columns are ignored; an empty table gives an empty one. The result is written
    to the shared folder, so that sequence ids stay as they are.
    """
    kind = id_type(docs, id_col)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"

    def first(batches):
        from pyspark import TaskContext

        from corvane.llm.arrays import release, slices

        part = TaskContext.get().partitionId()
        packer, run, made, arrow = Packer(size, slots, waste), encode(), 0, None
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                arrow = batch.schema.field("doc_id").type
                ids, counts = run(batch.column("text"))
                done, at = [], 0
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                    for window in packer.add(doc_id, 0, np.concatenate((ids[at : at + n], end)), n + 1):
                        done.append(((part << 32) + made, window))
                        made += 1
                    at += n
                if done:
                    yield _rows(arrow, done, None, with_ids)
        if packer.held:
            yield _rows(arrow, [((part << 32) + made + i, w) for i, w in enumerate(packer.rest())], part, with_ids)
        release()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = written(rows.mapInArrow(first, schema), "packed")
    tables = []
    turn = 0
    while True:
        tables.append(found.filter(F.col("part").isNull()))
        left = found.filter(F.col("part").isNotNull())
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        turn += 1
        last = most < FAN_IN

        def merge(key, table):
            table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            group = key[0].as_py()
            base = (turn << 56) + (group << 32)
            packer, done = Packer(size, slots, waste), []
            for x in table.to_pylist():
                done += packer.add(x["doc_id"], x["start"], np.frombuffer(x["ids"], np.uint32), x["doc_tokens"])
            rest = packer.rest()
            arrow = table.schema.field("doc_id").type
            if last:
                done += rest
            out = [_rows(arrow, [(base + i, w) for i, w in enumerate(done)], None, with_ids)]
            if not last:
                out.append(_rows(arrow, [(base + len(done) + i, w) for i, w in enumerate(rest)], group, with_ids))
            return pa.Table.from_batches(out)

        groups = left.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("group")
        found = written(groups.applyInArrow(merge, schema), "packed")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.drop("part") if with_ids else out.drop("part", "ids")
