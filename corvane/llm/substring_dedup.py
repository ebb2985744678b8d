"""Substring dedup: repeated windows of words are removed from all but their first place.

A log-structured fingerprint index. Every window of `width` words has an anchor, the least hash among
its runs of width // 2 words; equal windows have equal anchors, and a text has about one distinct anchor
in (width // 2 + 2) / 2 words. A run of the index is immutable: for each shard of the hash space its anchors
in order, each with the unit that has it. A new batch becomes a run of its own, which is merge-joined with
all runs before it: an anchor that two units hold makes the windows under it candidates. Candidates are
verified by 96-bit hashes of the whole window, of which a unit sends each once, with its first document;
all but the first place in order are removed. Runs are compacted by merging them into one.

Order: batches in the order they were added; in a batch documents by id (null first; equal ids: table
order), then by place. What is removed is judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import units as U
from corvane.llm.arrays import Words, owner, ranges, rolled, words
from corvane.llm.shared import drop_path, names_in, new_path, publish, written

_F1, _F2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_LEAST = np.iinfo(np.int64).min


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A unit's rows by id, nulls first, then by row."""
    return batch.take(pa.compute.sort_indices(pa.Table.from_batches([batch]), [("doc_id", "ascending"), ("_row", "ascending")], null_placement="at_start"))


def _least(g: np.ndarray, span: int) -> np.ndarray:
    """Least of each `span` consecutive values."""
    out, step = g, 1
    while 2 * step <= span:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = span - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window that lies in one document, its anchor, and the word hashes."""
    h = w.hashes(0)
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), h
    own = owner(w.first)
    at = np.flatnonzero(own[width - 1 :] == own[: len(h) - width + 1])
    half = width // 2
    anchors = _least(rolled(h, half, _F1), width - half + 1) if half else h
    return at, anchors[at], h


def _lists(units: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, unit, anchors) of packed units: each list sorted and without repeats."""

    def each(batches):
        for rows in batches:
            for unit, blob in zip(rows.column("unit").to_pylist(), rows.column("blob").to_pylist()):
                _, anchors, _ = _windows(words(_in_order(U.thaw(blob)).column("text")), width)
                anchors = np.unique(anchors)
                found = [(s, i) for s, i in enumerate(U.split_by((anchors % np.uint64(shards)).astype(np.int64), shards)) if len(i)]
                yield pa.RecordBatch.from_pydict({"shard": [s for s, _ in found], "unit": [unit] * len(found), "anchors": [anchors[i].tobytes() for _, i in found]}, schema=_LISTS)

    return units.select("unit", "blob").mapInArrow(each, "shard long, unit long, anchors binary")


_LISTS = pa.schema([("shard", pa.int64()), ("unit", pa.int64()), ("anchors", pa.binary())])
_RUN = pa.schema([("shard", pa.int64()), ("batches", pa.binary()), ("units", pa.binary()), ("anchors", pa.binary()), ("owners", pa.binary())])
_RUN_TYPE = "shard long, batches binary, units binary, anchors binary, owners binary"


def _run(lists: DataFrame, batch: int) -> DataFrame:
    """A run: for each shard its units (with their batches), and all anchors in order, each with the number of its unit."""

    def sort(key, table):
        each = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
        units = table.column("unit").to_numpy()
        return _run_row(key[0].as_py(), np.full(len(units), batch), units, np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each]))

    return lists.groupBy("shard").applyInArrow(sort, _RUN_TYPE)


def _run_row(shard: int, batches: np.ndarray, units: np.ndarray, anchors: np.ndarray, owners: np.ndarray) -> pa.Table:
    order = np.argsort(anchors, kind="stable")  # merges what is in order already
    data = [batches.astype(np.int64), units.astype(np.int64), anchors[order], owners[order].astype(np.uint32)]
    return pa.Table.from_pydict({"shard": [shard]} | {c: [x.tobytes()] for c, x in zip(_RUN.names[1:], data)}, schema=_RUN)


def _row_arrays(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], t) for c, t in (("batches", np.int64), ("units", np.int64), ("anchors", np.uint64), ("owners", np.uint32))]


def _merged(runs: DataFrame) -> DataFrame:
    """Runs as one, shard by shard."""

    def merge(key, table):
        rows = [_row_arrays(r) for r in table.to_pylist()]
        base = np.cumsum([0] + [len(r[1]) for r in rows])
        return _run_row(key[0].as_py(), *[np.concatenate([r[k] for r in rows]) for k in range(3)], np.concatenate([r[3].astype(np.int64) + b for r, b in zip(rows, base)]))

    return runs.groupBy("shard").applyInArrow(merge, _RUN_TYPE)


def _resharded(run: DataFrame, shards: int) -> DataFrame:
    """A run of fewer shards, each split: the numbers of shards are powers of two."""

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                batch_of, units, anchors, owners = _row_arrays(row)
                for s, i in enumerate(U.split_by((anchors % np.uint64(shards)).astype(np.int64), shards)):
                    if len(i):
                        some, code = np.unique(owners[i], return_inverse=True)
                        yield from _run_row(s, batch_of[some], units[some], anchors[i], code).to_batches()

    return run.mapInArrow(split, _RUN_TYPE)


def _met(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """(batch, shard, unit, n, bits): which anchors of a unit also stand in another unit, if a unit of the new run is among them.

    `new` is a run of one batch, `old` the runs before it.
    """

    def join(key, own, before):
        if not own.num_rows:
            return _MET.empty_table()
        rows = [_row_arrays(r) for r in own.to_pylist() + (before.to_pylist() if before else [])]
        fresh = rows[0][2]
        edges = np.flatnonzero(np.concatenate(([True], fresh[1:] != fresh[:-1])))
        distinct, hit = fresh[edges], np.diff(np.append(edges, len(fresh))) > 1
        places = []
        for _, _, anchors, _ in rows[1:]:  # both sides are in order
            at = np.minimum(np.searchsorted(distinct, anchors), len(distinct) - 1)
            same = distinct[at] == anchors
            hit[at[same]] = True
            places.append(same)
        places.insert(0, np.repeat(hit, np.diff(np.append(edges, len(fresh)))))
        out: list[list] = [[] for _ in _MET]
        for (batch_of, units, anchors, owners), met in zip(rows, places):
            order = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[order], np.arange(len(units) + 1))
            met = met[order]
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if met[a:b].any():
                    for column, value in zip(out, (int(batch_of[k]), key[0].as_py(), int(units[k]), b - a, np.packbits(met[a:b]).tobytes())):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _MET)], schema=_MET)

    kind = "batch long, shard long, unit long, n long, bits binary"
    if old is None:
        return new.groupBy("shard").applyInArrow(lambda key, own: join(key, own, None), kind)
    return new.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(join, kind)


_MET = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _candidates(batch: pa.RecordBatch, answers: list[dict] | None, width: int, shards: int):
    """Of a unit: its rows in order, their words, first words of candidate windows, their hashes, the
    index of the first window with each hash, and where each of those is sent."""
    batch = _in_order(batch)
    w = words(batch.column("text"))
    at, anchors, h = _windows(w, width)
    distinct, code, times = np.unique(anchors, return_inverse=True, return_counts=True)
    met = U.answer_bits((distinct % np.uint64(shards)).astype(np.int64), answers)
    take = met[code] | (times[code] > 1)  # windows under an anchor that is met elsewhere, or again in this unit
    at = at[take]
    one, two = (rolled(h, width, _F1)[at], rolled(w.hashes(1), width, _F2)[at].astype(np.uint32)) if len(at) else (np.empty(0, np.uint64), np.empty(0, np.uint32))
    _, first, group = np.unique(one, return_index=True, return_inverse=True)
    if (two != two[first][group]).any():  # windows that only agree in the first 64 bits
        _, first = np.unique(np.rec.fromarrays((one, two)), return_index=True)
    sent = np.sort(first[met[code][take][first]])  # only what another unit may hold
    return batch, w, at, one, two, first, sent, (one[sent] % np.uint64(shards)).astype(np.int64)


def _send(units: DataFrame, width: int, shards: int) -> DataFrame:
    """(batch, shard, unit, n, one, two, doc_id): each distinct candidate window of a unit with its first document."""
    names = ["batch", "shard", "unit", "n", "one", "two", "doc_id"]

    def each(batches):
        for rows in batches:
            for number, unit, blob, answers in zip(*[rows.column(c).to_pylist() for c in ("batch", "unit", "blob", "answers")]):
                if not answers:
                    continue
                batch, w, at, one, two, _, sent, shard = _candidates(U.thaw(blob), answers, width, shards)
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(_LEAST).to_numpy()
                ids = ids[np.searchsorted(w.first, at[sent], side="right") - 1]
                found = [(s, i) for s, i in enumerate(U.split_by(shard, shards)) if len(i)]
                columns = [[number] * len(found), [s for s, _ in found], [unit] * len(found), [len(i) for _, i in found]]
                columns = [pa.array(x, pa.int64()) for x in columns]
                columns += [pa.array([values[i].tobytes() for _, i in found], pa.binary()) for values in (one[sent], two[sent], ids)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return units.mapInArrow(each, "batch long, shard long, unit long, n long, one binary, two binary, doc_id binary")


def _judge(sent: DataFrame, newest: int) -> DataFrame:
    """(shard, unit, n, bits) of new units: which of the windows they sent have an earlier place elsewhere."""

    def each(key, table):
        table = table.sort_by([("batch", "ascending"), ("unit", "ascending")])
        n = table.column("n").to_numpy()
        one, two, ids = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("one", np.uint64), ("two", np.uint32), ("doc_id", np.int64)))
        place = np.repeat(np.arange(len(n)), n)  # order of (batch, unit)
        number = np.repeat(table.column("batch").to_numpy(), n)
        order = np.argsort(one, kind="stable")
        sorted_one = one[order]
        same = np.zeros(len(one), bool)
        same[1:] = sorted_one[1:] == sorted_one[:-1]
        group = same.copy()
        group[:-1] |= same[1:]
        many = order[group]
        many = many[np.lexsort((place[many], ids[many], number[many], two[many], one[many]))]
        later = np.zeros(len(many), bool)
        later[1:] = (one[many[1:]] == one[many[:-1]]) & (two[many[1:]] == two[many[:-1]])
        flags = np.zeros(len(one), bool)
        flags[many[later]] = True
        cuts = np.concatenate(([0], np.cumsum(n)))
        is_new = table.column("batch").to_numpy() == newest
        bits = [np.packbits(flags[a:b]).tobytes() if new and flags[a:b].any() else None for a, b, new in zip(cuts[:-1], cuts[1:], is_new)]
        out = table.select(["shard", "unit", "n"]).append_column("bits", pa.array(bits, pa.binary()))
        return out.filter(pa.compute.is_valid(out.column("bits")))

    return sent.groupBy("shard").applyInArrow(each, "shard long, unit long, n long, bits binary")


def _remove(units: DataFrame, width: int, shards: int, kind: str, with_text: bool) -> DataFrame:
    """One row for each document."""
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]

    def each(batches):
        for rows in batches:
            for blob, met, judged in zip(*[rows.column(c).to_pylist() for c in ("blob", "met", "judged")]):
                batch, w, at, one, _, first, sent, shard = _candidates(U.thaw(blob), met, width, shards)
                gone = np.ones(len(at), bool)  # a later place in this unit
                gone[first] = False
                gone[sent] = U.answer_bits(shard, judged)
                cover = np.zeros(len(w.start) + width + 1, np.int32)
                np.add.at(cover, at[gone], 1)
                np.add.at(cover, at[gone] + width, -1)
                keep = np.cumsum(cover)[: len(w.start)] == 0
                kept = joined(w, keep)
                left = np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
                columns = [batch.column("doc_id"), pa.array(w.counts), pa.array(w.counts - left), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                if with_text:
                    columns.append(pa.array([x.decode() for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return units.mapInArrow(each, schema)


def joined(w: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    start, length = w.start[keep], (w.end - w.start)[keep] + 1
    index = ranges(start, length)
    ends = np.cumsum(length)
    index[ends - 1] = 0
    out = w.raw[index] if len(index) else np.empty(0, np.uint8)
    out[ends - 1] = 32
    data = memoryview(out.tobytes())
    first = np.concatenate(([0], np.cumsum(keep)))[w.first]
    at = np.concatenate(([0], ends))[first]
    return [bytes(data[a : max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def substring_dedup(docs: DataFrame, width: int = 20, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Removes each word that a window covers whose words also stand earlier; one row for each document.

    The documents go through a `FingerprintIndex` in `batches` batches of consecutive ids, whose runs are
    compacted at the end. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space)
    and, if `with_text`, those words as `kept`. Ids must be integers. A null or empty text has no words and nothing
    removed; a text shorter than `width` words keeps all of them; repeated rows count as copies in table order; other
    columns are ignored; an empty table gives an empty one.
    """
    _need_integers(docs, id_col)
    index = FingerprintIndex(docs.sparkSession, new_path(docs.sparkSession, "fingerprints"), width)
    own = F.col(f"`{id_col}`")
    size, cuts = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.percentile_approx(own, [k / batches for k in range(1, batches)] or [1.0], 10000)).first()
    cuts = sorted(set(cuts or []))[: batches - 1]
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        mine = F.coalesce(own <= high if high is not None else F.lit(True), F.lit(True)) & (own > low if low is not None else F.lit(True))
        parts.append(index.add(docs.filter(mine), with_text, id_col, text_col, room=size or 0))
    index.compact()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _need_integers(docs: DataFrame, id_col: str) -> None:
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")


class FingerprintIndex:
    """A stored index for incremental dedup: each added batch is judged against all that came before.

    `path` holds a folder of packed units for each batch, and one for each run, `runs/<first>-<last>-<bytes>-<shards>`
    by the batches in it. What is published is the index's whole state, so that it can be opened again. A run is
    there whole or not at all; one whose batches a longer run has is void, so that an interrupted compaction loses
    nothing. A batch whose run isn't there wasn't added. Batches are added one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 20):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def runs(self) -> list[tuple[int, int, int, int]]:
        """(first batch, last batch, bytes of text, shards) of each run in force."""
        every = [tuple(map(int, x.split("-"))) for x in names_in(self.spark, f"{self.path}/runs") if x[0] != "_"]
        return sorted(r for r in every if not any(o[0] <= r[0] and r[1] <= o[1] and o[:2] != r[:2] for o in every))

    def _read(self, run: tuple[int, int, int, int], shards: int) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/runs/{'-'.join(map(str, run))}")
        return df if run[3] == shards else _resharded(df, shards)

    def _all(self, runs: list, shards: int) -> DataFrame | None:
        out = None
        for run in runs:
            out = self._read(run, shards) if out is None else out.union(self._read(run, shards))
        return out

    def add(self, docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", room: int = 0) -> DataFrame:
        """Adds a batch as a new run; the batch's rows as `substring_dedup` returns them.

        `room`: bytes of text that the index is going to hold, if known; its shards are made for these. An empty
        batch gives an empty table and a run without rows.
        """
        _need_integers(docs, id_col)
        before = self.runs()
        k = before[-1][1] + 1 if before else 0
        rows = U.source(docs, id_col, text_col)
        publish(self.spark, U.packed(rows), f"{self.path}/units/{k}")
        new_units = self.spark.read.parquet(f"{self.path}/units/{k}")
        size = new_units.agg(F.sum("size")).first()[0] or 0
        wanted = max(room, size + sum(r[2] for r in before)) // U.SHARD_BYTES
        shards = max([8, 1 << max(0, wanted).bit_length(), *[r[3] for r in before]])
        mine = (k, k, size, shards)
        publish(self.spark, _run(_lists(new_units, self.width, shards), k), f"{self.path}/runs/{'-'.join(map(str, mine))}")
        met = written(_met(self._read(mine, shards), self._all(before, shards)), "met")
        lists = met.groupBy("batch", "unit").agg(F.collect_list(F.struct("shard", "n", "bits")).alias("answers"))
        units = new_units.withColumn("batch", F.lit(k).cast("long"))
        for b in range(k):
            units = units.union(self.spark.read.parquet(f"{self.path}/units/{b}").withColumn("batch", F.lit(b).cast("long")))
        judged = written(_judge(_send(units.join(lists, ["batch", "unit"]), self.width, shards), k), "judged")
        first = lists.filter(F.col("batch") == k).select("unit", F.col("answers").alias("met"))
        last = judged.groupBy("unit").agg(F.collect_list(F.struct("shard", "n", "bits")).alias("judged"))
        answered = new_units.join(first.join(last, "unit", "left"), "unit", "left")
        return _remove(answered.select("blob", "met", "judged"), self.width, shards, U.doc_type(rows), with_text)

    def compact(self) -> None:
        """Merges all runs into one; the old ones go after it is published."""
        old = self.runs()
        if len(old) < 2:
            return
        shards = max(r[3] for r in old)
        new = (old[0][0], old[-1][1], sum(r[2] for r in old), shards)
        publish(self.spark, _merged(self._all(old, shards)), f"{self.path}/runs/{'-'.join(map(str, new))}")
        for run in old:
            drop_path(self.spark, f"{self.path}/runs/{'-'.join(map(str, run))}")
