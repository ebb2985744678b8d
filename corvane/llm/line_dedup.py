"""Line dedup through a sharded minimal perfect hash.

A line's key is hashed to 128 bits. Each shard of the hash space holds a minimal perfect hash over its
distinct keys: levels of bit arrays give every key a slot of its own, and arrays of fingerprints and
document counts are indexed by the slot. Documents never join lines: a unit of rows sends each of its
distinct keys to their shards, which look the slots up and answer a bit for each key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import units as U
from corvane.llm.arrays import LOWER, mix
from corvane.llm.shared import written

SPACE = b" \t\n\r\x0b\x0c"
_LOWER = LOWER.tobytes()


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys, without storing the keys.

    Level by level, a key that no other key meets in the level's bit array takes its bit; the rest go
    on to the next level. A key's slot is the number of bits set before its own. A key that isn't of
    the set gets any slot or -1; fingerprints tell. What is left after LEVELS levels, such as equal keys, stays
    in `left` and gets no slot.
    """

    GAMMA = 1.5
    LEVELS = 64

    def __init__(self, keys: np.ndarray | None = None, sizes: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.left = np.empty(0, np.uint64)
        if keys is not None:
            levels, sizes_of, level = [], [], 0
            while len(keys):
                if level == self.LEVELS:
                    self.left = keys
                    break
                size = max(64, int(self.GAMMA * len(keys)))
                at = self._at(keys, level, size)
                times = np.bincount(at, minlength=size)
                levels.append(times == 1)
                sizes_of.append(size)
                keys = keys[times[at] != 1]
                level += 1
            sizes, bits = np.array(sizes_of, np.int64), np.concatenate(levels) if levels else np.empty(0, bool)
        self.sizes, self.bits = sizes, bits
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.rank = np.concatenate(([0], np.cumsum(bits)))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 2**64 - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self._at(keys[left], level, size) + self.base[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and the key of each; null is one empty line."""
    lines = (text or "").encode().split(b"\n")
    return lines, [x.strip(SPACE).translate(_LOWER) for x in lines]


def _looked_up(batch: pa.RecordBatch, min_chars: int):
    """Of a unit: lines of each row, the code of each line's key (-1: too short), and the distinct keys' two hashes and documents."""
    codes: dict[bytes, int] = {}
    docs, all_lines, all_codes = [], [], []
    for text in batch.column("text").to_pylist():
        lines, keys = line_keys(text)
        mine = []
        for k in keys:
            long = len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars)
            if not long:
                mine.append(-1)
                continue
            code = codes.get(k)
            if code is None:
                code = codes[k] = len(docs)
                docs.append(0)
            mine.append(code)
        for c in set(mine):
            if c >= 0:
                docs[c] += 1
        all_lines.append(lines)
        all_codes.append(mine)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, codes)), np.uint64).reshape(-1, 2)
    return all_lines, all_codes, both[:, 0], both[:, 1], np.array(docs, np.uint32)


def line_index(keys: DataFrame) -> DataFrame:
    """(shard, n, sizes, bits, prints, counts, rest): each shard's perfect hash, fingerprints and document counts by slot.

    `rest` has the keys that got no slot, as both hashes and the count, and is nearly always empty.
    """

    def build(key, table):
        one, two = (np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()]) for c in ("one", "two"))
        docs = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("docs").to_pylist()])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(docs[order].astype(np.int64), starts)
        one, two = one[starts], two[starts]
        mixed = one ^ mix(two)
        h = PerfectHash(mixed)
        placed = ~np.isin(mixed, h.left)
        slot, n = h.slots(mixed[placed]), int(placed.sum())
        prints, by_slot = np.empty(n, np.uint64), np.empty(n, np.uint32)
        prints[slot] = two[placed]
        by_slot[slot] = np.minimum(counts[placed], 2**32 - 1)
        rest = np.stack((one[~placed], two[~placed], counts[~placed].astype(np.uint64)), axis=1)
        data = {"shard": [key[0].as_py()], "n": [len(one)], "sizes": [h.sizes.tobytes()], "bits": [np.packbits(h.bits).tobytes()], "prints": [prints.tobytes()], "counts": [by_slot.tobytes()], "rest": [rest.tobytes()]}
        return pa.Table.from_pydict(data, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("sizes", "bits", "prints", "counts", "rest")]))

    return keys.groupBy("shard").applyInArrow(build, "shard long, n long, sizes binary, bits binary, prints binary, counts binary, rest binary")


def _probe(keys: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """(shard, unit, n, bits): which of the keys that a unit sent stand in at least min_docs documents."""

    def each(key, table, arrays):
        row = arrays.to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], np.int64)
        h = PerfectHash(sizes=sizes, bits=np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
        prints, counts = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32)
        rest = {(a, b): n for a, b, n in np.frombuffer(row["rest"], np.uint64).reshape(-1, 3).tolist()}
        bits = []
        for a, b in zip(table.column("one").to_pylist(), table.column("two").to_pylist()):
            one, two = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            slot = h.slots(one ^ mix(two))
            found = (slot >= 0) & (prints[slot] == two) & (counts[slot] >= min_docs) if len(prints) else np.zeros(len(one), bool)
            if rest:
                found |= np.array([rest.get(x, 0) >= min_docs for x in zip(one.tolist(), two.tolist())], bool)
            bits.append(np.packbits(found).tobytes() if found.any() else None)
        out = table.select(["shard", "unit", "n"]).append_column("bits", pa.array(bits, pa.binary()))
        return out.filter(pa.compute.is_valid(out.column("bits")))

    return keys.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(each, "shard long, unit long, n long, bits binary")


def _keys(rows: DataFrame, min_chars: int, shards: int) -> DataFrame:
    """(shard, unit, n, one, two, docs): each distinct key of a unit once, with its documents in the unit."""
    schema = pa.schema([("shard", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("docs", pa.binary())])

    def each(unit, batch):
        _, _, one, two, docs = _looked_up(batch, min_chars)
        found = [(s, i) for s, i in enumerate(U.split_by((one % np.uint64(shards)).astype(np.int64), shards)) if len(i)]
        data = {"shard": [s for s, _ in found], "unit": [unit] * len(found), "n": [len(i) for _, i in found]}
        yield pa.RecordBatch.from_pydict(data | {c: [x[i].tobytes() for _, i in found] for c, x in (("one", one), ("two", two), ("docs", docs))}, schema=schema)

    return U.per_unit(rows, each, "shard long, unit long, n long, one binary, two binary, docs binary")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops every line whose key (stripped of ASCII white space, A-Z lower-cased) stands in min_docs documents.

    Keys of less than min_chars code points always stay. Returns one row for each document: doc_id,
    n_lines (before), n_dropped, kept_sha256 (of the other lines, joined by \\n) and, if `with_text`,
    those as `kept`, and the `carry` columns as they are. `docs` is a stored table. A null or empty text is one empty line and gives an
    empty text; each row counts as a document of its own, so that repeated rows count each; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = U.source(docs, id_col, text_col, carry)
    shards = U.shards_of(rows)
    keys = written(_keys(rows, min_chars, shards), "line-keys")
    index = written(line_index(keys.select("shard", "one", "two", "docs")), "line-index")
    answers = written(_probe(keys.select("shard", "unit", "n", "one", "two"), index, min_docs), "line-answers")
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"][: 4 + with_text]
    schema = f"doc_id {U.doc_type(rows)}, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text + U.carried(docs, carry, names)
    names += carry

    def drop(batches):
        for some in batches:
            for blob, replies in zip(some.column("blob").to_pylist(), some.column("answers").to_pylist()):
                batch = U.thaw(blob)
                lines, codes, one, _, _ = _looked_up(batch, min_chars)
                gone = U.answer_bits((one % np.uint64(shards)).astype(np.int64), replies).tolist() + [False]
                kept = [[x for x, c in zip(ls, cs) if not gone[c]] for ls, cs in zip(lines, codes)]
                data = [b"\n".join(x) for x in kept]
                columns = [batch.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) - len(k) for x, k in zip(lines, kept)], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())]
                if with_text:
                    columns.append(pa.array([x.decode() for x in data], pa.string()))
                columns += U.carry_of(batch, carry)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return U.answered(U.packed(rows), answers).select("blob", "answers").mapInArrow(drop, schema)
