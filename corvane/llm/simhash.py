"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint lane has 64 bits. To find all pairs within `radius` bits, each bit gets a non-zero vector of
radius + 1 bits, and there is a table for each non-zero vector v: its mask has the bits whose vector
has an odd product with v. Any `radius` vectors leave some v orthogonal to all of them; that
table's mask avoids all bits in which two such fingerprints differ, so they meet in it. With several
lanes, each lane has its own tables, and pairs that meet are held against all lanes.

With a similarity, pairs as far apart as that would need tables without end, or lose some. So the shingles
propose: in an order that all texts share, a text's first shingles, all but the share that a similar text must
have and one more, hold a shingle of each similar text's first ones. The bits of all lanes then sort out texts far below the similarity,
and the Jaccard similarity of the shingle sets themselves decides.

Only distinct fingerprints enter the tables. A bucket of more than `LIMIT` of them is split by the same
construction over its other bits, and at last into pairs of blocks; so no task holds more than two blocks.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrays import Words, flat, mix, ranges, words
from corvane.llm.components import components
from corvane.llm.shared import id_type, need_skew_joins, parts, per_slice, written

LIMIT = 4096
#: Text that is held in expanded form at once.
SLICE = 3 << 20
LEVELS = 3
#: One of so many texts is looked at for frequent shingles; how often a shingle must be found there, and how many are kept.
SAMPLE = 64
FREQUENT = 16
MOST = 1 << 17

_SPREAD = np.array([sum(1 << (8 * j) for j in range(8) if i >> j & 1) for i in range(256)], np.uint64)


def shingle_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's shingles of `size` words joined by a space, and each text's number of them.

    A text of fewer words has its whole sequence as its one shingle; without words it has none.
    """
    length = w.end - w.start + 1
    index = ranges(w.start, length)
    ends = np.cumsum(length)
    if len(index):
        index[ends - 1] = 0
    raw = w.raw[index] if len(index) else np.empty(0, np.uint8)
    raw[ends - 1] = 32
    begins, ends = ends - length, ends - 1
    counts = w.counts
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = ranges(w.first[:-1], each)
    last = np.minimum(first + size, np.repeat(w.first[1:], each)) - 1
    data, digest = memoryview(raw.tobytes()), xxhash.xxh64_intdigest
    found = [digest(data[a:b], 42) for a, b in zip(begins[first].tolist(), ends[last].tolist())]
    return np.array(found, np.uint64), each


def majority(hashes: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bits that are set in over half of its hashes. None: zero.

    Eight bits at a time are spread over the bytes of an integer and summed by blocks of at most 255.
    """
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(each)
    if not len(some):
        return out
    blocks = -(-each[some] // 255)
    starts = np.repeat((np.cumsum(each) - each)[some], blocks) + 255 * ranges(np.zeros(len(some), np.int64), blocks)
    owners = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), owners, axis=0)
        bits = 2 * counts > each[some][:, None]
        out[some] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def distinct(hashes: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted by their last 32 bits, these alone, and each text's number of them."""
    both, at = np.unique(np.repeat(np.arange(len(each), dtype=np.uint64), each) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF), return_index=True)
    return hashes[at], both.astype(np.uint32), np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(each))


def prefixes(hashes: np.ndarray, each: np.ndarray, similarity: float, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's distinct hashes the first ones, and their number: two texts of Jaccard `similarity` have one of them in common.

    Of n hashes a similar text has `similarity` * n or more, so not all of them lie behind the first ones. The order must be
    the same for all texts, else it is free: that of `distinct`, but those among `late` (sorted) come last.
    """
    n = np.where(each > 0, each - np.ceil(similarity * each - 1e-9).astype(np.int64) + 1, 0)
    if len(late) and len(hashes):
        behind = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        hashes = hashes[np.lexsort((behind, np.repeat(np.arange(len(each)), each)))]
    return hashes[ranges(np.cumsum(each) - each, n)], n


def frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that many texts (doc_id, text) share, from a sample, sorted. Which these are plays no part in results: first shingles go into smaller buckets without them."""

    def run(batch):
        h, each = shingle_hashes(words(batch.column("text"), lower=True), size)
        value, n = np.unique(distinct(h, each)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["hash", "n"])

    sample = rows.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    found = per_slice(sample, run, "hash long, n long", limit=SLICE).groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    most = found.orderBy(F.desc("n"), "hash").limit(MOST).collect()
    return np.sort(np.array([r.hash for r in most], np.int64).view(np.uint64))


def _binary(values: np.ndarray, each: np.ndarray) -> pa.Array:
    """Each text's values as one binary."""
    offsets = np.concatenate(([0], np.cumsum(values.itemsize * each))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def fingerprints(docs: DataFrame, size: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, f0, f1, ...): 64-bit fingerprints of each text, as signed integers.

    With `similarity` they are of its distinct shingles; these follow as `shingles`, a 64-bit digest of their set as `node`, and the
    first ones (see `prefixes`) as `prefix`.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", *[f"f{k}" for k in range(lanes)], *(["shingles", "node", "prefix"] if similarity is not None else [])]
    late = docs.sparkSession.sparkContext.broadcast(frequent(rows, size)) if similarity is not None else None

    def run(batch):
        h, each = shingle_hashes(words(batch.column("text"), lower=True), size)
        if late is not None:
            h, data, each = distinct(h, each)
        found = [pa.array(majority(h if k == 0 else mix(h + np.uint64(k)), each).view(np.int64)) for k in range(lanes)]
        if late is not None:
            sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(h)))
            ends = np.cumsum(each)
            found += [_binary(data, each), pa.array((sums[ends] - sums[ends - each]).view(np.int64)), _binary(*prefixes(h, each, similarity, late.value))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], names=names)

    kinds = ", ".join(f"f{k} long" for k in range(lanes)) + ", shingles binary, node long, prefix binary" * (similarity is not None)
    return per_slice(rows, run, f"doc_id {id_type(docs, id_col)}, {kinds}", limit=SLICE)


def masks(radius: int, level: int = 0) -> list[int]:
    """The masks of 2 ** (radius + 1) - 1 tables, as signed integers."""
    n = (1 << (radius + 1)) - 1
    vectors = np.arange(64) % n + 1
    vectors = np.random.default_rng(level).permutation(vectors)
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i, x in enumerate(vectors.tolist()) if (x & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _spread(rows: DataFrame, lanes: int, radius: int, level: int) -> DataFrame:
    """Each row once for each table: (lane, mask, bucket, node, f...)."""
    names = ["node", *[f"f{k}" for k in range(lanes)]]
    if "mask" in rows.columns:
        lane, old = F.col("lane"), F.col("mask")
        own = F.coalesce(*[F.when(lane == k, F.col(f"f{k}")) for k in range(lanes)])
        tables = F.explode(F.array(*[F.lit(m) for m in masks(radius, level)])).alias("new")
        made = rows.select(*names, "lane", "mask", tables).withColumn("mask", old.bitwiseOR(F.col("new"))).drop("new")
        return made.select("lane", "mask", F.xxhash64("lane", "mask", own.bitwiseAND(F.col("mask"))).alias("bucket"), *names)
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(m).alias("mask"), F.col(f"f{k}").bitwiseAND(F.lit(m)).alias("key")) for k in range(lanes) for m in masks(radius, level)])).alias("t")
    made = rows.select(*names, tables)
    return made.select("t.lane", "t.mask", F.xxhash64("t.lane", "t.mask", "t.key").alias("bucket"), *names)


def _groups(f: np.ndarray, limit: int) -> np.ndarray:
    """Index of the first fingerprint to which each is linked, directly or over others of the bucket."""
    n = len(f)
    label = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        label[root] = root
        stack = [root]
        while stack and len(left):
            now = stack.pop()
            near = np.bitwise_count(f[left] ^ f[now]).sum(axis=1) <= limit
            label[left[near]] = root
            stack += left[near].tolist()
            left = left[~near]
    return label


def _buckets(batches, names: list[str]):
    """From rows sorted by bucket: their columns, and the first row and the size of each bucket, whole buckets at a time."""
    held = None
    for batch in _ended(batches):
        now = [] if batch is None else [batch.column(c).to_numpy() for c in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)] if now else held
        if not now or not len(now[0]):
            continue
        begins = np.concatenate(([0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1))
        sizes = np.diff(np.append(begins, len(now[0])))
        if batch is not None:  # the last bucket may go on
            held = [x[begins[-1] :] for x in now]
            begins, sizes = begins[:-1], sizes[:-1]
        yield now, begins, sizes


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _links(rows: DataFrame, lanes: int, limit: int) -> DataFrame:
    """(a, b): for each linked node of a bucket, the first node of its group in the bucket."""
    names = ["bucket", "node", *[f"f{k}" for k in range(lanes)]]

    def each(batches):
        for now, begins, sizes in _buckets(batches, names):
            node, f = now[1], np.stack(now[2:], axis=1).view(np.uint64)
            pairs = begins[sizes == 2]
            near = pairs[np.bitwise_count(f[pairs] ^ f[pairs + 1]).sum(axis=1) <= limit]
            a, b = [node[near + 1]], [node[near]]
            for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                label = _groups(f[at : at + n], limit)
                linked = np.flatnonzero(label != np.arange(n))
                a.append(node[at + linked])
                b.append(node[at + label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    ordered = rows.select(*names).repartition(parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(each, "a long, b long")


def _met(nodes: DataFrame, lanes: int, radius: int, counts: bool) -> DataFrame:
    """(bucket, node) of each node in each table of each lane; or (bucket, n) of those that a batch holds twice or more."""
    tables = [np.array(masks(radius, k), np.int64).view(np.uint64) for k in range(lanes)]

    def each(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            found = []
            for k, lane in enumerate(tables):
                f = batch.column(f"f{k}").to_numpy().view(np.uint64)
                for t, mask in enumerate(lane):
                    bucket = mix((f & mask) + np.uint64((k * len(lane) + t + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)).view(np.int64)
                    if counts:
                        value, times = np.unique(bucket, return_counts=True)
                        found.append((value[times > 1], times[times > 1]))
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], names=["bucket", "node"])
            if counts and found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([t for _, t in found]))], names=["bucket", "n"])

    return nodes.mapInArrow(each, "bucket long, n long" if counts else "bucket long, node long")


def _shared_groups(rows: DataFrame) -> DataFrame:
    """(bucket, node) of buckets with two nodes or more, repeated rows once; buckets with the same nodes become one."""

    def each(batches):
        for (bucket, node), begins, sizes in _buckets(batches, ["bucket", "node"]):
            if not len(begins):
                continue
            bucket, node = bucket[: sizes.sum()], node[: sizes.sum()]
            new = np.append(True, (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1]))
            node, sizes = node[new], np.add.reduceat(new.astype(np.int64), begins)
            begins = np.cumsum(sizes) - sizes
            begins, sizes = begins[sizes > 1], sizes[sizes > 1]
            if not len(begins):
                continue
            flat = ranges(begins, sizes)
            sums = np.add.reduceat(mix(node[flat].view(np.uint64) + np.uint64(12345)), np.cumsum(sizes) - sizes).view(np.int64)
            sums, new = np.unique(sums, return_index=True)
            flat = ranges(begins[new], sizes[new])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sums, sizes[new])), pa.array(node[flat])], names=["bucket", "node"])

    ordered = rows.repartition(parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(each, "bucket long, node long").distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Large buckets (bucket, node, ...) as pairs of blocks of about half of LIMIT nodes: each two nodes meet in one."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    blocks = rows.join(sizes, "bucket").withColumn("k", F.ceil(F.col("n") * 2 / LIMIT).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    made = blocks.select("*", other).withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return made.select(*rows.columns)


def _meetings(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(bucket, node) of groups of nodes that meet in a bucket of `rows` (bucket, node); `counts` (bucket, n) are of those that a batch holds twice or more.

    A bucket that two or more nodes of some batches share, LIMIT of them in all, is taken apart beforehand, so
    that another bucket has at most LIMIT nodes and one for each batch.
    """
    hot = written(counts.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > LIMIT).select("bucket"), "hot")
    if hot.isEmpty():
        groups = _shared_groups(rows)
    else:
        groups = _shared_groups(rows.join(hot, "bucket", "left_anti")).union(_block_pairs(rows.join(hot, "bucket", "left_semi").select("bucket", "node").distinct()))
    return written(groups, "groups")


def _first_shingles(found: DataFrame, counts: bool) -> DataFrame:
    """(bucket, node) of each node and each of its first shingles; or (bucket, n) of those that a batch holds twice or more. A batch counts equal nodes once."""

    def each(batches):
        for batch in batches:
            node, at = np.unique(batch.column("node").to_numpy(), return_index=True)
            raw, ends = flat(batch.column("prefix").take(pa.array(at)))
            bucket = raw.view(np.int64) if len(raw) else np.empty(0, np.int64)
            if counts:
                value, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value[n > 1]), pa.array(n[n > 1])], names=["bucket", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(node, np.diff(ends) // 8))], names=["bucket", "node"])

    return found.select("node", "prefix").mapInArrow(each, "bucket long, n long" if counts else "bucket long, node long")


def _near_groups(rows: DataFrame, lanes: int, limit: int) -> DataFrame:
    """(bucket, node): nodes of a bucket that the bits of all lanes link, in groups; groups of the same nodes become one."""
    names = ["bucket", "node", *[f"f{k}" for k in range(lanes)]]

    def each(batches):
        for now, begins, sizes in _buckets(batches, names):
            node, f = now[1], np.stack(now[2:], axis=1).view(np.uint64)
            pairs = begins[sizes == 2]
            near = pairs[np.bitwise_count(f[pairs] ^ f[pairs + 1]).sum(axis=1) <= limit]
            groups = np.stack((near, near + 1), axis=1).ravel()
            n = np.full(len(near), 2)
            for at, m in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                label = _groups(f[at : at + m], limit)
                order = np.argsort(label, kind="stable")
                _, times = np.unique(label, return_counts=True)
                kept = np.repeat(times > 1, times)
                groups, n = np.concatenate((groups, at + order[kept])), np.concatenate((n, times[times > 1]))
            if len(n):
                sums = np.add.reduceat(mix(node[groups].view(np.uint64) + np.uint64(12345)), np.cumsum(n) - n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sums, n)), pa.array(node[groups])], names=["bucket", "node"])

    ordered = rows.select(*names).repartition(parts(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(each, "bucket long, node long").distinct()


def alike(data: list[np.ndarray], similarity: float) -> np.ndarray:
    """Index of the first set to which each is linked, directly or over others: those of Jaccard `similarity` or more."""
    size = np.array([len(x) for x in data])
    label, left = np.full(len(data), -1), np.arange(len(data))
    while len(left):
        root, left = left[0], left[1:]
        label[root] = root
        stack = [root]
        while stack and len(left):
            now = stack.pop()
            a, b = size[now], size[left]
            maybe = left[(np.minimum(a, b) >= similarity * np.maximum(a, b)) & (b > 0)]
            if not a or not len(maybe):
                continue
            flat = np.concatenate([data[i] for i in maybe])
            at = np.minimum(np.searchsorted(data[now], flat), a - 1)
            both = np.add.reduceat((data[now][at] == flat).astype(np.int64), np.cumsum(size[maybe]) - size[maybe])
            near = maybe[both >= similarity * (a + size[maybe] - both) - 1e-9]
            label[near] = root
            stack += near.tolist()
            left = left[label[left] < 0]
    return label


def _alike_links(groups: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes of the groups whose shingle sets (node, shingles) have the similarity, or that others of the group join."""

    def each(batches):
        rows = ((b, n, s) for batch in batches for b, n, s in zip(*[batch.column(c).to_pylist() for c in ("bucket", "node", "shingles")]))
        for _, group in itertools.groupby(rows, lambda r: r[0]):
            group = list(group)
            node = np.array([n for _, n, _ in group])
            label = alike([np.frombuffer(x, np.uint32) for _, _, x in group], similarity)
            linked = np.flatnonzero(label != np.arange(len(node)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])

    ordered = groups.join(shingles, "node").repartition(parts(groups.sparkSession), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(each, "a long, b long")


def differing(similarity: float) -> float:
    """The largest expected share of bits in which fingerprints of two shingle sets of Jaccard `similarity` or more differ.

    Of large sets it is that of the angle between them. Of small ones, where ties count as zero, it is more: sizes up to 40 are gone through.
    """
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    for a in range(1, 41):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            both = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both <= a:
                set_ = [np.array([own[max(n // 2 + 1 - k, 0) :].sum() for k in range(both + 1)]) for n in (a, b) for own in (chance(n - both),)]
                most = max(most, float((chance(both) * (set_[0] * (1 - set_[1]) + set_[1] * (1 - set_[0]))).sum()))
    return most


def similar_links(found: DataFrame, nodes: DataFrame, lanes: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes (node, f0, ...): all of Jaccard `similarity` or more, directly or over others.

    Nodes that share one of their first shingles are held against each other by their bits, with a limit 9 standard deviations
    over the most that is expected at `similarity` (lost beyond: under 1e-13 with 8 lanes), and then by their sets.
    """
    n, share = 64 * lanes, differing(similarity)
    limit = math.floor(n * share + 9 * math.sqrt(n * share * (1 - share)))
    met = _meetings(_first_shingles(found, False), _first_shingles(found, True))
    groups = written(_near_groups(met.join(nodes, "node"), lanes, limit), "near")
    mine = groups.select("node").distinct().hint("shuffle_hash")
    shingles = found.select("node", "shingles").join(mine, "node").groupBy("node").agg(F.min("shingles").alias("shingles"))
    return _alike_links(groups, written(shingles, "shingles"), similarity)


def near_links(nodes: DataFrame, lanes: int, radius: int, limit: int) -> DataFrame:
    """Links (a, b) between nodes (node, f0, ...) that meet in a table and differ in at most `limit` bits of all lanes."""
    if lanes > 1:
        return _links(_meetings(_met(nodes, lanes, radius, False), _met(nodes, lanes, radius, True)).join(nodes, "node"), lanes, limit)
    rows, found = _spread(nodes, lanes, radius, 0), []
    for level in range(1, LEVELS + 1):
        hot = written(rows.groupBy("bucket").count().filter(F.col("count") > LIMIT), "hot")
        if hot.isEmpty():
            return _union([*found, _links(rows, lanes, limit)])
        found.append(_links(rows.join(hot, "bucket", "left_anti"), lanes, limit))
        rows = written(rows.join(hot.select("bucket"), "bucket", "left_semi"), "split")
        if level < LEVELS:
            rows = written(_spread(rows, lanes, radius, level).distinct(), "split")
    return _union([*found, _links(_block_pairs(rows), lanes, limit)])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def near_components(docs: DataFrame, size: int = 3, radius: int = 3, lanes: int = 1, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits, of the first lane), component_id.

    Texts are lower-cased (A-Z) and cut into shingles of `size` words, repeats included unless `similarity` is given. With one lane
    all pairs of fingerprints within `radius` bits are linked. With `similarity`, all pairs whose sets of shingles have a
    Jaccard similarity of `similarity` or more are linked, whatever the number of documents, and `radius` plays no part; texts
    with the same set count as one. component_id is the least doc_id reachable over links, its own included.

    A null or empty text has fingerprint zero and is linked like any other. Null ids stay null and
    never count as least (a component of null ids alone has none); repeated rows appear each; other
    columns are ignored; an empty table gives an empty one.
    """
    need_skew_joins(docs.sparkSession)
    names = [f"f{k}" for k in range(lanes)]
    found = written(fingerprints(docs, size, lanes, id_col, text_col, similarity), "fingerprints")
    if similarity is None:
        key = names
        nodes = written(found.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
        links = near_links(nodes.select("node", *names), lanes, radius, radius)
    else:
        key = ["node"]
        nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in names]), "nodes")
        links = similar_links(found, nodes.select("node", *names), lanes, similarity)
    label = components(links)
    joined = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = written(joined.join(least, "label").select(*key, "component_id"), "classes")
    out = found.select("doc_id", *{"f0": 0, **dict.fromkeys(key)}).join(by_print, key)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
