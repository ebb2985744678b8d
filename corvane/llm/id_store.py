"""A content-addressed store of token ids.

Rolling hashes over 16 ids cut each document's id stream into chunks at places that depend on the
content alone, so equal passages give equal chunks wherever they stand. A chunk is stored once, under
the SHA-256 of its ids. A document is a recipe: the list of its chunks. Recipes lie in ascending
document order with each document's place in the whole stream. The manifest is a Merkle tree: a leaf is
the hash of a recipe, a shard's root that of its leaves in order, the store's root that of the shard roots.

Files: `data/kind=chunk` (hash, n, body), `recipes` (shard, place, doc_id, start, n_tokens, chunks, leaf),
`manifest` (shard, n_docs, n_tokens, root). Bodies are little-endian unsigned integers of 16 bits, or of
32 where an id needs it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.arrays import mix, rolled
from corvane.llm.shared import id_type, keyed, need_skew_joins, parts, per_slice

WINDOW = 16
#: A chunk holds 512 ids on average and 8192 at most.
AVERAGE_BITS = 9
LONGEST = 8192


def chunk_ends(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents whose ids lie end to end, document i at first[i]:first[i + 1]."""
    n = len(ids)
    h = rolled(mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW, 0x9E3779B97F4A7C15)
    cuts = np.flatnonzero((h & np.uint64((1 << AVERAGE_BITS) - 1)) == 0) + WINDOW  # after the window's last id
    begin = first[np.searchsorted(first, cuts - 1, side="right") - 1] if len(cuts) else cuts
    cuts = cuts[cuts - begin >= WINDOW]  # a window over a document's start doesn't count
    ends = np.unique(np.concatenate((cuts, first[1:])))
    ends = ends[ends > 0]
    begins = np.concatenate(([0], ends[:-1]))
    extra = (ends - begins - 1) // LONGEST
    if extra.any():
        long = np.flatnonzero(extra)
        ends = np.sort(np.concatenate([ends, *[begins[i] + LONGEST * np.arange(1, extra[i] + 1) for i in long]]))
    return ends[ends <= n]


def _encode(docs: DataFrame, encode, end_id: int) -> DataFrame:
    """Rows of kind chunk (hash, n, body) and recipe (row, doc_id, n, hashes, sizes)."""
    kind = id_type(docs, "doc_id")
    names = ["kind", "hash", "row", "doc_id", "n", "body", "sizes"]

    def run(batch):
        ids, counts = encode()(batch.column("text"))
        first = np.concatenate(([0], np.cumsum(counts + 1)))
        stream = np.full(first[-1], end_id, np.uint32)
        keep = np.ones(len(stream), bool)
        keep[first[1:] - 1] = False
        stream[keep] = ids
        ends = chunk_ends(stream, first)
        begins = np.concatenate(([0], ends[:-1]))
        data, wide = memoryview(stream.tobytes()), stream
        small = memoryview(wide.astype(np.uint16).tobytes())
        bodies: dict[bytes, tuple[int, bytes]] = {}
        digests = []
        fits = stream < 65536
        narrow_all = bool(fits.all())
        for a, b in zip(begins.tolist(), ends.tolist()):
            digest = hashlib.sha256(data[4 * a : 4 * b]).digest()
            digests.append(digest)
            if digest not in bodies:
                narrow = narrow_all or bool(fits[a:b].all())
                bodies[digest] = (b - a, bytes(small[2 * a : 2 * b] if narrow else data[4 * a : 4 * b]))
        each = np.searchsorted(ends, first[1:], side="right")
        sizes = (ends - begins).astype(np.uint32)
        n, m = batch.num_rows, len(bodies)
        cut = np.concatenate(([0], each))
        recipe = [b"".join(digests[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        lengths = [sizes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        columns = [
            pa.array(["recipe"] * n + ["chunk"] * m),
            pa.array(recipe + list(bodies), pa.binary()),
            pa.concat_arrays([batch.column("_row").cast(pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, batch.column("doc_id").type)]),
            pa.array([*(counts + 1).tolist(), *[x[0] for x in bodies.values()]], pa.int64()),
            pa.array([None] * n + [x[1] for x in bodies.values()], pa.binary()),
            pa.array(lengths + [None] * m, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return per_slice(docs, run, f"kind string, hash binary, row long, doc_id {kind}, n long, body binary, sizes binary")


def write_store(docs: DataFrame, path: str, encode: Callable, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Stores the ids of all documents under `path`, each followed by `end_id`, in ascending id order.

    `encode()` gives, in a worker, a function from texts to ids and counts (see packing). Null ids come
    first; rows with equal ids follow the order of the table. A null or empty text is the end id
    alone. Other columns are ignored. An empty table gives a store without rows.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id", "text")
    found = _encode(rows, encode, end_id)
    schema = found.schema

    def unique(batches):
        last = None
        for batch in batches:
            hashes = batch.column("hash")
            chunk = pc.equal(batch.column("kind"), "chunk")
            before = pa.concat_arrays([pa.array([last], hashes.type), hashes.slice(0, len(hashes) - 1)])
            again = pc.fill_null(pc.and_(chunk, pc.equal(hashes, before)), False)
            if len(hashes):
                last = hashes[-1].as_py() if chunk[-1].as_py() else None
            yield batch.filter(pc.invert(again))

    # equal chunks meet in one partition and stand side by side, recipes are spread by row
    spread = found.repartition(parts(spark), F.when(F.col("kind") == "chunk", F.xxhash64("hash")).otherwise(F.xxhash64("row")))
    ordered = spread.sortWithinPartitions("kind", F.when(F.col("kind") == "chunk", F.col("hash")))
    ordered.mapInArrow(unique, schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")

    recipes = spark.read.schema(schema).parquet(f"{path}/data").filter(F.col("kind") == "recipe").select("row", "doc_id", "n", "hash", "sizes")
    ordered = recipes.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("row")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("row"))
    kind = docs.schema[id_col].dataType.simpleString()

    def number(batches):
        from pyspark import TaskContext

        shard, at, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            sizes = batch.column("sizes").to_pylist()
            leaves = [leaf(i, h, s) for i, h, s in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), sizes)]
            columns = [pa.array([shard] * len(n), pa.int64()), pa.array(place + np.arange(len(n))), batch.column("doc_id"), pa.array(local), batch.column("n"), batch.column("hash"), batch.column("sizes"), pa.array(leaves, pa.binary())]
            place += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "doc_id", "local", "n_tokens", "hashes", "sizes", "leaf"])

    ordered.mapInArrow(number, f"shard long, place long, doc_id {kind}, local long, n_tokens long, hashes binary, sizes binary, leaf binary").write.option("compression", "zstd").parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    # one row for each shard, of which there are as many as range partitions
    shards = _roots(written).withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards.coalesce(1).write.parquet(f"{path}/manifest")


def leaf(doc_id, hashes: bytes, sizes: bytes) -> bytes:
    return hashlib.sha256(repr(doc_id).encode() + b"\0" + hashes + sizes).digest()


def _roots(recipes: DataFrame) -> DataFrame:
    """(shard, n_docs, n_tokens, root): leaves are folded by runs first, so that no task gathers a shard's leaves."""

    def fold(batches):
        now = None
        for batch in batches:
            for shard, place, n, x in zip(*[batch.column(c).to_pylist() for c in ("shard", "place", "n_tokens", "leaf")]):
                if now is None or now[0] != shard:
                    if now:
                        yield _fold_row(now)
                    now = [shard, place, 0, 0, hashlib.sha256()]
                now[2] += 1
                now[3] += n
                now[4].update(x)
        if now:
            yield _fold_row(now)

    runs = recipes.select("shard", "place", "n_tokens", "leaf").repartition(parts(recipes.sparkSession), "shard").sortWithinPartitions("shard", "place")
    return runs.mapInArrow(fold, "shard long, place long, n_docs long, n_tokens long, root binary").drop("place")


def _fold_row(now: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": [now[0]], "place": [now[1]], "n_docs": [now[2]], "n_tokens": [now[3]], "root": [now[4].digest()]})


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, with its place in the whole stream."""
    shards = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("shard_start"))
    return spark.read.parquet(f"{path}/recipes").join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("local")).drop("shard_start", "local")


def _chunk_rows(recipes: DataFrame) -> DataFrame:
    """One row for each chunk of a document: shard, place, hash, n, and the ids after it in its document."""

    def run(batches):
        for batch in batches:
            sizes = [np.frombuffer(s, np.uint32).astype(np.int64) for s in batch.column("sizes").to_pylist()]
            each = np.array([len(s) for s in sizes], np.int64)
            hashes = b"".join(batch.column("hashes").to_pylist())
            after = np.concatenate([s.sum() - np.cumsum(s) for s in sizes]) if sizes else np.empty(0, np.int64)
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(), each)) for c in ("shard", "place")]
            columns += [pa.array([hashes[i : i + 32] for i in range(0, len(hashes), 32)], pa.binary()), pa.array(np.concatenate(sizes) if sizes else []).cast(pa.int64()), pa.array(after).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "hash", "n", "after"])

    return recipes.select("shard", "place", "hashes", "sizes").mapInArrow(run, "shard long, place long, hash binary, n long, after long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), computed from the stored bodies, each of them verified.

    A body that doesn't match its hash, or a recipe with a missing chunk, is an error. The CRC of a
    document is put together from those of its chunks, each shifted by the ids after it: no body moves.
    """
    need_skew_joins(spark)  # a passage of very many documents is a hot chunk
    recipes = read_recipes(spark, path)
    data = spark.read.schema("kind string, hash binary, n long, body binary").parquet(f"{path}/data").filter(F.col("kind") == "chunk")

    def checked(batches):
        import zlib

        for batch in batches:
            crcs = []
            for h, n, body in zip(*[batch.column(c).to_pylist() for c in ("hash", "n", "body")]):
                ids = body if len(body) == 4 * n else np.frombuffer(body, np.uint16).astype(np.uint32).tobytes()
                if len(ids) != 4 * n or hashlib.sha256(ids).digest() != h:
                    raise ValueError("a stored chunk doesn't match its hash")
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crcs, pa.int64())], names=["hash", "crc"])

    chunks = data.select("hash", "n", "body").mapInArrow(checked, "hash binary, crc long")

    def shifted(batches):
        for batch in batches:
            if batch.column("crc").null_count:
                raise ValueError("a recipe names a chunk that isn't stored")
            moved = crc_shift(batch.column("crc").to_numpy().astype(np.uint32), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), batch.column("n"), pa.array(moved.astype(np.int64))], names=["shard", "place", "n", "crc"])

    moved = _chunk_rows(recipes).join(chunks, "hash", "left").select("shard", "place", "n", "after", "crc").mapInArrow(shifted, "shard long, place long, n long, crc long")
    sums = moved.groupBy("shard", "place").agg(F.sum("n").alias("read"), F.bit_xor("crc").alias("ids_crc32"))
    out = recipes.select("shard", "place", "doc_id", "start", "n_tokens").join(sums, ["shard", "place"], "left")
    n = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe doesn't add up")).cast("long"))
    return out.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def verify(spark: SparkSession, path: str) -> bytes:
    """The store's Merkle root, after all leaves and shard roots were computed anew from the recipes.

    Raises if a shard's root differs from the manifest. Bodies are verified by `read_documents`.
    """

    def fresh(batches):
        for batch in batches:
            new = [leaf(i, h, s) for i, h, s in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "hashes", "sizes")])]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), batch.column("n_tokens"), pa.array(new, pa.binary())], names=["shard", "place", "n_tokens", "leaf"])

    recipes = spark.read.parquet(f"{path}/recipes")
    again = _roots(recipes.mapInArrow(fresh, "shard long, place long, n_tokens long, leaf binary"))
    stored = spark.read.parquet(f"{path}/manifest").select("shard", F.col("root").alias("stored"))
    root = hashlib.sha256()
    for row in stored.join(again, "shard", "full").orderBy("shard").toLocalIterator():
        if row.stored != row.root:
            raise ValueError(f"shard {row.shard} doesn't match the manifest")
        root.update(row.root)
    return root.digest()


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC's polynomial, bits reflected."""
    p, b = np.zeros_like(a), b.copy()
    for i in range(31, -1, -1):
        p ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0)).astype(np.uint32)
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ _POLY, b >> np.uint32(1)).astype(np.uint32)
    return p


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 contributes to the CRC of a sequence that goes on for n_bytes."""
    n = np.asarray(n_bytes, np.int64)
    out, power = crc.astype(np.uint32), np.array([1 << 23], np.uint32)  # x to the 8
    while n.any():
        odd = n & 1 == 1
        if odd.any():
            out[odd] = _times(np.broadcast_to(power, odd.sum()).copy(), out[odd])
        power = _times(power, power)
        n = n >> 1
    return out
