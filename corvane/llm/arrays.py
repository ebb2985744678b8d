"""Columnar text kernels shared by the operators: texts in an Arrow array become flat numpy arrays of words.

Null texts count as empty everywhere. All kernels work on whole texts; `slices` only bounds how many
texts are held in expanded form at once (a single longer text forms a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte tables of the word definitions. Bytes of multi-byte characters (0x80 and above) always belong to words.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts hold about `limit` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives memory that a finished partition held back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each text in them (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of some texts: byte range of each in `raw`, and the first word of each text in `first` (one more than texts)."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.Array:
        """The words as one Arrow binary array."""
        length = self.end - self.start
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        if not len(length):
            return pa.array([], pa.large_binary())
        kept = self.raw[ranges(self.start, length)]
        return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """Code of each word and the distinct words."""
        if not len(self.start):
            return np.empty(0, np.int64), []
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of each word: a multilinear hash of its bytes, mixed with its length. Lanes are independent."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        length = self.end - self.start
        byte, factor = _tables(lane, int(length.max()))
        ends = np.cumsum(length)
        begins = ends - length
        kept = ranges(self.start, length)
        sums = byte[self.raw[kept]]
        kept -= np.repeat(self.start, length)
        sums *= factor[kept]
        return mix(np.add.reduceat(sums, begins) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TABLES: dict[int, list[np.ndarray]] = {}


def _tables(lane: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte, and random odd factor of each position in a word; the same in every process."""
    if lane not in _TABLES or len(_TABLES[lane][1]) < longest:
        n = 1 << max(10, (longest - 1).bit_length())
        seed = np.uint64(lane * 1_000_003 + 1) << np.uint64(40)
        _TABLES[lane] = [mix(mix(np.arange(1, 257, dtype=np.uint64) + seed)), mix(mix(np.arange(1000, n + 1000, dtype=np.uint64) + seed)) | np.uint64(1)]
    return _TABLES[lane][0], _TABLES[lane][1]


def words(texts: pa.Array, kind: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Maximal runs of word bytes; no word crosses a text's end."""
    raw, at = flat(texts)
    return words_of(LOWER[raw] if lower else raw, at, kind)


def words_of(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    inside = kind[raw]
    if not len(raw):
        return Words(raw, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[(at > 0) & (at < len(raw))]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return Words(raw, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, by its first word (runs may cross texts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, f = h[:n].copy(), np.uint64(factor)
    for i in range(1, width):
        out *= f
        out += h[i : i + n]
    return mix(out)


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each length, end to end."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    base = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return base + np.arange(total)
