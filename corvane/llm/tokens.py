"""Byte-level tokenizing through the tokenizers library, each distinct pre-token encoded once per worker.

A byte-level BPE treats every pre-token by itself. So a slice of texts is cut into pre-tokens with
array operations, the distinct ones are looked up in a memo that the library's own encodings fill,
and the ids of all texts are gathered from there. Texts with characters outside the scripts whose
classes the cutter knows (see `KNOWN`) go to the library whole. `tests/llm/test_tokens.py` holds
both against the library.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from corvane.llm.arrays import flat, ranges

#: Texts whose code points all lie below are cut here; others are encoded by the library whole.
KNOWN = 0x0590
#: Distinct pre-tokens that a worker remembers; later ones are encoded anew in each slice.
MEMO = 300_000

_L, _N, _S, _O = 1, 2, 3, 4


def _classes() -> np.ndarray:
    out = np.full(KNOWN, _O, np.uint8)
    for i in range(KNOWN):
        kind = unicodedata.category(chr(i))[0]
        out[i] = _L if kind == "L" else _N if kind == "N" else _O
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _S
    return out


_CLASS = _classes()


def cut(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First code points of the pre-tokens of texts that lie end to end, text i at at[i]:at[i + 1].

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+ of byte-level BPE.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASS[points]
    first = np.zeros(n + 1, bool)
    first[at] = True
    space = kind == _S
    begins = first[:-1].copy()
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    joined = np.zeros(n, bool)  # a plain space before, in the same text: it belongs to this run
    joined[1:] = (points[:-1] == 32) & ~first[1:-1]
    begins |= change & (space | ~joined)
    inner = np.zeros(n, bool)  # the last of several white-space characters, before something else
    inner[1:-1] = space[1:-1] & space[:-2] & ~space[2:] & ~first[1:-2] & ~first[2:-1]
    begins |= inner
    quotes = np.flatnonzero(begins & (points == 39))
    if len(quotes):
        ends = at[np.searchsorted(at, quotes, side="right")]
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one = np.where(quotes + 1 < ends, padded[quotes + 1], 0)
        two = np.where(quotes + 2 < ends, padded[quotes + 2], 0)
        short = np.isin(one, [115, 116, 109, 100])  # s t m d
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for found, length in ((quotes[short], 2), (quotes[long & ~short], 3)):
            begins[found + 1] = False
            after = found + length
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


def _blocks(index: np.ndarray, size: int = 2000) -> list[np.ndarray]:
    return [index[i : i + size] for i in range(0, len(index), size)]


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, special tokens as ordinary text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet = _byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.width = np.ones(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece) if all(c in alphabet for c in piece) else len(piece.encode())
        self.memo: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.begin = self.count = np.empty(0, np.int64)

    def _encode_new(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens in an array, and where each one's begin there and how many they are."""
        text = b"\0".join(new).decode().split("\0") if b"\0" not in new else [w.decode() for w in new]
        if len(text) != len(new):
            text = [w.decode() for w in new]
        size = np.fromiter(map(len, new), np.int64, len(new))
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in text), bool, len(text))
        begin, count, out, total = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        for some in _blocks(np.flatnonzero(plain)):  # each such word is a pre-token again when they are joined
            ids = np.array(self.library.encode("".join([text[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum(size[some])
            widths = np.cumsum(self.width[ids])
            cuts = np.searchsorted(widths, ends) + 1
            if widths[-1] != ends[-1] or (widths[cuts - 1] != ends).any():
                raise ValueError("the tokenizer is not a byte-level BPE")
            count[some] = np.diff(cuts, prepend=0)
            begin[some] = total + cuts - count[some]
            out.append(ids)
            total += len(ids)
        for some in _blocks(np.flatnonzero(~plain)):
            found = [e.ids for e in self.library.encode_batch_fast([text[i] for i in some], add_special_tokens=False)]
            count[some] = [len(x) for x in found]
            begin[some] = total + np.cumsum(count[some]) - count[some]
            out.append(np.fromiter((i for x in found for i in x), np.uint32))
            total += len(out[-1])
        return np.concatenate(out), begin, count

    def _look_up(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of the ids of each distinct pre-token in an array, and that array."""
        get = self.memo.get
        known = np.array([get(w, -1) for w in distinct], np.int64)
        missing = np.flatnonzero(known < 0)
        if not len(missing):
            return self.begin[known], self.count[known], self.ids
        new = [distinct[i] for i in missing]
        ids, begin, count = self._encode_new(new)
        base = len(self.begin)
        known[missing] = base + np.arange(len(new))
        begin = np.concatenate((self.begin, begin + len(self.ids)))
        count = np.concatenate((self.count, count))
        ids = np.concatenate((self.ids, ids))
        if len(self.memo) < MEMO:
            self.memo.update(zip(new, range(base, base + len(new))))
            self.begin, self.count, self.ids = begin, count, ids
        return begin[known], count[known], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (unsigned 32 bits) and the number of ids of each. Null: no ids."""
        raw, at = flat(texts)
        points, point_at, lead = code_points(raw, at)
        n = len(at) - 1
        foreign = np.zeros(n, bool)
        odd = np.flatnonzero(points >= KNOWN)
        if len(odd):
            foreign[np.searchsorted(point_at, odd, side="right") - 1] = True
            points = np.where(points >= KNOWN, 120, points)
        start = cut(points, point_at)
        first = np.searchsorted(start, point_at)
        offsets = np.append(lead[start], len(raw))
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        keep = ~np.repeat(foreign, np.diff(first)) if foreign.any() else None
        tokens = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        if keep is not None:
            tokens = tokens.filter(pa.array(keep))
            first = np.concatenate(([0], np.cumsum(np.where(foreign, 0, np.diff(first)))))
        coded = tokens.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        begin, length, ids = self._look_up(coded.dictionary.to_pylist())
        lengths = length[codes] if len(codes) else np.empty(0, np.int64)
        sums = np.concatenate(([0], np.cumsum(lengths)))
        counts = sums[first[1:]] - sums[first[:-1]]
        out = ids[ranges(begin[codes], lengths)] if len(codes) else np.empty(0, np.uint32)
        if keep is None:
            return out, counts
        pieces = np.split(out, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(foreign):
            pieces[i] = np.array(self.library.encode(bytes(raw[at[i] : at[i + 1]]).decode(), add_special_tokens=False).ids, np.uint32)
            counts[i] = len(pieces[i])
        return np.concatenate(pieces), counts


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, the offsets `at` in code points, and each code point's first byte."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, at, np.arange(len(raw))
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    return points, np.searchsorted(lead, at), lead


def _byte_letters() -> set[str]:
    """The characters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in own} | {chr(256 + i) for i in range(256 - len(own))}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
