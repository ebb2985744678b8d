"""Token counts by a linear longest-match automaton.

Every pre-token is cut greedily into the longest pieces of a vocabulary. A trie of the vocabulary
carries failure links and, with each, the number of pieces that following it pops; so one walk over
a word's bytes counts its pieces without building any of them. A worker counts each distinct
pre-token once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import tokens
from corvane.llm.arrays import flat
from corvane.llm.shared import id_type, per_slice

#: Distinct pre-tokens whose count a worker remembers.
MEMO = 1_000_000


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings. Every single byte must be a piece."""

    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        piece = [False]
        for word in pieces:
            node = 0
            for b in word:
                to = edges[node].get(b)
                if to is None:
                    to = edges[node][b] = len(edges)
                    edges.append({})
                    piece.append(False)
                node = to
            piece[node] = bool(word)
        if len(edges[0]) < 256 or not all(piece[n] for n in edges[0].values()):
            raise ValueError("a longest-match vocabulary needs all single bytes")
        n = len(edges)
        fail, pops = [0] * n, [0] * n  # popping at the root ends a walk
        level = [(0, b, to) for b, to in edges[0].items()]
        while level:
            after = []
            for parent, b, node in level:
                if piece[node]:
                    fail[node], pops[node] = 0, 1
                else:
                    z, popped = fail[parent], pops[parent]
                    while b not in edges[z]:
                        popped += pops[z]
                        z = fail[z]
                    fail[node], pops[node] = edges[z][b], popped
                after += [(node, c, to) for c, to in edges[node].items()]
            level = after
        self.edges, self.fail, self.pops = edges, fail, pops
        self.left = [0] * n  # pieces that the input's end pops
        for node in range(1, n):
            total, z = 0, node
            while z:
                total += pops[z]
                z = fail[z]
            self.left[node] = total
        self.memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node = total = 0
        for b in word:
            to = edges[node].get(b)
            while to is None:
                total += pops[node]
                node = fail[node]
                to = edges[node].get(b)
            node = to
        return total + self.left[node]

    def counts(self, words: list[bytes]) -> np.ndarray:
        memo, count = self.memo, self.count
        found = [memo.get(w) for w in words]
        new = {}
        for i, n in enumerate(found):
            if n is None:
                found[i] = new[words[i]] = count(words[i])
        if len(memo) < MEMO:
            memo.update(new)
        return np.array(found, np.int64)


def byte_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file, as bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(letters[c] for c in piece) for piece in vocabulary if all(c in letters for c in piece)]


_AUTOMATA: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(byte_pieces(path))
    return _AUTOMATA[path]


def count_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and pieces of each text."""
    raw, at = flat(texts)
    n = len(at) - 1
    points, point_at, lead = tokens.code_points(raw, at)
    start = tokens.cut(np.where(points >= tokens.KNOWN, 0x61, points), point_at)
    first = np.searchsorted(start, point_at)
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    offsets = np.append(lead[start], len(raw)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    counts = automaton(path).counts(coded.dictionary.to_pylist())
    sums = np.concatenate(([0], np.cumsum(counts[coded.indices.to_numpy(zero_copy_only=False)])))
    return np.diff(first), sums[first[1:]] - sums[first[:-1]]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): pre-tokens of each whole text, and their greedy longest-match pieces.

    `vocabulary` is a byte-level tokenizer file. Characters beyond the known scripts count as letters
    when words are cut. A null or empty text has 0 of both; a null id stays null; repeated rows
    are counted each; other columns are ignored; an empty table gives an empty one.
    """

    def run(batch):
        n_words, n_tokens = count_batch(batch.column("text"), vocabulary)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return per_slice(rows, run, f"doc_id {id_type(docs, id_col)}, n_words long, n_tokens long")
