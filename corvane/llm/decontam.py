"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: for each unit of rows it holds the unit's documents and, for each
term, the sorted positions of its tokens. A test window is searched from its rarest term (by the corpus
counts that the index gives): that term's positions, less its offset, are intersected with those of
the next rarest, until all terms of the window agree. Proximity matches ask only that an item's rarest
terms stand near each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import units as U
from corvane.llm.arrays import ALNUM, ranges, words
from corvane.llm.shared import written

#: Words of test items that one search holds (some 50 bytes each); a larger test set is searched in blocks.
BLOCK_WORDS = 1 << 20
#: Postings of rarest terms that are followed at once.
CHUNK = 1 << 20
_INDEX = "unit long, n long, first binary, terms binary, offsets binary, positions binary"


def _terms(texts: pa.Array):
    w = words(texts, ALNUM, lower=True)
    return w, w.hashes()


def build_index(rows: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """(unit, n, first, terms, offsets, positions): a positional index of each unit of `source` rows.

    `first` has the first token of each document, and the end. `terms` are sorted hashes of which
    alone tokens are to be posted; None posts all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(terms) if terms is not None else None

    def each(unit, batch):
        w, h = _terms(batch.column("text"))
        at = np.arange(len(h))
        if shared is not None:
            keep = shared.value
            found = np.searchsorted(keep, h)
            found[found == len(keep)] = 0
            hit = keep[found] == h if len(keep) else np.zeros(len(h), bool)
            at, h = at[hit], h[hit]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        begins = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1)) if len(h) else np.empty(0, np.int64)
        data = {"unit": [unit], "n": [batch.num_rows], "first": [w.first.tobytes()], "terms": [h[begins].tobytes()], "offsets": [np.append(begins, len(h)).astype(np.int64).tobytes()], "positions": [at.astype(np.uint32).tobytes()]}
        yield pa.RecordBatch.from_pydict(data, schema=pa.schema([("unit", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("first", "terms", "offsets", "positions")]))

    return U.per_unit(rows, each, _INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): tokens of each posted term in the corpus."""

    def each(batches):
        for batch in batches:
            for terms, offsets in zip(batch.column("terms").to_pylist(), batch.column("offsets").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(offsets, np.int64)))], names=["term", "n"])

    return index.select("terms", "offsets").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Searches:
    """Windows of test items, ready to be searched, in flat arrays: a window is a place in the items' stream of term codes.

    Each distinct window is held once, with the items that have it. `rank` orders a window's terms by their
    counts in the corpus and files it under its rarest one, so that a unit only touches windows (and items)
    whose rarest term it holds.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int, rare_terms: int):
        w, h = _terms(pa.array([t for _, t in items], pa.string()))
        self.terms, at, code = np.unique(h, return_index=True, return_inverse=True)
        self.names = [bytes(w.raw[a:b]) for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.rare_terms, self.codes, self.first = rare_terms, code.astype(np.int32), w.first
        n = w.counts
        each = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        start, item = ranges(w.first[:-1], each), np.repeat(np.arange(len(n)), each)
        size = np.minimum(n, window)[item]
        self.windows, self.window_items = {}, {}
        for k in np.unique(size).tolist():
            mine = np.flatnonzero(size == k)
            stream = np.ascontiguousarray(self.codes[start[mine][:, None] + np.arange(k)])
            _, kept, group = np.unique(stream.view(f"V{4 * k}").ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(np.stack((group, item[mine]), axis=1), axis=0)
            self.windows[k] = start[mine][kept]
            self.window_items[k] = (np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1)), pairs[:, 1])

    def rank(self, counts: dict[int, int]) -> None:
        """Orders terms by their counts in the corpus; of equal counts the one whose bytes come first is the rarer."""
        n = np.array([counts.get(x, 0) for x in self.terms.view(np.int64).tolist()], np.int64)
        by_name = np.empty(len(n), np.int64)
        by_name[sorted(range(len(n)), key=self.names.__getitem__)] = np.arange(len(n))
        self.place = np.empty(len(n), np.int32)
        self.place[np.lexsort((by_name, n))] = np.arange(len(n))
        self.names = None
        self.orders, self.filed = {}, {}
        for k, start in self.windows.items():
            order = np.argsort(self.place[self.codes[start[:, None] + np.arange(k)]], axis=1, kind="stable").astype(np.min_scalar_type(k))
            self.orders[k] = order
            self.filed[k] = self._filed(self.codes[start + order[:, 0]])
        rare = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            mine = np.unique(self.codes[a:b])
            mine = mine[np.argsort(self.place[mine])][: self.rare_terms]
            rare.append(np.pad(mine, (0, self.rare_terms - len(mine)), mode="edge") if len(mine) else np.full(self.rare_terms, -1))
        self.rare = np.array(rare, np.int64).reshape(-1, self.rare_terms)
        self.rare_filed = self._filed(self.rare[:, 0])

    def _filed(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the given things by their term: where each term's begin, and the numbers."""
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), order

    @staticmethod
    def _under(filed: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> np.ndarray:
        begin, numbers = filed
        return numbers[ranges(begin[terms], begin[terms + 1] - begin[terms])]

    def postings(self, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray, n_tokens: int) -> Postings:
        code = np.searchsorted(self.terms, terms)
        code[code == len(self.terms)] = 0
        known = self.terms[code] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return Postings(len(self.terms), code[known], offsets[:-1][known], np.diff(offsets)[known], positions.astype(np.int64), n_tokens)

    def phrases(self, found: Postings, first: np.ndarray):
        """(windows, first words, length) of exact matches inside one document, a limited number of postings at a time."""
        for k, start in self.windows.items():
            mine = self._under(self.filed[k], found.here)
            for i in range(1, k):  # windows of which a term is missing drop out, rarest terms first
                mine = mine[found.size[self.codes[start[mine] + self.orders[k][mine, i]]] > 0]
            rarest = self.codes[start[mine] + self.orders[k][mine, 0]] if len(mine) else np.empty(0, np.int64)
            ends = np.cumsum(found.size[rarest])
            for some in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
                window = np.repeat(mine[some], found.size[rarest[some]])
                at = found.positions[ranges(found.begin[rarest[some]], found.size[rarest[some]])] - self.orders[k][window, 0]
                inside = (at >= 0) & (at + k <= len(found.code))
                window, at = window[inside], at[inside]
                for i in range(1, k):  # the lists, less their offsets, are intersected from the rarest term on
                    offset = self.orders[k][window, i]
                    same = found.code[at + offset] == self.codes[start[window] + offset]
                    window, at = window[same], at[same]
                whole = at + k <= first[np.searchsorted(first, at, side="right")] if len(at) else np.zeros(0, bool)
                if whole.any():
                    yield window[whole], at[whole], k

    def items_of(self, k: int, windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of document and item for windows found in documents."""
        begin, items = self.window_items[k]
        n = begin[windows + 1] - begin[windows]
        pairs = np.unique(np.stack((np.repeat(docs, n), items[ranges(begin[windows], n)]), axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def near(self, found: Postings, first: np.ndarray, span: int):
        """(item, documents) where all of an item's rarest terms stand within `span` words of the rarest."""
        items = self._under(self.rare_filed, found.here)
        for k in items[(found.size[self.rare[items]] > 0).all(axis=1)].tolist():
            at = found.of(self.rare[k, 0])
            doc = np.searchsorted(first, at, side="right") - 1
            for c in np.unique(self.rare[k, 1:]).tolist():
                p = found.of(c)
                lo, hi = np.maximum(at - span, first[doc]), np.minimum(at + span, first[doc + 1] - 1)
                ok = np.searchsorted(p, lo) < np.searchsorted(p, hi, side="right")
                at, doc = at[ok], doc[ok]
            if len(at):
                yield k, np.unique(doc)


class Postings:
    """A unit's postings by the codes of test terms: where each term's positions begin and how many there are; `code`: the term at each position, or -1."""

    def __init__(self, n_terms: int, here: np.ndarray, begin: np.ndarray, size: np.ndarray, positions: np.ndarray, n_tokens: int):
        self.here, self.positions = here, positions
        self.begin, self.size = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        self.begin[here], self.size[here] = begin, size
        self.code = np.full(n_tokens, -1, np.int32)
        self.code[positions[ranges(begin, size)]] = np.repeat(here, size)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.begin[term] + self.size[term]]


_MATCHES = pa.schema([("unit", pa.int64()), ("start", pa.binary()), ("length", pa.binary()), ("docs", pa.binary()), ("items", pa.list_(pa.string())), ("near_docs", pa.binary()), ("near_items", pa.list_(pa.string()))])


def search(index: DataFrame, searches: Searches, span: int) -> DataFrame:
    """Matches of each unit that has some: places of phrase matches, documents with the items found in them, and proximity matches."""
    shared = index.sparkSession.sparkContext.broadcast(searches)

    def each(batches):
        s = shared.value
        for batch in batches:
            for unit, *data in zip(*[batch.column(c).to_pylist() for c in ("unit", "first", "terms", "offsets", "positions")]):
                first, terms, offsets, positions = (np.frombuffer(x, t) for x, t in zip(data, (np.int64, np.uint64, np.int64, np.uint32)))
                here = s.postings(terms, offsets, positions, int(first[-1]))
                start, length, pairs = [], [], set()
                for windows, at, n in s.phrases(here, first):
                    start.append(at)
                    length.append(np.full(len(at), n))
                    docs, items = s.items_of(n, windows, np.searchsorted(first, at, side="right") - 1)
                    pairs |= {(d, s.ids[i]) for d, i in zip(docs.tolist(), items.tolist())}
                near = [(d, s.ids[k]) for k, docs in s.near(here, first, span) for d in docs.tolist()]
                if start or near:
                    pairs = list(pairs)
                    join = lambda x: np.concatenate(x).astype(np.int64).tobytes() if x else b""
                    yield pa.RecordBatch.from_pylist(
                        [{"unit": unit, "start": join(start), "length": join(length), "docs": np.array([d for d, _ in pairs], np.int64).tobytes(), "items": [i for _, i in pairs], "near_docs": np.array([d for d, _ in near], np.int64).tobytes(), "near_items": [i for _, i in near]}],
                        schema=_MATCHES,
                    )

    return index.select("unit", "first", "terms", "offsets", "positions").mapInArrow(each, "unit long, start binary, length binary, docs binary, items array<string>, near_docs binary, near_items array<string>")


def _item_blocks(items: DataFrame, id_col: str, text_col: str):
    """The test items in lists of at most BLOCK_WORDS words, as counted by half their characters (or one item)."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        n = (len(row.t or "") + 1) // 2
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += n
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_share: float = 0.05,
    rare_terms: int = 4,
    span: int = 20,
    with_text: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What of a benchmark stands in each document: one row for each row of `docs`, a stored table.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A window is
    `window` consecutive words of an item, or a shorter item whole. Returns doc_id, n_words, n_hit (words
    in an occurring window), n_items (items of which one occurs), items_sha256 (their ids as strings,
    sorted, joined by commas), contaminated (n_hit > 0 and n_hit / n_words >= min_share), n_near (items
    whose `rare_terms` rarest terms, by their counts in `docs`, stand within `span` words of the rarest;
    of equal counts the first by bytes), near_items (their ids as strings, sorted, joined by commas) and, if `with_text`, `kept`: the text
    without the hit words. The `carry` columns follow as they are.

    Null and empty texts have no words and no hits; items without words match nothing; items with a null
    id mark words but aren't listed; repeated rows appear each; other columns are ignored; an empty
    benchmark leaves all documents clean, and an empty `docs` gives an empty table.
    """
    rows = U.source(docs, id_col, text_col, carry)
    kind = U.doc_type(rows)
    found = None
    shape = None
    for block in _item_blocks(benchmark, item_col, item_text_col):
        searches = Searches(block, window, rare_terms)
        index = written(build_index(rows, searches.terms), "postings")
        searches.rank({r.term: r.n for r in term_counts(index).toLocalIterator()})
        matches = search(index, searches, span)
        shape = index.select("unit", "n", "first") if shape is None else shape
        found = matches if found is None else found.union(matches)
    if shape is None:
        shape = build_index(rows, np.empty(0, np.uint64)).select("unit", "n", "first")
        found = rows.sparkSession.createDataFrame([], "unit long, start binary, length binary, docs binary, items array<string>, near_docs binary, near_items array<string>")
    matches = found.groupBy("unit").agg(F.collect_list(F.struct("start", "length", "docs", "items", "near_docs", "near_items")).alias("matches"))
    units = U.packed(rows) if with_text else _ids_only(rows, carry)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "near_items", *["kept"] * with_text]
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, near_items string" + ", kept string" * with_text + U.carried(docs, carry, names)
    names += carry

    def judge(batches):
        for some in batches:
            for blob, raw_first, mine in zip(*[some.column(c).to_pylist() for c in ("blob", "first", "matches")]):
                batch, first = U.thaw(blob), np.frombuffer(raw_first, np.int64)
                cover = np.zeros(int(first[-1]) + 1, np.int32)
                items: dict[int, set] = {}
                near: dict[int, set] = {}
                for m in mine or []:
                    at, n = np.frombuffer(m["start"], np.int64), np.frombuffer(m["length"], np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n, -1)
                    for to, d, i in ((items, m["docs"], m["items"]), (near, m["near_docs"], m["near_items"])):
                        for doc, item in zip(np.frombuffer(d, np.int64).tolist(), i):
                            to.setdefault(doc, set()).add(item)
                hit = np.cumsum(cover)[:-1] > 0
                sums = np.concatenate(([0], np.cumsum(hit)))[first]
                n_words, n_hit = np.diff(first), np.diff(sums)
                listed, close = ([sorted(x for x in of.get(d, ()) if x is not None) for d in range(batch.num_rows)] for of in (items, near))
                columns = [
                    batch.column("doc_id"), pa.array(n_words), pa.array(n_hit),
                    pa.array([len(x) for x in listed], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()),
                    pa.array((n_hit > 0) & (n_hit >= min_share * n_words - 1e-9)),
                    pa.array([len(x) for x in close], pa.int64()),
                    pa.array([",".join(x) for x in close], pa.string()),
                ]
                if with_text:
                    columns.append(_without(batch.column("text"), hit, n_hit))
                columns += U.carry_of(batch, carry)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = units.join(shape.select("unit", "first"), "unit").join(matches, "unit", "left")
    return joined.select("blob", "first", "matches").mapInArrow(judge, schema)


def _ids_only(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Packed units without their texts."""

    def run(unit, batch):
        yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([U.freeze(batch.select(["doc_id", *U.carry_names(carry)]))], pa.binary())], names=["unit", "blob"])

    return U.per_unit(rows, run, "unit long, blob binary")


def _without(texts: pa.Array, hit: np.ndarray, n_hit: np.ndarray) -> pa.Array:
    """Texts without their hit words; the rest stays as it is."""
    out = texts.to_pylist()
    if n_hit.any():
        w = words(texts, ALNUM, lower=True)
        sizes = [len((t or "").encode()) for t in out]
        base = np.concatenate(([0], np.cumsum(sizes)))
        for d in np.flatnonzero(n_hit).tolist():
            raw, parts, at = out[d].encode(), [], 0
            for k in (w.first[d] + np.flatnonzero(hit[w.first[d] : w.first[d + 1]])).tolist():
                parts.append(raw[at : w.start[k] - base[d]])
                at = w.end[k] - base[d]
            out[d] = b"".join([*parts, raw[at:]]).decode()
    return pa.array(out, pa.string())
