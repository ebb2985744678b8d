"""License scans over a positional rare-token index.

Templates of notices are indexed by their rarest words: which template has the word, and where. A first pass
counts the documents that hold each template word, over the whole corpus. Of a template of n words as many
of highest inverse document frequency are posted as can't all be missing from a notice that has the asked share of
the n in place: (1 - share) * n of them, and one. A file is looked up by those of its words that are posted: each place
proposes alignments with templates, by relative position, and each alignment is verified: a mandatory phrase of the
template must stand, word for word, where the alignment puts it, and the share of the template's words must be in place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrays import ALNUM, ranges, words
from corvane.llm.shared import id_type, per_slice

#: Phrases whose every place counts.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, notice, mandatory phrases of it (one of them must stand at its place).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc by nc sa"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    ("proprietary", "copyright all rights reserved no part of this work may be reproduced", ["all rights reserved"]),
]


@dataclass
class Index:
    """Templates as word codes, with each code's postings in templates' rarest words."""

    codes: np.ndarray  # sorted hashes of all words
    templates: list[np.ndarray]
    labels: list[str]
    rare: list[np.ndarray]  # places of each template's rarest words
    phrases: list[list[tuple[int, int]]]  # first place and length
    base: list[tuple[str, np.ndarray]]
    post_first: np.ndarray  # postings of each code: template, place
    post: np.ndarray


def _codes(texts: list[str]) -> list[np.ndarray]:
    w = words(pa.array(texts, pa.string()), ALNUM, lower=True)
    return np.split(w.hashes(), w.first[1:-1])


def make_index(templates=TEMPLATES, base=None, frequency: dict[int, int] | None = None, n_docs: int = 1, share: float = 0.7) -> Index:
    """`frequency`: documents, of `n_docs`, that hold each word (by its hash). A template's words of highest IDF are indexed."""
    base = BASE if base is None else base
    texts, phrases = _codes([t for _, t, _ in templates]), [_codes(p) for _, _, p in templates]
    base_codes = list(zip(base.values(), _codes(list(base)))) if base else []
    all_codes = np.unique(np.concatenate([*texts, *[c for _, c in base_codes]]))
    idf = np.array([math.log((n_docs + 1) / ((frequency or {}).get(int(c), 0) + 1)) for c in all_codes.view(np.int64)])
    coded = [np.searchsorted(all_codes, t) for t in texts]
    places, rare = [], []
    for t, parts in zip(coded, phrases):
        found = []
        for p in parts:
            p = np.searchsorted(all_codes, p)
            at = [i for i in range(len(t) - len(p) + 1) if (t[i : i + len(p)] == p).all()]
            if not at:
                raise ValueError("a mandatory phrase isn't part of its template")
            found.append((at[0], len(p)))
        places.append(found)
        rare.append(np.sort(np.argsort(-idf[t], kind="stable")[: len(t) - math.ceil(share * len(t) - 1e-9) + 1]))
    pairs = sorted((int(t[i]), k, int(i)) for k, (t, r) in enumerate(zip(coded, rare)) for i in r)
    post = np.array([(k, i) for _, k, i in pairs], np.int64).reshape(-1, 2)
    first = np.searchsorted([c for c, _, _ in pairs], np.arange(len(all_codes) + 1))
    return Index(all_codes, coded, [x for x, _, _ in templates], rare, places, [(x, np.searchsorted(all_codes, c)) for x, c in base_codes], first, post)


def template_words(templates=TEMPLATES, base=None) -> np.ndarray:
    return make_index(templates, base).codes


def _code_of(codes: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(codes, h)
    at[at == len(codes)] = 0
    return np.where(codes[at] == h, at, -1)


def word_frequency(docs: DataFrame, codes: np.ndarray) -> DataFrame:
    """(word, n): documents of (text) that hold each of some words, by hash."""
    from corvane.llm.arrays import owner

    def run(batch):
        w = words(batch.column("text"), ALNUM, lower=True)
        code = _code_of(codes, w.hashes())
        hit = np.flatnonzero(code >= 0)
        pairs = np.unique(owner(w.first)[hit] * len(codes) + code[hit])
        n = np.bincount(pairs % len(codes), minlength=len(codes))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(codes[some].view(np.int64)), pa.array(n[some])], names=["word", "n"])

    return per_slice(docs, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scan(texts: pa.Array, index: Index, share: float) -> dict[str, list]:
    w = words(texts, ALNUM, lower=True)
    code = _code_of(index.codes, w.hashes())
    padded = np.concatenate((code, np.full(64, -2)))
    n = len(w.first) - 1

    def doc_of(at):
        return np.searchsorted(w.first, at, side="right") - 1

    n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
    base_labels: list[set] = [set() for _ in range(n)]
    labels: list[set] = [set() for _ in range(n)]
    score = np.zeros(n)
    for label, phrase in index.base:
        at = np.flatnonzero(code == phrase[0])
        for i, c in enumerate(phrase.tolist()[1:], 1):
            at = at[padded[at + i] == c]
        d = doc_of(at)
        inside = at + len(phrase) <= w.first[d + 1] if len(at) else np.zeros(0, bool)
        at, d = at[inside], d[inside]
        np.add.at(n_base, d, 1)
        begin = at - w.first[d]
        for x, p in zip(d.tolist(), begin.tolist()):
            base_labels[x].add(label)
            labels[x].add(label)
            score[x] = max(score[x], 0.5)
            first[x] = p if first[x] < 0 else min(first[x], p)
            last[x] = max(last[x], p)
    hit = np.flatnonzero(code >= 0)
    each = (index.post_first[1:] - index.post_first[:-1])[code[hit]]
    posts = index.post[ranges(index.post_first[code[hit]], each)]
    at = np.repeat(hit, each)
    if len(at):
        found = np.unique(np.stack((posts[:, 0], at - posts[:, 1], doc_of(at)), axis=1), axis=0)
        for mine in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            t, k = index.templates[mine[0, 0]], mine[0, 0]
            for some in np.array_split(mine, len(mine) // 65536 + 1):
                place, lo, hi = some[:, 1:2] + np.arange(len(t)), w.first[some[:, 2]][:, None], w.first[some[:, 2] + 1][:, None]
                same = (place >= lo) & (place < hi) & (padded[np.clip(place, 0, len(code))] == t)
                share_of = same.mean(axis=1)
                good = (share_of >= share - 1e-9) & np.any([same[:, i : i + m].all(axis=1) for i, m in index.phrases[k]], axis=0)
                for d, x in zip(some[good, 2].tolist(), share_of[good].tolist()):
                    labels[d].add(index.labels[k])
                    score[d] = max(score[d], x)
    return {"n_words": w.counts.astype(np.int64), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": [",".join(sorted(x)) for x in base_labels], "labels": [",".join(sorted(x)) for x in labels], "score": score}


def license_scan(docs: DataFrame, templates=TEMPLATES, base=None, share: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in each document.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (least and
    largest start of one, in words from 0; null without any), base_labels, labels (these and the labels of
    templates of which at least `share` of the words stand in place, a mandatory phrase among them), and
    score (the largest such share; 0.5 for a base phrase alone; 0 for none). Labels are distinct, sorted
    and joined by commas.

    A null or empty text has no words and no labels; null ids stay null; repeated rows appear each; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    codes = template_words(templates, base)
    frequency = {r.word: r.n for r in word_frequency(rows.select("text"), codes).toLocalIterator()}  # a row for each template word
    index = make_index(templates, base, frequency, rows.count(), share)

    def run(batch):
        out = scan(batch.column("text"), index, share)
        columns = [batch.column("doc_id")]
        for name, values in out.items():
            mask = values < 0 if name in ("first_word", "last_word") else None
            columns.append(pa.array(values, mask=mask))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out])

    return per_slice(rows, run, f"doc_id {id_type(docs, id_col)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
