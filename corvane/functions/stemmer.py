"""The English (Porter2) stemming algorithm, as published, and its column functions."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", None), ("li", None),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _after(word: str, start: int) -> int:
    """Place after the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _V and word[i - 1] in _V:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a word; upper-case letters count as they are, so lower-case first."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word[1:] if word[0] == "'" else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    # 0
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w.lower()
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _V for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: -len(s)] + to
            break
    # 3
    for s, to in _STEP3:
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Words that are stemmed at a time.
WORDS = 1 << 18


def _stems(words: pa.Array) -> pa.Array:
    """Stems of words, each distinct one of a piece made once; no word becomes a Python object by itself."""
    out = []
    for i in range(0, len(words), WORDS):
        found = words.slice(i, WORDS).dictionary_encode()
        out.append(pa.array([stem(w) for w in found.dictionary.to_pylist()], pa.string()).take(found.indices))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _stem_lists(lists: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    made = pa.ListArray.from_arrays(offsets, _stems(lists.flatten()), mask=lists.is_null())
    pa.default_memory_pool().release_unused()
    return made


def stem_token(token) -> Column:
    """Column: the stem of a word."""
    return F.arrow_udf(_stems, "string")(token)


def stem_token_arr(tokens) -> Column:
    """Column: the stems of an array of words."""
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)
