"""Training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from corvane.llm import arrays, decontam, html_text, id_store, license_scan, line_dedup, packing, quality, queries, simhash, substring_dedup, token_counts, tokens

PATH = queries.tokenizer_path()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    vocabulary = ["tion", "the", "of", "Éta", "über", "x1", "a-b", "don't", "naïve", "中文", "R2", "le"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    passage, line = prose(60), "Shared Line of text "
    rows = [(i, prose(rng.randrange(1, 120))) for i in range(40)]
    rows += [(100 + i, prose(30) + "\n" + line.upper() + "\n" + passage + " " + prose(5)) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, prose(20000)), (204, passage + " " + passage), (205, passage), (206, passage)]
    rows += [(None, passage), (None, None), (205, passage), (205, prose(40)), (207, "x" * 50000), (208, "Released under the MIT License.\r\nMIT license"), (209, "Licensed under CC BY-NC 4.0. <|endoftext|>")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The rows, with columns whose names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "docs.parquet")
    rows = [(i, t, ["en", None, "fr"][k % 3], "s", len(t or ""), 1, "kept?", 2.0) for k, (i, t) in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, kept string, score double")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


def rows_of(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def library_ids(text):
    return tokens.encoder(PATH).library.encode(text or "", add_special_tokens=False).ids


def multiset(rows):
    return collections.Counter(rows)


def test_words_and_hashes():
    t = pa.array(["", None, " a  b\n", "é1 ü", "x"])
    w = arrays.words(t)
    assert w.counts.tolist() == [0, 0, 2, 2, 1]
    assert [bytes(b) for b in w.array().to_pylist()] == [b"a", b"b", "é1".encode(), "ü".encode(), b"x"]
    h = arrays.words(pa.array(["ab ba ab a aa aaa"])).hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 5


def test_encoder_matches_library():
    rng = random.Random(5)
    letters = list("ab's tdrevml   \n\t19.,!?-''’é ñ²½ߐא中 \u0085​́DM")
    sample = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "<|endoftext|>"]
    ids, counts = tokens.encoder(PATH).encode(pa.array(sample))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library_ids(x) for x in sample]


def greedy(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in vocabulary)
        n += 1
    return n


def test_token_counts(table, empty):
    got = token_counts.token_counts(table, PATH).collect()
    vocabulary = set(token_counts.byte_pieces(PATH))
    longest = max(map(len, vocabulary))
    expected = []
    for i, t in rows_of(table):
        points = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
        start = tokens.cut(np.where(points >= tokens.KNOWN, 0x61, points), np.array([0, len(points)])).tolist()
        words = [(t or "")[a:b].encode() for a, b in zip(start, [*start[1:], len(points)])]
        expected.append((i, len(words), sum(greedy(w, vocabulary, longest) for w in words)))
    assert multiset((r.doc_id, r.n_words, r.n_tokens) for r in got) == multiset(expected)
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_longest_match_needs_failure_links():
    m = token_counts.LongestMatch([bytes([i]) for i in range(256)] + [b"abcd", b"bc", b"cdef", b"ab"])
    for word in (b"", b"abc", b"abcd", b"abcdef", b"bcdef", b"xabcab", b"abab"):
        assert m.count(word) == greedy(word, {bytes([i]) for i in range(256)} | {b"abcd", b"bc", b"cdef", b"ab"}, 4)


def test_packing(table, empty):
    out = packing.pack(table, queries.byte_bpe(PATH), 64, slots=4, waste=4).toPandas()
    expected = multiset((i, tuple([*library_ids(t), 0])) for i, t in rows_of(table))
    ids = {}
    for r in out.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 64
    # rows with distinct ids come back whole
    counts = collections.Counter(i for i, _ in rows_of(table))
    for i, g in out.groupby("doc_id"):
        if counts[i] == 1:
            g = g.sort_values("start")
            assert (g.start.to_numpy() == np.cumsum(g.length) - g.length).all()
            ids[i] = tuple(np.frombuffer(b"".join(g.ids), np.uint32).tolist())
            assert (i, ids[i]) in expected and set(g.doc_tokens) == {len(ids[i])}
    assert out.length.sum() == sum(len(x) * n for (_, x), n in expected.items())
    assert out.doc_id.isna().sum() >= 2
    assert out.groupby("sequence_id").length.sum().mean() > 60
    assert packing.pack(empty, queries.byte_bpe(PATH)).count() == 0


def test_packing_merges_in_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    path = str(tmp_path / "d.parquet")
    spark.range(300).selectExpr("id AS doc_id", "repeat('word ', 5 + cast(id % 40 AS int)) AS text").repartition(7).write.parquet(path)
    out = packing.pack(spark.read.parquet(path), queries.byte_bpe(PATH), 64, slots=3).toPandas()
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 64 and (used < 48).sum() <= 3


def test_id_store(spark, table, empty, tmp_path):
    path = str(tmp_path / "store")
    id_store.write_store(table, path, queries.byte_bpe(PATH))
    got = id_store.read_documents(spark, path).toPandas()
    docs = [(i, [*library_ids(t), 0]) for i, t in rows_of(table)]
    assert multiset((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()) == multiset((i, len(x), zlib.crc32(np.array(x, np.uint32).tobytes())) for i, x in docs)
    got = got.sort_values("start")
    assert (got.start.to_numpy() == np.cumsum(got.n_tokens) - got.n_tokens).all()
    known = got.doc_id.dropna()
    assert known.is_monotonic_increasing and got.doc_id.isna().to_numpy()[: got.doc_id.isna().sum()].all()
    assert len(id_store.verify(spark, path)) == 32
    data = spark.read.parquet(f"{path}/data").filter("kind = 'chunk'")
    assert data.count() == data.select("hash").distinct().count()
    other = str(tmp_path / "none")
    id_store.write_store(empty, other, queries.byte_bpe(PATH))
    assert id_store.read_documents(spark, other).count() == 0


def test_crc_shift():
    rng = np.random.default_rng(1)
    a, b = rng.bytes(1000), rng.bytes(777)
    assert int(id_store.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([777]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_license_scan(table, empty):
    got = license_scan.license_scan(table).collect()
    expected = []
    for i, t in rows_of(table):
        w = re.findall(ALNUM, (t or "").translate(LOW))
        at = sorted(k for p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({label for p, label in license_scan.BASE.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))})
        expected.append((i, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(labels)))
    assert multiset(tuple(r[:6]) for r in got) == multiset(expected)
    assert {r.labels for r in got if r.doc_id == 209} == {"cc-by-nc"} and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.license_scan(empty).count() == 0


def test_license_labels_short_reserved_notice():
    lines = ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    out = license_scan.scan(pa.array(["some words. " + x + " and more" for x in lines]), license_scan.make_index(), 0.7)
    assert out["labels"] == ["cc-by-nc", "proprietary", "mit", "gpl"]


def test_license_labels_with_any_words_altered():
    """A notice with a mandatory phrase and the share of the words in place is found, whichever words are altered."""
    label, notice, phrases = next(t for t in license_scan.TEMPLATES if t[0] == "isc")
    words, rng = notice.split(), random.Random(1)
    at = next(i for i in range(len(words)) if words[i : i + len(phrases[0].split())] == phrases[0].split())
    free = [i for i in range(len(words)) if not at <= i < at + len(phrases[0].split())]
    most = len(words) - int(np.ceil(0.7 * len(words) - 1e-9))
    texts, expected = [], []
    for n in range(len(free) + 1):
        for _ in range(20):
            w = list(words)
            for i in rng.sample(free, n):
                w[i] = f"other{i}"
            texts.append(f"before {' '.join(w)} after")
            expected.append(label if n <= most else "")
    got = license_scan.scan(pa.array(texts), license_scan.make_index(share=0.7), 0.7)
    assert got["labels"] == expected


def brute_substrings(docs, width):
    """docs in order; (n_words, n_removed, kept) of each."""
    seen, out = set(), []
    for t in docs:
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                cover[k : k + width] = [True] * width
            seen.add(key)
        out.append((len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c)))
    return out


def test_substring_dedup(table, empty):
    docs = rows_of(table)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    found = brute_substrings([docs[k][1] for k in order], 20)
    expected = multiset((docs[k][0], n, m, hashlib.sha256(x).hexdigest(), x.decode()) for k, (n, m, x) in zip(order, found))
    got = substring_dedup.substring_dedup(table)
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()) == expected
    assert sum(m for _, m, _ in found) > 500
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("width", [2, 3, 7])
def test_substring_dedup_widths(spark, tmp_path, width):
    rng = random.Random(width)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(30)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(path)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substring_dedup.substring_dedup(spark.read.parquet(path), width).collect()}
    assert [got[i] for i, _ in docs] == brute_substrings([t for _, t in docs], width)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup_in_batches(table, batches):
    docs = rows_of(table)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    found = brute_substrings([docs[k][1] for k in order], 20)
    got = substring_dedup.substring_dedup(table, batches=batches).collect()
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in got) == multiset((docs[k][0], *x) for k, x in zip(order, found))


def test_substring_dedup_wants_integer_ids(spark):
    with pytest.raises(ValueError, match="integer"):
        substring_dedup.substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprint_index(spark, tmp_path, monkeypatch):
    """Batches, some empty, repeated or with nulls, on an index that is opened anew each time, compacted in between and after interruptions."""
    rng = random.Random(9)
    prose = lambda n: " ".join(str(rng.randrange(500)) for _ in range(n))
    passage = prose(50)
    batches = [[(10 * b + i, prose(30) + " " + (passage if i % 2 else prose(40))) for i in range(5)] for b in range(3)]
    batches += [[], batches[1], [(3, None), (4, ""), (5, passage)]]
    expected = brute_substrings([t for b in batches for _, t in b], 20)
    got, home = [], str(tmp_path / "index")
    for k, b in enumerate(batches):
        path = str(tmp_path / f"b{k}.parquet")
        spark.createDataFrame(b, "doc_id long, text string").write.parquet(path)
        index = substring_dedup.FingerprintIndex(spark, home, 20)
        if k == 1:  # what an interrupted add leaves behind
            spark.range(3).write.parquet(f"{home}/units/1")
        if k == 4:
            monkeypatch.setattr(substring_dedup.U, "SHARD_BYTES", 100)  # more shards than the runs have
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in index.add(spark.read.parquet(path)).collect()}
        got += [found[i] for i, _ in b]
        if k == 2:
            with monkeypatch.context() as m:  # stopped before the old runs are deleted
                m.setattr(substring_dedup, "drop_path", lambda *a: None)
                index.compact()
            assert len(substring_dedup.FingerprintIndex(spark, home, 20).runs()) == 1
    assert got == expected
    index.compact()
    (run,) = index.runs()
    assert run[:2] == (0, 5)
    for row in index._read(run, run[3]).collect():
        anchors = np.frombuffer(row.anchors, np.uint64)
        assert (anchors[1:] >= anchors[:-1]).all() and (anchors % np.uint64(run[3]) == row.shard).all()


PAGE = """<html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=1>Menu</a></ul></nav>
<div class="ad">Buy now this wonderful thing that everybody needs so very much indeed today.</div><article><h1>Head &amp; line</h1>
<p><b>First&nbsp;  paragraph<br>goes on for quite a while with many words in it.<p>Second one, also rather long so that it counts as text.</p><p>Short.</p>
<form>Your name <input></form><div class="comments"><p>I like it a lot, thanks for writing this article!</p></div></article><footer>&copy; someone</footer></body></html>"""


def test_html_text(spark, tmp_path):
    expected = "Head & line\n\nFirst paragraph goes on for quite a while with many words in it.\n\nSecond one, also rather long so that it counts as text.\n\nShort."
    assert html_text.main_text(PAGE) == expected
    path = str(tmp_path / "p.parquet")
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>plain text of a page, long enough"), (5, "u", "<nav>menu</nav>"), (6, "u", "<div" * 3000 + "x" * 100000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    got = html_text.extract(spark.read.parquet(path)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got if r.page_id != 6) == sorted([(1, expected, len(expected))] * 2 + [(2, "", 0), (3, "", 0), (0, "plain text of a page, long enough", 33), (5, "", 0)])
    assert html_text.extract(spark.read.parquet(path).filter("false")).count() == 0


def test_html_names_of_layouts():
    text = "A paragraph that is long enough to be the text of a page."
    for before, after in (('<div class="has-sidebar main">', "</div>"), ('<div class="sidebar-layout"><article>', "</article></div>"), ("<main>", "</main>")):
        assert html_text.main_text(f'<body>{before}<p>{text}</p><div class="post-comments"><p>me too</p></div>{after}<aside>more</aside></body>') == text


LONG = "A paragraph that is long enough to be the text of a page, with some more words in it."


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<article><h1>T</h1><p>{}</p><article class="comment"><p>me too, I like it very much</p></article></article>', ["T", LONG]),
        ('<article><p>{}</p><section class="comments"><article><p>me too, I like it very much</p></article></section></article>', [LONG]),
        ('<main><p>{}</p><div id="comments"><article><p>me too, I like it very much</p></article></div></main>', [LONG]),
        ('<article><p>{}</p><ol class="comment-list"><li><article><p>me too</p></article></li></ol><div class="post-comments-area">x</div></article>', [LONG]),
        ('<form action="/x"><nav>menu</nav><h1>T</h1><p>{}</p><input name="q"></form>', ["T", LONG]),
        ('<form action="/x"><div><p>{0}</p><p>{0}</p><p>{0}</p></div></form>', [LONG] * 3),
        ('<article><p>{}</p><form><p>Your name</p><input></form></article>', [LONG]),
        ('<article><p>{0}</p><div class="discussion"><p>{0}</p></div><div class="legal-note"><p>{0}</p></div><section class="related-work"><p>{0}</p></section></article>', [LONG] * 4),
        ('<article><p>{}</p><div class="related-posts"><a href="/a">Other</a></div><div class="share-buttons">Share</div><div id="cookie-banner">We use cookies</div></article>', [LONG]),
        ('<h1>Title</h1><div class="content"><p>{0}</p><p>{0}</p></div>', ["Title", LONG, LONG]),
        ('<div id="nav"><a href="/">Home</a> <a href="/b">News</a></div><div class="post"><section><h2>One</h2><p>{0}</p><p>{0}</p><p>{0}</p></section><section><h2>Two</h2><p>{0}</p></section></div><div><a href="/1">a</a> <a href="/2">b</a></div>', ["One", LONG, LONG, LONG, "Two", LONG]),
        ('<div id="page-wrapper"><div class="sidebar"><p>{0}</p></div><div class="col-main"><p>{0}</p><p>{0}</p></div></div>', [LONG, LONG]),
    ],
)
def test_html_layouts(page, expected):
    assert html_text.main_text(f"<html><body>{page.format(LONG)}<footer>end</footer></body></html>") == "\n\n".join(expected)


def test_html_article_regions(spark, sf):
    """Synthetic pages: the text of the article, block by block."""
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"</?[a-zA-Z][^>]*>", "", re.sub(r"<br\s*/?>", " ", re.sub(r"<!--.*?-->", "", b, flags=re.S))) for b in re.split(r"</?(?:p|h1)>", article)]
        assert html_text.main_text(r.html) == "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_quality(table, empty):
    got = quality.quality(table).collect()
    expected = []
    for i, t in rows_of(table):
        t = t or ""
        w = re.findall(SPACE, t)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), failed))
    assert multiset(tuple(r[:7]) for r in got) == multiset(expected)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(empty).count() == 0


def test_quality_model_is_a_distribution():
    raw, at = arrays.flat(pa.array(["abracadabra arcane banana", "cabana nada", ""]))
    keys, counts = quality._counted(quality.ngram_keys(raw, at), raw)
    scorer = quality.Scorer(quality.fit(keys, counts))
    for before in (b"ab", b"na", b"zz", b"a\0", b"\0\0", b"qa"):
        key = np.arange(256) + (before[0] << 16) + (before[1] << 8)
        assert abs(scorer.of(key).sum() - 1) < 1e-9


def test_quality_model_is_sorted_by_hashes():
    """Each order is an array of 64-bit hashes in ascending order, without collisions between n-grams or orders."""
    raw, at = arrays.flat(pa.array(["abracadabra arcane banana", "cabana nada", "é"]))
    keys, counts = quality._counted(quality.ngram_keys(raw, at), raw)
    model = quality.fit(keys, counts)
    for name, order in (("one", 1), ("two", 2), ("three", 3)):
        grams = np.unique(keys & ((1 << 8 * order) - 1))
        assert model[name].dtype == np.uint64 and (model[name][1:] > model[name][:-1]).all()
        assert set(model[name].tolist()) == set(quality.hashed(grams, order).tolist()) and len(model[name]) == len(grams)
        assert len(quality.hashed(np.arange(1 << 16), order)) == len(np.unique(quality.hashed(np.arange(1 << 16), order)))
    assert not set(model["one"].tolist()) & set(model["two"].tolist()) | set(model["two"].tolist()) & set(model["three"].tolist())


def brute_scores(docs):
    """Mean negative log-probability a byte by a modified Kneser-Ney model of order 3 for each language, from its definition."""
    counts = {}
    grams = lambda t: [tuple([0, 0, *t][i : i + 3]) for i in range(len(t))]
    for t, lang in docs:
        counts.setdefault(lang, collections.Counter()).update(grams((t or "").translate(LOW).encode()))

    def discounts(c):
        n = [sum(1 for v in c.values() if v == k) for k in range(5)]
        if not n[1] or not n[2]:
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        last = 3 - 4 * y * n[4] / n[3] if n[3] else 2 - 3 * y * n[3] / n[2]
        return [0, *(min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n[2] / n[1], 0.95), (2 - 3 * y * n[3] / n[2], 1.95), (last, 2.95)))]

    def model(three):
        levels = [three]
        for _ in range(2):  # continuation counts
            levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
        d = [discounts(c) for c in levels]

        def p(gram):
            if not gram:
                return 1 / 256
            c, mine = levels[len(gram) - 1], d[len(gram) - 1]
            followers = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
            if not followers:
                return p(gram[1:])
            total = sum(followers.values())
            n = followers.get(gram, 0)
            return (n - mine[min(n, 3)]) / total + sum(mine[min(x, 3)] for x in followers.values()) / total * p(gram[1:])

        return p

    models, out = {lang: model(c) for lang, c in counts.items()}, []
    for t, lang in docs:
        g = grams((t or "").translate(LOW).encode())
        out.append(-sum(np.log(models[lang](x)) for x in g) / len(g) if g else None)
    return out


def test_quality_scores(spark, tmp_path, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join("".join(rng.choice("aAbcé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(12))), "xy"[i % 2]) for i in range(20)] + [(50, None, "x"), (51, "Ω", "z")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    expected = brute_scores([(t, x) for _, t, x in rows])
    for limit in (quality.BROADCAST, 1):
        monkeypatch.setattr(quality, "BROADCAST", limit)
        got = {r.doc_id: r.score for r in quality.quality(spark.read.parquet(path)).collect()}
        for (i, _, _), e in zip(rows, expected):
            assert got[i] is None if e is None else abs(got[i] - e) < 1e-5


def test_quality_rejects_noise_and_splits_languages(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice(["ta", "re", "lo"]) for _ in range(3)) + str(k) for k in range(80))
    noise = " ".join("".join(chr(rng.randrange(33, 1200)) for _ in range(9)) for _ in range(80))
    rows = [(i, prose(), "a" if i % 2 else "b") for i in range(60)] + [(99, noise, "a")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    one = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert one.pop(99) is False and all(one.values())
    monkeypatch.setattr(quality, "BROADCAST", 1)  # a pass for each language
    assert {r.doc_id: r.kept for r in quality.quality(docs).collect()} == one | {99: False}


def test_quality_bands_reject_symbol_noise_and_keep_mixed_languages(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    syllables = {"a": "ta re lo mi san ter in".split(), "b": "ku pro ne wix zo gu ba".split()}
    word = lambda x: "".join(rng.choice(syllables[x]) for _ in range(rng.randrange(1, 4)))
    prose = lambda x, n: " ".join(word(x) for _ in range(n))
    rows = [(i, prose("ab"[i % 2], rng.randrange(100, 300)), "ab"[i % 2]) for i in range(300)]
    rows += [(1000 + i, " ".join(word("a") + rng.choice(["%%%", "***", "###"]) for _ in range(150)), "a") for i in range(12)]
    rows += [(2000 + i, prose("ab"[i % 2], 100) + ". " + prose("ba"[i % 2], 100), "a") for i in range(6)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    one = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not any(one[1000 + i] for i in range(12)) and all(one[2000 + i] for i in range(6))
    assert sum(one[i] for i in range(300)) >= 294
    monkeypatch.setattr(quality, "BROADCAST", 1)  # a pass for each language
    assert {r.doc_id: r.kept for r in quality.quality(docs).collect()} == one


def test_line_dedup(table, empty):
    for min_docs in (2, 10):
        docs = rows_of(table)
        key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOW)
        c = collections.Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")})
        expected = []
        for i, t in docs:
            lines = (t or "").split("\n")
            kept = "\n".join(x for x in lines if not (key(x) and c[key(x)] >= min_docs))
            dropped = sum(bool(key(x)) and c[key(x)] >= min_docs for x in lines)
            expected.append((i, len(lines), dropped, hashlib.sha256(kept.encode()).hexdigest(), kept))
        got = line_dedup.line_dedup(table, min_docs).collect()
        assert multiset((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in got) == multiset(expected)
        assert sum(e[2] for e in expected) >= 12
    assert line_dedup.line_dedup(empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    h = line_dedup.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.PerfectHash(np.empty(0, np.uint64)).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_line_index_with_keys_that_no_slot_parts():
    """Keys whose 64-bit mixes are equal end up in the index's rest."""
    with_twins = np.array([5, 7, 5, 9, 7], np.uint64)
    h = line_dedup.PerfectHash(with_twins)
    assert sorted(set(h.left.tolist())) == [5, 7] and h.slots(np.array([9], np.uint64)).tolist() == [0]


def test_line_dedup_without_slots(table, monkeypatch):
    expected = multiset((r.doc_id, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup(table, 2, with_text=False).collect())
    monkeypatch.setattr(line_dedup.PerfectHash, "LEVELS", 1)  # all keys that meet another one at once
    assert multiset((r.doc_id, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup(table, 2, with_text=False).collect()) == expected


def test_carried_columns_with_clashing_names(table, items):
    for out in (line_dedup.line_dedup(table, with_text=False, carry=("_row", "lang")), decontam.decontaminate(table, items, with_text=False, carry=("_row", "lang"))):
        assert {r._row for r in out.collect()} == {1} and out.columns[-2:] == ["_row", "lang"]
    with pytest.raises(ValueError, match="kept"):
        line_dedup.line_dedup(table, carry=("kept",))


def brute_fingerprint(t, size=3):
    w = (t or "").translate(LOW).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(table, empty):
    docs = rows_of(table)
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(prints, 3)
    least = {}
    for (i, _), r in zip(docs, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = multiset((i, format(p, "016x"), least.get(r)) for (i, _), p, r in zip(docs, prints, roots))
    got = simhash.near_components(table).collect()
    assert multiset((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert simhash.near_components(empty).count() == 0


def test_covering_masks_meet_every_near_pair():
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        rng = random.Random(radius)
        for _ in range(500):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in masks)


def test_simhash_hot_buckets(spark, monkeypatch):
    """Chains and dense balls of fingerprints, with buckets far over the limit."""
    monkeypatch.setattr(simhash, "LIMIT", 8)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 60:
        prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 3))))
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(30)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame(list(zip(range(len(prints)), signed)), "node long, f0 long")
    from corvane.llm.components import components

    found = {r.node: r.label for r in components(simhash.near_links(nodes, 1, 3, 3)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints, 3)


def test_near_copies_by_lanes(spark, tmp_path):
    """Several lanes: texts with one word changed are found, others left alone."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        w = [str(rng.randrange(10**6)) for _ in range(300)]
        rows.append((2 * k, " ".join(w)))
        w[150] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs, 5, 4, 8, 0.8).collect()}
    assert all(c in (i, i - i % 2) for i, c in got.items())
    assert sum(got[2 * k + 1] == 2 * k for k in range(40)) >= 39


def five_word_sets(t):
    w = (t or "").translate(LOW).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_lanes_find_pairs_near_the_similarity(spark, tmp_path):
    """Of pairs at 0.80 to 0.83, nearly all are linked; of pairs at 0.74 to 0.79, none."""
    rng = random.Random(11)
    rows = []
    for k in range(160):
        w = [str(rng.randrange(10**6)) for _ in range(404)]
        v = list(w)
        changed = 40 if k < 80 else 52 + k % 9
        v[200 : 200 + changed - 4] = [str(rng.randrange(10**6)) for _ in range(changed - 4)]  # touches `changed` shingles
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    shares = [len(a & b) / len(a | b) for a, b in ((five_word_sets(rows[i][1]), five_word_sets(rows[i + 1][1])) for i in range(0, 320, 2))]
    assert all(0.8 <= x < 0.83 for x in shares[:80]) and all(0.73 < x < 0.795 for x in shares[80:])
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.read.parquet(path), 5, 4, 8, 0.8).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(80)) >= 76
    assert all(got[2 * k + 1] == 2 * k + 1 for k in range(80, 160))


def test_lanes_link_all_pairs_of_the_similarity(spark, tmp_path, monkeypatch):
    """Against brute force: short texts, where bits differ more, families with a phrase in common, copies; whatever the limits on buckets and the number of rows."""
    rng = random.Random(31)
    fresh = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    rows = []
    for _ in range(150):  # 4 of 5 shingles in common
        w = fresh(9)
        rows += [" ".join(w), " ".join(w[:8])]
    phrase = fresh(30)
    for k in range(40):  # at, above and below 0.8
        w = phrase + fresh(10 + 6 * k)
        for _ in range(3):
            v = list(w)
            a = rng.randrange(30, len(v))
            v[a : a + rng.randrange(1, 2 + len(v) // 8)] = fresh(rng.randrange(3))
            rows += [" ".join(w), " ".join(v)]
    rows += [" ".join(phrase), None, "", "one two"]
    sets = [five_word_sets(t) for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    expected = {i: find(i) for i in range(len(rows))}
    assert 300 < sum(i != c for i, c in expected.items())
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    for limit, sample in ((4096, 64), (8, 64), (8, 1)):
        monkeypatch.setattr(simhash, "LIMIT", limit)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        assert {r.doc_id: r.component_id for r in simhash.near_components(docs, 5, 4, 8, 0.8).collect()} == expected
    monkeypatch.undo()
    noise = spark.range(10**6, 10**6 + 40000).selectExpr("id AS doc_id", "concat_ws(' ', id, id * 7, id * 11) AS text")
    noise.write.parquet(str(tmp_path / "n.parquet"))
    many = spark.read.parquet(path, str(tmp_path / "n.parquet"))
    assert {r.doc_id: r.component_id for r in simhash.near_components(many, 5, 4, 8, 0.8).filter("doc_id < 1000000").collect()} == expected


def test_lanes_take_shingles_as_sets(spark, tmp_path):
    """A copy with one line added forty times has nearly the same set of shingles."""
    rng = random.Random(12)
    rows = []
    for k in range(10):
        w = [str(rng.randrange(10**6)) for _ in range(404)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w) + ("\n" + " ".join(f"line{k}{x}" for x in range(8))) * 40)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.read.parquet(path), 5, 4, 8, 0.8).collect()}
    assert got == {i: i - i % 2 for i in range(20)}


def test_lanes_with_hot_buckets(spark, monkeypatch):
    """Many near fingerprints, buckets far over the limit: all that meet and are near enough are linked."""
    from corvane.llm.components import components

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(2)]
    rows = [(k, *[b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(3))) for b in base]) for k in range(120)]
    rows += [(200 + k, rng.getrandbits(64), rng.getrandbits(64)) for k in range(40)]
    signed = [(k, *[x - (1 << 64) if x >> 63 else x for x in f]) for k, *f in rows]
    nodes = spark.createDataFrame(signed, "node long, f0 long, f1 long")
    for limit in (4096, 8):
        monkeypatch.setattr(simhash, "LIMIT", limit)
        found = {r.node: r.label for r in components(simhash.near_links(nodes, 2, 3, 12)).collect()}
        assert {found.get(k) for k in range(120)} == {0} and not any(k >= 200 for k in found)


def brute_decontam(docs, items, window=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, (t or "").translate(LOW))
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows[tuple(w[k : k + window])].add(i)
    sizes, out = {len(x) for x in windows}, []
    for i, t in docs:
        w = re.findall(ALNUM, (t or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    found |= ids
                    hit[k : k + n] = [1] * n
        listed = sorted(str(x) for x in found if x is not None)
        n = sum(hit)
        out.append((i, len(w), n, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


def brute_near(docs, items, rare_terms=4, span=20):
    cut = lambda t: re.findall(ALNUM, (t or "").translate(LOW))
    texts = [cut(t) for _, t in docs]
    counts = collections.Counter(x for w in texts for x in w)
    out = []
    for (i, _), w in zip(docs, texts):
        found = set()
        for item, t in items:
            rare = sorted(set(cut(t)), key=lambda x: (counts[x], x.encode()))[:rare_terms]
            near = lambda p: all(x in w[max(p - span, 0) : p + span + 1] for x in rare)
            if item is not None and rare and any(x == rare[0] and near(p) for p, x in enumerate(w)):
                found.add(str(item))
        out.append((i, len(w), len(found), ",".join(sorted(found))))
    return out


@pytest.fixture(scope="module")
def items(spark):
    some = [t for _, t in sorted(((i or 0), t) for i, t in texts() if t and 14 < len(t.split()) < 1000)]
    rows = [(k, " ".join(t.split()[2:30])) for k, t in enumerate(some[:9])] + [(20, "mit license"), (21, None), (22, ""), (None, some[10]), (23, "nothing of this stands anywhere at all"), (0, some[11])]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate(table, empty, items, monkeypatch):
    docs = rows_of(table)
    expected = multiset(brute_decontam(docs, [tuple(r) for r in items.collect()]))
    assert sum(e[5] for e in expected) >= 5
    got = decontam.decontaminate(table, items, carry=("lang",)).collect()
    assert multiset(tuple(r[:6]) for r in got) == expected
    clean = [r for r in got if not r.n_hit]
    assert multiset((r.doc_id, r.kept) for r in clean) == multiset((i, t) for (i, t), e in zip(docs, brute_decontam(docs, [tuple(r) for r in items.collect()])) if not e[2])
    for r in got:
        assert len(re.findall(ALNUM, (r.kept or "").translate(LOW))) == r.n_words - r.n_hit
    assert multiset((r.doc_id, r.n_words, r.n_near, r.near_items) for r in got) == multiset(brute_near(docs, [tuple(r) for r in items.collect()]))
    assert sum(r.n_near > 0 for r in got) > 5
    monkeypatch.setattr(decontam, "CHUNK", 2)
    assert multiset(tuple(r[:6]) for r in decontam.decontaminate(table, items).collect()) == expected
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 150)  # several searches
    assert multiset(tuple(r[:6]) for r in decontam.decontaminate(table, items, with_text=False).collect()) == expected
    assert decontam.decontaminate(empty, items).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(table, items.filter("false")).collect())
