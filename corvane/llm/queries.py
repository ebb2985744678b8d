"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, html_text, id_store, license_scan, line_dedup, packing, quality, simhash, substring_dedup, token_counts, tokens
from corvane.llm.shared import new_path

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe(path: str):
    """An `encode` for packing and the id store: the worker's encoder for a tokenizer file."""

    def encode():
        return tokens.encoder(path).encode

    return encode


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(tokenizer_path()), size=1024, with_ids=False)


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "id-store")
    id_store.write_store(table(spark, sf_dir, "documents"), path, byte_bpe(tokenizer_path()))
    return id_store.read_documents(spark, path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), width=20, with_text=False)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, with_text=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"), size=3, radius=3)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, min_share=0.05, with_text=False)


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_packing, op3_id_store, op4_license_scan, op5_substring_dedup, op6_html_text, op7_quality, op8_line_dedup, op9_simhash, op10_decontam)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COALESCED = _LOWER.format("coalesce(text, '')")
_WORDS = f"regexp_extract_all({_COALESCED}, '" + r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, len(w) AS n, unnest(generate_series(1, len(w) - 19)) AS i, w FROM words WHERE len(w) >= 20
), keyed AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM windows
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM keyed WHERE k > 1
), lists AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), split AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
    SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.p) AS t FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p GROUP BY s.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN lists l ON w.doc_id = l.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

_OP8 = rf"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT doc_id, p, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), hot AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id
"""

_OP10 = f"""
WITH d AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), i AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS key
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS key
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
    SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.key = iw.key
), places AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY 1
), corpus AS (
    SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t
), terms AS (
    SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), t) AS r
    FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM i) LEFT JOIN corpus USING (t)
), rare AS (
    SELECT item_id, t, r, count(*) OVER (PARTITION BY item_id) AS m FROM terms WHERE r <= 4
), spots AS (
    SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d) WHERE t IN (SELECT t FROM rare)
), close AS (
    SELECT DISTINCT item_id, doc_id FROM (
        SELECT a.item_id, x.doc_id, x.p, any_value(a.m) AS m, count(DISTINCT b.t) AS k
        FROM rare a JOIN spots x ON a.t = x.t JOIN rare b ON a.item_id = b.item_id JOIN spots y ON b.t = y.t AND x.doc_id = y.doc_id AND abs(x.p - y.p) <= 20
        WHERE a.r = 1 GROUP BY a.item_id, x.doc_id, x.p
    ) WHERE k = m
), near AS (
    SELECT doc_id, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_items FROM close GROUP BY 1
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": _OP5, "op8_line_dedup": _OP8, "op10_decontam": _OP10}
