"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs`, a stored table with the columns of
`documents`, and returns these columns (the last: pieces of sequences). Between stages the rows are
written as Parquet and read again. Further columns of `docs` are ignored, whatever their names; an empty table
gives an empty one; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, line_dedup, packing, quality, simhash
from corvane.llm.queries import byte_bpe, table, tokenizer_path
from corvane.llm.shared import drop_path, keyed, new_path, temporaries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are.

    A null or empty text fails; a null language is one of its own; null ids stay null.
    """
    rows = keyed(docs, *COLUMNS)
    return _chosen(rows, quality.quality(rows, id_col="_row").filter("kept"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in ten or more of them; n_chars follows the text.

    A null text becomes an empty one. Each row counts as a document, null and repeated ids too.
    """
    return _rewritten(line_dedup.line_dedup(docs, min_docs=10, carry=("lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as it is: the first of the table.

    Texts without words are near-duplicates of each other; ids play no part, so that null and repeated ones are like others.
    """
    rows = keyed(docs, *COLUMNS)
    found = simhash.near_components(rows, size=5, radius=4, lanes=8, similarity=0.8, id_col="_row")
    return _chosen(rows, found.filter("doc_id = component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without words of benchmark windows that they quote in passing.

    A null or empty text has no words and stays as it is; n_chars of a null text is null; null ids stay null.
    """
    return _rewritten(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source")).filter("not contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null or empty text is its end id alone; null ids stay null."""
    return packing.pack(docs, byte_bpe(tokenizer_path()), size=1024)


def _chosen(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose number is among the ids found; ids are the small side and are hashed, texts aren't sorted."""
    ids = found.select(F.col("doc_id").alias("_row")).hint("shuffle_hash")
    return rows.join(ids, "_row", "left_semi").select(*COLUMNS)


def _rewritten(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: Perplexity, fingerprints and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote on its way, and the table of the stage before it, go when its own is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        with temporaries(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
