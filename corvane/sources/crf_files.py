"""Tab-separated files of a sequence-labelling corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "label": ("crf_label.tab", "id int, label string"),
    "regex": ("crf_regex.tab", "pattern string, name string"),
    "trainingset": ("crf_trainingset.tab", "start_pos int, doc_id int, seg_text string, label int, max_pos int"),
    "testset": ("crf_testset.tab", "start_pos int, doc_id int, seg_text string, max_pos int"),
    "dictionary": ("crf_dictionary.tab", "token string, token_id int, label string, count int, total int"),
    "feature": ("crf_feature.tab", "id int, name string, prev_label_id int, label_id int, weight double"),
}


def read(spark: SparkSession, folder: str, *wanted: str) -> dict[str, DataFrame]:
    """The named tables of a folder."""
    return {t: spark.read.csv(f"{folder}/{TABLES[t][0]}", sep="\t", schema=TABLES[t][1]) for t in wanted}


def crf_train_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read(spark, folder, "label", "regex", "trainingset")


def crf_test_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read(spark, folder, "testset", "dictionary", "feature", "label", "regex")
