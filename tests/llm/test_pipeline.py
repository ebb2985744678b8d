"""Pipeline stages on small tables, each against its own input."""

from __future__ import annotations

import corpus_pipeline as P
import pytest


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, sf).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def test_columns(stages):
    for _, made in stages[:-1]:
        assert made.columns == P.COLUMNS


def test_quality_keeps_clean_rows(stages):
    before, after = (x.toPandas().set_index("doc_id") for x in stages[0])
    gone = set(before.index) - set(after.index)
    assert all(len(before.text[i].split()) < 50 or before.text[i] for i in gone)
    assert all(before.text[i] == after.text[i] for i in after.index)
    assert len(after) > 0.8 * len(before)


def test_lines(stages):
    before, after = stages[1]
    assert before.count() == after.count()
    lines = after.selectExpr("doc_id", "explode(split(text, '\n')) AS x").selectExpr("doc_id", "lower(trim(x)) AS k").filter("k <> ''").distinct().groupBy("k").count()
    assert lines.filter("count >= 10").count() == 0


def test_one_of_each_copy_stays(stages):
    before, after = stages[2]
    assert after.count() == after.select("text").distinct().count()
    assert after.join(before, "doc_id", "left_anti").count() == 0


def test_no_benchmark_window_stays(spark, sf, stages):
    from corvane.llm.decontam import decontaminate

    left = decontaminate(stages[3][1], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert left.filter("contaminated").count() == 0


def test_packing_holds_all_tokens(stages):
    from corvane.llm import queries, tokens

    docs, out = stages[4]
    encoder = tokens.encoder(queries.tokenizer_path())
    expected = {r.doc_id: len(encoder.library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert got == expected
    assert out.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").filter("n > 1024").count() == 0


def test_repeated_and_null_rows(spark, sf, tmp_path):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose + " more", None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    assert P.quality_rules(spark, docs, sf).count() == 3
    assert P.drop_lines(spark, docs, sf).count() == 5
    assert P.near_dedup(spark, docs, sf).filter("text LIKE 'word0%'").count() in (1, 2)
    assert P.decontaminate(spark, docs, sf).count() == 5
    assert P.pack(spark, docs, sf).count() >= 1


def test_empty_and_clashing_tables(spark, sf, tmp_path):
    """Stages take empty tables and further columns with the names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, kept string, unit int, component_id int"
    rows = [(k, " ".join(f"word{i} of {k}" for i in range(60)), "en", "s", 1, 7, "k", 0, 3) for k in range(4)]
    for some in ([], rows):
        path = str(tmp_path / f"d{len(some)}")
        spark.createDataFrame(some, schema).write.parquet(path)
        docs = spark.read.parquet(path)
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert (out.count() > 0) == bool(some), name
            assert name == P.STAGES[-1][0] or out.columns == P.COLUMNS
