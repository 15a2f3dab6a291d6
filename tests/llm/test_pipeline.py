"""The corpus pipeline: each stage against its operator, what it hands on, and odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from merchlens.llm import line_dedup, quality_classifier, quality_rules, simhash

STAGE = dict(P.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _texts(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "line dedup", "SimHash near-dedup", "best-fit packing"]


def test_each_stage_does_what_its_operator_says(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_classifier.score_documents(docs, labels).where("score >= 0.5").collect()}
    kept = STAGE["quality classifier"](spark, docs, sf)
    assert kept.columns == docs.columns and _texts(kept) == _texts(docs.where(F.col("doc_id").isin(list(good))))

    ruled = STAGE["quality rules"](spark, docs, sf)
    verdict = {r["doc_id"] for r in docs.select("doc_id", quality_rules.verdict(F.col("text")).alias("v")).where("v.kept").collect()}
    assert ruled.columns == docs.columns and {r["doc_id"] for r in ruled.collect()} == verdict

    lines = STAGE["line dedup"](spark, docs, sf)
    assert lines.columns == docs.columns and _texts(lines) == _texts(line_dedup.dedup_lines(docs))

    single = STAGE["SimHash near-dedup"](spark, docs, sf)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, width=3, radius=3).collect()}
    ids = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns and sorted(groups[i] for i in ids) == sorted(set(groups.values()))

    for changed in (ruled, lines):
        assert changed.where(F.col("n_chars") != F.length("text")).count() == 0
        assert dict(changed.dtypes)["n_chars"] == dict(docs.dtypes)["n_chars"]

    packed = STAGE["best-fit packing"](spark, single, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(ids)


def test_odd_and_empty_tables_pass_every_stage(spark, sf, odd_docs, no_docs):
    odd = odd_docs.withColumn("n_chars", F.length("text"))
    for name, stage in P.STAGES:
        out = stage(spark, odd, sf)
        n = out.count()
        if name != "best-fit packing":
            assert out.columns == odd.columns and n <= odd.count()
        if name == "line dedup":
            assert n == odd.count()
        assert stage(spark, no_docs.withColumn("n_chars", F.length("text")), sf).count() == 0


def _python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("EvalPython")


def test_classifier_filter_needs_one_python_worker_a_task(spark, sf, docs):
    assert _python_steps(STAGE["quality classifier"](spark, docs, sf)) == 1


def test_rules_judge_a_text_once(spark, sf, docs):
    assert _python_steps(STAGE["quality rules"](spark, docs, sf)) == 1
