"""Corpus pipeline: from the documents table to packed training sequences.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns the
next docs.  Each result is written as Parquet under the shared checkpoint folder and
read back.  All stages but the last return the columns of ``documents``; a stage that
changes texts keeps ``n_chars``, where there is one, in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from merchlens.llm.common import table
from merchlens.llm.tokens import vocabulary_path
from merchlens.session import materialize


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.5."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return _with_length(quality_rules.clean(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows removed; no document goes."""
    return _with_length(line_dedup.dedup_lines(docs).select(*docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, at most three bits apart)."""
    return simhash.representatives(docs, width=3, radius=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in packed sequences."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("best-fit packing", pack),
]

#: SQL has no random Fourier features, XXH64 or tokenizer; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
