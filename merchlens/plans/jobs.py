"""Whole-pipeline jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.operators import chunks as C
from merchlens.operators import models as M
from merchlens.operators import retrieval as R
from merchlens.operators.analytics import latest_per_merchant
from merchlens.sources import layers as L


def rebuild(spark: SparkSession, raw_df: DataFrame, out_dir: str, city: str | None = None,
            limit: int | None = None, tiebreak: list[str] | None = None, prefix: str = "merchlens") -> DataFrame:
    """Raw -> staging -> mart -> latest rows -> chunks -> tf-idf, each a catalog table of the layers
    ``<prefix>_staging`` / ``<prefix>_marts`` under ``out_dir`` (overwritten); returns ``(table, row_count)``.

    ``city`` keeps one city (case-insensitive) and ``limit`` the first
    ``limit`` raw rows by transaction id — both optional features of the
    reload call (L26); with neither, every raw row is rebuilt.  Each stage
    reads the table the previous stage wrote, so a failure restarts from the
    last written table instead of the raw source, and texts are tokenised once."""
    src = raw_df
    if city:
        src = src.where(F.lower(F.trim("city")) == city.strip().lower())
    if limit:
        src = src.orderBy("transaction_id", *(tiebreak or [])).limit(limit)
    layers = L.open_layers(spark, out_dir, prefix)
    stg = L.save_staging(layers, M.staging(src, tiebreak))
    L.save(layers, "merchants", M.mart(stg))
    latest = L.save_lookup(layers, "merchant_latest", latest_per_merchant(stg), "merchant_id")
    chunks = L.save(layers, "chunks", C.chunk_merchants(latest))
    post = L.save(layers, "tfidf_postings", R.postings(chunks).select("doc_id", "token", "tf"))
    idf = L.save(layers, "tfidf_idf", R.idf_table(post, chunks))
    L.save(layers, "tfidf_norms", R.doc_norms(post, idf))
    names = {"transactions": "staging", "merchants": "mart"}
    out = None
    for t in ("transactions", "merchants", "chunks", "tfidf_postings", "tfidf_idf", "tfidf_norms"):
        n = layers.read(spark, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(names.get(t, t)).alias("table"), "row_count")
        out = n if out is None else out.unionByName(n)
    return out
