"""Merchant text: chunking (R1, R2, R17), document text (P13), category lists.

A merchant row becomes 1, 3 or 4 chunk rows (budget 256 / 512 / 1024) through
one ``explode`` of an array of (type, text) structs — a narrow, per-row
transformation with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dec_text
from merchlens.functions.text import price_symbol, split_categories, value_tier

META_COLUMNS = ["merchant_name", "city", "state", "neighborhood", "mcc_code", "mcc_description", "categories",
                "stars", "review_count", "review_velocity_30d", "transaction_amount", "transaction_value_tier",
                "acceptance_method", "price_range", "is_open"]


def _cats(df: DataFrame) -> Column:
    """Categories as an array whether the column holds text or an array."""
    dt = dict(df.dtypes).get("categories", "string")
    return F.col("categories") if dt.startswith("array") else split_categories("categories")


def _s(c) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None")) if isinstance(c, str) else F.coalesce(c, F.lit("None"))


def _nb() -> Column:
    return F.coalesce(F.nullif(F.col("neighborhood"), F.lit("")), F.col("city"))


def _truthy_num_text(c: str, none: str) -> Column:
    """Python ``x or default`` for a number rendered as text."""
    v = F.col(c)
    return F.when(v.isNull() | (v == 0), F.lit(none)).otherwise(v.cast("string"))


def document_text(df: DataFrame) -> Column:
    """The full text of one transaction (missing values print as None)."""
    cats = F.array_join(_cats(df), ", ")
    return F.concat(
        F.lit("Merchant: "), _s("merchant_name"), F.lit(" | ID: "), _s("merchant_id"),
        F.lit(" | Location: "), _s(_nb()), F.lit(", "), _s("city"), F.lit(", "), _s("state"),
        F.lit(" | Categories: "), cats,
        F.lit(" | MCC: "), _s("mcc_code"), F.lit(" ("), _s("mcc_description"), F.lit(")"),
        F.lit(" | Stars: "), _s("stars"), F.lit(" | Reviews: "), _s("review_count"),
        F.lit(" | Velocity (30d): "), _s("review_velocity_30d"),
        F.lit(" | Amount: $"), dec_text("transaction_amount", 2),
        F.lit(" | Acceptance: "), _s("acceptance_method"),
        F.lit(" | Price tier: "), price_symbol(F.nullif(F.col("price_range"), F.lit(0))),
        F.lit(" | Open: "), F.when(F.col("is_open"), F.lit("yes")).otherwise(F.lit("no")),
    )


def chunk_merchants(df: DataFrame, budget: int = K.DEFAULT_CHUNK_BUDGET) -> DataFrame:
    """R1 + R2: chunk rows ``(doc_id, merchant_id, chunk_type, text, <metadata>)``.

    identity chunk is cut to ``budget * 4`` characters; financial and quality
    chunks need budget >= 512, the full document >= 1024.  doc_id = md5 of
    ``<merchant_id>_<type>``.  The address is empty (the record has none, L27)."""
    cats = _cats(df)
    name = _s("merchant_name")
    pr = F.nullif(F.col("price_range"), F.lit(0))
    identity = F.substring(F.concat(
        F.lit("Merchant: "), name, F.lit(". ID: "), _s("merchant_id"), F.lit(". Location:  "),
        _s(_nb()), F.lit(", "), _s("city"), F.lit(", "), _s("state"), F.lit(". Categories: "),
        F.array_join(cats, ", "), F.lit(". MCC: "), _s("mcc_code"), F.lit(" — "), _s("mcc_description"),
        F.lit(".")), 1, budget * 4)
    financial = F.concat(
        F.lit("Merchant "), name, F.lit(" financial profile: Average transaction $"),
        dec_text("transaction_amount", 2), F.lit(". Price tier: "), price_symbol(pr),
        F.lit(". Acceptance method: "), _s("acceptance_method"), F.lit(". Transaction value tier: "),
        value_tier("transaction_amount"), F.lit("."))
    quality = F.concat(
        F.lit("Merchant "), name, F.lit(" customer metrics: Star rating "), _truthy_num_text("stars", "N/A"),
        F.lit(". Total reviews: "), _truthy_num_text("review_count", "0"),
        F.lit(". Review velocity: "), _truthy_num_text("review_velocity_30d", "0"),
        F.lit(" reviews/30 days. Currently "),
        F.when(F.col("is_open"), F.lit("open")).otherwise(F.lit("closed")), F.lit("."))
    parts = [F.struct(F.lit("identity").alias("t"), identity.alias("x"))]
    if budget >= 512:
        parts += [F.struct(F.lit("financial").alias("t"), financial.alias("x")),
                  F.struct(F.lit("quality").alias("t"), quality.alias("x"))]
    if budget >= 1024:
        parts.append(F.struct(F.lit("full").alias("t"), document_text(df).alias("x")))
    meta = [
        F.col("merchant_name"), F.col("city"), F.col("state"), _nb().alias("neighborhood"),
        F.col("mcc_code"), F.col("mcc_description"), F.array_join(F.slice(cats, 1, 3), ", ").alias("categories"),
        F.col("stars"), F.col("review_count"), F.col("review_velocity_30d"), F.col("transaction_amount"),
        value_tier("transaction_amount").alias("transaction_value_tier"), F.col("acceptance_method"),
        F.col("price_range"), F.col("is_open"),
    ]
    return (df.select("merchant_id", *meta, F.explode(F.array(*parts)).alias("c"))
            .select(F.md5(F.concat_ws("_", F.col("merchant_id"), F.col("c.t"))).alias("doc_id"),
                    "merchant_id", F.col("c.t").alias("chunk_type"), F.col("c.x").alias("text"), *META_COLUMNS))


def mart_documents(mart: DataFrame) -> DataFrame:
    """One text document per mart row (the documented use of the mart)."""
    text = F.concat(
        F.lit("Merchant: "), _s("merchant_name"), F.lit(" | ID: "), _s("merchant_id"),
        F.lit(" | Location: "), _s("neighborhood"), F.lit(", "), _s("city"), F.lit(", "), _s("state"),
        F.lit(" | Categories: "), _s("categories"),
        F.lit(" | MCC: "), _s("mcc_code"), F.lit(" ("), _s("mcc_description"), F.lit(")"),
        F.lit(" | Transactions: "), _s("total_transactions"),
        F.lit(" | Avg amount: $"), dec_text("avg_transaction_amount", 2),
        F.lit(" | Total volume: $"), dec_text("total_transaction_volume", 2),
        F.lit(" | Avg stars: "), F.coalesce(dec_text("avg_stars", 2), F.lit("None")),
        F.lit(" | Reviews: "), _s("review_count"),
        F.lit(" | Price tier: "), _s("price_symbol"),
        F.lit(" | Open: "), F.when(F.col("is_open"), F.lit("yes")).otherwise(F.lit("no")),
        F.lit(" | High-volume anomaly: "), F.when(F.col("is_high_volume_anomaly"), F.lit("yes")).otherwise(F.lit("no")),
        F.lit(" | Q4 spike: "), F.when(F.col("is_q4_spending_spike"), F.lit("yes")).otherwise(F.lit("no")),
    )
    return mart.select(F.md5(F.concat_ws("_", F.col("merchant_id"), F.lit("mart"))).alias("doc_id"),
                       "merchant_id", text.alias("text"))
