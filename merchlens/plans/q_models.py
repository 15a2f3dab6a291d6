"""Registered queries: raw / staging / mart models."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens.functions.text import mcc_pad
from merchlens.operators import models as M
from merchlens.operators.analytics import latest_per_merchant
from merchlens.plans.catalog import register
from merchlens.plans.sqltext import STG_COLS, with_ctes
from merchlens.session import materialize
from merchlens.sources import fixtures as FX


def stg_of(spark, sf):
    return M.staging(FX.raw_txn(spark, sf), tiebreak=FX.DEDUPE_TIEBREAK)


def staged_of(spark, sf):
    """The staged rows, written once: jobs that read them several times, or sort them again, start from files."""
    with FX.partitions_by_size(spark, sf):
        return materialize(stg_of(spark, sf), "staged")


def latest_of(spark, sf):
    """The merchant corpus (latest staged row per merchant, L23), written once
    under the shared checkpoint dir: analytics, anomaly, chunking and search
    jobs read it several times (global statistics, then a row pass), and a
    written table spares re-running the transaction-level shuffles each time."""
    return materialize(latest_per_merchant(staged_of(spark, sf)), "latest-per-merchant")


RAW_SQL_COLS = ", ".join(M.RAW_COLUMNS)


@register("raw_view", with_ctes(f"SELECT {RAW_SQL_COLS} FROM raw_txn", "raw_txn"), ids=("S14",))
def q_raw_view(spark, sf):
    return M.raw(FX.raw_txn(spark, sf))


@register("raw_row_count", with_ctes("SELECT count(*) AS row_count FROM raw_txn", "raw_txn"), ids=("S8",))
def q_raw_row_count(spark, sf):
    return FX.raw_txn(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))


_CLEAN_COLS = STG_COLS.split(", ")[:20]


@register("stg_clean", with_ctes(f"SELECT {', '.join(_CLEAN_COLS)} FROM stg_clean", "stg_clean"),
          ids=("P9", "F1"))
def q_stg_clean(spark, sf):
    return M.clean(FX.raw_txn(spark, sf))


@register("stg_enriched", with_ctes(f"SELECT {STG_COLS} FROM stg_enriched", "stg_enriched"),
          ids=("P11", "P12"))
def q_stg_enriched(spark, sf):
    return M.enrich(M.clean(FX.raw_txn(spark, sf))).select(*M.STAGING_COLUMNS)


@register("stg_dedup", with_ctes(f"SELECT {STG_COLS} FROM stg", "stg"), ids=("W1", "S14"))
def q_stg_dedup(spark, sf):
    return stg_of(spark, sf)


@register("value_tier", with_ctes("""
SELECT transaction_value_tier, count(*) AS n_txns, min(transaction_amount) AS min_amount,
       max(transaction_amount) AS max_amount
FROM stg GROUP BY transaction_value_tier""", "stg"), ids=("P10",))
def q_value_tier(spark, sf):
    return stg_of(spark, sf).groupBy("transaction_value_tier").agg(
        F.count(F.lit(1)).alias("n_txns"),
        F.min("transaction_amount").alias("min_amount"),
        F.max("transaction_amount").alias("max_amount"))


@register("mcc_pad", with_ctes("""
SELECT mcc_code, CASE WHEN length(mcc_code) < 4 THEN lpad(mcc_code, 4, '0') ELSE mcc_code END AS mcc_padded,
       count(*) AS n_txns
FROM raw_txn GROUP BY mcc_code""", "raw_txn"), ids=("P8",))
def q_mcc_pad(spark, sf):
    return (FX.raw_txn(spark, sf).groupBy("mcc_code").agg(F.count(F.lit(1)).alias("n_txns"))
            .select("mcc_code", mcc_pad("mcc_code").alias("mcc_padded"), "n_txns"))


_AGG_COLS = ("merchant_id, merchant_name, city, state, neighborhood, latitude, longitude, mcc_code, "
             "mcc_description, categories, price_range, price_symbol, is_open, total_transactions, "
             "avg_transaction_amount, total_transaction_volume, min_transaction, max_transaction, "
             "stddev_transaction, avg_stars, review_count, review_velocity_30d, first_seen_at, last_seen_at, "
             "last_ingested_at")


@register("mart_merchant_agg", with_ctes(f"SELECT {_AGG_COLS} FROM mart_agg", "mart_agg"), ids=("A1", "A5"))
def q_mart_merchant_agg(spark, sf):
    return M.merchant_agg(stg_of(spark, sf)).select(*_AGG_COLS.split(", "))


_ACC = "merchant_id, chip_count, contactless_count, online_count, swipe_count, mobile_pay_count, keyed_count"
_TIER = "merchant_id, low_value_txns, mid_value_txns, high_value_txns"
_QTR = "merchant_id, q1_transactions, q2_transactions, q3_transactions, q4_transactions"


@register("mart_acceptance_counts", with_ctes(f"SELECT {_ACC} FROM mart_agg", "mart_agg"), ids=("A2",))
def q_mart_acceptance_counts(spark, sf):
    return M.merchant_agg(stg_of(spark, sf)).select(*_ACC.split(", "))


@register("mart_tier_counts", with_ctes(f"SELECT {_TIER} FROM mart_agg", "mart_agg"), ids=("A3",))
def q_mart_tier_counts(spark, sf):
    return M.merchant_agg(stg_of(spark, sf)).select(*_TIER.split(", "))


@register("mart_quarter_counts", with_ctes(f"SELECT {_QTR} FROM mart_agg", "mart_agg"), ids=("A4",))
def q_mart_quarter_counts(spark, sf):
    return M.merchant_agg(stg_of(spark, sf)).select(*_QTR.split(", "))


@register("mart_anomaly", with_ctes("SELECT * FROM mart", "mart"), ids=("J1", "W2", "W3", "W4", "W5", "A1"))
def q_mart_anomaly(spark, sf):
    return M.mart(stg_of(spark, sf))


@register("mart_q4_spike", with_ctes(
    f"SELECT {_QTR}, is_q4_spending_spike FROM mart WHERE is_q4_spending_spike", "mart"), ids=("W5",))
def q_mart_q4_spike(spark, sf):
    return M.mart(stg_of(spark, sf)).where("is_q4_spending_spike").select(
        *_QTR.split(", "), "is_q4_spending_spike")


@register("latest_per_merchant", with_ctes(f"SELECT {STG_COLS} FROM latest", "latest"), ids=("A13",))
def q_latest_per_merchant(spark, sf):
    return latest_of(spark, sf)
