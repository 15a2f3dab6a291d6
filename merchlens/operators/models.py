"""Raw -> staging -> mart models.

Scale notes
* Dedupe (W1) is ``row_number() = 1`` per ``transaction_id``; Spark plans it as a
  partial ``WindowGroupLimit`` before the exchange, so a hot key is cut to one
  row per map partition before it is shuffled.  The derived columns (P10-P12) are
  added after it, so they are neither shuffled nor sorted.
* The mart is a hash aggregate on the 13 attribute columns (partial aggregation
  on the map side).  Global mean / stddev (W2) are scalar subqueries over the
  small aggregated mart — never an un-partitioned ``OVER ()`` window and never a
  join; the mart's shuffle is reused by the subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dround, money_sum
from merchlens.functions.text import price_symbol, quarter_label, value_tier, year_text
from merchlens.session import materialize

RAW_COLUMNS = [
    "transaction_id", "merchant_id", "merchant_name", "transaction_amount", "mcc_code",
    "mcc_description", "city", "state", "neighborhood", "latitude", "longitude", "ts",
    "acceptance_method", "stars", "review_count", "review_velocity_30d", "categories",
    "is_open", "price_range", "ingested_at",
]

STAGING_COLUMNS = [
    "transaction_id", "merchant_id", "merchant_name", "transaction_amount", "mcc_code",
    "mcc_description", "city", "state", "neighborhood", "latitude", "longitude",
    "transaction_at", "acceptance_method", "stars", "review_count", "review_velocity_30d",
    "categories", "is_open", "price_range", "ingested_at",
    "transaction_value_tier", "price_symbol", "transaction_quarter", "transaction_year",
]

MART_GROUP = [
    "merchant_id", "merchant_name", "city", "state", "neighborhood", "latitude", "longitude",
    "mcc_code", "mcc_description", "categories", "price_range", "price_symbol", "is_open",
]


def raw(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S14 raw layer: the warehouse columns (plus optional pass-through columns)."""
    return df.select(*RAW_COLUMNS, *(keep or []))


def staging_filter() -> Column:
    """ids and city present, 0 < amount < cap (on raw columns)."""
    c = F.col
    return (c("transaction_id").isNotNull()
            & c("merchant_id").isNotNull()
            & (c("transaction_amount") > 0)
            & (c("transaction_amount") < K.STAGING_AMOUNT_CAP)
            & c("city").isNotNull())


def clean(raw_df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P9 + F1: typed, trimmed projection and the staging row filter."""
    c = F.col
    return raw_df.where(staging_filter()).select(
        "transaction_id",
        "merchant_id",
        F.trim("merchant_name").alias("merchant_name"),
        dround(c("transaction_amount").cast("double"), 2).alias("transaction_amount"),
        F.lpad(c("mcc_code").cast("string"), 4, "0").alias("mcc_code"),
        "mcc_description",
        F.trim("city").alias("city"),
        F.upper(F.trim("state")).alias("state"),
        # the fallback uses the untrimmed source city, as the model does
        F.coalesce(F.nullif(F.trim("neighborhood"), F.lit("")), c("city")).alias("neighborhood"),
        c("latitude").cast("double").alias("latitude"),
        c("longitude").cast("double").alias("longitude"),
        c("ts").cast("timestamp").alias("transaction_at"),
        F.lower("acceptance_method").alias("acceptance_method"),
        c("stars").cast("double").alias("stars"),
        c("review_count").cast("int").alias("review_count"),
        c("review_velocity_30d").cast("int").alias("review_velocity_30d"),
        "categories",
        c("is_open").cast("boolean").alias("is_open"),
        F.coalesce(c("price_range"), F.lit(K.DEFAULT_PRICE_RANGE)).cast("int").alias("price_range"),
        c("ingested_at").cast("timestamp").alias("ingested_at"),
        *(keep or []),
    )


def enrich(df: DataFrame) -> DataFrame:
    """Value tier, price symbol, quarter label, year text."""
    return df.withColumns({
        "transaction_value_tier": value_tier("transaction_amount"),
        "price_symbol": price_symbol("price_range"),
        "transaction_quarter": quarter_label("transaction_at"),
        "transaction_year": year_text("transaction_at"),
    })


def latest_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key under ``order`` (W1 / A13 shape).

    ``row_number() = 1`` is planned as WindowGroupLimit(partial) -> exchange ->
    WindowGroupLimit(final): each map task keeps one row per key before the
    shuffle, so a key holding a third of the table does not flood one reducer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe(df: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """Latest ``ingested_at`` per ``transaction_id`` (ties: ``tiebreak`` DESC)."""
    order = [F.col("ingested_at").desc_nulls_last()] + [F.col(t).desc_nulls_last() for t in (tiebreak or [])]
    return latest_per_key(df, "transaction_id", order)


def staging(raw_df: DataFrame, tiebreak: list[str] | None = None) -> DataFrame:
    """Full staging model: clean -> dedupe -> enrich.  ``tiebreak`` columns may
    name raw pass-through columns; ``ts`` means the cleaned ``transaction_at``."""
    tb = [("transaction_at" if t == "ts" else t) for t in (tiebreak or [])]
    keep = [t for t in tb if t != "transaction_at"]
    out = enrich(dedupe(clean(raw_df, keep=keep), tb))
    return out.select(*STAGING_COLUMNS)


def _count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def merchant_agg(stg: DataFrame) -> DataFrame:
    """A1-A5: one row per merchant attribute set (grouped by the 13 named columns, L2)."""
    c = F.col
    m = c("acceptance_method")
    t = c("transaction_value_tier")
    q = c("transaction_quarter")
    return stg.groupBy(*MART_GROUP).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        dround(F.avg("transaction_amount"), 2).alias("avg_transaction_amount"),
        F.round(money_sum("transaction_amount"), 2).cast("double").alias("total_transaction_volume"),
        F.min("transaction_amount").alias("min_transaction"),
        F.max("transaction_amount").alias("max_transaction"),
        dround(F.stddev_samp("transaction_amount"), 2).alias("stddev_transaction"),
        *[_count_when(m == v).alias(f"{v}_count") for v in K.ACCEPTANCE_METHODS],
        *[_count_when(t == v).alias(f"{v}_value_txns") for v in K.VALUE_TIERS],
        *[_count_when(q == v).alias(f"{v.lower()}_transactions") for v in K.QUARTERS],
        dround(F.avg("stars"), 4).alias("avg_stars"),
        F.max("review_count").alias("review_count"),
        F.max("review_velocity_30d").alias("review_velocity_30d"),
        F.min("transaction_at").alias("first_seen_at"),
        F.max("transaction_at").alias("last_seen_at"),
        F.max("ingested_at").alias("last_ingested_at"),
    )


def global_stats(df: DataFrame, col: str) -> Column:
    """Struct (mu, sd): mean and sample stddev of ``col`` over the whole frame,
    as ONE scalar subquery (attach it once with ``withColumn`` and read its
    fields; every ``getField`` on a fresh subquery would plan another one)."""
    return df.select(F.struct(F.avg(col).alias("mu"), F.stddev_samp(col).alias("sd")).alias("s")).scalar()


def mart(stg: DataFrame, stage: bool = True) -> DataFrame:
    """Mart with anomaly columns (W2-W5).  Flags are attached to the row itself
    (ledger L5), equal to the model's self-join when merchant ids are unique.

    With ``stage`` the aggregated mart (one row per merchant attribute set) is
    written once to the shared checkpoint folder; the global-statistics
    subquery and the flag pass both read that table, so the transaction-level
    shuffles run once."""
    agg = merchant_agg(stg)
    if stage:
        agg = materialize(agg, "mart-agg")
    a = F.col("avg_transaction_amount")
    mu, sd = F.col("_g.mu"), F.col("_g.sd")
    q123 = F.col("q1_transactions") + F.col("q2_transactions") + F.col("q3_transactions")
    return agg.withColumn("_g", global_stats(agg, "avg_transaction_amount")).withColumns({
        "z_score_amount": dround((a - mu) / F.nullif(sd, F.lit(0.0)), 2),
        "is_high_volume_anomaly": F.coalesce(a > mu + K.MART_HIGH_VOLUME_SD * sd, F.lit(False)),
        # q4 > (q1+q2+q3)/3 * 1.5  <=>  2*q4 > q1+q2+q3, exact in integers
        "is_q4_spending_spike": F.coalesce(F.col("q4_transactions") * 2 > q123, F.lit(False)),
    }).drop("_g")
