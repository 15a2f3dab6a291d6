"""Merchant corpus analytics.

Inputs are any transaction-shaped DataFrame; the default corpus is the latest
row per merchant (A13, ledger L23).  Global statistics are scalar subqueries
(computed once, inlined as literals at execution) — no ``OVER ()`` window and no
cross join.  Grouped outputs are hash aggregates with map-side partial
aggregation; "top n" outputs sort on a total key (value, then group key) so the
result is deterministic, and Spark plans them as ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dround, money_sum, pct_text
from merchlens.functions.text import price_symbol, quarter_label, value_tier, year_text
from merchlens.operators.models import latest_per_key, staging_filter
from merchlens.session import materialize


def latest_per_merchant(stg: DataFrame) -> DataFrame:
    """Latest transaction per merchant (``transaction_at`` DESC, ``transaction_id`` DESC).

    Each merchant's newest time is a hash aggregate over two columns, written as a small table; only the rows
    of that time are shuffled and sorted whole.  ``stg`` is read twice: pass written rows."""
    newest = materialize(stg.groupBy("merchant_id").agg(F.max("transaction_at").alias("_at")), "newest-times")
    newest = newest.withColumnRenamed("merchant_id", "_merchant")
    rows = stg.join(newest, F.col("merchant_id").eqNullSafe(F.col("_merchant")) & F.col("transaction_at").eqNullSafe(F.col("_at")), "left_semi")
    return latest_per_key(rows, "merchant_id", [F.col("transaction_at").desc_nulls_last(), F.col("transaction_id").desc()])


def group_key(by: str) -> Column:
    """Grouping key chosen at run time; unknown names fall back to the raw MCC."""
    c = F.col
    keys = {
        "mcc_code": F.concat_ws(" — ", c("mcc_code"), c("mcc_description")),
        "city": c("city"),
        "neighborhood": F.coalesce(F.nullif(c("neighborhood"), F.lit("")), c("city")),
        "value_tier": value_tier("transaction_amount"),
    }
    return keys.get(by, c("mcc_code"))


def _city_filter(df: DataFrame, city: str | None) -> DataFrame:
    return df.where(F.lower("city") == city.lower()) if city else df


def review_velocity(df: DataFrame, group_by: str = "mcc_code", city: str | None = None,
                    limit: int | None = 10) -> DataFrame:
    """Velocity by group, sorted by average velocity desc."""
    v = F.coalesce(F.col("review_velocity_30d"), F.lit(0))
    out = (_city_filter(df, city).groupBy(group_key(group_by).alias("group")).agg(
        dround(F.avg(v), 1).alias("avg_velocity"),
        F.max(v).alias("max_velocity"),
        F.count(F.lit(1)).alias("merchant_count"),
        F.sum(F.coalesce(F.col("review_count"), F.lit(0)).cast("long")).alias("total_reviews"),
    ).orderBy(F.col("avg_velocity").desc(), F.col("group")))
    return out.limit(limit) if limit else out


def avg_transaction(df: DataFrame, group_by: str = "mcc_code", city: str | None = None,
                    limit: int | None = 10) -> DataFrame:
    """Mean, median, total and merchant count of amounts per group."""
    a = F.col("transaction_amount")
    out = (_city_filter(df, city).groupBy(group_key(group_by).alias("group")).agg(
        dround(F.avg(a), 2).alias("avg_transaction"),
        dround(F.median(a), 2).alias("median_transaction"),
        F.round(money_sum(a), 2).cast("double").alias("total_volume"),
        F.count(F.lit(1)).alias("merchant_count"),
    ).orderBy(F.col("avg_transaction").desc(), F.col("group")))
    return out.limit(limit) if limit else out


def mcc_distribution(df: DataFrame, city: str | None = None, limit: int | None = 10) -> DataFrame:
    """Most common MCC labels."""
    out = (_city_filter(df, city).groupBy(group_key("mcc_code").alias("mcc"))
           .agg(F.count(F.lit(1)).alias("merchant_count"))
           .orderBy(F.col("merchant_count").desc(), F.col("mcc")))
    return out.limit(limit) if limit else out


def acceptance_distribution(df: DataFrame, city: str | None = None) -> DataFrame:
    """Method counts with their share of all merchants as percent text."""
    base = _city_filter(df, city)
    total = base.select(F.count(F.lit(1))).scalar()
    return (base.groupBy(F.col("acceptance_method").alias("method"))
            .agg(F.count(F.lit(1)).alias("merchant_count"))
            .withColumn("pct", pct_text(F.col("merchant_count") * 100.0 / total, 1))
            .orderBy(F.col("merchant_count").desc(), F.col("method")))


def summary(df: DataFrame) -> DataFrame:
    """Dashboard scalars in one aggregate pass."""
    s = F.col("stars")
    return df.agg(
        F.count(F.lit(1)).alias("total_merchants"),
        F.count(F.when(F.col("is_open"), F.lit(1))).alias("open_merchants"),
        dround(F.avg("transaction_amount"), 2).alias("avg_transaction"),
        F.coalesce(dround(F.avg(F.when(s != 0, s)), 2), F.lit(0.0)).alias("avg_stars"),
        F.sum(F.coalesce(F.col("review_count"), F.lit(0)).cast("long")).alias("total_reviews"),
        dround(F.avg(F.coalesce(F.col("review_velocity_30d"), F.lit(0))), 1).alias("avg_velocity_30d"),
    )


def top_mcc_categories(df: DataFrame, n: int = 5) -> DataFrame:
    """The five most common MCC descriptions."""
    return (df.groupBy(F.col("mcc_description").alias("mcc"))
            .agg(F.count(F.lit(1)).alias("merchant_count"))
            .orderBy(F.col("merchant_count").desc(), F.col("mcc")).limit(n))


def merchant_summary(txns: DataFrame) -> DataFrame:
    """Merchant rollup over all transactions, with the sorted set of methods used.

    The merchant's own attributes are those of its newest transaction (ties: larger id), so a
    merchant whose record changed gets one consistent row."""
    c = F.col
    attributes = ("merchant_name", "city", "state", "neighborhood", "mcc_code", "mcc_description", "review_count",
                  "review_velocity_30d", "categories", "price_range", "is_open", "latitude", "longitude")
    newest = F.max_by(F.struct(*attributes), F.struct("transaction_at", "transaction_id"))
    return txns.groupBy("merchant_id").agg(
        newest.alias("m"),
        dround(F.avg("transaction_amount"), 2).alias("avg_transaction"),
        F.count(F.lit(1)).alias("total_transactions"),
        dround(F.avg("stars"), 2).alias("avg_stars"),
        F.array_join(F.sort_array(F.collect_set("acceptance_method")), ",").alias("acceptance_methods"),
    ).select(
        "merchant_id", "m.merchant_name", "m.city", "m.state", "m.neighborhood", "m.mcc_code", "m.mcc_description",
        "avg_transaction", "total_transactions", "avg_stars", c("m.review_count").alias("total_reviews"),
        c("m.review_velocity_30d").alias("review_velocity"), "m.categories", "acceptance_methods", "m.price_range", "m.is_open",
        c("m.latitude").alias("lat"), c("m.longitude").alias("lon"))


def anomaly_flags(df: DataFrame, limit: int | None = 10) -> DataFrame:
    """|z| >= 2 or velocity ratio >= 2.5; sorted by |z| desc.

    sd uses the sample formula with a zero guard (null z counts as 0, L18); the
    velocity mean falls back to 1 when it is 0.  Exactly +-2.0 is labelled
    ``velocity_spike`` (L19)."""
    a = F.col("transaction_amount")
    vel = F.coalesce(F.col("review_velocity_30d"), F.lit(0))
    stats = df.select(F.struct(
        F.avg(a).alias("mu"),
        F.when(F.count(a) > 1, F.stddev_samp(a)).otherwise(F.lit(1.0)).alias("sd"),
        F.avg(vel.cast("double")).alias("mv"),
    )).scalar()
    mv = F.coalesce(F.nullif(F.col("_st.mv"), F.lit(0.0)), F.lit(1.0))
    z = F.coalesce((a - F.col("_st.mu")) / F.nullif(F.col("_st.sd"), F.lit(0.0)), F.lit(0.0))
    ratio = vel / mv
    out = (df.withColumn("_st", stats).select("merchant_name", "merchant_id", "city", "mcc_description", "transaction_amount",
                     z.alias("_z"), F.col("review_velocity_30d").alias("review_velocity"), ratio.alias("_r"))
           .where((F.abs("_z") >= K.ANALYTICS_FLAG_Z) | (F.col("_r") >= K.ANALYTICS_VELOCITY_RATIO))
           .select("merchant_name", "merchant_id", "city", "mcc_description", "transaction_amount",
                   dround("_z", 2).alias("z_score"), "review_velocity",
                   dround("_r", 2).alias("velocity_ratio"),
                   F.when(F.col("_z") > K.ANALYTICS_FLAG_Z, F.lit("high_amount"))
                   .when(F.col("_z") < -K.ANALYTICS_FLAG_Z, F.lit("low_amount"))
                   .otherwise(F.lit("velocity_spike")).alias("anomaly_type"))
           .orderBy(F.abs("z_score").desc(), F.col("merchant_id")))
    return out.limit(limit) if limit else out


def q4_spending(df: DataFrame, limit: int | None = 10) -> DataFrame:
    """The reference's 'Q4' proxy — amount above 1.3 x the corpus mean (dates unused)."""
    a = F.col("transaction_amount")
    mu = F.col("_mu")
    out = (df.withColumn("_mu", df.select(F.avg(a)).scalar()).where(a > mu * K.Q4_PROXY_MULT)
           .select("merchant_name", "merchant_id", "city", "mcc_description", a.alias("avg_transaction"),
                   pct_text((a - mu) * 100.0 / mu, 0).alias("above_mean_by_pct"))
           .orderBy(F.col("avg_transaction").desc(), F.col("merchant_id")))
    return out.limit(limit) if limit else out


def q4_actual(txns: DataFrame) -> DataFrame:
    """N5 (dated variant): merchants whose Q4 mean amount exceeds 1.3 x their Q1-Q3 mean."""
    a = F.col("transaction_amount")
    is_q4 = F.col("transaction_quarter") == "Q4"
    g = txns.groupBy("merchant_id").agg(
        dround(F.avg(F.when(is_q4, a)), 2).alias("q4_avg"),
        dround(F.avg(F.when(~is_q4, a)), 2).alias("rest_avg"),
        F.count(F.when(is_q4, F.lit(1))).alias("q4_txns"),
    )
    return (g.where(F.col("q4_avg") > F.col("rest_avg") * K.Q4_PROXY_MULT)
            .withColumn("above_rest_by_pct",
                        pct_text((F.col("q4_avg") - F.col("rest_avg")) * 100.0 / F.col("rest_avg"), 0)))


def merchant_record(df: DataFrame) -> DataFrame:
    """Merchant output record (adds value tier and price symbol)."""
    return df.select(
        "merchant_id", "merchant_name", "mcc_code", "mcc_description", "city", "state", "neighborhood",
        "latitude", "longitude", "categories", "stars", "review_count", "review_velocity_30d",
        "transaction_amount", value_tier("transaction_amount").alias("transaction_value_tier"),
        "acceptance_method", "price_range", price_symbol("price_range").alias("price_symbol"), "is_open",
    )


def merchant_filter(city: str | None = None, neighborhood: str | None = None, mcc_code: str | None = None,
                    min_stars: float | None = None, value_tier_: str | None = None, open_only: bool = False,
                    acceptance: str | None = None, has_parking: bool | None = None, case_sensitive: bool = False) -> Column:
    """F2/F3/F4 predicate builder.  Falsy filters are skipped (L14).  ``has_parking`` reads the
    business record's ``attributes.Parking``: some kind of parking is offered (or, if False, none)."""
    c = F.col
    cond = F.lit(True)
    if city:
        cond &= (c("city") == city) if case_sensitive else (F.lower(c("city")) == city.lower())
    if neighborhood:
        cond &= F.contains(F.lower(F.coalesce(c("neighborhood"), F.lit(""))), F.lit(neighborhood.lower()))
    if mcc_code:
        cond &= c("mcc_code") == mcc_code
    if min_stars:
        cond &= F.coalesce(c("stars"), F.lit(0.0)) >= min_stars
    if value_tier_:
        cond &= value_tier("transaction_amount") == value_tier_
    if open_only:
        cond &= c("is_open")
    if acceptance:
        cond &= c("acceptance_method") == acceptance
    if has_parking is not None:
        some = F.coalesce(F.exists(F.map_values(c("attributes.Parking")), lambda v: F.coalesce(v.cast("boolean"), F.lit(False))),
                          F.lit(False))
        cond &= some == has_parking
    return cond


def list_merchants(df: DataFrame, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """F2 + T1: filtered listing, stars desc (null = 0), one page, with the total match count."""
    hits = df.where(merchant_filter(**filters))
    total = hits.select(F.count(F.lit(1))).scalar()
    page = (merchant_record(hits)
            .orderBy(F.coalesce(F.col("stars"), F.lit(0.0)).desc(), F.col("merchant_id"))
            .offset(offset).limit(limit))
    return page.withColumn("total", total)


def date_range(df: DataFrame, start: str, end: str, ts_col: str = "transaction_at") -> DataFrame:
    """inclusive timestamp range.  Where ``df`` has the year and quarter that staging derives from
    ``transaction_at``, the range is stated on them too: a table partitioned by them reads its quarters only."""
    lo, hi = (F.lit(t).cast("timestamp") for t in (start, end))
    cond = F.col(ts_col).between(lo, hi)
    if ts_col == "transaction_at" and {"transaction_year", "transaction_quarter"} <= set(df.columns):
        year, quarter = F.col("transaction_year"), F.col("transaction_quarter")
        # years are compared as text: four digits each
        four = (F.year(lo) >= 1000) & (F.year(hi) <= 9999)
        cond &= ~four | ((year >= year_text(lo)) & (year <= year_text(hi))
                         & ((year > year_text(lo)) | (quarter >= quarter_label(lo)))
                         & ((year < year_text(hi)) | (quarter <= quarter_label(hi))))
    return df.where(cond)


def pipeline_counts(raw_df: DataFrame, staged: DataFrame) -> DataFrame:
    """A14 / ST8: produced, valid, failed (one pass over raw) and transformed rows."""
    valid = F.count(F.when(staging_filter(), F.lit(1)))
    return raw_df.agg(
        F.count(F.lit(1)).alias("records_produced"),
        valid.alias("records_valid"),
        (F.count(F.lit(1)) - valid).alias("records_failed"),
    ).withColumn("records_transformed", staged.select(F.count(F.lit(1))).scalar())


def analytics(df: DataFrame, metric: str, group_by: str = "mcc_code", city: str | None = None,
              limit: int | None = 10) -> DataFrame:
    """The analytics call by metric name (the reference's analytics endpoint):
    ``review_velocity`` | ``avg_transaction`` | ``mcc_distribution`` | ``acceptance_methods``
    | ``summary`` | ``anomaly_flags`` | ``q4_spending``."""
    if metric == "review_velocity":
        return review_velocity(df, group_by, city, limit)
    if metric == "avg_transaction":
        return avg_transaction(df, group_by, city, limit)
    if metric == "mcc_distribution":
        return mcc_distribution(df, city, limit)
    if metric in ("acceptance", "acceptance_methods"):
        return acceptance_distribution(df, city)
    if metric == "summary":
        return summary(_city_filter(df, city))
    if metric == "anomaly_flags":
        return anomaly_flags(_city_filter(df, city), limit)
    if metric == "q4_spending":
        return q4_spending(_city_filter(df, city), limit)
    raise ValueError(f"unknown metric {metric!r}")
