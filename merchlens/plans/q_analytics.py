"""Registered queries: analytics, listing and lookups over the latest-per-merchant corpus."""

from __future__ import annotations

from merchlens.operators import analytics as A
from merchlens.operators import models as M
from merchlens.plans.catalog import register
from merchlens.plans.q_models import latest_of, stg_of
from merchlens.plans.sqltext import dr, dt, tier, with_ctes
from merchlens.sources import fixtures as FX

GROUP_SQL = {
    "mcc_code": "concat_ws(' — ', mcc_code, mcc_description)",
    "city": "city",
    "neighborhood": "coalesce(nullif(neighborhood, ''), city)",
    "value_tier": tier("transaction_amount"),
}


def _velocity_sql(by: str) -> str:
    return with_ctes(f"""
SELECT {GROUP_SQL[by]} AS group_key,
       {dr('avg(coalesce(review_velocity_30d, 0))', 1)} AS avg_velocity,
       max(coalesce(review_velocity_30d, 0)) AS max_velocity,
       count(*) AS merchant_count,
       CAST(sum(coalesce(review_count, 0)) AS BIGINT) AS total_reviews
FROM latest GROUP BY 1 ORDER BY avg_velocity DESC, group_key LIMIT 10""", "latest")


def _avg_txn_sql(by: str) -> str:
    return with_ctes(f"""
SELECT {GROUP_SQL[by]} AS group_key,
       {dr('avg(transaction_amount)', 2)} AS avg_transaction,
       {dr('median(transaction_amount)', 2)} AS median_transaction,
       CAST(round(sum(CAST(transaction_amount AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_volume,
       count(*) AS merchant_count
FROM latest GROUP BY 1 ORDER BY avg_transaction DESC, group_key LIMIT 10""", "latest")


def _rename(df):
    return df.withColumnRenamed("group", "group_key")


for _by, _suffix in [("mcc_code", ""), ("city", "_by_city"), ("neighborhood", "_by_neighborhood"),
                     ("value_tier", "_by_value_tier")]:
    def _mk_vel(by):
        return lambda spark, sf: _rename(A.review_velocity(latest_of(spark, sf), group_by=by))

    def _mk_avg(by):
        return lambda spark, sf: _rename(A.avg_transaction(latest_of(spark, sf), group_by=by))

    register(f"analytics_review_velocity{_suffix}", _velocity_sql(_by), ids=("A6", "A8"))(_mk_vel(_by))
    register(f"analytics_avg_transaction{_suffix}", _avg_txn_sql(_by), ids=("A7", "A8"))(_mk_avg(_by))


@register("analytics_mcc_distribution", with_ctes(f"""
SELECT {GROUP_SQL['mcc_code']} AS mcc, count(*) AS merchant_count
FROM latest GROUP BY 1 ORDER BY merchant_count DESC, mcc LIMIT 10""", "latest"), ids=("A10", "T2"))
def q_mcc_distribution(spark, sf):
    return A.mcc_distribution(latest_of(spark, sf))


@register("analytics_acceptance", with_ctes(f"""
SELECT acceptance_method AS method, count(*) AS merchant_count,
       {dt('CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM latest)', 1)} || '%' AS pct
FROM latest GROUP BY 1""", "latest"), ids=("A11",))
def q_acceptance(spark, sf):
    return A.acceptance_distribution(latest_of(spark, sf))


@register("analytics_summary", with_ctes(f"""
SELECT count(*) AS total_merchants,
       count(CASE WHEN is_open THEN 1 END) AS open_merchants,
       {dr('avg(transaction_amount)', 2)} AS avg_transaction,
       coalesce({dr('avg(CASE WHEN stars <> 0 THEN stars END)', 2)}, 0.0) AS avg_stars,
       CAST(sum(coalesce(review_count, 0)) AS BIGINT) AS total_reviews,
       {dr('avg(coalesce(review_velocity_30d, 0))', 1)} AS avg_velocity_30d
FROM latest""", "latest"), ids=("A12",))
def q_summary(spark, sf):
    return A.summary(latest_of(spark, sf))


@register("analytics_top_mcc", with_ctes("""
SELECT mcc_description AS mcc, count(*) AS merchant_count
FROM latest GROUP BY 1 ORDER BY merchant_count DESC, mcc LIMIT 5""", "latest"), ids=("A12", "T2"))
def q_top_mcc(spark, sf):
    return A.top_mcc_categories(latest_of(spark, sf))


_FLAGS_LOCAL = [
    ("s", """SELECT avg(transaction_amount) AS mu,
       CASE WHEN count(transaction_amount) > 1 THEN stddev_samp(transaction_amount) ELSE 1.0 END AS sd,
       avg(CAST(coalesce(review_velocity_30d, 0) AS DOUBLE)) AS mv FROM latest"""),
    ("f", """SELECT l.*, coalesce((transaction_amount - s.mu) / nullif(s.sd, 0), 0) AS _z,
       coalesce(review_velocity_30d, 0) / coalesce(nullif(s.mv, 0), 1) AS _r
FROM latest l CROSS JOIN s"""),
]


@register("analytics_anomaly_flags", with_ctes(f"""
SELECT merchant_name, merchant_id, city, mcc_description, transaction_amount, {dr('_z', 2)} AS z_score,
       review_velocity_30d AS review_velocity, {dr('_r', 2)} AS velocity_ratio,
       CASE WHEN _z > 2 THEN 'high_amount' WHEN _z < -2 THEN 'low_amount' ELSE 'velocity_spike' END AS anomaly_type
FROM f WHERE abs(_z) >= 2 OR _r >= 2.5
ORDER BY abs(z_score) DESC, merchant_id LIMIT 10""", "latest", local=_FLAGS_LOCAL), ids=("N4", "T3"))
def q_anomaly_flags(spark, sf):
    return A.anomaly_flags(latest_of(spark, sf))


@register("analytics_q4_spending", with_ctes(f"""
SELECT merchant_name, merchant_id, city, mcc_description, transaction_amount AS avg_transaction,
       {dt('(transaction_amount - s.mu) * 100.0 / s.mu', 0)} || '%' AS above_mean_by_pct
FROM latest CROSS JOIN (SELECT avg(transaction_amount) AS mu FROM latest) s
WHERE transaction_amount > s.mu * 1.3
ORDER BY avg_transaction DESC, merchant_id LIMIT 10""", "latest"), ids=("N5",))
def q_q4_spending(spark, sf):
    return A.q4_spending(latest_of(spark, sf))


@register("analytics_q4_actual", with_ctes(f"""
SELECT merchant_id, q4_avg, rest_avg, q4_txns,
       {dt('(q4_avg - rest_avg) * 100.0 / rest_avg', 0)} || '%' AS above_rest_by_pct
FROM (SELECT merchant_id,
             {dr("avg(CASE WHEN transaction_quarter = 'Q4' THEN transaction_amount END)", 2)} AS q4_avg,
             {dr("avg(CASE WHEN transaction_quarter <> 'Q4' THEN transaction_amount END)", 2)} AS rest_avg,
             count(CASE WHEN transaction_quarter = 'Q4' THEN 1 END) AS q4_txns
      FROM stg GROUP BY merchant_id)
WHERE q4_avg > rest_avg * 1.3""", "stg"), ids=("N5",))
def q_q4_actual(spark, sf):
    return A.q4_actual(stg_of(spark, sf))


@register("merchant_summary", with_ctes(f"""
SELECT a.merchant_id, n.merchant_name, n.city, n.state, n.neighborhood, n.mcc_code, n.mcc_description, a.avg_transaction,
       a.total_transactions, a.avg_stars, n.review_count AS total_reviews, n.review_velocity_30d AS review_velocity,
       n.categories, a.acceptance_methods, n.price_range, n.is_open, n.latitude AS lat, n.longitude AS lon
FROM (SELECT merchant_id, {dr('avg(transaction_amount)', 2)} AS avg_transaction, count(*) AS total_transactions,
             {dr('avg(stars)', 2)} AS avg_stars,
             array_to_string(list_sort(list_distinct(list(acceptance_method) FILTER (WHERE acceptance_method IS NOT NULL))), ',')
               AS acceptance_methods
      FROM stg GROUP BY merchant_id) a
JOIN (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_at DESC NULLS LAST, transaction_id DESC) AS rn
      FROM stg) n ON n.merchant_id = a.merchant_id AND n.rn = 1""", "stg"), ids=("A9",))
def q_merchant_summary(spark, sf):
    return A.merchant_summary(stg_of(spark, sf))


RECORD_SQL = f"""merchant_id, merchant_name, mcc_code, mcc_description, city, state, neighborhood, latitude,
       longitude, categories, stars, review_count, review_velocity_30d, transaction_amount,
       {tier('transaction_amount')} AS transaction_value_tier, acceptance_method, price_range,
       repeat('$', coalesce(price_range, 2)) AS price_symbol, is_open"""


@register("merchant_record", with_ctes(f"SELECT {RECORD_SQL} FROM latest", "latest"), ids=("P14",))
def q_merchant_record(spark, sf):
    return A.merchant_record(latest_of(spark, sf))


@register("merchant_list", with_ctes(f"""
SELECT {RECORD_SQL},
       (SELECT count(*) FROM latest WHERE coalesce(stars, 0) >= 4.0 AND is_open) AS total
FROM latest WHERE coalesce(stars, 0) >= 4.0 AND is_open
ORDER BY coalesce(stars, 0) DESC, merchant_id LIMIT 20 OFFSET 0""", "latest"), ids=("F2", "T1"))
def q_merchant_list(spark, sf):
    return A.list_merchants(latest_of(spark, sf), limit=20, offset=0, min_stars=4.0, open_only=True)


@register("merchant_list_city", with_ctes(f"""
SELECT {RECORD_SQL},
       (SELECT count(*) FROM latest WHERE lower(city) = 'nation_7' AND contains(lower(coalesce(neighborhood, '')), 'zone')
          AND transaction_amount >= 20 AND transaction_amount < 75) AS total
FROM latest WHERE lower(city) = 'nation_7' AND contains(lower(coalesce(neighborhood, '')), 'zone')
  AND transaction_amount >= 20 AND transaction_amount < 75
ORDER BY coalesce(stars, 0) DESC, merchant_id LIMIT 20 OFFSET 0""", "latest"), ids=("F2", "T1"))
def q_merchant_list_city(spark, sf):
    return A.list_merchants(latest_of(spark, sf), limit=20, offset=0, city="Nation_7",
                            neighborhood="Zone", value_tier_="mid")


@register("pipeline_counts", with_ctes("""
SELECT count(*) AS records_produced,
       count(CASE WHEN transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND transaction_amount > 0
                   AND transaction_amount < 100000 AND city IS NOT NULL THEN 1 END) AS records_valid,
       count(*) - count(CASE WHEN transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND transaction_amount > 0
                   AND transaction_amount < 100000 AND city IS NOT NULL THEN 1 END) AS records_failed,
       (SELECT count(*) FROM stg) AS records_transformed
FROM raw_txn""", "raw_txn", "stg"), ids=("A14", "ST8"))
def q_pipeline_counts(spark, sf):
    return A.pipeline_counts(FX.raw_txn(spark, sf), stg_of(spark, sf))
