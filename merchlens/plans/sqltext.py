"""DuckDB text for the oracle side of every registered query.

The oracle is an independent, plain-SQL statement of each operator's semantics,
run by DuckDB over the same Parquet tables.  Shared CTEs below mirror the
fixtures and the staging / mart models; ``with_ctes`` assembles only the CTEs a
statement needs, in dependency order.
"""

from __future__ import annotations

from merchlens import constants as K
from merchlens.sources import fixtures as FX


def dr(expr: str, n: int) -> str:
    """SQL twin of numeric.dround."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)), {n}) AS DOUBLE)"


def dt(expr: str, n: int) -> str:
    """SQL twin of numeric.dec_text."""
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(28,8)), {n}) AS DECIMAL(28,{n})) AS VARCHAR)"


def tier(expr: str) -> str:
    return (f"CASE WHEN {expr} < {K.TIER_LOW_BELOW} THEN 'low' "
            f"WHEN {expr} < {K.TIER_MID_BELOW} THEN 'mid' ELSE 'high' END")


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{K.TOKEN_PATTERN}')"


STG_COLS = (
    "transaction_id, merchant_id, merchant_name, transaction_amount, mcc_code, mcc_description, city, state, "
    "neighborhood, latitude, longitude, transaction_at, acceptance_method, stars, review_count, "
    "review_velocity_30d, categories, is_open, price_range, ingested_at, transaction_value_tier, "
    "price_symbol, transaction_quarter, transaction_year"
)

MART_GROUP = ("merchant_id, merchant_name, city, state, neighborhood, latitude, longitude, mcc_code, "
              "mcc_description, categories, price_range, price_symbol, is_open")

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("raw_txn", [], FX.as_duckdb(FX.RAW_TXN_SQL))
cte("stream_txn", [], FX.as_duckdb(FX.STREAM_TXN_SQL))
cte("questions", [], FX.QUESTIONS_SQL)
cte("turn_pairs", [], FX.as_duckdb(FX.TURN_PAIRS_SQL))

cte("stg_clean", ["raw_txn"], f"""
SELECT transaction_id, merchant_id, trim(merchant_name) AS merchant_name,
       {dr('CAST(transaction_amount AS DOUBLE)', 2)} AS transaction_amount,
       lpad(CAST(mcc_code AS VARCHAR), 4, '0') AS mcc_code, mcc_description,
       trim(city) AS city, upper(trim(state)) AS state,
       coalesce(nullif(trim(neighborhood), ''), city) AS neighborhood,
       CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude,
       CAST(ts AS TIMESTAMP) AS transaction_at, lower(acceptance_method) AS acceptance_method,
       CAST(stars AS DOUBLE) AS stars, CAST(review_count AS INTEGER) AS review_count,
       CAST(review_velocity_30d AS INTEGER) AS review_velocity_30d, categories,
       CAST(is_open AS BOOLEAN) AS is_open, CAST(coalesce(price_range, 2) AS INTEGER) AS price_range,
       CAST(ingested_at AS TIMESTAMP) AS ingested_at, tb1, tb2, tb3
FROM raw_txn
WHERE transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND transaction_amount > 0
  AND transaction_amount < {K.STAGING_AMOUNT_CAP} AND city IS NOT NULL
""")

cte("stg_enriched", ["stg_clean"], f"""
SELECT *, {tier('transaction_amount')} AS transaction_value_tier,
       repeat('$', price_range) AS price_symbol,
       'Q' || CAST(quarter(transaction_at) AS VARCHAR) AS transaction_quarter,
       strftime(transaction_at, '%Y') AS transaction_year
FROM stg_clean
""")

cte("stg", ["stg_enriched"], f"""
SELECT {STG_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id
         ORDER BY ingested_at DESC NULLS LAST, transaction_at DESC NULLS LAST,
                  tb1 DESC NULLS LAST, tb2 DESC NULLS LAST, tb3 DESC NULLS LAST) AS rn
  FROM stg_enriched) WHERE rn = 1
""")

_acc = ",\n       ".join(
    f"count(CASE WHEN acceptance_method = '{m}' THEN 1 END) AS {m}_count" for m in K.ACCEPTANCE_METHODS)
_tiers = ",\n       ".join(
    f"count(CASE WHEN transaction_value_tier = '{t}' THEN 1 END) AS {t}_value_txns" for t in K.VALUE_TIERS)
_qs = ",\n       ".join(
    f"count(CASE WHEN transaction_quarter = '{q}' THEN 1 END) AS {q.lower()}_transactions" for q in K.QUARTERS)

cte("mart_agg", ["stg"], f"""
SELECT {MART_GROUP},
       count(*) AS total_transactions,
       {dr('avg(transaction_amount)', 2)} AS avg_transaction_amount,
       CAST(round(sum(CAST(transaction_amount AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_transaction_volume,
       min(transaction_amount) AS min_transaction, max(transaction_amount) AS max_transaction,
       {dr('stddev_samp(transaction_amount)', 2)} AS stddev_transaction,
       {_acc},
       {_tiers},
       {_qs},
       {dr('avg(stars)', 4)} AS avg_stars, max(review_count) AS review_count,
       max(review_velocity_30d) AS review_velocity_30d,
       min(transaction_at) AS first_seen_at, max(transaction_at) AS last_seen_at,
       max(ingested_at) AS last_ingested_at
FROM stg
GROUP BY {MART_GROUP}
""")

cte("mart", ["mart_agg"], f"""
SELECT m.*,
       {dr('(m.avg_transaction_amount - a.g_avg) / nullif(a.g_sd, 0)', 2)} AS z_score_amount,
       coalesce(m.avg_transaction_amount > a.g_avg + 2 * a.g_sd, false) AS is_high_volume_anomaly,
       coalesce(m.q4_transactions * 2 > m.q1_transactions + m.q2_transactions + m.q3_transactions, false)
         AS is_q4_spending_spike
FROM mart_agg m
JOIN (SELECT merchant_id, avg(avg_transaction_amount) OVER () AS g_avg,
             stddev_samp(avg_transaction_amount) OVER () AS g_sd FROM mart_agg) a USING (merchant_id)
""")

cte("latest", ["stg"], f"""
SELECT {STG_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY transaction_at DESC NULLS LAST,
                                transaction_id DESC) AS rn FROM stg) WHERE rn = 1
""")


def with_ctes(body: str, *needed: str, local: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding ``needed`` CTEs and their dependencies, then
    statement-local CTEs ``local`` (name, text), then body."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1].strip()}\n)" for n in order]
    parts += [f"{n} AS (\n{t.strip()}\n)" for n, t in (local or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
