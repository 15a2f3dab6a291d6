"""Registered queries: expectation suites, model tests, validation, freshness, anomalies."""

from __future__ import annotations

from merchlens import constants as K
from merchlens.operators import anomaly as N
from merchlens.operators import models as M
from merchlens.operators import quality as Q
from merchlens.plans.catalog import register
from merchlens.plans.q_models import latest_of, stg_of
from merchlens.plans.sqltext import dr, dt, sql_list, with_ctes
from merchlens.session import materialize, scratch_dir
from merchlens.sources import fixtures as FX
from merchlens.sources.files import read_runs, write_run

AS_OF = "2001-11-05 00:00:00"
RAW_TEXT_COLS = {"transaction_id", "merchant_id", "merchant_name", "mcc_code", "mcc_description", "city",
                 "state", "neighborhood", "acceptance_method", "categories", "transaction_value_tier",
                 "transaction_quarter", "transaction_year", "price_symbol"}


def _check_sql(ch: Q.Check) -> tuple[str, str, str]:
    """(failure-count aggregate, observed text over n/total, success predicate) in DuckDB."""
    c = ch.column
    if ch.kind == "row_count":
        return "count(*)", "CAST(n AS VARCHAR)", f"n BETWEEN {ch.lo} AND {ch.hi}"
    if ch.kind == "not_null":
        blank = f"{c} IS NULL OR {c} = ''" if c in RAW_TEXT_COLS else f"{c} IS NULL"
        pct = dt("coalesce(CAST(n AS DOUBLE) * 100 / nullif(total, 0), 0.0)", 1)
        return (f"count(CASE WHEN {blank} THEN 1 END)",
                f"CAST(n AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' null (' || {pct} || '%)'", "n = 0")
    if ch.kind == "in_set":
        vals = sql_list([str(v).lower() for v in ch.values])
        return (f"count(CASE WHEN {c} IS NOT NULL AND lower(CAST({c} AS VARCHAR)) NOT IN ({vals}) THEN 1 END)",
                "CAST(n AS VARCHAR) || ' invalid values'", "n = 0")
    if ch.kind == "between":
        return (f"count(CASE WHEN {c} IS NOT NULL AND NOT (CAST({c} AS DOUBLE) BETWEEN {ch.lo} AND {ch.hi}) THEN 1 END)",
                "CAST(n AS VARCHAR) || ' out-of-range'", "n = 0")
    if ch.kind == "unique":
        return f"count({c}) - count(DISTINCT {c})", "CAST(n AS VARCHAR) || ' duplicates'", "n = 0"
    if ch.kind == "pair_not_null":
        return (f"count(CASE WHEN {c} IS NOT NULL AND {ch.other} IS NULL THEN 1 END)",
                f"CAST(n AS VARCHAR) || ' records with {c} set but {ch.other} null'", "n = 0")
    raise ValueError(ch.kind)


def suite_sql(checks: list[Q.Check], source: str, suite: str) -> str:
    aggs = ["count(*) AS total"] + [f"{_check_sql(ch)[0]} AS f{i}" for i, ch in enumerate(checks)]
    parts = []
    for i, ch in enumerate(checks):
        _, obs, ok = _check_sql(ch)
        failures = "CAST(0 AS BIGINT)" if ch.kind == "row_count" else "n"
        name = ch.name.replace("'", "''")
        expected = ch.expected.replace("'", "''")
        parts.append(
            f"SELECT '{suite}' AS suite_name, {i + 1} AS check_no, '{name}' AS expectation, "
            f"({ok}) AS success, {obs} AS observed, '{expected}' AS expected, {failures} AS failures "
            f"FROM (SELECT total, f{i} AS n FROM agg_{suite})")
    return f"SELECT {', '.join(aggs)} FROM {source}", "\nUNION ALL\n".join(parts)


def _suite_query(checks, source_cte: str, suite: str) -> tuple[list[tuple[str, str]], str]:
    agg, body = suite_sql(checks, source_cte, suite)
    return [(f"agg_{suite}", agg)], body


_RAW_LOCAL, _RAW_BODY = _suite_query(Q.raw_suite(), "raw_txn", "raw_merchant_transactions")
_STG_LOCAL, _STG_BODY = _suite_query(Q.staging_suite(), "stg", "stg_merchant_transactions")


def _raw_suite(spark, sf):
    return Q.run_suite(M.raw(FX.raw_txn(spark, sf)), Q.raw_suite(), "raw_merchant_transactions")


def _stg_suite(spark, sf):
    return Q.run_suite(stg_of(spark, sf), Q.staging_suite(), "stg_merchant_transactions")


@register("dq_raw_suite", with_ctes(_RAW_BODY, "raw_txn", local=_RAW_LOCAL), ids=("Q1", "Q2", "Q3", "Q4", "Q5", "Q6", "Q7"))
def q_dq_raw_suite(spark, sf):
    return _raw_suite(spark, sf)


@register("dq_staging_suite", with_ctes(_STG_BODY, "stg", local=_STG_LOCAL), ids=("Q8",))
def q_dq_staging_suite(spark, sf):
    return _stg_suite(spark, sf)


def _samples_sql(checks, source: str, suite: str) -> str:
    parts = []
    for i, ch in enumerate(checks, 1):
        if ch.kind == "row_count":
            continue
        c = ch.column
        if ch.kind == "unique":
            body = f"SELECT {c} AS id, CAST(count(*) AS VARCHAR) AS value FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1"
        else:
            cond = _check_sql(ch)[0].removeprefix("count(CASE WHEN ").removesuffix(" THEN 1 END)")
            body = f"SELECT transaction_id AS id, CAST({c} AS VARCHAR) AS value FROM {source} WHERE {cond}"
        parts.append(f"SELECT {i} AS check_no, '{ch.name.replace(chr(39), chr(39) * 2)}' AS expectation, * FROM ({body})")
    return f"""SELECT '{suite}' AS suite_name, check_no, expectation, sample_no, id AS transaction_id, value FROM (
SELECT *, row_number() OVER (PARTITION BY check_no ORDER BY id NULLS FIRST, value NULLS FIRST) AS sample_no
FROM ({" UNION ALL ".join(parts)})) WHERE sample_no <= 5"""


@register("dq_raw_samples", with_ctes(_samples_sql(Q.raw_suite(), "raw_txn", "raw_merchant_transactions"), "raw_txn"), ids=("T4",))
def q_dq_raw_samples(spark, sf):
    """Written at once (a few rows a check), so that the passes over the ids get partitions by the size of the tables."""
    with FX.partitions_by_size(spark, sf):
        return materialize(Q.failed_samples(M.raw(FX.raw_txn(spark, sf)), Q.raw_suite(), "raw_merchant_transactions"), "failed-samples")


_REPORT_BODY = f"""
SELECT suite_name, count(*) AS evaluated_expectations,
       count(CASE WHEN success THEN 1 END) AS successful_expectations,
       count(*) - count(CASE WHEN success THEN 1 END) AS unsuccessful_expectations,
       {dt('CAST(count(CASE WHEN success THEN 1 END) AS DOUBLE) * 100 / count(*)', 1)} || '%' AS success_percent,
       count(CASE WHEN success THEN 1 END) = count(*) AS success
FROM ({_RAW_BODY}
UNION ALL
{_STG_BODY}) GROUP BY suite_name"""


@register("dq_report", with_ctes(_REPORT_BODY, "raw_txn", "stg", local=_RAW_LOCAL + _STG_LOCAL), ids=("Q9", "S13"))
def q_dq_report(spark, sf):
    """The report is kept per run and read back."""
    path = scratch_dir(spark, "dq-reports")
    write_run(Q.suite_report(_raw_suite(spark, sf)), path, "raw")
    write_run(Q.suite_report(_stg_suite(spark, sf)), path, "staging")
    return read_runs(spark, path).drop("run_id")


def _tests_sql(model: str, source: str, tests) -> str:
    parts = []
    for col, test, arg in tests:
        if test == "unique":
            e = f"count({col}) - count(DISTINCT {col})"
        elif test == "not_null":
            e = f"count(CASE WHEN {col} IS NULL THEN 1 END)"
        elif test == "accepted_values":
            e = f"count(CASE WHEN NOT ({col} IN ({sql_list(arg)})) THEN 1 END)"
        else:
            e = f"count(CASE WHEN NOT ({col} {arg}) THEN 1 END)"
        parts.append(f"SELECT '{model}' AS model, '{col}' AS column_name, '{test}' AS test, n AS failures, "
                     f"CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT {e} AS n FROM {source})")
    return "\nUNION ALL\n".join(parts)


_MODEL_TESTS_BODY = "\nUNION ALL\n".join([
    _tests_sql("raw_merchant_transactions", "raw_txn", Q.SOURCE_TESTS),
    _tests_sql("stg_merchant_transactions", "stg", Q.STAGING_TESTS),
    _tests_sql("mart_merchant_intelligence", "mart", Q.MART_TESTS),
])


@register("dq_model_tests", with_ctes(_MODEL_TESTS_BODY, "raw_txn", "stg", "mart"), ids=("Q10",))
def q_dq_model_tests(spark, sf):
    stg = materialize(stg_of(spark, sf), "model-tests-staging")
    return (Q.model_test(FX.raw_txn(spark, sf), "raw_merchant_transactions", Q.SOURCE_TESTS)
            .unionByName(Q.model_test(stg, "stg_merchant_transactions", Q.STAGING_TESTS))
            .unionByName(Q.model_test(M.mart(stg), "mart_merchant_intelligence", Q.MART_TESTS)))


_MISSING = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in Q.REQUIRED_FIELDS)
_MCC = "coalesce(CASE WHEN length(mcc_code) < 4 THEN lpad(mcc_code, 4, '0') ELSE mcc_code END, 'None')"
_VALID_LOCAL = [("v", f"""
SELECT merchant_id, list_filter([
  CASE WHEN len(list_filter([{_MISSING}], lambda x: x IS NOT NULL)) > 0
       THEN 'Missing fields: ' || array_to_string(list_filter([{_MISSING}], lambda x: x IS NOT NULL), ', ') END,
  CASE WHEN {_MCC} NOT IN ({sql_list(K.VALIDATION_VALID_MCC)})
       THEN 'Invalid MCC code: ' || {_MCC} END,
  CASE WHEN transaction_amount IS NULL THEN 'Non-numeric amount: None'
       WHEN NOT (CAST(transaction_amount AS DOUBLE) BETWEEN 0.01 AND 99999.99)
       THEN 'Amount out of range: ' || CAST(CAST(transaction_amount AS DOUBLE) AS VARCHAR) END,
  CASE WHEN merchant_id IS NOT NULL AND coalesce(merchant_name, '') = ''
       THEN 'merchant_id set but merchant_name is null' END
  ], lambda x: x IS NOT NULL) AS iss
FROM latest"""),
    ("vr", """SELECT merchant_id, CAST(len(iss) AS BIGINT) AS n_issues, array_to_string(iss, '; ') AS issues,
       len(iss) = 0 AS passed FROM v""")]


def _validation(spark, sf):
    return Q.validate_records(latest_of(spark, sf))


@register("validation_records", with_ctes("SELECT * FROM vr", "latest", local=_VALID_LOCAL), ids=("Q11", "U3"))
def q_validation_records(spark, sf):
    return _validation(spark, sf)


@register("validation_summary", with_ctes(f"""
SELECT count(*) AS total, count(CASE WHEN passed THEN 1 END) AS passed,
       count(*) - count(CASE WHEN passed THEN 1 END) AS failed,
       {dt('coalesce(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0.0) * 100', 1)} || '%'
         AS pass_rate,
       CASE WHEN coalesce(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0.0) >= 0.95
            THEN 'pass' ELSE 'fail' END AS status,
       coalesce(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0.0) >= 0.95
         AS ready_for_embedding
FROM vr""", "latest", local=_VALID_LOCAL), ids=("Q11",))
def q_validation_summary(spark, sf):
    return Q.validation_summary(_validation(spark, sf))


@register("validation_issues_sample", with_ctes(
    "SELECT * FROM vr WHERE NOT passed ORDER BY merchant_id LIMIT 5", "latest", local=_VALID_LOCAL), ids=("T4",))
def q_validation_issues_sample(spark, sf):
    return Q.issues_sample(_validation(spark, sf))


_AGE = (f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(transaction_at, ingested_at)))"
        " / 86400000000.0) AS BIGINT)")
_FRESH_LOCAL = [("fr", f"""
SELECT merchant_id, merchant_name, {_AGE} AS age_days,
       CASE WHEN coalesce(transaction_at, ingested_at) IS NULL THEN 'critical'
            WHEN {_AGE} >= 7 THEN 'critical' WHEN {_AGE} >= 3 THEN 'warning' ELSE 'fresh' END AS status,
       CASE WHEN coalesce(transaction_at, ingested_at) IS NULL THEN 'No timestamp available' END AS reason
FROM latest""")]


@register("freshness_records", with_ctes("SELECT * FROM fr", "latest", local=_FRESH_LOCAL), ids=("Q12",))
def q_freshness_records(spark, sf):
    return Q.freshness(latest_of(spark, sf), AS_OF)


@register("freshness_report", with_ctes(f"""
SELECT CASE WHEN CAST(count(CASE WHEN status = 'critical' THEN 1 END) AS DOUBLE) / greatest(count(*), 1) > 0.1
            THEN 'critical' WHEN count(CASE WHEN status = 'warning' THEN 1 END) > 0 THEN 'warning'
            ELSE 'healthy' END AS status,
       count(*) AS total, count(CASE WHEN status = 'fresh' THEN 1 END) AS fresh,
       count(CASE WHEN status = 'warning' THEN 1 END) AS stale_warning,
       count(CASE WHEN status = 'critical' THEN 1 END) AS stale_critical,
       {dt("coalesce(CAST(count(CASE WHEN status = 'fresh' THEN 1 END) AS DOUBLE) * 100 / nullif(count(*), 0), 0.0)", 1)}
         || '%' AS freshness_pct
FROM fr""", "latest", local=_FRESH_LOCAL), ids=("Q12", "L11"))
def q_freshness_report(spark, sf):
    return Q.freshness_report(Q.freshness(latest_of(spark, sf), AS_OF))


_NAME = "coalesce(CAST(merchant_name AS VARCHAR), 'None')"
_ANOM_LOCAL = [
    ("sa", """SELECT count(*) AS n, avg(coalesce(transaction_amount, 0.0)) AS mu,
       stddev_samp(coalesce(transaction_amount, 0.0)) AS sd FROM latest"""),
    ("fa", """SELECT merchant_id, merchant_name, coalesce(transaction_amount, 0.0) AS value,
       (coalesce(transaction_amount, 0.0) - sa.mu) / coalesce(nullif(sa.sd, 0), 1.0) AS _z, sa.mu AS _mu, sa.n
FROM latest CROSS JOIN sa"""),
    ("amount_out", f"""SELECT 'amount_outlier' AS type, merchant_id, merchant_name, value, {dr('_z', 2)} AS z_score,
       CASE WHEN _z > 0 THEN 'high' ELSE 'low' END AS direction, {dr('_mu', 2)} AS mean,
       {_NAME} || ' has an unusually ' || CASE WHEN _z > 0 THEN 'high' ELSE 'low' END || ' average transaction of $'
         || {dt('value', 2)} || ' (global mean: $' || {dt('_mu', 2)} || ', z=' || {dt('_z', 2)}
         || '). This may indicate ' || CASE WHEN _z > 0 THEN 'premium positioning'
                                          ELSE 'discount/fast-casual operation' END || '.' AS narrative
FROM fa WHERE n > 3 AND abs(_z) >= 2.5"""),
    ("sv", """SELECT count(*) AS n, coalesce(nullif(avg(CAST(coalesce(review_velocity_30d, 0) AS DOUBLE)), 0), 1.0)
       AS mv FROM latest"""),
    ("vel_out", f"""SELECT 'review_velocity_spike' AS type, merchant_id, merchant_name,
       CAST(coalesce(review_velocity_30d, 0) AS BIGINT) AS velocity, {dr('sv.mv', 1)} AS mean_velocity,
       {dr('coalesce(review_velocity_30d, 0) / sv.mv', 1)} AS spike_factor,
       {_NAME} || ' is receiving ' || CAST(coalesce(review_velocity_30d, 0) AS VARCHAR) || ' reviews/30d — '
         || {dt('coalesce(review_velocity_30d, 0) / sv.mv', 1)} || 'x the dataset average of ' || {dt('sv.mv', 1)}
         || '. This signals strong viral growth or a recent viral event.' AS narrative
FROM latest CROSS JOIN sv
WHERE sv.n > 3 AND coalesce(review_velocity_30d, 0) > sv.mv * 3.0 AND coalesce(review_velocity_30d, 0) > 10"""),
    ("ss", """SELECT count(r) AS n, avg(r) AS mu,
       CASE WHEN count(r) > 1 THEN coalesce(nullif(stddev_samp(r), 0), 0.5) ELSE 0.5 END AS sd
FROM (SELECT CASE WHEN coalesce(stars, 0.0) <> 0 THEN stars END AS r FROM latest)"""),
    ("fs", """SELECT merchant_id, merchant_name, stars, (stars - ss.mu) / ss.sd AS _z, ss.mu AS _mu
FROM latest CROSS JOIN ss WHERE stars > 0"""),
    ("star_out", f"""SELECT 'low_star_outlier' AS type, merchant_id, merchant_name, stars, {dr('_z', 2)} AS z_score,
       {_NAME} || ' has a significantly low rating of ' || CAST(stars AS VARCHAR) || ' stars (mean: '
         || {dt('_mu', 2)} || ', z=' || {dt('_z', 2)} || '). May warrant customer experience review.' AS narrative
FROM fs WHERE _z < -2.5"""),
    ("anoms", """SELECT * FROM amount_out UNION ALL BY NAME SELECT * FROM vel_out
UNION ALL BY NAME SELECT * FROM star_out"""),
]


@register("anomaly_amount_outlier", with_ctes("SELECT * FROM amount_out", "latest", local=_ANOM_LOCAL[:3]),
          ids=("N1", "N6"))
def q_anomaly_amount(spark, sf):
    return N.amount_outliers(latest_of(spark, sf))


@register("anomaly_velocity_spike", with_ctes("SELECT * FROM vel_out", "latest", local=_ANOM_LOCAL[3:5]),
          ids=("N2", "N6"))
def q_anomaly_velocity(spark, sf):
    return N.velocity_spikes(latest_of(spark, sf))


@register("anomaly_low_star", with_ctes("SELECT * FROM star_out", "latest", local=_ANOM_LOCAL[5:8]),
          ids=("N3", "N6"))
def q_anomaly_low_star(spark, sf):
    return N.low_stars(latest_of(spark, sf))


@register("anomalies_all", with_ctes("SELECT * FROM anoms", "latest", local=_ANOM_LOCAL), ids=("U2",))
def q_anomalies_all(spark, sf):
    return N.all_anomalies(latest_of(spark, sf))


@register("anomaly_type_counts", with_ctes(
    "SELECT type, count(*) AS anomaly_count FROM anoms GROUP BY type", "latest", local=_ANOM_LOCAL), ids=("A16",))
def q_anomaly_type_counts(spark, sf):
    return N.type_counts(N.all_anomalies(latest_of(spark, sf)))


_TYPE_RANK = "CASE type WHEN 'amount_outlier' THEN 1 WHEN 'review_velocity_spike' THEN 2 ELSE 3 END"
_HEALTH_LOCAL = _VALID_LOCAL + _FRESH_LOCAL + _ANOM_LOCAL + [
    ("vs", f"""SELECT count(*) AS total, count(CASE WHEN passed THEN 1 END) AS passed,
       {dt('coalesce(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0.0) * 100', 1)} || '%'
         AS pass_rate,
       CASE WHEN coalesce(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / nullif(count(*), 0), 0.0) >= 0.95
            THEN 'pass' ELSE 'fail' END AS status FROM vr"""),
    ("frs", """SELECT CASE WHEN CAST(count(CASE WHEN status = 'critical' THEN 1 END) AS DOUBLE) / greatest(count(*), 1) > 0.1
            THEN 'critical' WHEN count(CASE WHEN status = 'warning' THEN 1 END) > 0 THEN 'warning'
            ELSE 'healthy' END AS status,
       count(CASE WHEN status = 'fresh' THEN 1 END) AS fresh,
       count(CASE WHEN status = 'critical' THEN 1 END) AS stale_critical FROM fr"""),
    ("tc", f"SELECT type, count(*) AS n, {_TYPE_RANK} AS k FROM anoms GROUP BY type"),
    ("an_text", f"""SELECT (SELECT count(*) FROM anoms) AS total,
       (SELECT string_agg(type || ': ' || CAST(n AS VARCHAR), ' | ' ORDER BY k, type, n) FROM tc) AS counts,
       (SELECT string_agg('  • ' || narrative, chr(10) ORDER BY k, merchant_id, narrative) FROM (
          SELECT {_TYPE_RANK} AS k, merchant_id, narrative FROM anoms ORDER BY k, merchant_id LIMIT 3)) AS top3"""),
]


@register("health_summary", with_ctes(f"""
SELECT vs.status AS validation_status, vs.pass_rate, frs.status AS freshness_status, a.total AS anomaly_count,
       'Agent Pipeline Summary — Task: pipeline_health_check' || chr(10) || chr(10)
       || 'Data Validation: ' || upper(vs.status) || ' | ' || CAST(vs.passed AS VARCHAR) || '/'
       || CAST(vs.total AS VARCHAR) || ' records passed (' || vs.pass_rate || ')' || chr(10)
       || 'Data Freshness: ' || upper(frs.status) || ' | ' || CAST(frs.fresh AS VARCHAR) || ' fresh, '
       || CAST(frs.stale_critical AS VARCHAR) || ' critical' || chr(10)
       || CASE WHEN a.total > 0 THEN 'Anomalies Detected: ' || CAST(a.total AS VARCHAR) || ' total | ' || a.counts
               || chr(10) || chr(10) || 'Top anomalies:' || chr(10) || a.top3
               ELSE 'Anomalies Detected: None' END AS summary
FROM vs, frs, an_text a""", "latest", local=_HEALTH_LOCAL), ids=("N7",))
def q_health_summary(spark, sf):
    return N.health_summary(latest_of(spark, sf), AS_OF)
