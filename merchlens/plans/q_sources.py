"""Registered queries: business mapping, file round trips, upserts, envelopes, rebuild."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens import constants as K
from merchlens.operators import chunks as C
from merchlens.operators import mapping as P
from merchlens.operators import quality as Q
from merchlens.plans import q_retrieval  # noqa: F401  (the chunk CTEs)
from merchlens.plans.catalog import register
from merchlens.plans.q_models import latest_of, stg_of
from merchlens.plans.sqltext import cte, sql_list, with_ctes
from merchlens.session import materialize_sliced, scratch_dir, shuffles_removed
from merchlens.sources import files as S
from merchlens.sources import fixtures as FX
from merchlens.sources.upsert import upsert
from merchlens.streaming import ingest as I


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


cte("businesses", [], FX.as_duckdb(FX.BUSINESSES_SQL))
cte("cat_map", [], _values(K.CATEGORY_TO_MCC.items(), ["cat", "mcc"]))
cte("mcc_desc", [], _values(K.MCC_DESCRIPTIONS.items(), ["code", "descr"]))
cte("biz_mcc", ["businesses", "cat_map"], """
SELECT b.business_id, b.cats, coalesce(m.mcc, '5812') AS mcc_code FROM (
  SELECT business_id, list_filter(list_transform(string_split(categories, ','), lambda s: trim(s)), lambda s: s <> '')
         AS cats FROM businesses) b
LEFT JOIN (
  SELECT p.business_id, arg_min(c.mcc, p.i) AS mcc
  FROM (SELECT business_id, unnest(cats) AS cat, generate_subscripts(cats, 1) AS i FROM (
          SELECT business_id, list_filter(list_transform(string_split(categories, ','), lambda s: trim(s)),
                                          lambda s: s <> '') AS cats FROM businesses)) p
  JOIN cat_map c ON c.cat = p.cat GROUP BY p.business_id) m USING (business_id)""")

_PRICE = "coalesce(nullif(TRY_CAST(price_attr AS INTEGER), 0), 2)"
_EXPECTED = (f"CASE {_PRICE} " + " ".join(f"WHEN {k} THEN {v}" for k, v in K.PRICE_TO_AVG_TRANSACTION.items())
             + f" ELSE {K.DEFAULT_EXPECTED_AMOUNT} END")


def _biz(spark, sf):
    return FX.businesses(spark, sf)


@register("category_to_mcc", with_ctes("""
SELECT business_id, array_to_string(cats[1:5], '|') AS categories, mcc_code FROM biz_mcc""", "biz_mcc"),
          ids=("P1", "P2", "P6"))
def q_category_to_mcc(spark, sf):
    cats = P.categories_array("categories")
    return _biz(spark, sf).select("business_id", F.array_join(F.slice(cats, 1, 5), "|").alias("categories"),
                                  P.mcc_from_categories(cats).alias("mcc_code"))


@register("mcc_description_lookup", with_ctes("""
SELECT business_id, mcc_code, coalesce(d.descr, 'General Retail') AS mcc_description
FROM biz_mcc LEFT JOIN mcc_desc d ON d.code = mcc_code""", "biz_mcc", "mcc_desc"), ids=("P3", "J3"))
def q_mcc_description_lookup(spark, sf):
    df = _biz(spark, sf).select("business_id", P.mcc_from_categories(P.categories_array("categories")).alias("mcc_code"))
    return P.with_mcc_description(df)


@register("price_range_coerce", with_ctes(f"""
SELECT business_id, price_attr, CAST({_PRICE} AS INTEGER) AS price_range, {_EXPECTED} AS expected_amount
FROM businesses""", "businesses"), ids=("P4", "P5"))
def q_price_range_coerce(spark, sf):
    pr = P.price_range(F.col("price_attr"))
    return _biz(spark, sf).select("business_id", "price_attr", pr.alias("price_range"),
                                  P.expected_amount(pr).alias("expected_amount"))


_B2M_BODY = f"""
SELECT b.business_id AS merchant_id, coalesce(b.name, 'Unknown') AS merchant_name, m.mcc_code,
       coalesce(d.descr, 'General Retail') AS mcc_description, coalesce(b.city, '') AS city,
       coalesce(b.state, '') AS state, b.neighborhood, coalesce(b.latitude, 0.0) AS latitude,
       coalesce(b.longitude, 0.0) AS longitude, CAST(b.stars AS DOUBLE) AS stars,
       CAST(coalesce(b.review_count, 0) AS INTEGER) AS review_count,
       CAST(coalesce(b.review_velocity_30d, 0) AS INTEGER) AS review_velocity_30d,
       array_to_string(m.cats[1:5], ', ') AS categories, coalesce(b.is_open, 1) <> 0 AS is_open,
       CAST({_PRICE} AS INTEGER) AS price_range, CAST({_EXPECTED} AS DOUBLE) AS transaction_amount
FROM {{src}} b JOIN biz_mcc m USING (business_id) LEFT JOIN mcc_desc d ON d.code = m.mcc_code"""


@register("business_to_merchant", with_ctes(_B2M_BODY.format(src="businesses"), "businesses", "biz_mcc", "mcc_desc"),
          ids=("P7",))
def q_business_to_merchant(spark, sf):
    return P.business_to_merchant(_biz(spark, sf))


@register("category_contains", with_ctes("""
SELECT business_id, name, categories FROM businesses
WHERE list_bool_or(list_transform(string_split(lower(coalesce(categories, '')), ','), lambda c: contains(c, 'bar')))""",
    "businesses"), ids=("F5",))
def q_category_contains(spark, sf):
    return P.category_contains(_biz(spark, sf), "Bar").select("business_id", "name", "categories")


@register("neighborhood_contains", with_ctes("""
SELECT business_id, name, neighborhood FROM businesses
WHERE contains(lower(coalesce(neighborhood, '')), 'zone 3')""", "businesses"), ids=("F5",))
def q_neighborhood_contains(spark, sf):
    return P.neighborhood_contains(_biz(spark, sf), "Zone 3").select("business_id", "name", "neighborhood")


# ---------------------------------------------------------------- files

def _csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "staging-csv")
    raw = FX.raw_txn(spark, sf)
    (S.staging_csv_frame(raw).write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return S.read_staging_csv(spark, path)


_ROUNDTRIP_SQL = with_ctes(f"""
SELECT transaction_id, merchant_name, transaction_amount,
       CASE WHEN length(mcc_code) < 4 THEN lpad(mcc_code, 4, '0') ELSE mcc_code END AS mcc_code,
       neighborhood, CASE WHEN stars = 0 THEN NULL ELSE stars END AS stars,
       coalesce(review_count, 0) AS review_count, coalesce(review_velocity_30d, 0) AS review_velocity_30d,
       array_to_string(list_filter(list_transform(string_split(categories, ','), lambda s: trim(s)),
                                   lambda s: s <> ''), '|') AS categories,
       is_open <> 0 AS is_open, coalesce(nullif(price_range, 0), 2) AS price_range, ts
FROM raw_txn WHERE acceptance_method IN ({sql_list(K.ACCEPTANCE_METHODS)}) AND city IS NOT NULL""", "raw_txn")


def _roundtrip_cols(valid):
    return valid.select("transaction_id", "merchant_name", "transaction_amount", "mcc_code", "neighborhood", "stars",
                        "review_count", "review_velocity_30d", F.array_join("categories", "|").alias("categories"),
                        "is_open", "price_range", "ts")


@register("csv_staging_roundtrip", _ROUNDTRIP_SQL, ids=("S1", "S2"))
def q_csv_staging_roundtrip(spark, sf):
    valid, _ = _csv_roundtrip(spark, sf)
    return _roundtrip_cols(valid)


def _csv_reject_sql() -> str:
    missing = [f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in
               ("transaction_id", "merchant_id", "merchant_name", "mcc_code", "mcc_description", "city", "state")]
    acc = (f"CASE WHEN coalesce(acceptance_method, '') NOT IN ({sql_list(K.ACCEPTANCE_METHODS)}) "
           f"THEN 'bad acceptance_method' END")
    reason = "concat_ws('; ', " + ", ".join(missing + [acc]) + ")"
    return with_ctes(f"""
SELECT transaction_id, reason, CAST(NULL AS VARCHAR) AS _corrupt_record
FROM (SELECT transaction_id, {reason} AS reason FROM raw_txn) WHERE reason <> ''""", "raw_txn")


@register("csv_staging_load", _csv_reject_sql(), ids=("S1",))
def q_csv_staging_load(spark, sf):
    _, rejects = _csv_roundtrip(spark, sf)
    return rejects


# Regional feeds: these regions send JSON lines, every other region sends CSV.
_JSON_FEEDS = ("AMERICA", "ASIA", "EUROPE")


def _write_business_files(spark, sf):
    """Land every business record once in one folder, as regional feeds do:
    JSON lines from some regions, CSV from the rest, plus a file of an
    unsupported type."""
    folder = scratch_dir(spark, "landed")
    biz = _biz(spark, sf)
    is_json = F.col("state").isin(*_JSON_FEEDS)
    P.nest_business(biz.where(is_json)).write.mode("append").json(folder)
    biz.where(~is_json).select(
        "business_id", "name", "address", "city", "state", "postal_code", "latitude", "longitude", "stars",
        "review_count", "is_open", "categories", "neighborhood", "review_velocity_30d",
    ).write.mode("append").option("header", True).csv(folder)
    spark.createDataFrame([("ignored by suffix",)], "value string").write.mode("append").text(folder)
    return folder


@register("business_json_read", with_ctes(f"""
SELECT business_id, name, city, stars, price_attr AS price, parking_street,
       CASE WHEN is_open = 1 THEN 2 END AS n_hours
FROM businesses WHERE state IN ({sql_list(_JSON_FEEDS)})""", "businesses"), ids=("S9",))
def q_business_json_read(spark, sf):
    folder = _write_business_files(spark, sf)
    good, _ = S.read_business_json(spark, folder + "/*.json")
    return good.select("business_id", "name", "city", "stars", F.col("attributes.RestaurantsPriceRange2").alias("price"),
                       F.col("attributes.Parking").getItem("street").alias("parking_street"),
                       F.size("hours").alias("n_hours"))


@register("landed_files_ingest", with_ctes(
    _B2M_BODY.format(src="landed"), "businesses", "biz_mcc", "mcc_desc",
    local=[("landed", f"""SELECT * REPLACE (CASE WHEN state IN ({sql_list(_JSON_FEEDS)}) THEN price_attr END
                                   AS price_attr) FROM businesses""")]), ids=("S4",))
def q_landed_files_ingest(spark, sf):
    return S.ingest_landed(spark, _write_business_files(spark, sf))


# ---------------------------------------------------------------- upserts

def _line(col="transaction_id"):
    return F.element_at(F.split(F.col(col), "-"), 2).cast("int")


def _upsert_inputs(spark, sf):
    s = stg_of(spark, sf).select("transaction_id", "merchant_id", "transaction_amount")
    target = s.where(_line() <= 4)
    updates = s.where(_line() >= 4).withColumn("transaction_amount", F.col("transaction_amount") + 1)
    return target, updates


_UPS_LOCAL = [
    ("tgt", "SELECT transaction_id, merchant_id, transaction_amount FROM stg "
            "WHERE CAST(split_part(transaction_id, '-', 2) AS INTEGER) <= 4"),
    ("upd", "SELECT transaction_id, merchant_id, transaction_amount + 1 AS transaction_amount FROM stg "
            "WHERE CAST(split_part(transaction_id, '-', 2) AS INTEGER) >= 4"),
]


@register("upsert_replace", with_ctes("""
SELECT * FROM tgt WHERE transaction_id NOT IN (SELECT transaction_id FROM upd)
UNION ALL SELECT * FROM upd""", "stg", local=_UPS_LOCAL), ids=("S7",))
def q_upsert_replace(spark, sf):
    t, u = _upsert_inputs(spark, sf)
    return upsert(t, u, "transaction_id", "replace")


@register("upsert_ignore", with_ctes("""
SELECT * FROM tgt UNION ALL
SELECT * FROM upd WHERE transaction_id NOT IN (SELECT transaction_id FROM tgt)""", "stg", local=_UPS_LOCAL),
          ids=("S7", "J7", "L7"))
def q_upsert_ignore(spark, sf):
    t, u = _upsert_inputs(spark, sf)
    return upsert(t, u, "transaction_id", "ignore")


@register("chunk_upsert", with_ctes("SELECT doc_id, merchant_id, chunk_type, text FROM chunks", "chunks"),
          ids=("S12", "R11", "L12"))
def q_chunk_upsert(spark, sf):
    lat = latest_of(spark, sf)
    cols = ["doc_id", "merchant_id", "chunk_type", "text"]
    small = C.chunk_merchants(lat, 256).select(*cols)
    medium = C.chunk_merchants(lat, 512).select(*cols)
    return upsert(small, medium, "doc_id", "replace")


# ---------------------------------------------------------------- envelopes

def envelope(df):
    """Event envelope as JSON text (the ``value`` of a topic record)."""
    from merchlens.streaming.ingest import to_envelope
    return to_envelope(df)


@register("event_envelope", with_ctes("""
SELECT md5(transaction_id) AS event_id, 'merchant_transaction' AS event_type, 'merchlens_pipeline' AS source,
       '1.0' AS schema_version, transaction_id, merchant_id, merchant_name, transaction_amount, mcc_code, mcc_description,
       city, state, neighborhood, latitude, longitude, strftime(transaction_at, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       acceptance_method, stars, review_count, review_velocity_30d, categories, CAST(is_open AS INTEGER) AS is_open,
       CAST(price_range AS INTEGER) AS price_range, epoch_ms(transaction_at) AS timestamp_ms
FROM stg""", "stg"), ids=("S6",))
def q_event_envelope(spark, sf):
    parsed = envelope(stg_of(spark, sf)).select(F.from_json("value", I.ENVELOPE).alias("e"))
    return parsed.select("e.event_id", "e.event_type", "e.source", "e.schema_version", "e.payload.*", "e.timestamp_ms")


# ---------------------------------------------------------------- ingest validation, batch jobs

def _reason_sql() -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in Q.INGEST_REQUIRED]
    parts.append("CASE WHEN transaction_amount < 0 THEN 'transaction_amount < 0' END")
    parts.append(f"CASE WHEN acceptance_method IS NOT NULL AND acceptance_method NOT IN "
                 f"({sql_list(K.ACCEPTANCE_METHODS)}) THEN 'acceptance_method not allowed' END")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


@register("ingest_validate", with_ctes(f"""
SELECT transaction_id, merchant_id,
       CASE WHEN length(mcc_code) < 4 THEN lpad(mcc_code, 4, '0') ELSE mcc_code END AS mcc_code,
       coalesce(acceptance_method, '{K.DEFAULT_ACCEPTANCE}') AS acceptance_method,
       nullif({_reason_sql()}, '') AS reason,
       nullif({_reason_sql()}, '') IS NULL AS is_valid
FROM raw_txn""", "raw_txn"), ids=("F7",))
def q_ingest_validate(spark, sf):
    return Q.validate_ingest(FX.raw_txn(spark, sf)).select(
        "transaction_id", "merchant_id", "mcc_code", "acceptance_method", "reason", "is_valid")


#: MB of transactions and orders (as given) for each staged CSV file of some 60 MB, and files of a load batch at most.
CSV_FILE_MB, MAX_BATCH_FILES = 5, 64


@register("batch_load_job", _ROUNDTRIP_SQL + """
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ts DESC NULLS LAST, merchant_id DESC NULLS LAST,
  transaction_amount DESC NULLS LAST, acceptance_method DESC NULLS LAST) = 1""", ids=("S3",))
def q_batch_load_job(spark, sf):
    staging, archive = scratch_dir(spark, "staging-in"), scratch_dir(spark, "staging-archive")
    files = max(6, FX.input_mb(spark, sf, "lineitem", "orders") // CSV_FILE_MB)
    slices = FX.slices_by_size(spark, sf)
    with shuffles_removed(spark):
        for i, raw in enumerate(FX.raw_slices(spark, sf)):
            S.write_staging_csv(raw.repartition(files * (i + 1) // slices - files * i // slices), staging, mode="append")
    raw_p, rej_p = scratch_dir(spark, "loaded"), scratch_dir(spark, "load-rejects")
    I.start_batch_load(spark, staging, archive, raw_p, rej_p, scratch_dir(spark, "ckpt"),
                       max_files=min(MAX_BATCH_FILES, -(-files // 3))).awaitTermination()
    return materialize_sliced(_roundtrip_cols(I.loaded_table(spark, raw_p)), "loaded-rows", "transaction_id", slices)


def _rebuild_sql(source: str | None = None) -> str:
    """Counts of the rebuilt tables; ``source`` replaces the raw table, which it names ``raw_all``."""
    from merchlens.plans.q_retrieval import _CH_IDX
    text = with_ctes("""
SELECT 'staging' AS "table", count(*) AS row_count FROM stg
UNION ALL SELECT 'mart', count(*) FROM mart
UNION ALL SELECT 'chunks', count(*) FROM chunks
UNION ALL SELECT 'tfidf_postings', count(*) FROM c_post
UNION ALL SELECT 'tfidf_idf', count(*) FROM c_idf
UNION ALL SELECT 'tfidf_norms', count(DISTINCT doc_id) FROM c_post""", "stg", "mart", "chunks", local=_CH_IDX[:2])
    if source is None:
        return text
    head, rest = text.split("),\n", 1)
    return head.replace("raw_txn AS (", "raw_all AS (", 1) + f"),\nraw_txn AS (SELECT * FROM {source}),\n" + rest


@register("rebuild_counts", _rebuild_sql(), ids=("S16", "T6"))
def q_rebuild_counts(spark, sf):
    from merchlens.plans.jobs import rebuild
    with FX.partitions_by_size(spark, sf):
        return rebuild(spark, FX.raw_txn(spark, sf), scratch_dir(spark, "rebuild"), tiebreak=FX.DEDUPE_TIEBREAK,
                       prefix=f"rebuild_{uuid.uuid4().hex[:12]}")
