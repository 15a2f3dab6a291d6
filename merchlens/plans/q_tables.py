"""Registered queries over stored tables: layers, date ranges, point lookups, bucketed merges."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import functions as F

from merchlens.operators import analytics as A
from merchlens.operators import models as M
from merchlens.operators.analytics import latest_per_merchant
from merchlens.plans.catalog import register
from merchlens.plans.q_analytics import RECORD_SQL
from merchlens.plans.q_models import stg_of
from merchlens.plans.q_sources import _UPS_LOCAL, _rebuild_sql, _upsert_inputs
from merchlens.plans.sqltext import STG_COLS, tier, with_ctes
from merchlens.session import ensure_checkpoint_dir, prepare, scratch_dir
from merchlens.sources import buckets as B
from merchlens.sources import fixtures as FX
from merchlens.sources import layers as L
from merchlens.sources.upsert import _fs

_SOURCES = sorted(set(re.findall(r"\{([a-z_]+)\}", FX.RAW_TXN_SQL)))
#: Buckets of a small table, and MB of transactions and orders (as given) for each further one: some 400,000 rows,
#: which a task sorts in memory.
BUCKETS, BUCKET_MB = 16, 8


def buckets_of(spark, sf: str) -> int:
    return max(BUCKETS, -(-FX.input_mb(spark, sf, "lineitem", "orders") // BUCKET_MB))


def _raw_sql(sf: str) -> str:
    """The raw model's text over the given files, so that it can be stored as a view."""
    return FX.RAW_TXN_SQL.format(**{t: f"parquet.`{sf.rstrip('/')}/{t}.parquet`" for t in _SOURCES})


def _state(spark, sf: str) -> str:
    """Name of the state of the given tables: paths, sizes and times of their files."""
    seen = []
    for t in _SOURCES:
        fs, p = _fs(spark, f"{sf.rstrip('/')}/{t}.parquet")
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            seen.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def layers_of(spark, sf: str) -> L.Layers:
    """The stored layers of the given tables: built once per state of the tables, by whichever session asks first,
    and attached by all later calls and sessions.  A build counts from its marker on, so a build that
    failed or still runs elsewhere is never read."""
    prepare(spark)
    state = _state(spark, sf)
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/merchlens/layers-{state}"
    fs, p = _fs(spark, home)
    done = sorted(st.getPath().getName() for st in fs.listStatus(p)
                  if fs.exists(st.getPath().suffix("/_BUILT"))) if fs.exists(p) else []
    prefix = f"layers_{state}"
    if not done:
        build = f"build-{uuid.uuid4().hex[:12]}"
        layers = L.open_layers(spark, f"{home}/{build}", prefix)
        L.raw_view(spark, layers, _raw_sql(sf))
        with FX.partitions_by_size(spark, sf):
            stg = L.save_staging(layers, stg_of(spark, sf))
            L.save_lookup(layers, "merchant_latest", latest_per_merchant(stg), "merchant_id")
            L.save(layers, "merchants", M.mart(stg))
        fs.create(_fs(spark, f"{home}/{build}/_BUILT")[1]).close()
        return layers
    layers = L.open_layers(spark, f"{home}/{done[0]}", prefix)
    if not spark.catalog.tableExists(f"{layers.schema('raw')}.transactions"):
        L.raw_view(spark, layers, _raw_sql(sf))
    return layers


@register("merchant_by_id", with_ctes(f"SELECT {RECORD_SQL} FROM latest WHERE merchant_id = '7'", "latest"), ids=("F9",))
def q_merchant_by_id(spark, sf):
    return A.merchant_record(L.lookup(spark, layers_of(spark, sf), "merchant_latest", "merchant_id", "7"))


@register("date_range_filter", with_ctes("""
SELECT transaction_id, merchant_id, transaction_at, transaction_amount, transaction_quarter
FROM stg WHERE transaction_at BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 23:59:59'""",
                                         "stg"), ids=("F10",))
def q_date_range(spark, sf):
    stg = layers_of(spark, sf).read(spark, "transactions")
    return A.date_range(stg, "1995-01-01 00:00:00", "1995-06-30 23:59:59").select(
        "transaction_id", "merchant_id", "transaction_at", "transaction_amount", "transaction_quarter")


@register("layer_tables", with_ctes("""
SELECT 'raw' AS layer, 'transactions' AS "table", 'view' AS kind, '' AS partitioned_by, count(*) AS row_count FROM raw_txn
UNION ALL SELECT 'staging', 'transactions', 'table', 'transaction_year,transaction_quarter', count(*) FROM stg
UNION ALL SELECT 'marts', 'merchant_latest', 'table', '', count(*) FROM latest
UNION ALL SELECT 'marts', 'merchants', 'table', '', count(*) FROM mart""", "raw_txn", "stg", "latest", "mart"), ids=("S14",))
def q_layer_tables(spark, sf):
    return L.describe(spark, layers_of(spark, sf))


_CORRECTED = "transaction_year = '1996' AND transaction_quarter IN ('Q1', 'Q2') AND transaction_amount < 100"


@register("staging_merge", with_ctes(f"""
SELECT {STG_COLS} FROM (
  SELECT * REPLACE ({tier('transaction_amount')} AS transaction_value_tier, strftime(transaction_at, '%Y') AS transaction_year,
                    'Q' || CAST(quarter(transaction_at) AS VARCHAR) AS transaction_quarter)
  FROM (SELECT * REPLACE (CASE WHEN moved THEN round(transaction_amount + 1, 2) ELSE transaction_amount END AS transaction_amount,
                          CASE WHEN moved THEN transaction_at + INTERVAL 100 DAY ELSE transaction_at END AS transaction_at)
        FROM (SELECT *, coalesce({_CORRECTED}, false) AS moved FROM stg)))""", "stg"), ids=("S14", "S7"))
def q_staging_merge(spark, sf):
    """A correction of two quarters' small transactions - a later date, a higher amount - merged into the staging
    table: rows leave their quarters, and only the quarters they leave or enter are rewritten."""
    layers = L.open_layers(spark, scratch_dir(spark, "staging-merge"), f"merge_{uuid.uuid4().hex[:12]}")
    with FX.partitions_by_size(spark, sf):
        return _merge_correction(spark, sf, layers)


def _merge_correction(spark, sf, layers):
    stg = L.save_staging(layers, stg_of(spark, sf))
    batch = stg.where(_CORRECTED).withColumns({"transaction_amount": F.round(F.col("transaction_amount") + 1, 2),
                                               "transaction_at": F.col("transaction_at") + F.expr("INTERVAL 100 DAYS")})
    L.merge_staging(spark, layers, M.enrich(batch))
    return layers.read(spark, "transactions").select(*M.STAGING_COLUMNS)


@register("rebuild_city_limit", _rebuild_sql("""(SELECT * FROM raw_all WHERE lower(trim(city)) = 'nation_7'
    ORDER BY transaction_id, ts, tb1, tb2, tb3 LIMIT 1000)"""), ids=("S16", "T6"))
def q_rebuild_city_limit(spark, sf):
    from merchlens.plans.jobs import rebuild
    return rebuild(spark, FX.raw_txn(spark, sf), scratch_dir(spark, "rebuild"), city="Nation_7", limit=1000,
                   tiebreak=FX.DEDUPE_TIEBREAK, prefix=f"rebuild_{uuid.uuid4().hex[:12]}")


@register("stg_dedup_bucketed", with_ctes(f"SELECT {STG_COLS} FROM stg", "stg"), ids=("W1", "S7", "S14"))
def q_stg_dedup_bucketed(spark, sf):
    """The staging model over a raw table bucketed by transaction id: no exchange after the table is written."""
    name = f"default.raw_{uuid.uuid4().hex[:12]}"
    with FX.partitions_by_size(spark, sf):
        raw = B.save_bucketed(FX.raw_txn(spark, sf), name, scratch_dir(spark, "raw-bucketed"), "transaction_id", buckets_of(spark, sf))
    return M.staging(raw, tiebreak=FX.DEDUPE_TIEBREAK)


def _merged(spark, sf, mode):
    t, u = _upsert_inputs(spark, sf)
    name = f"default.merge_{uuid.uuid4().hex[:12]}"
    n = buckets_of(spark, sf)
    B.save_bucketed(t, name, scratch_dir(spark, "merge-bucketed"), "transaction_id", n)
    B.merge_bucketed(spark, name, "transaction_id", u, n, mode)
    return B.read_bucketed(spark, name)


@register("merge_replace", with_ctes("""
SELECT * FROM tgt WHERE transaction_id NOT IN (SELECT transaction_id FROM upd)
UNION ALL SELECT * FROM upd""", "stg", local=_UPS_LOCAL), ids=("S7", "S12", "R11"))
def q_merge_replace(spark, sf):
    return _merged(spark, sf, "replace")


@register("merge_ignore", with_ctes("""
SELECT * FROM tgt UNION ALL
SELECT * FROM upd WHERE transaction_id NOT IN (SELECT transaction_id FROM tgt)""", "stg", local=_UPS_LOCAL),
          ids=("S7", "J7"))
def q_merge_ignore(spark, sf):
    return _merged(spark, sf, "ignore")
