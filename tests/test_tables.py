"""Stored tables: layers with partitions, point lookups, bucketed merges, log compaction."""

import os
import re

import pytest
from pyspark.sql import functions as F

from merchlens.operators import analytics as A
from merchlens.plans import q_tables
from merchlens.plans.q_models import stg_of
from merchlens.session import scratch_dir
from merchlens.sources import buckets as B
from merchlens.sources import layers as L
from merchlens.sources.upsert import log_append, log_length, log_maintain, log_read
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def layers(spark):
    return q_tables.layers_of(spark, SF_SMALL)


@pytest.fixture()
def staged(spark, layers):
    own = L.open_layers(spark, scratch_dir(spark, "tables-test"), "t" + os.urandom(6).hex())
    return own, L.save_staging(own, layers.read(spark, "transactions"))


def test_date_range_prunes_partitions(spark, layers):
    df = A.date_range(layers.read(spark, "transactions"), "1995-01-01 00:00:00", "1995-06-30 23:59:59")
    plan = plan_text(df)
    assert re.search(r"PartitionFilters: \[isnotnull\(transaction_year#\d+\), \(transaction_year#\d+ >= 1995\)", plan)
    read = {re.search(r"transaction_year=(\d+)/transaction_quarter=(Q\d)", f).groups() for f in df.select(
        F.col("_metadata.file_path").alias("f")).distinct().toPandas()["f"]}
    assert read == {("1995", "Q1"), ("1995", "Q2")}
    whole = layers.read(spark, "transactions").drop("transaction_year", "transaction_quarter")
    for lo, hi in (("1994-11-03 00:00:00", "1996-02-01 12:00:00"), ("1996-07-01 00:00:00", "1996-07-01 00:00:00"),
                   ("1999-01-01 00:00:00", "1990-01-01 00:00:00"), ("0001-01-01 00:00:00", "9999-12-31 00:00:00")):
        assert A.date_range(layers.read(spark, "transactions"), lo, hi).count() == A.date_range(whole, lo, hi).count()


def test_layers_are_views_and_tables_in_three_schemas(spark, layers):
    rows = {(r["layer"], r["table"]): (r["kind"], r["partitioned_by"]) for r in L.describe(spark, layers).collect()}
    assert rows == {("raw", "transactions"): ("view", ""), ("staging", "transactions"): ("table", "transaction_year,transaction_quarter"),
                    ("marts", "merchants"): ("table", ""), ("marts", "merchant_latest"): ("table", "")}


def test_layers_attach_from_the_folder(spark, layers):
    again = L.open_layers(spark, layers.root, "again" + os.urandom(4).hex())
    stg = again.read(spark, "transactions")
    assert stg.schema.names == layers.read(spark, "transactions").schema.names
    assert dict(stg.dtypes)["transaction_year"] == "string"
    assert stg.count() == layers.read(spark, "transactions").count()
    before = _jobs(spark)
    q_tables.layers_of(spark, SF_SMALL)
    assert _jobs(spark) == before  # built once


def test_rows_without_a_date_have_a_partition(spark, staged):
    own, stg = staged
    batch = stg.limit(3).withColumns({"transaction_at": F.lit(None).cast("timestamp"), "transaction_year": F.lit(None).cast("string"),
                                      "transaction_quarter": F.lit(None).cast("string"), "ingested_at": F.lit("2030-01-01").cast("timestamp")})
    n = stg.count()
    L.merge_staging(spark, own, batch)
    now = own.read(spark, "transactions")
    assert now.count() == n and now.where("transaction_year IS NULL").count() == 3


def test_merge_rewrites_touched_quarters_only(spark, staged):
    own, stg = staged
    path = own.path("transactions")
    before = _files(path)
    year, quarter = stg.select("transaction_year", "transaction_quarter").where("transaction_year IS NOT NULL").first()
    other = "1901"
    rows = stg.where((F.col("transaction_year") == year) & (F.col("transaction_quarter") == quarter))
    moved = rows.withColumns({"transaction_year": F.lit(other), "ingested_at": F.lit("2030-01-01").cast("timestamp")})
    n, k = stg.count(), rows.count()
    assert L.merge_staging(spark, own, moved) == 2
    now = own.read(spark, "transactions")
    assert now.count() == n and now.where(F.col("transaction_year") == other).count() == k
    assert now.where((F.col("transaction_year") == year) & (F.col("transaction_quarter") == quarter)).count() == 0
    after = _files(path)
    old = f"transaction_year={year}/transaction_quarter={quarter}"
    assert {f: t for f, t in before.items() if old not in f} == {f: t for f, t in after.items() if f"transaction_year={other}" not in f}
    # a stale version does not replace a newer one, a replay changes nothing
    L.merge_staging(spark, own, rows.sparkSession.createDataFrame([], stg.schema))
    L.merge_staging(spark, own, now.where(F.col("transaction_year") == other).withColumns(
        {"ingested_at": F.lit("2000-01-01").cast("timestamp"), "city": F.lit("stale")}))
    assert own.read(spark, "transactions").where("city = 'stale'").count() == 0 and own.read(spark, "transactions").count() == n


def test_lookup_skips_row_groups_and_runs_no_job_to_plan(spark, layers):
    own = L.open_layers(spark, scratch_dir(spark, "lookup-test"), "t" + os.urandom(6).hex())
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).cast("string").alias("merchant_id"), "id", F.lit("x").alias("v"))
    L.save_lookup(own, "merchant_latest", rows, "merchant_id", group_rows=1000)
    before = _jobs(spark)
    hit = L.lookup(spark, own, "merchant_latest", "merchant_id", "41234")
    assert "PushedFilters: [IsNotNull(merchant_id), EqualTo(merchant_id,41234)]" in plan_text(hit)
    assert _jobs(spark) == before
    assert [r["merchant_id"] for r in hit.collect()] == ["41234"]
    import pyarrow.parquet as pq

    groups = [m.row_group(g).column(0) for f in _files(own.path("merchant_latest")) for m in [pq.ParquetFile(f).metadata]
              for g in range(m.num_row_groups)]
    may_hold = [g for g in groups if g.statistics.min <= "41234" <= g.statistics.max]
    assert len(groups) >= 40 and len(may_hold) == 1
    # what the scan itself hands on is one row group, not the table
    plan = hit._jdf.queryExecution().executedPlan()
    scanned = _scan_rows(plan)
    assert 0 < scanned <= 1000
    # ids between the minimum and the maximum of interleaved files: the Bloom filter excludes them
    assert all(m.row_group(0).column(0).statistics is not None for f in _files(own.path("merchant_latest")) for m in [pq.ParquetFile(f).metadata])
    before = _jobs(spark)
    q_tables.q_merchant_by_id(spark, SF_SMALL)
    assert _jobs(spark) == before


def _scan_rows(plan):
    name = plan.getClass().getSimpleName()
    if name.startswith("AdaptiveSparkPlan"):
        return _scan_rows(plan.executedPlan())
    if name.startswith("FileSourceScan"):
        return plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    return sum(_scan_rows(children.apply(i)) for i in range(children.size()))


def test_bloom_filter_excludes_absent_keys(spark):
    own = L.open_layers(spark, scratch_dir(spark, "bloom-test"), "t" + os.urandom(6).hex())
    # even ids only: an odd id lies within the limits of some row group
    rows = spark.range(0, 40_000, 2).select(F.format_string("%08d", "id").alias("merchant_id"), F.lit("x").alias("v"))
    L.save_lookup(own, "merchant_latest", rows, "merchant_id", group_rows=1000)
    miss = L.lookup(spark, own, "merchant_latest", "merchant_id", "00012345")
    assert miss.collect() == []
    assert _scan_rows(miss._jdf.queryExecution().executedPlan()) == 0


def test_dedupe_over_buckets_needs_no_exchange(spark):
    plan = plan_text(q_tables.q_stg_dedup_bucketed(spark, SF_SMALL))
    assert "Exchange" not in plan and "WindowGroupLimit" in plan


def test_merge_rewrites_touched_buckets_only(spark):
    name, path = "default.t" + os.urandom(6).hex(), scratch_dir(spark, "bucket-test")
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    B.save_bucketed(rows, name, path, "k", 16)
    before = _files(path)
    assert len(before) == 16
    batch = spark.createDataFrame([("k5", -1, 1), ("k5", -5, 2), ("new", -2, 1), (None, -3, 1)], "k string, v long, at int")
    touched = B.merge_bucketed(spark, name, "k", batch, 16, order_by=[F.col("at").desc()])
    assert 1 <= len(touched) <= 3
    now = B.read_bucketed(spark, name)
    assert now.count() == 2002 and {r["k"]: r["v"] for r in now.where("v < 0").collect()} == {"k5": -5, "new": -2, None: -3}
    after = _files(path)
    untouched = {f: t for f, t in before.items() if int(re.search(r"_bucket=(\d+)", f).group(1)) not in touched}
    assert len(untouched) == 16 - len(touched) and untouched.items() <= after.items()
    # insert-if-absent keeps what is there; an empty batch touches nothing
    B.merge_bucketed(spark, name, "k", spark.createDataFrame([("k5", 0), ("new2", 9)], "k string, v long"), 16, "ignore")
    got = {r["k"]: r["v"] for r in B.read_bucketed(spark, name).where("k IN ('k5', 'new2')").collect()}
    assert got == {"k5": -5, "new2": 9}
    assert B.merge_bucketed(spark, name, "k", batch.where("false"), 16) == []
    # each file holds its bucket alone, so scans still report the partitioning
    wrong = spark.table(name).where(F.col("_bucket") != B.bucket_of("k", 16)).count()
    assert wrong == 0 and "Exchange" not in plan_text(B.read_bucketed(spark, name).groupBy("k").count())
    with pytest.raises(ValueError):
        B.merge_bucketed(spark, name, "k", batch, 16, "other")


def test_log_is_compacted_by_its_length(spark):
    root, order = scratch_dir(spark, "maintain-test"), [F.col("_epoch").desc()]
    made = []
    for e in range(7):
        log_append(spark.createDataFrame([(1, e), (e + 10, e)], "k int, v int"), root, e)
        made.append(log_maintain(spark, root, "k", order, 3))
        assert log_length(spark, root) < 3
    assert made == [None, None, 2, None, None, 5, None]
    got = {r["k"]: r["v"] for r in log_read(spark, root, "k", order).collect()}
    assert got == {1: 6, **{e + 10: e for e in range(7)}}
    assert log_maintain(spark, root, "k", order, None) is None
