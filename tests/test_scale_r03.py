"""What lets jobs grow: counts of files, buckets and slices follow the input, whole rows are sorted once."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from merchlens.operators import models as M
from merchlens.operators import retrieval as R
from merchlens.operators.analytics import latest_per_merchant
from merchlens.plans import q_rag, q_sources, q_stream, q_tables
from merchlens.plans.q_models import stg_of
from merchlens.session import scratch_dir
from merchlens.sources import fixtures as FX
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text


def _folder(monkeypatch, module):
    """Folders that a query asks for, by name."""
    seen = {}

    def own(spark, name):
        seen[name] = scratch_dir(spark, name)
        return seen[name]

    monkeypatch.setattr(module, "scratch_dir", own)
    return seen


def test_partitions_follow_the_size(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(FX, "input_mb", lambda *a: 4000)
    with FX.partitions_by_size(spark, SF_SMALL):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1000"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert q_tables.buckets_of(spark, SF_SMALL) == 500 and q_stream._slices(spark, SF_SMALL) == 125


def test_derived_columns_are_not_shuffled(spark):
    lines = plan_text(stg_of(spark, SF_SMALL)).splitlines()
    window = next(i for i, ln in enumerate(lines) if " Window " in ln)
    assert "transaction_value_tier" not in "\n".join(lines[window:])


def test_latest_sorts_only_rows_of_the_newest_time(spark):
    rows = [("a", "1", "2020-01-01"), ("a", "2", "2020-01-02"), ("a", "3", "2020-01-02"), ("b", "4", None), ("b", "5", None),
            ("c", "6", None), ("c", "7", "1999-01-01"), (None, "8", "2020-01-01"), (None, "9", "2020-01-03")]
    stg = spark.createDataFrame(rows, "merchant_id string, transaction_id string, d string").withColumn(
        "transaction_at", F.to_timestamp("d"))
    out = latest_per_merchant(stg)
    assert {(r["merchant_id"], r["transaction_id"]) for r in out.collect()} == {("a", "3"), ("b", "5"), ("c", "7"), (None, "9")}
    assert "LeftSemi" in plan_text(out)


def test_buckets_hold_a_bounded_share(spark, monkeypatch):
    seen = _folder(monkeypatch, q_tables)
    monkeypatch.setattr(FX, "input_mb", lambda *a: 240)
    assert q_tables.q_stg_dedup_bucketed(spark, SF_SMALL).count() == stg_of(spark, SF_SMALL).count()
    assert len(glob.glob(seen["raw-bucketed"] + "/_bucket=*")) == 30


def test_staged_files_follow_the_size(spark, monkeypatch):
    seen = _folder(monkeypatch, q_sources)
    want = q_sources.q_batch_load_job(spark, SF_SMALL).count()
    monkeypatch.setattr(FX, "input_mb", lambda *a: 60)
    assert q_sources.q_batch_load_job(spark, SF_SMALL).count() == want
    staged = glob.glob(seen["staging-in"] + "/*.csv") + glob.glob(seen["staging-archive"] + "/**/*.csv", recursive=True)
    assert len(staged) == 12


def test_envelopes_are_compressed_and_no_batch_is_kept(spark, monkeypatch):
    seen = _folder(monkeypatch, q_stream)
    monkeypatch.setattr(q_stream, "FILE_ENVELOPES", 1000)
    monkeypatch.setattr("pyspark.sql.DataFrame.persist", lambda *a: pytest.fail("kept"), raising=False)
    got = q_stream._ingested(spark, SF_SMALL).count()
    packed = glob.glob(seen["envelopes"] + "/*.txt.gz")
    assert len(packed) >= stg_of(spark, SF_SMALL).count() // 1000 and 0 < got <= stg_of(spark, SF_SMALL).count()


@pytest.mark.parametrize("late", [False, True])
def test_slices_are_cut_once_and_arrive_in_order(spark, monkeypatch, late):
    seen = _folder(monkeypatch, q_stream)
    rows = spark.range(10_000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    early = rows.where("id < 5") if late else None
    monkeypatch.setattr(q_stream, "ROW_GROUP_BYTES", 4096)
    assert q_stream._stream_by_time(spark, rows, "s", slices=7, late=early).isStreaming
    files = sorted(glob.glob(seen["s"] + "/*.parquet"), key=os.path.getmtime)
    tables = [pq.read_table(f).to_pydict()["id"] for f in files]
    assert len(tables) == 7 and sum(map(len, tables)) == 10_000 + 5 * late
    tables[-1] = [i for i in tables[-1] if i >= 5]
    assert all(max(a) < min(b) for a, b in zip(tables, tables[1:]))
    assert len(os.listdir(seen["s-slices"])) >= 7


@pytest.mark.parametrize("frequent", [0, 2, 100])
def test_frequent_tokens_are_joined_without_a_shuffle(spark, monkeypatch, frequent):
    monkeypatch.setattr(R, "FREQUENT_TOKENS", frequent)
    docs = spark.createDataFrame([(1, "a b c c"), (2, "a b"), (3, "a d e"), (4, "")], "doc_id long, text string")
    idx = R.tfidf_fit(docs)
    plain = idx.postings.join(idx.idf.select("token", "idf"), "token")
    key = lambda df: sorted((r["doc_id"], r["token"], r["tf"], r["idf"]) for r in df.collect())
    assert key(R.with_idf(idx.postings, idx.idf)) == key(plain)
    by_doc = {d: sum(r["weight"] ** 2 for r in idx.weights.collect() if r["doc_id"] == d) for d in (1, 2, 3)}
    assert all(abs(v - 1) < 1e-12 for v in by_doc.values())


def test_evaluation_stages_the_merchants_once(spark, monkeypatch):
    calls = []
    real = q_rag.latest_of
    monkeypatch.setattr(q_rag, "latest_of", lambda *a: calls.append(1) or real(*a))
    assert q_rag._evals(spark, SF_SMALL).count() > 0 and len(calls) == 1


def test_materialised_staging_is_the_model(spark):
    from merchlens.plans.q_models import staged_of
    a, b = stg_of(spark, SF_SMALL), staged_of(spark, SF_SMALL)
    assert a.columns == b.columns == M.STAGING_COLUMNS
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_samples_are_taken_with_partitions_by_size(spark, monkeypatch):
    from merchlens.plans import q_quality

    seen, real = [], q_quality.materialize
    monkeypatch.setattr(FX, "input_mb", lambda *a: 80)
    monkeypatch.setattr(q_quality, "materialize", lambda df, name: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or real(df, name))
    assert q_quality.q_dq_raw_samples(spark, SF_SMALL).count() > 0 and seen == ["20"]
