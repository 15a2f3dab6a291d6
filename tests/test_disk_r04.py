"""What keeps jobs small on disk: shuffles go with their job, wide rows are shuffled a slice of their keys at a time."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from merchlens import session
from merchlens.plans import q_sources, q_stream
from merchlens.session import scratch_dir, write_sliced
from merchlens.sources import fixtures as FX
from merchlens.sources import upsert as U
from merchlens.streaming import ingest as I
from tests.conftest import SF_SMALL


def shuffled(spark) -> set[str]:
    """Shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_")}


def local(path: str) -> str:
    return path.removeprefix("file://")


def test_slices_hold_all_rows_and_leave_no_shuffle(spark):
    rows = spark.range(5000).select((F.col("id") % 700).cast("string").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, 1), (None, 2)], "k string, id long"))
    last = U.latest_per_key(rows, "k", [F.col("id").desc()])
    want, before, path = sorted(map(str, last.collect())), shuffled(spark), scratch_dir(spark, "sliced")
    write_sliced(last, path, "k", 4)
    assert not shuffled(spark) - before
    assert sorted(map(str, spark.read.parquet(path).select(*last.columns).collect())) == want and len(want) == 701


def test_a_slice_that_fails_leaves_no_marker(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).cast("string").alias("x"))
    path = scratch_dir(spark, "sliced")
    slices = rows.select((F.pmod(F.xxhash64("id"), F.lit(4))).alias("s"), "id").where("id = 57").first()["s"]
    with pytest.raises(Exception, match="no"):
        write_sliced(rows, path, "id", 4 if slices else 5)
    assert not os.path.exists(local(path) + "/_SUCCESS")


def test_compaction_by_slices(spark, monkeypatch):
    root = scratch_dir(spark, "log")
    for e in range(3):
        U.log_append(spark.range(e * 50, 200).select("id", F.lit(e).alias("v")), root, e)
    order = [F.col("_epoch").desc()]
    want = sorted(map(tuple, U.log_read(spark, root, "id", order).select("id", "v").collect()))
    monkeypatch.setattr(U, "SLICE_BYTES", 1)
    assert U._slices(spark, root) == U.MAX_SLICES and U.log_compact(spark, root, "id", order) == 2
    assert U._numbered(spark, f"{root}/snap", "upto=") == [2]
    assert sorted(map(tuple, U.log_read(spark, root, "id", order).select("id", "v").collect())) == want


def test_a_batch_leaves_no_shuffle(spark):
    src, raw = scratch_dir(spark, "src"), scratch_dir(spark, "raw")
    good = "{" + ", ".join(f'"{c}": "x"' for c in ("transaction_id", "merchant_id", "merchant_name", "mcc_code", "mcc_description", "city", "state"))
    good += ', "transaction_amount": 1.0, "latitude": 1.0, "longitude": 1.0, "timestamp": "2024-01-01T00:00:00"}'
    spark.createDataFrame([('{"event_id": "%d", "payload": %s, "timestamp_ms": %d}' % (i, good, i),) for i in range(9)], "value string").write.text(src)
    before = shuffled(spark)
    q_stream._run(I.start_ingest(I.file_source(spark, src), raw, scratch_dir(spark, "rejects"), scratch_dir(spark, "ckpt")))
    assert not shuffled(spark) - before
    assert [r["event_id"] for r in I.raw_table(spark, raw).collect()] == ["8"]


@pytest.mark.parametrize("query", [q_sources.q_batch_load_job, q_stream.q_stream_raw_staging], ids=["batch_load_job", "stream_raw_staging"])
def test_sliced_jobs_give_the_same_rows(spark, monkeypatch, query):
    text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    want = text(query(spark, SF_SMALL))
    monkeypatch.setattr(FX, "slices_by_size", lambda *a: 3)
    folders = []
    real = session.scratch_dir
    monkeypatch.setattr(session, "scratch_dir", lambda *a: folders.append(real(*a)) or folders[-1])
    before = shuffled(spark)
    got = query(spark, SF_SMALL)
    assert not shuffled(spark) - before
    assert text(got) == want and want
    assert any(glob.glob(local(f) + "/*.zstd.parquet") for f in folders)
