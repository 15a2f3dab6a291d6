"""Spark session helpers.

The library never creates a session inside an operator; callers pass one in.
``local_session`` is for tests and the bench only.  ``scratch_dir`` returns a
folder under the cluster's shared ``spark.checkpoint.dir`` (never a machine-local
temp folder) for jobs that must materialise an intermediate table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole-stage codegen fuses a scan, several broadcast joins and wide CASE
# projections into one generated method; past 8000 bytes of bytecode HotSpot
# refuses to JIT it and the stage runs interpreted (2-3x slower here).  Let
# the JVM compile such methods.  On a cluster set the same flag in
# spark.driver.extraJavaOptions / spark.executor.extraJavaOptions.
JVM_FLAGS = "-XX:-DontCompileHugeMethods"

_SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "merchlens") -> SparkSession:
    """A local session configured like a small cluster (tests / bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.merchlens.fixture.partitions", str(os.cpu_count() if cores == "*" else cores))
        .config("spark.driver.extraJavaOptions", JVM_FLAGS)
        .config("spark.executor.extraJavaOptions", JVM_FLAGS)
    )
    for k, v in _SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on (UTC wall clock for timestamp text)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set one only where the session has none (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # a single machine (tests, bench): any local folder is shared
        d = os.path.join(os.environ.get("MERCHLENS_SCRATCH", "/tmp"), "merchlens-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for one job's files."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/merchlens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a fresh folder under the shared checkpoint
    dir and read it back: the lineage is cut (a lost executor re-reads files
    instead of re-running the upstream shuffles) and later passes over the
    table (global statistics, then a row pass) read it instead of recomputing it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For the length of a block, the shuffle files of a job go when the job ends, not when the driver happens to
    collect its garbage; for jobs that each run their own frame once."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def write_sliced(df: DataFrame, path: str, key: str | list[str], slices: int) -> None:
    """Write ``df`` as Parquet, one slice of its keys after another: the rows of a key stay together, so what is deduplicated
    or grouped by the key gives the same rows, and only one slice's shuffle is on disk.  The folder is marked as
    complete with the last slice."""
    keys = [key] if isinstance(key, str) else list(key)
    with shuffles_removed(df.sparkSession):
        for i in range(slices):
            part = df.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == i) if slices > 1 else df
            (part.write.mode("append" if i else "overwrite").option("compression", "zstd")
             .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(i == slices - 1).lower()).parquet(path))


def materialize_sliced(df: DataFrame, name: str, key: str | list[str], slices: int) -> DataFrame:
    """As :func:`materialize`, by slices of the keys; with one slice ``df`` itself."""
    if slices < 2:
        return df
    path = scratch_dir(df.sparkSession, name)
    write_sliced(df, path, key, slices)
    return df.sparkSession.read.parquet(path)


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Write ``df`` (partition columns last) over the partitions it has rows for; all others stay."""
    with setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        df.write.insertInto(table, overwrite=True)
    df.sparkSession.catalog.refreshTable(table)
