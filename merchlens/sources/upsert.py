"""Keyed upsert (S7, S12, J7) and merge-on-read keyed tables.

``upsert`` is a pure DataFrame operation: both sides are shuffled on the key
once (anti join) and unioned — no per-row merge, no driver loop.  Two modes
(ledger L7): ``replace`` (last write wins) and ``ignore`` (insert only keys that
are absent).  Duplicate keys inside one batch of updates are resolved first by
``order_by`` (latest wins).

Persisted keyed tables (stream sinks) are merge-on-read, so a write costs
O(batch), never a rewrite of the whole table:

* ``log_append`` writes one batch to ``<root>/log/epoch=<n>``; a replayed
  micro-batch overwrites its own folder, so retries are idempotent;
* ``log_read`` resolves the newest row per key (caller's ordering, which may
  use the batch number ``_epoch``) over the latest snapshot plus the log
  epochs after it — partition pruning skips the folded epochs;
* ``log_compact`` folds snapshot + newer epochs into ``<root>/snap/upto=<n>``;
  ``log_maintain`` does so once a stated number of epochs lies beyond the last
  snapshot, and the ingest jobs call it after each batch (old folders can
  then be expired by retention).

For a table that is merged in place, see :mod:`merchlens.sources.buckets`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.operators.models import latest_per_key
from merchlens.session import write_sliced


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str], mode: str = "replace",
           order_by: list[Column] | None = None) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    if order_by:
        updates = latest_per_key(updates, keys, order_by)
    updates = updates.select(*target.columns)
    if mode == "replace":
        return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)
    if mode == "ignore":
        return target.unionByName(updates.join(target.select(*keys), keys, "left_anti"))
    raise ValueError(f"unknown upsert mode {mode!r}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Committed ``<prefix><n>`` sub-folders (those with a _SUCCESS marker), sorted."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(name[len(prefix):]))
    return sorted(out)


def log_append(df: DataFrame, root: str, epoch: int) -> None:
    """Write one batch of keyed rows as log epoch ``epoch`` (idempotent on replay)."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/log/epoch={epoch}")


def log_read(spark: SparkSession, root: str, key: str | list[str], order: list[Column],
             keep_epoch: bool = False) -> DataFrame | None:
    """Newest row per key under ``order`` across snapshot + later log epochs."""
    keys = [key] if isinstance(key, str) else list(key)
    snaps = _numbered(spark, f"{root}/snap", "upto=")
    epochs = _numbered(spark, f"{root}/log", "epoch=")
    lo = snaps[-1] if snaps else -1
    parts = []
    if snaps:
        parts.append(spark.read.parquet(f"{root}/snap/upto={lo}"))
    if epochs and epochs[-1] > lo:
        parts.append(spark.read.parquet(f"{root}/log").where(F.col("epoch") > lo)
                     .withColumnRenamed("epoch", "_epoch"))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = latest_per_key(rows, keys, order)
    return out if keep_epoch else out.drop("_epoch")


#: Bytes of a log and its snapshot for each slice of the keys that a compaction shuffles at a time, and slices at most.
SLICE_BYTES, MAX_SLICES = 64 << 20, 4


def _slices(spark: SparkSession, root: str) -> int:
    fs, p = _fs(spark, root)
    return min(MAX_SLICES, 1 + fs.getContentSummary(p).getLength() // SLICE_BYTES)


def log_compact(spark: SparkSession, root: str, key: str | list[str], order: list[Column]) -> int | None:
    """Fold the table into a snapshot covering every committed epoch; returns its epoch.  A large table is
    folded by slices of its keys."""
    epochs = _numbered(spark, f"{root}/log", "epoch=")
    snaps = _numbered(spark, f"{root}/snap", "upto=")
    if not epochs or (snaps and snaps[-1] >= epochs[-1]):
        return snaps[-1] if snaps else None
    merged = log_read(spark, root, key, order, keep_epoch=True)
    write_sliced(merged, f"{root}/snap/upto={epochs[-1]}", key, _slices(spark, root))
    return epochs[-1]


def log_length(spark: SparkSession, root: str) -> int:
    """Committed log epochs that no snapshot covers: what a reader has to merge."""
    snaps = _numbered(spark, f"{root}/snap", "upto=")
    return sum(e > (snaps[-1] if snaps else -1) for e in _numbered(spark, f"{root}/log", "epoch="))


def log_maintain(spark: SparkSession, root: str, key: str | list[str], order: list[Column], every: int | None) -> int | None:
    """Compact the log when ``every`` or more epochs lie beyond its snapshot (None: never); returns the snapshot's epoch."""
    if not every or log_length(spark, root) < every:
        return None
    return log_compact(spark, root, key, order)
