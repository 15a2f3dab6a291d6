"""Keyed tables in buckets: merges that rewrite only what a batch touches.

A table is partitioned by ``_bucket`` and bucketed by its key with the same hash, so each
partition folder holds one bucket.  Two things follow:

* a scan reports that rows are hash-partitioned by the key: dedupe, joins and aggregates on
  the key run without an exchange of the table;
* a merge reads and overwrites (dynamic partition overwrite) the folders of the buckets that a
  batch's keys fall in; the files of all others stay.

The number of buckets is stated when the table is made: a dedupe sorts a bucket's rows in one task, so take the
number of rows over some 400,000, not a fixed number.  A hot key does not fill a bucket, for a merged table has one row per key; a history
table (:func:`save_bucketed` of rows with repeated keys) keeps the versions of a key together,
which is what dedupe reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.operators.models import latest_per_key
from merchlens.session import materialize, overwrite_partitions

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket that Spark's own bucketing assigns to a key (null keys included)."""
    return F.pmod(F.hash(F.col(key)), F.lit(buckets))


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a new keyed table (one shuffle, one file per bucket) and read it back."""
    dealt = df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(buckets, key)
    (dealt.write.format("parquet").mode("overwrite").option("path", path).partitionBy(BUCKET)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return read_bucketed(df.sparkSession, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).drop(BUCKET)


def merge_bucketed(spark: SparkSession, table: str, key: str, updates: DataFrame, buckets: int, mode: str = "replace",
                   order_by: list[Column] | None = None) -> list[int]:
    """Upsert ``updates`` into a keyed table (modes of :func:`merchlens.sources.upsert.upsert`); returns the
    buckets it rewrote.  The table's side is not shuffled; a replayed batch leaves the same rows."""
    if mode not in ("replace", "ignore"):
        raise ValueError(f"unknown upsert mode {mode!r}")
    columns = [c for c in spark.table(table).columns if c != BUCKET]
    if order_by:
        updates = latest_per_key(updates, key, order_by)
    # written: the list of buckets and the join read the same rows
    updates = materialize(updates.select(*columns).withColumn(BUCKET, bucket_of(key, buckets)), "merge-batch")
    touched = sorted(r[0] for r in updates.select(BUCKET).distinct().collect())  # at most the number of buckets
    if not touched:
        return []
    now = spark.table(table).where(F.col(BUCKET).isin(touched)).withColumn("_old", F.lit(True)).alias("o")
    new = updates.repartition(buckets, key).withColumn("_new", F.lit(True)).alias("n")
    first, last = ("n", "o") if mode == "replace" else ("o", "n")
    taken = F.col("_new" if mode == "replace" else "_old").isNotNull()
    merged = now.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(
        *[F.when(taken, F.col(f"{first}.{c}")).otherwise(F.col(f"{last}.{c}")).alias(c) for c in [*columns, BUCKET]])
    overwrite_partitions(merged, table)
    return touched
