"""Catalog tables by layer: raw as a view, staging and marts as saved tables.

A :class:`Layers` is a folder and three schemas of the session's catalog (``<prefix>_raw``,
``<prefix>_staging``, ``<prefix>_marts``).  The tables are plain Parquet folders with a stated
layout, so any later session attaches them again from the folder (:func:`open_layers`); no
metastore service is needed, and where the session has one the tables are registered there.

Layout
* ``staging.transactions`` is partitioned by year and quarter, so a date range reads its
  quarters only (:func:`merchlens.operators.analytics.date_range` adds the partition
  predicates).  Rows are dealt to writers by a rebalance on the partition columns: adaptive
  execution splits a quarter that holds a third of all rows over several writers and merges small
  ones.  Inside a file rows are sorted by merchant.
* ``marts.merchant_latest`` is range-partitioned and sorted by merchant id, in small row groups
  with a Bloom filter on the id: a point lookup skips files and row groups by their minimum and
  maximum, and by the filter where ids interleave.
* :func:`merge_staging` rewrites only the quarters that a batch touches (dynamic partition
  overwrite), including those that a corrected transaction leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens.operators.models import RAW_COLUMNS, latest_per_key
from merchlens.session import materialize, overwrite_partitions
from merchlens.sources.upsert import _fs

STAGING_PARTITIONS = ["transaction_year", "transaction_quarter"]
#: Rows of a row group in tables made for point lookups.
LOOKUP_GROUP_ROWS = 20_000

#: table -> (layer, partition columns); every partition column is text.
TABLES: dict[str, tuple[str, list[str]]] = {
    "transactions": ("staging", STAGING_PARTITIONS),
    "merchants": ("marts", []),
    "merchant_latest": ("marts", []),
    "chunks": ("marts", []),
    "tfidf_postings": ("marts", []),
    "tfidf_idf": ("marts", []),
    "tfidf_norms": ("marts", []),
}


@dataclass(frozen=True)
class Layers:
    """Three schemas over one folder that all executors share."""

    root: str
    prefix: str = "merchlens"

    def schema(self, layer: str) -> str:
        return f"{self.prefix}_{layer}"

    def name(self, table: str) -> str:
        """Qualified name of a table of :data:`TABLES`."""
        return f"{self.schema(TABLES[table][0])}.{table}"

    def path(self, table: str) -> str:
        return f"{self.root}/{TABLES[table][0]}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.table(self.name(table))


def open_layers(spark: SparkSession, root: str, prefix: str = "merchlens") -> Layers:
    """The layers under ``root``: schemas are created, finished tables of the folder attached."""
    layers = Layers(root.rstrip("/"), prefix)
    for layer in ("raw", "staging", "marts"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{layers.schema(layer)}` LOCATION '{layers.root}/{layer}'")
    for table, (_, parts) in TABLES.items():
        fs, done = _fs(spark, layers.path(table) + "/_SUCCESS")
        if fs.exists(done) and not spark.catalog.tableExists(layers.name(table)):
            _attach(spark, layers.name(table), layers.path(table), parts)
    return layers


def _attach(spark: SparkSession, name: str, path: str, parts: list[str]) -> None:
    # folder names are text: a year is not to become a number
    fields = [T.StructField(f.name, T.StringType() if f.name in parts else f.dataType) for f in spark.read.parquet(path).schema]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION '{path}'")
    if parts:
        _sync(spark, name)


def _sync(spark: SparkSession, name: str) -> None:
    """Bring the catalog's list of partitions in step with the folder."""
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")


def raw_view(spark: SparkSession, layers: Layers, source_sql: str, name: str = "transactions") -> DataFrame:
    """The raw layer: a stored view of the warehouse columns over ``source_sql``, which names stored
    tables or files (``parquet.`path```), never temporary views."""
    full = f"{layers.schema('raw')}.{name}"
    spark.sql(f"CREATE OR REPLACE VIEW {full} AS SELECT {', '.join(RAW_COLUMNS)} FROM ({source_sql}) AS source")
    return spark.table(full)


def save(layers: Layers, table: str, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table of :data:`TABLES` whole (overwrite) and read it back."""
    parts = TABLES[table][1]
    w = df.write.format("parquet").mode("overwrite").option("path", layers.path(table)).options(**(options or {}))
    (w.partitionBy(*parts) if parts else w).saveAsTable(layers.name(table))
    return layers.read(df.sparkSession, table)


def _by_quarter(stg: DataFrame) -> DataFrame:
    """Rows of a quarter together, a large quarter over several tasks, sorted as the writer wants them."""
    columns = [c for c in stg.columns if c not in STAGING_PARTITIONS]
    dealt = stg.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(STAGING_PARTITIONS)}) */ * FROM {{stg}}", stg=stg)
    return dealt.select(*columns, *STAGING_PARTITIONS).sortWithinPartitions(*STAGING_PARTITIONS, "merchant_id")


def save_staging(layers: Layers, stg: DataFrame) -> DataFrame:
    """The staging model as a table partitioned by year and quarter."""
    return save(layers, "transactions", _by_quarter(stg))


def merge_staging(spark: SparkSession, layers: Layers, batch: DataFrame) -> int:
    """Merge staged rows into ``staging.transactions``: per transaction id the latest ``ingested_at`` stays (ties: later
    ``transaction_at``, then the batch).  Only quarters that the batch's rows enter or leave are rewritten;
    returns their number (the list of quarters is all that reaches the driver)."""
    batch = materialize(batch, "staging-batch")
    table = layers.read(spark, "transactions")
    left = table.join(batch.select("transaction_id"), "transaction_id", "left_semi").select(*STAGING_PARTITIONS)
    touched = left.union(batch.select(*STAGING_PARTITIONS)).distinct().collect()

    def among(rows) -> Column:
        c = F.lit(False)
        for r in rows:
            c = c | (F.col(STAGING_PARTITIONS[0]).eqNullSafe(F.lit(r[0])) & F.col(STAGING_PARTITIONS[1]).eqNullSafe(F.lit(r[1])))
        return c

    rows = table.where(among(touched)).withColumn("_new", F.lit(0)).unionByName(batch.select(*table.columns).withColumn("_new", F.lit(1)))
    order = [F.col("ingested_at").desc_nulls_last(), F.col("transaction_at").desc_nulls_last(), F.col("_new").desc()]
    merged = materialize(latest_per_key(rows, "transaction_id", order).drop("_new"), "staging-merged")
    filled = {tuple(r) for r in merged.select(*STAGING_PARTITIONS).distinct().collect()}
    overwrite_partitions(_by_quarter(merged), layers.name("transactions"))
    for r in touched:
        if tuple(r) not in filled:  # its last row moved to another quarter
            where = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(STAGING_PARTITIONS, r))
            fs, p = _fs(spark, f"{layers.path('transactions')}/{where}")
            fs.delete(p, True)
    _sync(spark, layers.name("transactions"))
    spark.catalog.refreshTable(layers.name("transactions"))
    return len(touched)


def lookup_options(key: str, group_rows: int = LOOKUP_GROUP_ROWS) -> dict[str, str]:
    """Parquet options of a table that is read by single values of ``key``."""
    return {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(group_rows),
            "parquet.block.row.count.limit": str(group_rows)}


def save_lookup(layers: Layers, table: str, df: DataFrame, key: str, group_rows: int = LOOKUP_GROUP_ROWS) -> DataFrame:
    """a table clustered by ``key`` for point lookups, written once."""
    return save(layers, table, df.repartitionByRange(key).sortWithinPartitions(key), lookup_options(key, group_rows))


def lookup(spark: SparkSession, layers: Layers, table: str, key: str, value) -> DataFrame:
    """the rows of one key value; the predicate reaches the scan and no job runs while the plan is built."""
    return layers.read(spark, table).where(F.col(key) == F.lit(value))


def describe(spark: SparkSession, layers: Layers) -> DataFrame:
    """(layer, table, kind, partitioned_by, row_count) of every view and table of the layers."""
    out = None
    for layer in ("raw", "staging", "marts"):
        for t in sorted(spark.catalog.listTables(layers.schema(layer)), key=lambda t: t.name):
            if t.isTemporary:
                continue
            full = f"{layers.schema(layer)}.{t.name}"
            parts = [c.name for c in spark.catalog.listColumns(full) if c.isPartition]
            row = spark.table(full).agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(layer).alias("layer"), F.lit(t.name).alias("table"), F.lit("view" if t.tableType == "VIEW" else "table").alias("kind"),
                F.lit(",".join(parts)).alias("partitioned_by"), "row_count")
            out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "layer string, table string, kind string, partitioned_by string, row_count long")
