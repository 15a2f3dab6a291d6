"""Registered queries: Structured Streaming jobs run to completion (availableNow)
over files derived from the driver tables, plus their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens.functions.numeric import dround
from merchlens.operators import models as M
from merchlens.plans.catalog import REGISTRY, register
from merchlens import constants as K
from merchlens.plans.sqltext import dr, sql_list, with_ctes
from merchlens.session import materialize, materialize_sliced, scratch_dir, shuffles_removed
from merchlens.sources import fixtures as FX
from merchlens.sources.upsert import log_append, log_read
from merchlens.streaming import ingest as I
from merchlens.streaming import windows as W


def _stream_files(spark, df, name, n_files=4):
    """Land a derived table as a folder of Parquet files and open it as a stream."""
    folder = scratch_dir(spark, name)
    df.repartition(n_files).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


#: MB of events (as given) for each file beyond four that arrives in event-time order, and bytes of its row groups.
SLICE_MB, ROW_GROUP_BYTES = 32, 4 << 20


def _slices(spark, sf):
    return max(4, -(-FX.input_mb(spark, sf, "events") // SLICE_MB))


def _stream_by_time(spark, df, name, ts="ts", slices=4, late=None):
    """The same as files that arrive in event-time order, one per micro-batch; ``late`` rows come
    with the last one.  The rows are cut once, so the task that writes a file reads its slice alone; the files'
    small row groups let a micro-batch read its file in several tasks."""
    folder, cut = scratch_dir(spark, name), scratch_dir(spark, name + "-slices")
    cuts = df.select(F.unix_micros(ts).alias("t")).approxQuantile("t", [i / slices for i in range(1, slices)], 0.01)
    bucket = sum((F.when(F.unix_micros(ts) >= F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumn("_slice", bucket)
    if late is not None:
        rows = rows.unionByName(late.withColumn("_slice", F.lit(slices - 1)))
    rows.write.partitionBy("_slice").parquet(cut)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(cut)
    for i in range(slices):
        part = kept.where(F.col("_slice") == i).drop("_slice")
        part.coalesce(1).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _keyed_updates(agg, spark, name, keys, mode="update"):
    """Run an aggregation in update mode into a keyed log; the newest value of each key."""
    table = scratch_dir(spark, name)
    _run(agg.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: log_append(df, table, epoch))
         .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True).start())
    return log_read(spark, table, keys, [F.col("_epoch").desc()])


def _run(query):
    query.awaitTermination()
    return query


def _txn_stream(spark, sf):
    return _stream_files(spark, FX.stream_txn(spark, sf), "stream-txn")


_VALID_STG = f"""
SELECT * FROM stg
WHERE transaction_id IS NOT NULL AND merchant_id IS NOT NULL AND merchant_name IS NOT NULL AND transaction_amount >= 0
  AND mcc_code IS NOT NULL AND mcc_description IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL
  AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND coalesce(acceptance_method, '{K.DEFAULT_ACCEPTANCE}') IN ({sql_list(K.ACCEPTANCE_METHODS)})"""


#: Envelopes of a file, and files of a micro-batch, at most.
FILE_ENVELOPES, MAX_BATCH_FILES = 100_000, 40


def _ingested(spark, sf, max_files=2):
    """All of staging sent as envelopes in bounded batches, beside a broken one; the raw table."""
    src = scratch_dir(spark, "envelopes")
    # compressed and written by the tasks that stage the rows: as plain text the envelopes take some 30 times the tables
    with FX.partitions_by_size(spark, sf, FX.slices_by_size(spark, sf)), shuffles_removed(spark):
        for raw in FX.raw_slices(spark, sf):
            (I.to_envelope(M.staging(raw, tiebreak=FX.DEDUPE_TIEBREAK)).write.mode("append").option("compression", "gzip")
             .option("maxRecordsPerFile", FILE_ENVELOPES).text(src))
    max_files = max(max_files, min(MAX_BATCH_FILES, FX.input_mb(spark, sf, "lineitem", "orders") // 32))
    spark.createDataFrame([("{broken envelope",)], "value string").write.mode("append").text(src)
    raw, rejects = scratch_dir(spark, "raw"), scratch_dir(spark, "rejects")
    _run(I.start_ingest(I.file_source(spark, src, max_files=max_files), raw, rejects, scratch_dir(spark, "ckpt")))
    return I.raw_table(spark, raw)


def _by_slices(spark, sf, rows):
    return materialize_sliced(rows, "settled", "transaction_id", FX.slices_by_size(spark, sf))


@register("stream_ingest_envelope", with_ctes(f"""
SELECT md5(transaction_id) AS event_id, transaction_id, merchant_id, merchant_name, transaction_amount, mcc_code,
       mcc_description, city, state, neighborhood, latitude, longitude,
       strftime(transaction_at, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       coalesce(acceptance_method, '{K.DEFAULT_ACCEPTANCE}') AS acceptance_method, stars, review_count,
       review_velocity_30d, categories, CAST(is_open AS INTEGER) AS is_open, CAST(price_range AS INTEGER) AS price_range,
       epoch_ms(transaction_at) AS timestamp_ms, make_timestamp(epoch_ms(transaction_at) * 1000) AS event_time
FROM valid""", "stg", local=[("valid", _VALID_STG)]), ids=("S5", "ST1", "ST8", "F7"))
def q_stream_ingest_envelope(spark, sf):
    return _by_slices(spark, sf, _ingested(spark, sf).drop("ts", "ingested_at"))


@register("stream_raw_staging", with_ctes("""
SELECT transaction_id, merchant_id, merchant_name, transaction_amount, mcc_code, mcc_description, city, state, neighborhood,
       latitude, longitude, transaction_at, acceptance_method, stars, review_count, review_velocity_30d, categories, is_open,
       price_range, transaction_value_tier, price_symbol, transaction_quarter, transaction_year
FROM valid""", "stg", local=[("valid", _VALID_STG)]), ids=("S5", "ST1", "S14"))
def q_stream_raw_staging(spark, sf):
    """The staging model over the raw table that the stream wrote."""
    return _by_slices(spark, sf, M.staging(_ingested(spark, sf, max_files=1)).drop("ingested_at"))


@register("stream_dedup", with_ctes(
    "SELECT transaction_id, merchant_id, transaction_amount, acceptance_method, ts FROM stream_txn", "stream_txn"),
    ids=("ST2",))
def q_stream_dedup(spark, sf):
    """Every seventh transaction is sent again at once, every fifth again long after: the first
    copies fall to the duplicate test, the others are late and fall to the watermark."""
    out = scratch_dir(spark, "dedup-out")
    txn = FX.stream_txn(spark, sf)
    number = F.col("transaction_id").cast("long")
    early = txn.where(number % 5 == 0).where(F.col("ts") < txn.select((F.min("ts") + F.expr("INTERVAL 5 DAYS"))).scalar())
    s = I.stream_dedup(_stream_by_time(spark, txn.unionByName(txn.where(number % 7 == 0)), "dups", slices=_slices(spark, sf), late=early), watermark="1 day")
    _run(s.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@register("stream_daily_acceptance", with_ctes(f"""
SELECT date_trunc('day', ts) AS window_start, acceptance_method, count(*) AS n_txns,
       {dr('sum(transaction_amount)', 2)} AS amount
FROM stream_txn GROUP BY 1, 2""", "stream_txn"), ids=("ST3",))
def q_stream_daily_acceptance(spark, sf):
    txn = FX.stream_txn(spark, sf)
    late = txn.where(F.col("ts") < txn.select((F.min("ts") + F.expr("INTERVAL 5 DAYS"))).scalar())  # sent again, too late to count
    agg = W.daily_acceptance(_stream_by_time(spark, txn, "daily", slices=_slices(spark, sf), late=late), watermark="1 day")
    return _keyed_updates(agg, spark, "daily-state", ["window_start", "acceptance_method"])


@register("velocity_30d", with_ctes(f"""
SELECT merchant_id, day, txns_day,
       sum(txns_day) OVER w AS txns_30d, {dr('sum(amt) OVER w', 2)} AS amount_30d
FROM (SELECT merchant_id, CAST(ts AS DATE) AS day, count(*) AS txns_day, sum(transaction_amount) AS amt
      FROM stream_txn GROUP BY 1, 2)
WINDOW w AS (PARTITION BY merchant_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
    "stream_txn"), ids=("ST4",))
def q_velocity_30d(spark, sf):
    return W.velocity_30d(FX.stream_txn(spark, sf))


@register("velocity_30d_stream", with_ctes("""
SELECT merchant_id, CAST(d AS TIMESTAMP) AS window_start, CAST(d + INTERVAL 30 DAYS AS TIMESTAMP) AS window_end, count(*) AS txns_30d
FROM (SELECT merchant_id, CAST(ts AS DATE) - CAST(k AS INTEGER) AS d FROM stream_txn, (SELECT unnest(range(0, 30)) AS k))
GROUP BY merchant_id, d""", "stream_txn"), ids=("ST4",))
def q_velocity_30d_stream(spark, sf):
    agg = W.velocity_30d_stream(_stream_by_time(spark, FX.stream_txn(spark, sf), "velocity", slices=_slices(spark, sf)))
    return _keyed_updates(agg, spark, "velocity-state", ["merchant_id", "window_start"])


_GAP = "6 hours"


@register("stream_sessions", with_ctes(f"""
SELECT merchant_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n_events,
       {dr('sum(transaction_amount)', 2)} AS amount
FROM (SELECT *, sum(new_s) OVER (PARTITION BY merchant_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY merchant_id ORDER BY ts) IS NULL
                            OR ts - lag(ts) OVER (PARTITION BY merchant_id ORDER BY ts) >= INTERVAL 6 HOURS
                           THEN 1 ELSE 0 END AS new_s FROM stream_txn))
GROUP BY merchant_id, sid""", "stream_txn"), ids=("ST7",))
def q_stream_sessions(spark, sf):
    return W.activity_sessions(FX.stream_txn(spark, sf), gap=_GAP)


_SESSIONS_SQL = next(e.sql for n, e in REGISTRY.items() if n == "stream_sessions")


@register("stream_sessions_streaming", _SESSIONS_SQL, ids=("ST7",))
def q_stream_sessions_streaming(spark, sf):
    """The streaming session windows: a row far in the future moves the watermark past all sessions."""
    txn = FX.stream_txn(spark, sf)
    flush = txn.limit(1).withColumns({"merchant_id": F.lit("flush"), "transaction_id": F.lit("flush"),
                                      "ts": F.col("ts") + F.expr("INTERVAL 20 YEARS")})
    out = scratch_dir(spark, "sessions")
    s = W.activity_sessions(_stream_by_time(spark, txn, "session-txn", slices=_slices(spark, sf), late=flush), gap=_GAP)
    _run(s.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out).where("merchant_id <> 'flush'")


@register("stream_latest", with_ctes("""
SELECT merchant_id, transaction_id, transaction_amount, acceptance_method, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id
                               ORDER BY ts DESC NULLS LAST, transaction_id DESC NULLS LAST) AS rn
  FROM stream_txn) WHERE rn = 1""", "stream_txn"), ids=("ST5",))
def q_stream_latest(spark, sf):
    table = scratch_dir(spark, "latest-state")
    _run(I.start_latest_state(_txn_stream(spark, sf), table, scratch_dir(spark, "ckpt")))
    return I.read_latest_state(spark, table)


@register("stream_alerts", with_ctes(f"""
SELECT t.transaction_id, t.merchant_id, t.transaction_amount, {dr('s.mean_amount', 6)} AS mean_amount,
       {dr('s.sd_amount', 6)} AS sd_amount, t.ts
FROM stream_txn t JOIN (
  SELECT merchant_id, avg(transaction_amount) AS mean_amount, stddev_samp(transaction_amount) AS sd_amount
  FROM stream_txn GROUP BY merchant_id) s USING (merchant_id)
WHERE t.transaction_amount > s.mean_amount + 2.0 * coalesce(s.sd_amount, 0.0)""", "stream_txn"), ids=("ST6",))
def q_stream_alerts(spark, sf):
    txn = FX.stream_txn(spark, sf)
    stats = txn.groupBy("merchant_id").agg(F.avg("transaction_amount").alias("mean_amount"),
                                           F.stddev_samp("transaction_amount").alias("sd_amount"))
    out = scratch_dir(spark, "alerts")
    # written once: the static side of a stream-static join is read again by every micro-batch
    a = I.alerts(_txn_stream(spark, sf), materialize(stats, "alert-stats"))
    _run(a.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True).start())
    return spark.read.parquet(out).select("transaction_id", "merchant_id", "transaction_amount",
                                          dround("mean_amount", 6).alias("mean_amount"),
                                          dround("sd_amount", 6).alias("sd_amount"), "ts")


@register("stream_memory", with_ctes("""
SELECT session_id, turn_no, human, ai FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS back FROM turn_pairs)
WHERE back <= 10""", "turn_pairs"), ids=("M1", "ST7"))
def q_stream_memory(spark, sf):
    pairs = FX.turn_pairs(spark, sf)
    out = scratch_dir(spark, "memory")

    def batch(df, epoch):
        # one folder per epoch, overwritten on replay: idempotent after a restart
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    mem = W.conversation_memory(_stream_files(spark, pairs, "turns"))
    _run(mem.writeStream.outputMode("update").foreachBatch(batch)
         .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True).start())
    # a session's memory is what its latest emitting epoch says
    emitted = spark.read.schema(T.StructType(W.MEMORY_OUT.fields + [T.StructField("epoch", T.LongType())])).parquet(out)
    w = Window.partitionBy("session_id")
    return (emitted.withColumn("_last", F.max("epoch").over(w)).where(F.col("epoch") == F.col("_last"))
            .select("session_id", "turn_no", "human", "ai"))
