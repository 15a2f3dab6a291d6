"""Structured Streaming ingest (S5, S6, ST1, ST2, ST5, ST6, ST8).

The stream carries event envelopes as JSON text in a ``value`` column — the
shape of a Kafka record value.  ``kafka_source`` returns the production reader
(earliest offsets, bounded batches); tests and the registered queries feed the
same ``value`` column from files (no Kafka jar in this environment).

Every sink is idempotent per micro-batch (``foreachBatch`` writing the batch
to its own epoch folder of a merge-on-read keyed table), so a restart from the
checkpoint after an executor or driver loss replays a batch without
duplicating rows, and a batch costs O(batch) however large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from merchlens.operators.models import latest_per_key
from merchlens.operators.quality import validate_ingest
from merchlens.session import shuffles_removed
from merchlens.sources.upsert import log_append, log_maintain, log_read

SOURCE_NAME = "merchlens_pipeline"
EVENT_TYPE = "merchant_transaction"
SCHEMA_VERSION = "1.0"

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
# The whole transaction record travels: nothing that staging needs is lost on the way.
PAYLOAD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("transaction_id", _S), ("merchant_id", _S), ("merchant_name", _S), ("transaction_amount", _D), ("mcc_code", _S),
    ("mcc_description", _S), ("city", _S), ("state", _S), ("neighborhood", _S), ("latitude", _D), ("longitude", _D),
    ("timestamp", _S), ("acceptance_method", _S), ("stars", _D), ("review_count", _I), ("review_velocity_30d", _I),
    ("categories", _S), ("is_open", _I), ("price_range", _I))])
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("payload", PAYLOAD_SCHEMA),
    T.StructField("timestamp_ms", T.LongType()),
])


def to_envelope(txns: DataFrame, ts_col: str = "transaction_at") -> DataFrame:
    """One envelope per transaction as JSON text in ``value`` (deterministic
    event id = md5 of the transaction id, so re-sends are idempotent)."""
    payload = F.struct(*[
        (F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp") if f.name == "timestamp"
         else F.col(f.name).cast(f.dataType).alias(f.name)) for f in PAYLOAD_SCHEMA.fields
        if f.name == "timestamp" or f.name in txns.columns])
    env = F.struct(
        F.md5(F.col("transaction_id")).alias("event_id"), F.lit(EVENT_TYPE).alias("event_type"),
        F.lit(SOURCE_NAME).alias("source"), F.lit(SCHEMA_VERSION).alias("schema_version"),
        payload.alias("payload"), F.unix_millis(F.col(ts_col).cast("timestamp")).alias("timestamp_ms"))
    return txns.select(F.to_json(env).alias("value"))


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int = 200_000) -> DataFrame:
    """S5 production source: consumer group semantics come from the checkpoint."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", max_offsets).load()
            .select(F.col("value").cast("string").alias("value")))


def write_kafka(txns: DataFrame, servers: str, topic: str, ts_col: str = "transaction_at") -> None:
    """Send transactions as envelopes to a topic (gzip-compressed producer), keyed by merchant."""
    (to_envelope(txns, ts_col).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.compression.type", "gzip").save())


def file_source(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Envelope JSON lines from files, same ``value`` column as the Kafka source."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)


def parse_envelopes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelope text -> (valid transaction rows, rejects with reason).

    The rules are those of ``quality.validate_ingest``, as for every other way in."""
    e = values.select(F.col("value"), F.from_json("value", ENVELOPE).alias("e"))
    p = F.col("e.payload")
    flat = e.select("value", F.col("e.event_id").alias("event_id"), F.col("e.timestamp_ms").alias("timestamp_ms"),
                    (F.col("e").isNull() | p.isNull()).alias("_broken"), *[p[f.name].alias(f.name) for f in PAYLOAD_SCHEMA.fields])
    checked = validate_ingest(flat)
    reason = (F.when(F.col("_broken"), F.lit("unparseable envelope"))
              .when(F.col("transaction_id").isNull(), F.concat_ws("; ", F.lit("missing transaction_id"), F.col("reason")))
              .otherwise(F.col("reason")))
    tagged = checked.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).select(
        "event_id", *PAYLOAD_SCHEMA.names, "timestamp_ms", F.timestamp_millis("timestamp_ms").alias("event_time"))
    bad = tagged.where(F.col("_reason").isNotNull()).select("value", F.col("_reason").alias("reason"))
    return good, bad


#: Log epochs after which an ingest job folds its log into a snapshot.
COMPACT_EVERY = 50


def start_ingest(stream: DataFrame, raw_path: str, rejects_path: str, checkpoint: str,
                 available_now: bool = True, compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """ST1: envelope stream -> validate -> dedupe within the batch -> append to
    the raw keyed log (readers see the last write per transaction); rejects go
    to a side table, one folder per epoch.  Both writes read the batch at its source:
    a kept copy of the envelope text would take more disk than all that is written.  A batch's shuffles go with it.

    No record is dropped: bound a batch at its source (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``), where what is not read yet stays unread.  The log is compacted
    whenever ``compact_every`` epochs lie beyond its snapshot."""

    def batch(df: DataFrame, epoch: int) -> None:
        good, bad = parse_envelopes(df)
        good = latest_per_key(good, "transaction_id", [F.col("timestamp_ms").desc(), F.col("event_id").desc()])
        with shuffles_removed(df.sparkSession):
            log_append(good, raw_path, epoch)
        bad.write.mode("overwrite").parquet(f"{rejects_path}/epoch={epoch}")
        log_maintain(df.sparkSession, raw_path, "transaction_id", _raw_order(), compact_every)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _raw_order() -> list:
    """Later batch first, then the newer envelope."""
    return [F.col("_epoch").desc(), F.col("timestamp_ms").desc(), F.col("event_id").desc()]


def raw_table(spark: SparkSession, raw_path: str) -> DataFrame | None:
    """The raw table: last write per transaction id (later batch wins), with the columns that
    ``models.staging`` reads (``ts`` from the record, ``ingested_at`` from the envelope)."""
    rows = log_read(spark, raw_path, "transaction_id", _raw_order())
    return None if rows is None else rows.withColumns({"ts": F.to_timestamp("timestamp"), "ingested_at": F.col("event_time")})


def stream_dedup(stream: DataFrame, ts_col: str = "ts", key: str = "transaction_id",
                 watermark: str = "1 day") -> DataFrame:
    """ST2: streaming duplicate removal; keeps the *first* row seen per key while
    the watermark lasts (the batch W1 keeps the latest — a different guarantee)."""
    return stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])


def start_latest_state(stream: DataFrame, table: str, checkpoint: str, ts_col: str = "ts",
                       key: str = "merchant_id", compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """ST5: latest row per merchant as a table: each batch appends its newest
    row per key; ``read_latest_state`` orders by event time, so an older late
    row never replaces a newer one whatever batch it arrives in."""

    def batch(df: DataFrame, epoch: int) -> None:
        order = [F.col(ts_col).desc(), F.col("transaction_id").desc()]
        log_append(latest_per_key(df, key, order), table, epoch)
        log_maintain(df.sparkSession, table, key, order, compact_every)

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_latest_state(spark: SparkSession, table: str, ts_col: str = "ts", key: str = "merchant_id") -> DataFrame | None:
    return log_read(spark, table, key, [F.col(ts_col).desc(), F.col("transaction_id").desc()])


def alerts(stream: DataFrame, stats: DataFrame, sd_mult: float = 2.0) -> DataFrame:
    """ST6: stream-static join with per-merchant mean / sd; amount above mean + 2 sd alerts."""
    s = stats.select("merchant_id", F.col("mean_amount"), F.col("sd_amount"))
    return (stream.join(s, "merchant_id")
            .where(F.col("transaction_amount") > F.col("mean_amount") + sd_mult * F.coalesce(F.col("sd_amount"),
                                                                                              F.lit(0.0)))
            .select("transaction_id", "merchant_id", "transaction_amount", "mean_amount", "sd_amount",
                    F.col("ts")))


def _loaded_order() -> list:
    """Newest record first; what is as new is ordered by its content, so any file order loads alike."""
    return [F.col(c).desc_nulls_last() for c in ("ts", "merchant_id", "transaction_amount", "acceptance_method")]


def loaded_table(spark: SparkSession, raw_path: str) -> DataFrame | None:
    """The table behind ``start_batch_load``: one row per ``transaction_id``, the newest."""
    return log_read(spark, raw_path, "transaction_id", _loaded_order())


def start_batch_load(spark: SparkSession, staging_dir: str, archive_dir: str, raw_path: str, rejects_path: str,
                     checkpoint: str, max_files: int = 1000, array_sep: str = "|",
                     compact_every: int | None = COMPACT_EVERY) -> StreamingQuery:
    """S3: load every staged CSV file once, then archive it.

    A file-stream source over the staging folder: the checkpoint's file log is
    the record of processed files (a restart never loads a file twice) and
    ``cleanSource=archive`` moves processed files to ``archive_dir`` (Spark
    archives a batch's files when the next batch starts, so the last batch's
    files move on the next run).  Each micro-batch is parsed once (persisted
    for its two writes) and upserted by ``transaction_id`` into the keyed log
    under ``raw_path``: an epoch folder that a replay overwrites, read by
    ``loaded_table``."""
    from merchlens.sources.files import CSV_STRING_SCHEMA, parse_staging_rows

    stream = (spark.readStream.schema(CSV_STRING_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record")
              .option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
              .option("maxFilesPerTrigger", max_files).csv(staging_dir))

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            valid, rejects = parse_staging_rows(df, array_sep)
            with shuffles_removed(df.sparkSession):
                log_append(latest_per_key(valid, "transaction_id", _loaded_order()), raw_path, epoch)
            rejects.write.mode("overwrite").parquet(f"{rejects_path}/epoch={epoch}")
            log_maintain(df.sparkSession, raw_path, "transaction_id", _loaded_order(), compact_every)
        finally:
            df.unpersist()

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
