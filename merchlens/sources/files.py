"""File sources and sinks.

Readers always take an explicit schema (no inference) and split good rows from
rejects inside Spark: a malformed value becomes a reject row with a reason,
never an exception that stops the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens import constants as K
from merchlens.functions.text import mcc_pad
from merchlens.operators.mapping import BUSINESS_SCHEMA, business_to_merchant

STAGING_CSV_COLUMNS = [
    "transaction_id", "merchant_id", "merchant_name", "transaction_amount", "mcc_code", "mcc_description",
    "city", "state", "neighborhood", "latitude", "longitude", "timestamp", "acceptance_method", "stars",
    "review_count", "review_velocity_30d", "categories", "is_open", "price_range",
]


def _arr(df: DataFrame, c: str) -> Column:
    dt = dict(df.dtypes).get(c, "string")
    if dt.startswith("array"):
        return F.col(c)
    return F.filter(F.transform(F.split(F.col(c), ",", -1), lambda s: F.trim(s)), lambda s: s != "")


def _num_or(c: str, default: str) -> Column:
    v = F.col(c)
    return F.when(v.isNull() | (v == 0), F.lit(default)).otherwise(v.cast("string"))


def staging_csv_frame(df: DataFrame, ts_col: str = "ts", array_sep: str = "|") -> DataFrame:
    """S2 text layout: arrays joined by ``array_sep``, null text -> '', null counts -> 0,
    null price -> 2, ``is_open`` as 0/1, ISO timestamps."""
    return df.select(
        F.col("transaction_id").cast("string"), F.col("merchant_id").cast("string"), "merchant_name",
        F.col("transaction_amount").cast("string").alias("transaction_amount"), "mcc_code", "mcc_description",
        "city", "state", F.coalesce(F.col("neighborhood"), F.lit("")).alias("neighborhood"),
        F.col("latitude").cast("string").alias("latitude"), F.col("longitude").cast("string").alias("longitude"),
        F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "acceptance_method",
        F.when(F.col("stars").isNull() | (F.col("stars") == 0), F.lit("")).otherwise(
            F.col("stars").cast("string")).alias("stars"),
        _num_or("review_count", "0").alias("review_count"),
        _num_or("review_velocity_30d", "0").alias("review_velocity_30d"),
        F.array_join(_arr(df, "categories"), array_sep).alias("categories"),
        F.col("is_open").cast("boolean").cast("int").cast("string").alias("is_open"),
        _num_or("price_range", "2").alias("price_range"),
    )


def write_staging_csv(df: DataFrame, path: str, ts_col: str = "ts", array_sep: str = "|", mode: str = "overwrite") -> None:
    """Write transactions as header CSV (one file per partition, many writers)."""
    (staging_csv_frame(df, ts_col, array_sep).write.mode(mode).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


CSV_STRING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STAGING_CSV_COLUMNS]
                                 + [T.StructField("_corrupt_record", T.StringType())])


def parse_staging_rows(raw: DataFrame, array_sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """S1 core: coerce text fields; any field that fails makes the row a reject."""
    c = F.col
    amt = c("transaction_amount").try_cast("double")
    lat = c("latitude").try_cast("double")
    lon = c("longitude").try_cast("double")
    ts = F.try_to_timestamp(c("timestamp"))
    stars = F.when(F.coalesce(c("stars"), F.lit("")) == "", F.lit(None).cast("double")).otherwise(
        c("stars").try_cast("double"))

    def int_or(col: str, default: int) -> Column:
        v = F.coalesce(c(col), F.lit(""))
        return F.when(v == "", F.lit(default)).otherwise(c(col).try_cast("int"))
    is_open = c("is_open").try_cast("int")
    reasons = F.array_compact(F.array(
        F.when(c("_corrupt_record").isNotNull(), F.lit("malformed line")),
        *[F.when(c(f).isNull(), F.lit(f"missing {f}")) for f in
          ("transaction_id", "merchant_id", "merchant_name", "mcc_code", "mcc_description", "city", "state")],
        F.when(amt.isNull(), F.lit("bad transaction_amount")).when(amt < 0, F.lit("negative transaction_amount")),
        F.when(lat.isNull(), F.lit("bad latitude")),
        F.when(lon.isNull(), F.lit("bad longitude")),
        F.when(ts.isNull(), F.lit("bad timestamp")),
        F.when(~F.coalesce(c("acceptance_method"), F.lit("")).isin(K.ACCEPTANCE_METHODS),
               F.lit("bad acceptance_method")),
        F.when(c("stars").isNotNull() & (c("stars") != "") & stars.isNull(), F.lit("bad stars")),
        F.when(int_or("review_count", 0).isNull(), F.lit("bad review_count")),
        F.when(int_or("review_velocity_30d", 0).isNull(), F.lit("bad review_velocity_30d")),
        F.when(is_open.isNull(), F.lit("bad is_open")),
        F.when(int_or("price_range", 2).isNull(), F.lit("bad price_range")),
    ))
    tagged = raw.withColumn("_reasons", reasons)
    valid = tagged.where(F.size("_reasons") == 0).select(
        "transaction_id", "merchant_id", "merchant_name", amt.alias("transaction_amount"),
        mcc_pad(c("mcc_code")).alias("mcc_code"), "mcc_description", "city", "state",
        F.nullif(c("neighborhood"), F.lit("")).alias("neighborhood"), lat.alias("latitude"),
        lon.alias("longitude"), ts.alias("ts"), "acceptance_method", stars.alias("stars"),
        int_or("review_count", 0).alias("review_count"),
        int_or("review_velocity_30d", 0).alias("review_velocity_30d"),
        F.filter(F.split(F.coalesce(c("categories"), F.lit("")), F.lit(array_sep.replace("|", "\\|")), -1),
                 lambda s: s != "").alias("categories"),
        (is_open != 0).alias("is_open"), int_or("price_range", 2).alias("price_range"))
    rejects = tagged.where(F.size("_reasons") > 0).select(
        "transaction_id", F.array_join("_reasons", "; ").alias("reason"), "_corrupt_record")
    return valid, rejects


def read_staging_csv(spark: SparkSession, path: str, array_sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Read staged CSV files as text with a fixed schema, then coerce (valid, rejects)."""
    raw = (spark.read.schema(CSV_STRING_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    return parse_staging_rows(raw, array_sep)


def read_business_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nested business JSON lines with a fixed schema; unreadable lines go to rejects.

    Lines are read as text and parsed with ``from_json`` (PERMISSIVE, corrupt
    text kept), so any projection — a bare count, or only the rejects — is a
    valid query; the JSON file source refuses plans that touch nothing but its
    corrupt-record column.  Blank lines are skipped, as the JSON source does."""
    schema = T.StructType(BUSINESS_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE",
                                                    "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
                      ).select("r.*")
    return (df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"),
            df.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record"))


def ingest_landed(spark: SparkSession, folder: str) -> DataFrame:
    """Map every landed business record to a merchant row, by file suffix:
    ``*.json`` lines and ``*.csv`` with header; other files are skipped; a bad
    line is dropped without stopping its file."""
    good_json, _ = read_business_json(spark, folder + "/*.json")
    csv_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in BUSINESS_SCHEMA.fields
                               if f.name not in ("hours", "attributes")])
    csv = (spark.read.schema(csv_schema).option("header", True).option("mode", "DROPMALFORMED")
           .option("pathGlobFilter", "*.csv").csv(folder))
    csv_typed = csv.select(
        "business_id", "name", "address", "city", "state", "postal_code",
        F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.col("stars").try_cast("double").alias("stars"), F.col("review_count").try_cast("int").alias("review_count"),
        F.col("is_open").try_cast("int").alias("is_open"), "categories", "neighborhood",
        F.lit(None).cast(BUSINESS_SCHEMA["hours"].dataType).alias("hours"),
        F.lit(None).cast(BUSINESS_SCHEMA["attributes"].dataType).alias("attributes"),
        F.col("review_velocity_30d").try_cast("int").alias("review_velocity_30d"))
    return business_to_merchant(good_json.unionByName(csv_typed))


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Load appended JSON rows; unreadable lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Keep the rows of one run (a report) under its run key; writing a run again replaces it, other runs stay."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every kept run, with the run key as text."""
    rows = spark.read.parquet(path)
    return rows.withColumn("run_id", F.col("run_id").cast("string"))
