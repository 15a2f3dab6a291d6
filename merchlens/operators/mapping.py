"""Business record -> merchant mapping.

All per-row logic is built-in expressions: category text becomes an array
(P1), the MCC is the first category with a known code (P2, a literal map looked
up inside ``transform`` — no join, no shuffle), descriptions come from a
broadcast join with the fixed 17-row MCC table (J3, a proven size bound).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens import constants as K
from merchlens.functions.text import literal_map, split_categories

BUSINESS_SCHEMA = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("is_open", T.IntegerType()),
    T.StructField("categories", T.StringType()),
    T.StructField("neighborhood", T.StringType()),
    T.StructField("hours", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attributes", T.StructType([
        T.StructField("RestaurantsPriceRange2", T.StringType()),
        T.StructField("WiFi", T.StringType()),
        T.StructField("OutdoorSeating", T.BooleanType()),
        T.StructField("Parking", T.MapType(T.StringType(), T.BooleanType())),
    ])),
    T.StructField("review_velocity_30d", T.IntegerType()),
])


def nest_business(flat: DataFrame) -> DataFrame:
    """Flat business fixture -> nested record shape of BUSINESS_SCHEMA (hours map, attributes struct)."""
    hours = F.when(F.col("is_open") == 1, F.create_map(F.lit("Monday"), F.lit("09:00-17:00"),
                                                       F.lit("Friday"), F.lit("09:00-22:00")))
    attrs = F.struct(
        F.col("price_attr").alias("RestaurantsPriceRange2"), F.col("wifi").alias("WiFi"),
        F.lit(None).cast("boolean").alias("OutdoorSeating"),
        F.create_map(F.lit("street"), F.col("parking_street")).alias("Parking"))
    return flat.select("business_id", "name", "address", "city", "state", "postal_code", "latitude", "longitude",
                       "stars", "review_count", "is_open", "categories", "neighborhood", hours.alias("hours"),
                       attrs.alias("attributes"), "review_velocity_30d")


def categories_array(c: str | Column = "categories") -> Column:
    """Text is split on commas and trimmed; an array passes through."""
    return split_categories(c)


def mcc_from_categories(cats: Column) -> Column:
    """MCC of the first category (list order) that has one; default 5812."""
    m = literal_map(K.CATEGORY_TO_MCC)
    found = F.filter(F.transform(cats, lambda c: m[c]), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit(K.DEFAULT_MCC))


def mcc_table(spark: SparkSession) -> DataFrame:
    """The fixed MCC -> description table (17 rows)."""
    return spark.createDataFrame(sorted(K.MCC_DESCRIPTIONS.items()), "mcc_code string, mcc_description string")


def with_mcc_description(df: DataFrame, mcc_col: str = "mcc_code") -> DataFrame:
    """Broadcast left join to the MCC table; unknown codes -> General Retail."""
    t = F.broadcast(mcc_table(df.sparkSession).withColumnRenamed("mcc_code", "_mcc"))
    return (df.join(t, F.col(mcc_col) == F.col("_mcc"), "left").drop("_mcc")
            .withColumn("mcc_description", F.coalesce(F.col("mcc_description"), F.lit(K.DEFAULT_MCC_DESCRIPTION))))


def price_range(attr: Column) -> Column:
    """Integer price tier; missing, zero or non-integer -> 2."""
    return F.coalesce(F.nullif(attr.cast("string").try_cast("int"), F.lit(0)), F.lit(K.DEFAULT_PRICE_RANGE))


def expected_amount(pr: Column) -> Column:
    """P5: typical amount of a price tier (default 35)."""
    out = None
    for tier_, amt in K.PRICE_TO_AVG_TRANSACTION.items():
        out = (F.when(pr == tier_, F.lit(amt)) if out is None else out.when(pr == tier_, F.lit(amt)))
    return out.otherwise(F.lit(K.DEFAULT_EXPECTED_AMOUNT))


def business_to_merchant(biz: DataFrame) -> DataFrame:
    """Deterministic part of the business -> merchant mapping (random amount,
    method and time are not reproduced; the tier's expected amount stands in)."""
    price_col = F.col("attributes.RestaurantsPriceRange2") if "attributes" in biz.columns else F.col("price_attr")
    cats = categories_array("categories")
    pr = price_range(price_col)
    base = biz.select(
        F.col("business_id").alias("merchant_id"),
        F.coalesce(F.col("name"), F.lit("Unknown")).alias("merchant_name"),
        mcc_from_categories(cats).alias("mcc_code"),
        F.coalesce(F.col("city"), F.lit("")).alias("city"),
        F.coalesce(F.col("state"), F.lit("")).alias("state"),
        "neighborhood",
        F.coalesce(F.col("latitude"), F.lit(0.0)).alias("latitude"),
        F.coalesce(F.col("longitude"), F.lit(0.0)).alias("longitude"),
        F.col("stars").cast("double").alias("stars"),
        F.coalesce(F.col("review_count"), F.lit(0)).cast("int").alias("review_count"),
        F.coalesce(F.col("review_velocity_30d"), F.lit(0)).cast("int").alias("review_velocity_30d"),
        F.array_join(F.slice(cats, 1, 5), ", ").alias("categories"),
        (F.coalesce(F.col("is_open"), F.lit(1)) != 0).alias("is_open"),
        pr.alias("price_range"),
        expected_amount(pr).cast("double").alias("transaction_amount"),
    )
    return with_mcc_description(base)


def neighborhood_contains(df: DataFrame, text: str) -> DataFrame:
    """case-insensitive substring match on the neighborhood."""
    return df.where(F.contains(F.lower(F.coalesce(F.col("neighborhood"), F.lit(""))), F.lit(text.lower())))


def category_contains(df: DataFrame, text: str) -> DataFrame:
    """any comma-separated category contains ``text`` (case-insensitive)."""
    parts = F.split(F.lower(F.coalesce(F.col("categories"), F.lit(""))), ",", -1)
    return df.where(F.exists(parts, lambda c: F.contains(c, F.lit(text.lower()))))
