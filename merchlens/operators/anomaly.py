"""Anomaly detection jobs.

Each detector computes its global statistics once as ONE scalar subquery over
the input (partial aggregation, one row), attached as a struct column and read
field by field (each ``getField`` on the bare subquery would plan another
subquery), then filters the rows — a narrow pass, no shuffle, no window over
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.numeric import dec_text, dround


def _name():
    return F.coalesce(F.col("merchant_name").cast("string"), F.lit("None"))


def amount_outliers(df: DataFrame, z_threshold: float = K.ANOMALY_Z) -> DataFrame:
    """|z| >= 2.5 on amounts (null -> 0), sample sd (0 -> 1), needs more than 3 rows."""
    a = F.coalesce(F.col("transaction_amount").cast("double"), F.lit(0.0))
    st = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mu"),
                            F.stddev_samp(a).alias("sd")).alias("s")).scalar()
    mu = F.col("_st.mu")
    sd = F.coalesce(F.nullif(F.col("_st.sd"), F.lit(0.0)), F.lit(1.0))
    z = (a - mu) / sd
    direction = F.when(z > 0, F.lit("high")).otherwise(F.lit("low"))
    out = df.withColumn("_st", st).select(
        "merchant_id", F.col("merchant_name"), a.alias("value"), z.alias("_z"), mu.alias("_mu"),
        direction.alias("direction"), F.col("_st.n").alias("_n")) \
        .where((F.col("_n") > 3) & (F.abs(F.col("_z")) >= z_threshold))
    narrative = F.concat(
        _name(), F.lit(" has an unusually "), F.col("direction"), F.lit(" average transaction of $"),
        dec_text("value", 2), F.lit(" (global mean: $"), dec_text("_mu", 2), F.lit(", z="), dec_text("_z", 2),
        F.lit("). This may indicate "),
        F.when(F.col("_z") > 0, F.lit("premium positioning")).otherwise(F.lit("discount/fast-casual operation")),
        F.lit("."))
    return out.select(
        F.lit("amount_outlier").alias("type"), "merchant_id", "merchant_name", "value",
        dround("_z", 2).alias("z_score"), "direction", dround("_mu", 2).alias("mean"), narrative.alias("narrative"))


def velocity_spikes(df: DataFrame, mult: float = K.VELOCITY_SPIKE_MULT,
                    floor: int = K.VELOCITY_SPIKE_FLOOR) -> DataFrame:
    """Velocity > 3 x mean and > 10 (mean 0 -> 1), needs more than 3 rows."""
    v = F.coalesce(F.col("review_velocity_30d"), F.lit(0)).cast("long")
    st = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.avg(v.cast("double")).alias("mv")).alias("s")).scalar()
    mv = F.coalesce(F.nullif(F.col("_st.mv"), F.lit(0.0)), F.lit(1.0))
    out = df.withColumn("_st", st).select(
        "merchant_id", "merchant_name", v.alias("velocity"), mv.alias("_mv"), F.col("_st.n").alias("_n")) \
        .where((F.col("_n") > 3) & (F.col("velocity") > F.col("_mv") * mult) & (F.col("velocity") > floor))
    ratio = F.col("velocity") / F.col("_mv")
    narrative = F.concat(
        _name(), F.lit(" is receiving "), F.col("velocity").cast("string"), F.lit(" reviews/30d — "),
        dec_text(ratio, 1), F.lit("x the dataset average of "), dec_text("_mv", 1),
        F.lit(". This signals strong viral growth or a recent viral event."))
    return out.select(
        F.lit("review_velocity_spike").alias("type"), "merchant_id", "merchant_name", "velocity",
        dround("_mv", 1).alias("mean_velocity"), dround(ratio, 1).alias("spike_factor"),
        narrative.alias("narrative"))


def low_stars(df: DataFrame, z_threshold: float = K.ANOMALY_Z) -> DataFrame:
    """Z < -2.5 over rated rows; one rated row -> sd 0.5; sd 0 -> 0.5."""
    s = F.col("stars").cast("double")
    rated = F.when(F.coalesce(s, F.lit(0.0)) != 0, s)
    st = df.select(F.struct(F.count(rated).alias("n"), F.avg(rated).alias("mu"),
                            F.stddev_samp(rated).alias("sd")).alias("s")).scalar()
    sd = F.when(F.col("_st.n") > 1, F.coalesce(F.nullif(F.col("_st.sd"), F.lit(0.0)), F.lit(K.LOW_STAR_DEFAULT_SD))) \
        .otherwise(F.lit(K.LOW_STAR_DEFAULT_SD))
    z = (s - F.col("_st.mu")) / sd
    out = df.withColumn("_st", st).select("merchant_id", "merchant_name", s.alias("stars"), z.alias("_z"),
                                          F.col("_st.mu").alias("_mu")) \
        .where((F.col("stars") > 0) & (F.col("_z") < -z_threshold))
    narrative = F.concat(
        _name(), F.lit(" has a significantly low rating of "), F.col("stars").cast("string"),
        F.lit(" stars (mean: "), dec_text("_mu", 2), F.lit(", z="), dec_text("_z", 2),
        F.lit("). May warrant customer experience review."))
    return out.select(F.lit("low_star_outlier").alias("type"), "merchant_id", "merchant_name", "stars",
                      dround("_z", 2).alias("z_score"), narrative.alias("narrative"))


def all_anomalies(df: DataFrame) -> DataFrame:
    """The three lists as one frame (missing columns become null)."""
    return (amount_outliers(df)
            .unionByName(velocity_spikes(df), allowMissingColumns=True)
            .unionByName(low_stars(df), allowMissingColumns=True))


ANOMALY_COLUMNS = ["type", "merchant_id", "merchant_name", "value", "z_score", "direction", "mean",
                   "velocity", "mean_velocity", "spike_factor", "stars", "narrative"]


def type_counts(anomalies: DataFrame) -> DataFrame:
    """Anomaly count per type."""
    return anomalies.groupBy("type").agg(F.count(F.lit(1)).alias("anomaly_count"))


_TYPE_ORDER = ["amount_outlier", "review_velocity_spike", "low_star_outlier"]


def health_summary(merchants: DataFrame, as_of: str, task: str = "pipeline_health_check") -> DataFrame:
    """Validate -> freshness -> anomalies -> one summary row with the report text.

    Each step is an aggregate over the same (cached by the caller) input; the
    three results are one-row frames combined through scalar subqueries, and the
    top-3 narratives come from a bounded ``limit(3)`` — nothing unbounded is
    collected."""
    from merchlens.operators import quality as Q

    v = Q.validation_summary(Q.validate_records(merchants))
    fr = Q.freshness_report(Q.freshness(merchants, as_of))
    an = all_anomalies(merchants)
    rank = F.array_position(F.array(*[F.lit(t) for t in _TYPE_ORDER]), F.col("type"))
    counts = type_counts(an).withColumn("_k", rank)
    counts_text = counts.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_k", "type", "anomaly_count"))),
        lambda x: F.concat(x["type"], F.lit(": "), x["anomaly_count"].cast("string"))), " | ")).scalar()
    total = an.select(F.count(F.lit(1))).scalar()
    top3 = (an.select(rank.alias("_k"), "merchant_id", "narrative")
            .orderBy("_k", "merchant_id").limit(3)
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "merchant_id", "narrative"))),
                                          lambda x: F.concat(F.lit("  • "), x["narrative"])), "\n")).scalar())
    fstat = fr.select(F.struct("status", "fresh", "stale_critical")).scalar()
    # every subquery attached once as a column, then read by name
    base = v.withColumns({"_f": fstat, "_total": total, "_counts": counts_text, "_top3": top3})
    n = F.col("_total")
    anomaly_part = F.when(n > 0, F.concat(
        F.lit("Anomalies Detected: "), n.cast("string"), F.lit(" total | "), F.col("_counts"),
        F.lit("\n\nTop anomalies:\n"), F.col("_top3"))).otherwise(F.lit("Anomalies Detected: None"))
    text = F.concat(
        F.lit(f"Agent Pipeline Summary — Task: {task}\n\n"),
        F.lit("Data Validation: "), F.upper("status"), F.lit(" | "), F.col("passed").cast("string"), F.lit("/"),
        F.col("total").cast("string"), F.lit(" records passed ("), F.col("pass_rate"), F.lit(")\n"),
        F.lit("Data Freshness: "), F.upper(F.col("_f.status")), F.lit(" | "),
        F.col("_f.fresh").cast("string"), F.lit(" fresh, "), F.col("_f.stale_critical").cast("string"),
        F.lit(" critical\n"), anomaly_part)
    return base.select(F.col("status").alias("validation_status"), "pass_rate",
                       F.col("_f.status").alias("freshness_status"),
                       n.alias("anomaly_count"), text.alias("summary"))
