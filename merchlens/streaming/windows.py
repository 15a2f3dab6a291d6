"""Event-time aggregation: tumbling, sliding and session windows (ST3, ST4, ST7) and
conversation memory as streaming state (M1 / ST7 via ``applyInPandasWithState``).

Every streaming aggregation carries a watermark so state is bounded and late
rows are dropped by Spark.  Each has a batch twin used as its correctness check.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from merchlens import constants as K
from merchlens.functions.numeric import dround


def daily_acceptance(df: DataFrame, ts_col: str = "ts", watermark: str | None = "2 days") -> DataFrame:
    """ST3: counts and amounts per 1-day tumbling window and acceptance method."""
    src = df.withWatermark(ts_col, watermark) if watermark and df.isStreaming else df
    return (src.groupBy(F.window(ts_col, "1 day").alias("w"), "acceptance_method")
            .agg(F.count(F.lit(1)).alias("n_txns"), F.sum("transaction_amount").alias("amount"))
            .select(F.col("w.start").alias("window_start"), "acceptance_method", "n_txns",
                    dround("amount", 2).alias("amount")))


def velocity_30d(df: DataFrame, ts_col: str = "ts", days: int = 30) -> DataFrame:
    """ST4 batch twin: trailing 30-day activity per merchant on each active day.

    Rows are first folded to one row per (merchant, day) — a partial aggregate
    that absorbs hot merchants — so the range window per merchant holds at most
    one row per calendar day, however many transactions there are."""
    daily = (df.groupBy("merchant_id", F.to_date(F.col(ts_col)).alias("day"))
             .agg(F.count(F.lit(1)).alias("txns_day"), F.sum("transaction_amount").alias("_amt")))
    w = Window.partitionBy("merchant_id").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select("merchant_id", "day", "txns_day",
                        F.sum("txns_day").over(w).alias("txns_30d"),
                        dround(F.sum("_amt").over(w), 2).alias("amount_30d"))


def velocity_30d_stream(stream: DataFrame, ts_col: str = "ts", watermark: str = "2 days") -> DataFrame:
    """ST4 streaming form: 30-day windows sliding by a day, per merchant."""
    return (stream.withWatermark(ts_col, watermark)
            .groupBy("merchant_id", F.window(ts_col, "30 days", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("txns_30d"))
            .select("merchant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "txns_30d"))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(duration: str) -> int:
    """'30 minutes' -> 1800 (one number and one unit)."""
    n, unit = duration.split()
    return int(n) * _UNIT_SECONDS[unit.lower().rstrip("s")]


def activity_sessions(df: DataFrame, ts_col: str = "ts", gap: str = "30 minutes",
                      key: str = "merchant_id", watermark: str | None = "1 hour",
                      bucket: str = "1 day") -> DataFrame:
    """ST7: session windows of activity per key (a session ends after ``gap`` of silence).

    Streaming input: Spark's session window with a watermark (state bounded by
    the watermark).  Batch input is sessionised in two exact stages so a key
    holding a third of all rows is not handled by one task:

    1. sessions per (key, time bucket) — a hot key is spread over its buckets;
    2. a fragment that starts within ``gap`` of its bucket's start or ends
       after its bucket's end may continue a session of the neighbouring
       bucket; only those (at most two per key and bucket) are merged again,
       with a session window whose per-row gap is the fragment's own span.
       Every other fragment is already a whole session."""
    def out(frame: DataFrame, n: str, amt: str) -> DataFrame:
        return frame.select(key, "session_start", "session_end", F.col(n).alias("n_events"),
                            dround(amt, 2).alias("amount"))

    if df.isStreaming:
        src = df.withWatermark(ts_col, watermark) if watermark else df
        s = (src.groupBy(key, F.session_window(ts_col, gap).alias("s"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum("transaction_amount").alias("_amt"))
             .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                     "_n", "_amt"))
        return out(s, "_n", "_amt")
    g_us, b_us = _seconds(gap) * 1_000_000, _seconds(bucket) * 1_000_000
    frag = (df.groupBy(key, F.floor(F.unix_micros(F.col(ts_col)) / F.lit(b_us)).alias("_b"),
                       F.session_window(ts_col, gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("transaction_amount").alias("_amt"))
            .select(key, "_b", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "_n", "_amt"))
    lo = F.col("_b") * F.lit(b_us)
    near_edge = ((F.unix_micros("session_start") < lo + F.lit(g_us))
                 | (F.unix_micros("session_end") > lo + F.lit(b_us)))
    # the predicate names an aggregate result (_n), so Catalyst keeps it above
    # the session aggregate: pushed below it, it would test each event's
    # unmerged window instead of the merged session
    edge = F.when(F.col("_n") > 0, near_edge).otherwise(F.lit(True))
    span = F.make_interval(secs=((F.unix_micros("session_end") - F.unix_micros("session_start")) / F.lit(1e6))
                           .cast("decimal(18,6)"))
    joined = (frag.where(edge).groupBy(key, F.session_window("session_start", span).alias("s"))
              .agg(F.sum("_n").alias("_n"), F.sum("_amt").alias("_amt"))
              .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                      "_n", "_amt"))
    return out(frag.where(~edge).drop("_b").unionByName(joined), "_n", "_amt")


MEMORY_OUT = T.StructType([
    T.StructField("session_id", T.LongType()), T.StructField("turn_no", T.LongType()),
    T.StructField("human", T.StringType()), T.StructField("ai", T.StringType()),
])
MEMORY_STATE = T.StructType([
    T.StructField("turn_no", T.ArrayType(T.LongType())), T.StructField("human", T.ArrayType(T.StringType())),
    T.StructField("ai", T.ArrayType(T.StringType())),
])


def conversation_memory(turns: DataFrame, max_turns: int = K.MAX_TURNS, timeout_ms: int | None = None):
    """M1 as streaming state: per session keep the last ``max_turns`` turns
    (state is bounded by ``max_turns``). With ``timeout_ms`` idle sessions
    expire after that much processing time; leave it unset for ``availableNow``
    runs, because a processing-time timeout makes Spark schedule another
    (empty) batch after every batch, so such a query never drains.
    Emits the kept turns of every session updated in a micro-batch."""

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            t, h, a = state.get
            kept = pd.DataFrame({"turn_no": list(t), "human": list(h), "ai": list(a)})
        else:
            kept = pd.DataFrame({"turn_no": pd.Series(dtype="int64"), "human": pd.Series(dtype="object"),
                                 "ai": pd.Series(dtype="object")})
        for pdf in pdfs:
            # trimmed batch by batch: a session's turns are never held together
            kept = pd.concat([kept, pdf[["turn_no", "human", "ai"]]], ignore_index=True)
            kept = kept.drop_duplicates("turn_no", keep="last").sort_values("turn_no").tail(max_turns)
        state.update((kept["turn_no"].astype("int64").tolist(), kept["human"].tolist(), kept["ai"].tolist()))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield kept.assign(session_id=key[0])[["session_id", "turn_no", "human", "ai"]]

    return turns.groupBy("session_id").applyInPandasWithState(
        fn, MEMORY_OUT, MEMORY_STATE, "update",
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
