"""Nothing is lost on the way in, and searches return what they are asked for."""

import pytest
from pyspark.sql import functions as F

from merchlens.operators import analytics as A
from merchlens.operators import dense as D
from merchlens.operators import retrieval as R
from merchlens.session import scratch_dir
from merchlens.streaming import ingest as I


def _txns(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("transaction_id"), F.lit("m").alias("merchant_id"), F.lit("M").alias("merchant_name"),
        (F.col("id") + 1.0).alias("transaction_amount"), F.lit("5812").alias("mcc_code"), F.lit("Food").alias("mcc_description"),
        F.lit("C").alias("city"), F.lit("S").alias("state"), F.lit(None).cast("string").alias("neighborhood"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.timestamp_seconds(F.col("id") * 60).alias("transaction_at"),
        F.lit("chip").alias("acceptance_method"), F.lit(None).cast("double").alias("stars"), F.lit(3).alias("review_count"),
        F.lit(None).cast("int").alias("review_velocity_30d"), F.lit("a, b").alias("categories"), F.lit(1).alias("is_open"),
        F.lit(2).alias("price_range"))


def test_bounded_batches_lose_nothing(spark):
    src, raw, rej = (scratch_dir(spark, n) for n in ("src", "raw", "rej"))
    txns = _txns(spark, 40)
    I.to_envelope(txns).repartition(5).write.text(src)
    I.start_ingest(I.file_source(spark, src, max_files=1), raw, rej, scratch_dir(spark, "ck")).awaitTermination()
    got = I.raw_table(spark, raw)
    assert got.count() == 40 and spark.read.parquet(rej).count() == 0
    same = [c for c in txns.columns if c != "transaction_at"]
    assert got.select(same).exceptAll(txns.select(same)).count() == 0
    assert got.select(F.col("ts").alias("transaction_at")).exceptAll(txns.select("transaction_at")).count() == 0


def test_stream_and_batch_share_their_rules(spark):
    bad = _txns(spark, 4).withColumns({
        "acceptance_method": F.when(F.col("transaction_id") == "0", "CHIP").when(F.col("transaction_id") == "1", F.lit(None)).otherwise("chip"),
        "mcc_code": F.when(F.col("transaction_id") == "2", F.lit(None)).otherwise("742")})
    good, rejects = I.parse_envelopes(I.to_envelope(bad))
    assert {r["transaction_id"]: (r["acceptance_method"], r["mcc_code"]) for r in good.collect()} == {
        "1": ("chip", "0742"), "3": ("chip", "0742")}
    assert sorted(r["reason"] for r in rejects.collect()) == ["acceptance_method not allowed", "missing mcc_code"]


def test_filter_holds_for_scored_documents(spark):
    docs = spark.createDataFrame([(1, "red fox", "x"), (2, "red hen", "y"), (3, "blue jay", "y")], "doc_id long, text string, lang string")
    qs = spark.createDataFrame([(1, "red fox")], "query_id long, query string")
    hits = R.tfidf_search(R.tfidf_fit(docs), qs, docs, filters=F.col("lang") == "y", k=5).collect()
    assert [r["doc_id"] for r in hits] == [2, 3]


def test_questions_without_hits_count(spark):
    hits = spark.createDataFrame([(1, 10, 1)], "query_id long, vec_id long, rank int")
    relevant = spark.createDataFrame([(1, 10), (2, 20)], "query_id long, vec_id long")
    rows = {r["query_id"]: (r["precision_at_k"], r["recall_at_k"]) for r in D.precision_recall_at_k(hits, relevant, k=5).collect()}
    assert rows == {1: (0.2, 1.0), 2: (0.0, 0.0)}


def test_dense_search_takes_any_input(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), (None, [1.0, 1.0]), ("d", [0.0, 0.0])],
                              "doc_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "query_id long, qvec array<double>")
    rows = D.dense_topk(v, q, k=2, id_col="doc_id").orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(1, "a"), (1, "b")]
    assert D.dense_topk(v, q.where("false"), id_col="doc_id").count() == 0
    assert D.dense_topk(v.where("false"), q, id_col="doc_id").count() == 0


def test_analytics_metric_names_and_parking(spark):
    df = _txns(spark, 3)
    assert A.analytics(df, "acceptance_methods").count() == 1
    parking = spark.createDataFrame([(1, {"street": True}), (2, {"street": False}), (3, None)], "id int, p map<string,boolean>")
    parking = parking.select("id", F.struct(F.col("p").alias("Parking")).alias("attributes"))
    assert [r["id"] for r in parking.where(A.merchant_filter(has_parking=True)).collect()] == [1]
    assert [r["id"] for r in parking.where(A.merchant_filter(has_parking=False)).orderBy("id").collect()] == [2, 3]


def test_scratch_folder_must_be_shared():
    from merchlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
