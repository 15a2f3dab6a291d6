"""Suites in one scan, samples per check, kept reports."""

import re

from pyspark.sql import functions as F

from merchlens.operators import models as M
from merchlens.operators import quality as Q
from merchlens.session import scratch_dir
from merchlens.sources import fixtures as FX
from merchlens.sources.files import read_runs, write_run
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text


def _rows(spark):
    rows = [("a", 1.0, "x", 5), ("a", 2.0, "y", None), ("b", None, "", 7), (None, 3.0, "x", 7), (None, -1.0, None, 7)] + [
        ("hot", 1.0, "x", 1)] * 200
    return spark.createDataFrame(rows, "transaction_id string, amount double, tag string, n int")


def test_suite_reads_each_table_once(spark):
    plan = plan_text(Q.run_suite(M.raw(FX.raw_txn(spark, SF_SMALL)), Q.raw_suite(), "s"))
    scans = re.findall(r"FileScan parquet", plan)
    assert len(scans) == 5  # the five tables that the raw rows are made of


def test_counts_equal_plain_aggregates(spark):
    df = _rows(spark)
    bad = {"neg": F.col("amount") < 0, "tag": F.col("tag") == "", "none": F.lit(False)}
    got = Q.count_failures(df, bad, {"id": F.col("transaction_id"), "n": F.col("n")}).first().asDict()
    assert got == {"_total": 205, "neg": 1, "tag": 1, "none": 0, "id": 200, "n": 201}
    assert Q.count_failures(df.where("false"), bad, {"id": F.col("transaction_id")}).first().asDict() == {
        "_total": 0, "neg": 0, "tag": 0, "none": 0, "id": 0}
    # more conditions than fit one number
    many = {f"c{i}": F.lit(i % 2 == 0) for i in range(130)}
    assert Q.count_failures(df, many, {}).first().asDict() == {"_total": 205, **{f"c{i}": 205 * (i % 2 == 0) for i in range(130)}}


def test_hot_key_is_folded_before_the_shuffle(spark):
    df = spark.range(0, 90_000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    one = Q.count_failures(df, {"f": F.col("k") == "hot"}, {"k": F.col("k")})
    assert one.first().asDict() == {"_total": 90_000, "f": 30_000, "k": 29_999}
    assert "partial_count" in plan_text(one)


def test_samples_are_five_a_check(spark):
    checks = [Q.Check("row_count", lo=1, hi=9), Q.Check("not_null", "tag"), Q.Check("unique", "transaction_id"),
              Q.Check("between", "amount", lo=1.5, hi=9), Q.Check("in_set", "tag", values=("y",))]
    got = {}
    for r in Q.failed_samples(_rows(spark), checks, "s").orderBy("check_no", "sample_no").collect():
        got.setdefault(r["check_no"], []).append((r["transaction_id"], r["value"]))
    assert got == {2: [(None, None), ("b", "")], 3: [("a", "2"), ("hot", "200")],
                   4: [(None, "-1.0"), ("a", "1.0")] + [("hot", "1.0")] * 3, 5: [(None, "x"), ("a", "x"), ("b", "")] + [("hot", "x")] * 2}
    plan = plan_text(Q.failed_samples(_rows(spark), checks, "s"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_reports_are_kept_per_run(spark):
    path = scratch_dir(spark, "runs-test")
    one = Q.suite_report(Q.run_suite(_rows(spark), [Q.Check("not_null", "tag")], "s"))
    write_run(one, path, "1")
    write_run(one.withColumn("suite_name", F.lit("t")), path, "2")
    write_run(one.withColumn("suite_name", F.lit("u")), path, "2")  # written again: replaced
    assert sorted((r["run_id"], r["suite_name"], r["success"]) for r in read_runs(spark, path).collect()) == [
        ("1", "s", False), ("2", "u", False)]
