"""(e) Plan checks over every registered query: no row-at-a-time Python UDF,
no single-partition exchange except under a global aggregate's final merge or
a LIMIT, column pruning into the scans; plus the driver contract."""

import contextlib
import io
import json
import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from merchlens.plans import catalog
from tests.conftest import ROOT, SF_SMALL

QUERIES = catalog.queries()
_OK_ABOVE_SINGLE = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "GlobalLimit", "CollectLimit",
                    "TakeOrderedAndProject")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def single_partition_parents(text: str) -> list[str]:
    lines = text.splitlines()
    out = []
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" not in ln:
            continue
        me = _indent(ln)
        for j in range(i - 1, -1, -1):
            if lines[j].strip() and _indent(lines[j]) < me:
                out.append(lines[j].strip(" :+-").split(" ")[0])
                break
    return out


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_text(fn(spark, SF_SMALL)) for name, fn in QUERIES.items()}


def test_no_row_at_a_time_python_udf(plans):
    bad = [n for n, p in plans.items() if "BatchEvalPython" in p]
    assert not bad


def test_no_single_partition_window_or_sort(plans):
    bad = {n: ps for n, p in plans.items()
           if (ps := [x for x in single_partition_parents(p) if not x.startswith(_OK_ABOVE_SINGLE)])}
    assert not bad


def test_scans_are_pruned(plans):
    # the wide text columns of lineitem / orders are never read by the transaction model
    for name in ("raw_view", "stg_dedup", "mart_anomaly"):
        assert "l_comment" not in plans[name] and "o_comment" not in plans[name], name


def test_no_cartesian_product(plans):
    assert not [n for n, p in plans.items() if "CartesianProduct" in p]


def test_texts_are_tokenised_once(plans):
    # no filter repeats the tokenising expression below the exchange
    for name in ("tfidf_tf", "tfidf_weights", "rag_heuristic_eval"):
        assert not [ln for ln in plans[name].splitlines() if "Filter" in ln and "regexp_extract_all" in ln], name


def test_dense_search_builds_a_plan_without_jobs(spark):
    from merchlens.operators import dense as D

    tracker = spark.sparkContext.statusTracker()
    v = spark.range(50).selectExpr("id AS vec_id", "array(cast(id as double), 1.0D) AS embedding", "id % 2 AS label")
    q = spark.range(3).selectExpr("id AS query_id", "array(1.0D, cast(id as double)) AS qvec", "id % 2 AS q_filter")
    before = len(tracker.getJobIdsForGroup(None))
    D.dense_topk(v, q, filter_col="label")
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plans["stg_clean"]


def test_entry_contract(spark):
    a = E.entry(spark)
    assert a.count() > 0
    assert a.schema == E.entry(spark).schema
    assert set(E.oracle_sql()) <= set(E.queries())


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_REPS="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "dense_topk", "velocity_30d"],
                         env=env, capture_output=True, text=True, timeout=600, check=True).stdout
    rec = json.loads(out.strip().splitlines()[-1])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"dense_topk", "velocity_30d"}


def test_registry_loads_without_a_session():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "from pyspark import SparkContext; q, o = E.queries(), E.oracle_sql(); "
            "assert SparkContext._active_spark_context is None; print(len(q), len(o))") % ROOT
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    n_q, n_o = map(int, out.stdout.split())
    assert n_q >= n_o > 0
