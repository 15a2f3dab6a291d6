"""Embedding whitening, sharding and the source audit against plain Python, and their edges."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.llm import divergence, queries, sharding, whitening
from merchlens.session import scratch_dir
from scripts.compare import digest
from tests.test_plans import plan_text

# ------------------------------------------------------------------------------ whitening


def _eigen(vectors, k):
    m = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(m), m.sum(axis=0)
    c = m - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * m - s) ** 2).sum(axis=1), c @ (u[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


def test_whitening_equals_full_eigensolver(spark, sf):
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf).toPandas()
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    deviation, want, explained = _eigen([r[1] for r in rows], 8)
    w = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(w.index) == [r[0] for r in rows] and list(w.columns) == list(range(1, 9))
    sign = np.sign((w.to_numpy() * want).sum(axis=0))
    assert np.abs(w.to_numpy() - want * sign).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").sort_index()
    assert first.deviation.tolist() == deviation.tolist() and set(got.n) == {len(rows)}
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_filters_wide_vectors(spark):
    """More dimensions than the block, a close spectrum: the filter has to do the work."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(1500, 120)) * np.linspace(1.3, 1.0, 120)
    x = whitening.integers(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))
    fitted = whitening.fit(x, 5)
    e = np.linalg.eigvalsh(np.cov(np.floor(1024 * v).T, bias=True))[::-1]
    assert fitted.passes > 5 and fitted.residual < 1e-11
    assert np.allclose(fitted.values, e[:5], rtol=1e-11) and np.isclose(fitted.trace, e.sum(), rtol=1e-12)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (2, [1.5, -1.0, 0.0]), (2, [1.5, -1.0, 0.0]), (None, [0.0, 3.0, 1.0]), (4, None), (5, [1.0, None, 0.0]),
            (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("id", "x", "w", "n", "component", "i")])
    got = whitening.whiten(df).toPandas()
    ids = got.groupby("component").vec_id.apply(lambda s: sorted(s.fillna(-1).astype(int)))
    assert all(v == [-1, 1, 2, 2] for v in ids) and set(got.n) == {4}
    # three distinct vectors span two dimensions: the third component has no variance
    deviation, want, _ = _eigen([[0.5, 1, 2], [1.5, -1, 0], [1.5, -1, 0], [0, 3, 1]], 2)
    assert list(ids.index) == [1, 2] and got.identity_error.max() < 1e-9
    one = got[got.vec_id == 1].sort_values("component")
    assert np.allclose(np.abs(one.whitened), np.abs(want[0])) and int(one.deviation.iloc[0]) == deviation[0]
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 2")).count() == 0  # no variance at all
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 7.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).count() > 0


# ------------------------------------------------------------------------------- sharding


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 1000])
def test_jump_hash_equals_plain_python(spark, shards):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 123456789012345, *range(2, 400)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: _jump(k % 2 ** 64, shards) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(d, 16).groupBy("shard", "grown_shard").count().collect()
    moved = sum(r["count"] for r in rows if r["shard"] != r["grown_shard"])
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert abs(moved - 20_000 / 17) < 200


def test_sharding_edges(spark, odd_docs, no_docs):
    got = sharding.assign(odd_docs, 5)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    want = odd_docs.select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in want)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.assign(no_docs, 5).count() == 0
    con = duckdb.connect()
    con.register("odd", odd_docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    res = con.execute(sharding.SHARDING_SQL.format(src="odd", shards=5))
    cols = [c[0] for c in res.description]
    assert digest([tuple(r) for r in rows], got.columns)[0] == digest(res.fetchall(), cols)[0]


def test_hot_rows_of_a_shard_spread_over_tasks(spark):
    """One id on a third of all rows, equal in everything: its slots are numbered in several tasks."""
    d = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sharding.assign(d, 4)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = plan_text(got)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapIn" not in plan
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values()) and len(rows) == 30_000


def test_write_shards(spark, odd_docs):
    path = scratch_dir(spark, "shards-test")
    sharding.write_shards(odd_docs, path, 5)
    back = spark.read.parquet(path)
    assert back.count() == odd_docs.count() and set(odd_docs.columns) < set(back.columns)
    assert back.where(F.col("shard") != sharding.jump_hash(F.col("doc_id"), 5)).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(odd_docs.withColumn("Shard", F.lit(1)), path + "-2", 5)


# ------------------------------------------------------------------------------ divergence


def _audit_sql(docs, min_docs, top):
    con = duckdb.connect()
    con.register("src", docs.select("lang", "source", "text").toPandas())
    res = con.execute(divergence.DIVERGENCE_SQL.format(src="src", min_docs=min_docs, top=top))
    return res.fetchall(), [c[0] for c in res.description]


def test_divergence_edges(spark, odd_docs, no_docs):
    for min_docs, top in ((1, 3), (2, 50), (30, 50)):
        got = divergence.audit(odd_docs, min_docs=min_docs, top=top)
        rows = [tuple(r) for r in got.collect()]
        want, cols = _audit_sql(odd_docs, min_docs, top)
        assert got.columns == cols and digest(rows, got.columns)[0] == digest(want, cols)[0]
    assert divergence.audit(no_docs).count() == 0


def test_divergence_prunes_and_ties(spark, sf, monkeypatch):
    """Small cells, blocks, buffers and tables: every path that joins bounded parts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    want, cols = _audit_sql(docs, 2, 4)
    for name, value in (("CELL", 64), ("BLOCK", 3), ("_BUFFER", 50), ("_TABLE", 40), ("_SLICE", 2_000)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(docs, min_docs=2, top=4)
    rows = [tuple(r) for r in got.collect()]
    assert digest(rows, got.columns)[0] == digest(want, cols)[0]


def test_skyband_keeps_every_possible_top(spark):
    rng = np.random.default_rng(2)
    for n, k in ((400, 5), (60, 1), (30, 40)):
        rows = [(int(a), int(b), b"t%04d" % i) for i, (a, b) in enumerate(zip(rng.integers(1, 30, n), rng.integers(30, 90, n)))]
        rng.shuffle(rows)
        rows = [(int(a), int(b), bytes(t)) for a, b, t in rows]

        def dominators(r):
            return sum(o[0] >= r[0] and o[1] <= r[1] and o[2] < r[2] for o in rows)

        assert set(divergence.skyband(rows, k)) == {r for r in rows if dominators(r) < k}


def test_terms_are_cut_like_the_pattern():
    import re

    import pyarrow as pa

    texts = ["", "Ab1cd É-ÉA b_c", "日本 語\x01x\x7fy @[`{ZzAa", "  one  ", "ÀB c d"]
    t = divergence._counted(pa.array(["l"] * 5), pa.array(["s"] * 5), pa.array([x.encode() for x in texts], pa.large_binary()))
    want = {}
    for x in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low):
            want[w] = want.get(w, 0) + 1
    assert dict(zip(t["term"].to_pylist(), t["n"].to_pylist())) == want
