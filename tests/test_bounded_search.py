"""Top-k search with score bounds equals the full sum and leaves out what cannot matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlens.operators import retrieval as R


def _corpus(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "and", "to", "in"]
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    rows = []
    for i in range(n):
        length = int(rng.choice([5, 20, 80, 300]))
        text = list(rng.choice(common, length)) + list(rng.choice(words, max(2, length // 3), p=p / p.sum()))
        rows.append((i, " ".join(text)))
    rows += [(n, ""), (n + 1, "the the the"), (n + 2, "rare1 the"), (n + 3, "rare1 rare2"), (n + 4, "rare1 rare2")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark):
    docs = _corpus(spark).cache()
    return docs, R.tfidf_fit(docs)


def _questions(spark):
    texts = ["the w399 of w350", "the of and", "w1 w2 the", "rare1 the to", "unknownword", "", "w397 w398 w399 the and in to of", "w1",
             " ".join(f"w{i}" for i in range(380, 400)) + " the of"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def _best(rows, k):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((round(r["score"], 8), r["doc_id"]))
    return {q: sorted(v, reverse=True)[:k] for q, v in out.items()}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equals_the_full_sum(spark, index, monkeypatch, k):
    docs, _ = index
    monkeypatch.setattr(R, "BLOCK_DOCS", 64)
    idx = R.tfidf_fit(docs)
    qs = _questions(spark)
    full, bounded = R.scores(idx, qs).collect(), R.top_scores(idx, qs, k).collect()
    assert _best(bounded, k) == _best(full, k)
    exact = {(r["query_id"], r["doc_id"]): r["score"] for r in full}
    assert all(abs(exact[r["query_id"], r["doc_id"]] - r["score"]) < 1e-12 for r in bounded)
    assert len(bounded) < len(full)


def test_blocks_are_skipped_and_frequent_tokens_find_nothing(spark, index, monkeypatch):
    docs, _ = index
    monkeypatch.setattr(R, "BLOCK_DOCS", 64)
    idx = R.tfidf_fit(docs)
    b = R.bounded_search(idx, _questions(spark), 3)
    cells = {(r["query_id"], r["read"]): r["n"] for r in b.cells.select("query_id", "block", (F.col("bound") >= F.col("theta")).alias("read"))
             .distinct().groupBy("query_id", "read").agg(F.count("*").alias("n")).collect()}
    skipped = sum(n for (_, read), n in cells.items() if not read)
    assert skipped > 0 and sum(cells.values()) > skipped
    tokens = {(r["query_id"], r["token"]): r["essential"] for r in b.tokens.collect()}
    assert tokens[3, "rare1"] and not tokens[3, "the"] and not tokens[3, "to"]
    assert any(tokens[1, t] for t in ("the", "of", "and"))  # nothing but frequent words: they decide
    # question 3 ("rare1 the to"): only the three documents with the rare word are scored
    assert {r["doc_id"] for r in b.hits.where("query_id = 3").collect()} == {602, 603, 604}
    # a document without any essential token is no hit of any question
    hits = b.hits.join(docs, "doc_id").select("query_id", "text").collect()
    essential = {q: {t for (p, t), e in tokens.items() if p == q and e} for q, _ in tokens}
    assert hits and all(essential[r["query_id"]] & set(r["text"].split()) for r in hits)


def test_filtered_search_counts_what_may_be_found(spark, index):
    docs, idx = index
    qs = _questions(spark)
    kept = docs.where("doc_id % 7 = 3")
    got = R.search_documents(idx, kept, qs, k=4, bounded=True).collect()
    full = R.scores(idx, qs).where("doc_id % 7 = 3").collect()
    want = _best(full, 4)
    for q in range(9):
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        matched = [r["doc_id"] for r in rows if r["score"] > 0]
        assert matched == [d for s, d in want.get(q, []) if round(s, 4) > 0][:len(matched)] and len(rows) == 4


def test_lazy_index_and_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "coffee shop"), (2, "pizza place coffee")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "coffee pizza")], "query_id long, query string")
    lazy = R.tfidf_fit(docs, materialize=False)
    assert [r["doc_id"] for r in R.search_documents(lazy, docs, qs, k=2, bounded=True).orderBy("rank").collect()] == [2, 1]
    none = R.tfidf_fit(docs.where("false"))
    assert R.search_documents(none, docs.where("false"), qs, k=2, bounded=True).count() == 0
