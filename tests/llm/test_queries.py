"""Each registered query against its SQL, and what needs no SQL against plain Python."""

import math
import zlib

import numpy as np
import pytest

from merchlens.llm import queries as Q
from merchlens.llm.tokens import vocabulary_path
from scripts.compare import digest


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, llm_duck, sf, name):
    df = Q.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    res = llm_duck.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(rows, df.columns)[0] == digest(want, cols)[0]


def _texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def test_token_file_equals_library(spark, sf):
    got = {r["doc_id"]: r for r in Q.QUERIES["op5_token_file"](spark, sf).collect()}
    docs, start = _texts(spark, sf), 0
    coded = _library("word_bpe_49k.json").encode_batch([t for _, t in docs], add_special_tokens=False)
    assert len(got) == len(docs)
    for (doc, _), e in zip(docs, coded):
        ids = np.array([*e.ids, 1], "<u4")
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_is_whole_gapless_and_tight(spark, sf):
    rows = Q.QUERIES["op7_best_fit_packing"](spark, sf).toPandas()
    docs = _texts(spark, sf)
    coded = _library("byte_bpe_50k.json").encode_batch([t for _, t in docs], add_special_tokens=False)
    ids = {d: np.array([*e.ids, 0], "<u4") for (d, _), e in zip(docs, coded)}
    by_doc = dict(list(rows.sort_values("piece").groupby("doc_id")))
    assert set(by_doc) == set(ids)
    for d, p in by_doc.items():
        assert p.length.sum() == len(ids[d]) and list(p.piece) == list(range(len(p)))
        assert (p.length.iloc[1:] == 2048).all() and (len(p) == 1) == (len(ids[d]) <= 2048)
        for r in p.itertuples():
            assert zlib.crc32(ids[d][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert s.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(map(len, ids.values()))
    assert rows.sequence_id.nunique() <= math.ceil(total / 2048 * 1.02) + 1


def test_sentencepiece_equals_library_and_round_trips(spark, sf):
    import hashlib

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in Q.QUERIES["op8_sentencepiece"](spark, sf).collect()}
    for doc, text in _texts(spark, sf):
        ids = np.array(lib.encode(text), "<u4")
        r = got[doc]
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["decoded_chars"] == len(text)


def test_near_duplicates_equal_brute_force(spark, sf):
    got = Q.QUERIES["op4_simhash_near_dedup"](spark, sf).collect()
    texts = dict(_texts(spark, sf))
    fps = {d: _simhash(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{v:016x}" for d, v in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == _components(fps)


def _simhash(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    ids, seen = sorted(fps), {}
    for d in ids:
        if d in seen:
            continue
        todo = [d]
        seen[d] = d
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 3:
                    seen[y] = d
                    todo.append(y)
    return seen


def test_neighbours_recall_and_scores(spark, sf):
    rows = Q.QUERIES["op9_nearest_neighbours"](spark, sf).toPandas()
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    at = {v: i for i, v in enumerate(ids.tolist())}
    queries = [v for v in ids.tolist() if v % 20 == 0]
    assert set(rows.query_id) == set(queries)
    hits = []
    for q, g in rows.sort_values("rank").groupby("query_id"):
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits.append(len(want & set(g.vec_id)) / len(want))
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and q not in set(g.vec_id)
        assert (np.diff(g.score) <= 0).all()
        assert np.allclose(g.score, [x[at[q]] @ x[at[v]] for v in g.vec_id], rtol=0, atol=1e-12)
    assert np.mean(hits) >= 0.9


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    r = Q.QUERIES["op1_quality_classifier"](spark, sf).toPandas().set_index("doc_id")
    assert len(r) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in r.held_out.items())
    y = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    held = r[r.held_out].join(y, how="inner")
    assert (held.predicted == held.quality).mean() >= 0.97
