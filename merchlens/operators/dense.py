"""Dense vectors: exact cosine top-k (J5, R10, F4, W7, W9), centroid queries,
precision/recall@k (E4, E5, J6) and batch embedding with a pluggable model (R12, UF1).

Top-k plan: the query set is dealt into packed blocks and the vectors into packed
chunks; each chunk meets each block once in an equi-join on the block number, and a
task multiplies the two in numpy (BLAS) and emits at most k rows per query and
chunk; ``row_number() <= k`` per query merges them.  No driver action, no cross
join, and no plan that depends on how many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchlens import constants as K
from merchlens.functions.numeric import dround

#: Query blocks that the query set is dealt into; a block's vectors are held by a task at once.
QUERY_BLOCKS = 8
#: Vectors packed into one row before they meet the query blocks.
CHUNK_ROWS = 4096


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label as ``(query_id, qvec)`` — queries derived from the whole table."""
    ex = vectors.select(label_col, F.posexplode(vec_col).alias("pos", "x"))
    per_dim = ex.groupBy(label_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(label_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("qvec")
    ).select(F.col(label_col).cast("long").alias("query_id"), "qvec",
             F.col(label_col).cast("long").alias("q_filter"))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1.0
    return m / n[:, None]


def _block_best(v: np.ndarray, ids: np.ndarray, labels, q: np.ndarray, q_filter, k: int):
    """(query index, id, score) of the k best rows of one chunk for each query of one block."""
    for s in range(0, len(q), 256):
        raw = q[s:s + 256] @ v.T
        if labels is not None:
            raw = np.where(labels[None, :] == q_filter[s:s + 256, None], raw, -np.inf)
        rank = np.round(raw, 8)
        if rank.shape[1] > k:  # ties with the k-th stay in
            cut = np.partition(rank, -k, axis=1)[:, -k]
            keep = rank >= cut[:, None]
        else:
            keep = np.ones(rank.shape, bool)
        keep &= np.isfinite(raw)
        row, col = np.nonzero(keep)
        order = np.lexsort((ids[col], -rank[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        yield s + row[top], ids[col[top]], raw[row[top], col[top]]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = K.DEFAULT_TOP_K, id_col: str = "vec_id",
               vec_col: str = "embedding", filter_col: str | None = None, query_blocks: int = QUERY_BLOCKS) -> DataFrame:
    """Exact cosine top-k per query; ``filter_col`` keeps only vectors whose value
    equals the query's ``q_filter`` (per-query metadata pre-filter, F4).  Ties
    rank by id ascending; scores are ranked on their 8-dp rounded value.

    One plan for any number of queries: queries are dealt into ``query_blocks`` packed
    blocks, vectors into packed chunks, and each chunk row meets each block row in an
    equi-join on the block number (Spark broadcasts the blocks when they are small).  A
    task holds one chunk and one block; raise ``query_blocks`` for larger query
    sets.  Rows with a null vector or id take no part; an empty side gives no rows."""
    id_type, q_type = vectors.schema[id_col].dataType, queries.schema["query_id"].dataType
    keep = [F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")]
    if filter_col:
        keep.append(F.col(filter_col).alias("label"))
    v = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(*keep)
    q = queries.where(F.col("qvec").isNotNull())
    member = [F.col("query_id"), F.col("qvec").cast("array<double>").alias("qvec"), *([F.col("q_filter")] if filter_col else [])]
    blocks = (q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("block"))
              .agg(F.collect_list(F.struct(*member)).alias("members")))

    # a chunk number per CHUNK_ROWS rows of a partition packs the vectors without moving them
    fields = ["id", "vec"] + (["label"] if filter_col else [])
    chunk = T.StructType([T.StructField(f, T.ArrayType(v.schema[f].dataType)) for f in fields])

    def pack(batches):
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS):
                part = pdf.iloc[s:s + CHUNK_ROWS]
                yield pd.DataFrame({f: [part[f].tolist()] for f in fields})

    chunks = v.mapInPandas(pack, chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    met = chunks.withColumn("block", F.col("block").cast("long")).join(blocks, "block").drop("block")
    out_schema = T.StructType([T.StructField("query_id", q_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.array(list(r.id))
                mat = _unit(np.array([list(x) for x in r.vec], dtype=np.float64))
                names = [m["query_id"] for m in r.members]
                qm = _unit(np.array([list(m["qvec"]) for m in r.members], dtype=np.float64))
                labels = np.array(list(r.label)) if filter_col else None
                qf = np.array([m["q_filter"] for m in r.members]) if filter_col else None
                for qi, found, score in _block_best(mat, ids, labels, qm, qf, k):
                    yield pd.DataFrame({"query_id": [names[i] for i in qi], id_col: found, "score": score})

    out = met.mapInPandas(search, out_schema)
    w = Window.partitionBy("query_id").orderBy(F.col("_rk").desc(), F.col(id_col).asc())
    return (out.withColumn("_rk", dround("score", 8)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).drop("_rk"))


def dense_merchants(vectors: DataFrame, queries: DataFrame, merchants: DataFrame, k: int = K.DEFAULT_TOP_K,
                    static_filter: Column | None = None, id_col: str = "doc_id", vec_col: str = "embedding",
                    depth: int = 4) -> DataFrame:
    """Dense merchant search.  ``vectors`` are chunk vectors with their metadata
    (``merchant_id``, city, mcc_code, transaction_value_tier ...), restricted by
    ``static_filter`` before scoring; each merchant appears once, with its best chunk, joined to
    its record.  ``depth``: chunks a merchant can have at most."""
    v = vectors.where(static_filter) if static_filter is not None else vectors
    hits = dense_topk(v, queries, k * depth, id_col, vec_col).join(v.select(id_col, "merchant_id"), id_col)
    rank = dround("score", 8)
    one = Window.partitionBy("query_id", "merchant_id").orderBy(rank.desc(), F.col(id_col).asc())
    best = hits.drop("rank").withColumn("_b", F.row_number().over(one)).where("_b = 1").drop("_b")
    top = Window.partitionBy("query_id").orderBy(rank.desc(), F.col(id_col).asc())
    best = best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return best.join(merchants.select("merchant_id", "merchant_name", "city", "mcc_code", "stars"), "merchant_id").select(
        "query_id", "rank", "merchant_id", "merchant_name", "city", "mcc_code", "stars", id_col, dround("score", 4).alias("score"))


def precision_recall_at_k(retrieved: DataFrame, relevant: DataFrame, k: int = K.DEFAULT_TOP_K,
                          qid: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """Precision divides by k (not by rows returned); recall is 0
    when nothing is relevant.  ``relevant`` is ``(query_id, id)``."""
    top = retrieved.where(F.col("rank") <= k).select(qid, id_col)
    hits = top.join(relevant.select(qid, id_col), [qid, id_col], "left_semi").groupBy(qid).agg(
        F.count(F.lit(1)).alias("hits"))
    n_rel = relevant.groupBy(qid).agg(F.count(F.lit(1)).alias("n_relevant"))
    # a question without hits counts with 0, one without relevant rows too
    qs = retrieved.select(qid).unionByName(relevant.select(qid)).distinct()
    return (qs.join(hits, qid, "left").join(n_rel, qid, "left")
            .select(qid, F.coalesce("hits", F.lit(0)).alias("hits"),
                    F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
                    dround(F.coalesce("hits", F.lit(0)) / F.lit(float(k)), 4).alias("precision_at_k"),
                    F.when(F.coalesce("n_relevant", F.lit(0)) == 0, F.lit(0.0))
                    .otherwise(dround(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 4)).alias("recall_at_k")))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in model: signed feature hashing of lower-cased
    ``[a-z0-9]+`` tokens, L2-normalised (tests; real models plug in the same way).  A token's
    32-bit hash is the start of its md5: the slot is it modulo ``dim``, its top bit the sign."""
    import hashlib
    import re

    pat = re.compile(K.TOKEN_PATTERN)

    def embed(texts: list[str]) -> np.ndarray:
        found = [pat.findall((t or "").lower()) for t in texts]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for f in found for t in f))}
        h = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") for t in vocabulary], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        hash_ = h[[vocabulary[t] for f in found for t in f]] if len(row) else np.zeros(0, np.int64)
        out = np.zeros((len(texts), dim))
        np.add.at(out, (row, hash_ % dim), np.where(hash_ >> 31 == 0, 1.0, -1.0))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        n[n == 0] = 1.0
        return (out / n).astype(np.float32)
    return embed


# Models loaded in this Python worker process, by caller-chosen key.  Spark
# reuses Python workers across tasks, so a keyed model loads once per process.
_MODELS: dict = {}


def embed(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[list[str]], np.ndarray]],
          out_col: str = "embedding", model_key: str | None = None) -> DataFrame:
    """Batch-embed a text column with a pluggable model.

    Texts travel to the model in Arrow batches through a pandas UDF.  Without
    ``model_key`` ``model_factory`` is called once per task (the closure's
    cache travels with the task); with it, the model is kept in the worker
    process and later tasks reuse it.  Never per row or per batch."""
    holder: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        if model_key is not None:
            from merchlens.operators import dense as this
            model = this._MODELS.get(model_key)
            if model is None:
                model = this._MODELS[model_key] = model_factory()
        else:
            if "m" not in holder:
                holder["m"] = model_factory()
            model = holder["m"]
        vecs = model(texts.tolist())
        return pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

    return df.withColumn(out_col, _embed(F.col(text_col)))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = K.DEFAULT_TOP_K,
                 filters: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """R10 entry point: exact cosine top-k; ``filters`` names a vector column that
    must equal each query's ``q_filter``."""
    return dense_topk(vectors, queries, k=k, id_col=id_col, vec_col=vec_col, filter_col=filters)
