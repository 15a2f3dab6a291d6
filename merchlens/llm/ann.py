"""Approximate nearest neighbours by a forest of random-projection trees.

1. **Distinct vectors.**  Equal vectors form one class with its ``k + 1`` smallest ids -
   more can never be among a query's k nearest - so a vector that a third of all rows
   share is one row of the index.  Every row belongs to a class.
2. **Forest** on a bounded sample of classes (:data:`SAMPLE`): each node splits by the
   hyperplane between two centres of its sample at the median projection.  Every
   class is then sent down every tree, so the index holds every row.
3. **Search.**  One priority queue per query over all trees, ordered by the largest
   margin violated on the way to a branch, yields leaves nearest first.
4. **Exact reranking.**  Queries meet the classes of their leaves in tasks that hold a block of
   neighbouring leaves of one tree (:data:`BLOCK`); a query is sent to a block once, however many of
   its leaves it visits there, and the block answers with the query's best ``k`` by inner product
   in double precision.  The blocks' answers are sorted once and merged.

How many leaves a query visits is calibrated, not assumed: for a bounded set of
probe vectors the exact neighbours are found by one pass over all classes, and the
smallest number of visits that reaches :data:`RECALL` on them is used.  Sample and probe
set are the only bounded parts, and both are drawn by hash order.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part.  Null ids take no part.  Repeated rows (same id and
vector) count once.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.session import materialize

#: Most vectors that the trees are fitted on, and most probe vectors of the calibration.
SAMPLE, PROBES = 32_768, 256
TREES = 8
#: Vectors a leaf should hold (a visit costs one row of a shuffle, so leaves are coarse); the
#: sample must leave at least 4 of its own to each.
LEAF = 1024
RECALL = 0.95
#: Components of vectors that a task of the reranking holds, and those of the queries it answers, at most
#: (a leaf at least); visits of a task that walks the trees, and answers of a task that merges them.
BLOCK, WALK, MERGE = 1 << 22, 100_000, 32_768


class Forest:
    """Hyperplanes of complete binary trees: ``planes[t]`` [2^depth - 1, dim], ``cuts[t]``."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5):
        self.depth, self.trees = depth, trees
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.planes = np.zeros((trees, 2 ** depth - 1, dim))
        self.cuts = np.zeros((trees, 2 ** depth - 1))
        for t in range(trees):
            level = [np.arange(len(sample))]
            for lv in range(depth):
                below = []
                for j, ix in enumerate(level):
                    w = self._plane(sample[ix], rng, dim)
                    p = sample[ix] @ w
                    cut = float(np.median(p)) if len(ix) else 0.0
                    node = 2 ** lv - 1 + j
                    self.planes[t, node], self.cuts[t, node] = w, cut
                    below += [ix[p <= cut], ix[p > cut]]
                level = below

    @staticmethod
    def _plane(x: np.ndarray, rng, dim: int) -> np.ndarray:
        w = rng.normal(size=dim)
        if len(x) >= 2:
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(3):  # a few two-means steps
                near = x @ (a - b) > (a + b) @ (a - b) / 2
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
            if np.linalg.norm(a - b) > 1e-9:
                w = a - b
        return w / np.linalg.norm(w)

    def margins(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.planes[t].T - self.cuts[t]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """[n, trees]: the leaf of each vector in each tree."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2 ** self.depth - 1)
        return out

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """Per vector the first ``most`` leaves (tree * 2^depth + leaf) of its shared queue."""
        inner = 2 ** self.depth - 1
        out = []
        for i in range(len(x)):
            if i % 256 == 0:  # the margins of all nodes, for a few vectors at a time
                margins = [self.margins(x[i:i + 256], t) for t in range(self.trees)]
            rows = [m[i % 256].tolist() for m in margins]
            heap = [(0.0, t, 0) for t in range(self.trees)]
            found: list[int] = []
            while heap and len(found) < most:
                bad, t, node = heapq.heappop(heap)
                row = rows[t]
                while node < inner:  # down the near side, the far sides wait in the queue
                    m = row[node]
                    near = 2 * node + 1 + (m > 0)
                    far = 2 * node + 2 - (m > 0)
                    heapq.heappush(heap, (max(bad, abs(m)), t, far))
                    if bad > 0 and heap[0][0] < bad:
                        heapq.heappush(heap, (bad, t, near))
                        break
                    node = near
                else:
                    found.append(t * (inner + 1) + node - inner)
            out.append(found)
        return out


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best ids (all, if fewer) by inner product, ties to smaller ids."""
    s = q @ v.T
    if s.shape[1] > k:
        # everything that could tie with the k-th within rounding is scored again
        cut = np.partition(s, -k, axis=1)[:, -k][:, None]
        keep = s >= cut - 1e-9 * (1 + np.abs(cut))
        many = keep.sum(axis=1)
        if (many == k).all():
            at = np.nonzero(keep)[1].reshape(len(s), k)
        else:
            at = np.argsort(~keep, axis=1, kind="stable")[:, :int(many.max())]
    else:
        at = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    # a fixed order of summation: a pair has one score wherever it is computed
    exact = (v[at] * q[:, None, :]).sum(axis=2)
    order = np.lexsort((ids[at], -exact), axis=1)[:, :k]
    return np.take_along_axis(ids[at], order, 1), np.take_along_axis(exact, order, 1)


def _first(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score), some of them repeated, the k first of each query: largest score, then smallest id."""
    at = np.lexsort((ids, -score, q))
    q, ids, score = q[at], ids[at], score[at]
    # a pair has one score, so its copies stand together
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[:len(q)])
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def _answers(q: np.ndarray, cells: list[np.ndarray], vec: np.ndarray, ids: np.ndarray, leaf: np.ndarray,
             k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, score): the k best of each query among the vectors of its ``cells``."""
    at = np.argsort(leaf, kind="stable")
    vec, ids, leaf = vec[at], ids[at], leaf[at]
    asked, who = np.concatenate(cells), np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    at = np.argsort(asked, kind="stable")
    asked, who = asked[at], who[at]
    out, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    for cell in np.unique(asked):
        lo, hi = np.searchsorted(leaf, [cell, cell + 1])
        w = who[slice(*np.searchsorted(asked, [cell, cell + 1]))]
        for s in range(0, len(w) if lo < hi else 0, 256):
            b, sc = _best(q[w[s:s + 256]], vec[lo:hi], ids[lo:hi], k)
            out.append((np.repeat(w[s:s + 256], b.shape[1]), b.ravel(), sc.ravel()))
            held += b.size
            if held > max(1 << 20, 2 * k * len(q)):
                out = [_first(*map(np.concatenate, zip(*out)), k)]
                held = len(out[0][0])
    return _first(*map(np.concatenate, zip(*out)), k)


def _plain(vec_col: str) -> Column:
    """The vector without negative zeros, which equal zero but hash apart."""
    return F.transform(vec_col, lambda x: F.when(x == 0, F.abs(x)).otherwise(x))


def _key(vec: Column) -> Column:
    """Name of a vector: equal vectors have equal names."""
    return F.concat_ws("-", F.xxhash64(vec).cast("string"), F.md5(F.array_join(vec.cast("array<string>"), ",")))


def classes(rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(key, cid, ids, vec): distinct usable vectors with their k + 1 smallest ids; cid is the smallest."""
    v = F.col("vec")
    ok = rows.select(F.col(id_col).cast("long").alias("id"), _plain(vec_col).alias("vec")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    size = ok.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if size:
        ok = ok.where(F.size("vec") == size[0]["n"])
    # rank <= k + 1 is cut in the tasks that hold the rows, before a shared vector's rows meet
    ok = ok.distinct().withColumn("key", _key(F.col("vec")))
    first = ok.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    return first.groupBy("key").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids"),
                                    F.min_by("vec", "id").alias("vec"))


def _probe(index: DataFrame, forest: Forest, probes: pd.DataFrame, k: int, target: float) -> int:
    """Leaves to visit: the exact neighbours of the probes come from one pass over all classes."""
    pid, pv = probes["cid"].to_numpy(), _vectors(probes["vec"])

    def exact(batches):
        for b in batches:
            if len(b):
                ids = b["cid"].to_numpy()
                top, score = _best(pv, _vectors(b["vec"]), ids, k + 1)
                yield pd.DataFrame({"probe": np.repeat(pid, top.shape[1]), "cid": top.ravel(), "score": score.ravel()})

    near = index.select("cid", "vec").mapInPandas(exact, "probe long, cid long, score double").where("probe <> cid")
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "cid")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).join(index.select("cid", "leaves"), "cid")
    truth = near.select("probe", "leaves").collect()  # PROBES x k rows
    if not truth:
        return 1
    width = 2 ** forest.depth
    order = {p: {leaf: n for n, leaf in enumerate(v)} for p, v in zip(pid.tolist(), forest.visits(pv, forest.trees * width))}
    reached = sorted(min(order[r["probe"]][t * width + leaf] for t, leaf in enumerate(r["leaves"])) for r in truth)
    return reached[min(len(reached) - 1, int(np.ceil(target * len(reached))))] + 1


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` (a subset of ``rows``: an id
    column) its k nearest other rows found, largest inner product first, ties to smaller ids."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = rows.sparkSession
    found = materialize(classes(rows, id_col, vec_col, k), "ann-classes")
    n = found.count()
    if not n:
        return spark.createDataFrame([], schema)
    sample = found.select("cid", "vec").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas()
    depth = int(max(0, min(np.ceil(np.log2(max(n, 1) / leaf)), np.floor(np.log2(max(len(sample), 1) / 4)))))
    forest = Forest(_vectors(sample["vec"]), depth, TREES if depth else 1)
    width = 2 ** depth

    @F.pandas_udf("array<int>")
    def leaves(vec: pd.Series) -> pd.Series:
        return pd.Series(list(forest.leaves(_vectors(vec))) if len(vec) else [], index=vec.index, dtype=object)

    index = materialize(found.withColumn("leaves", leaves("vec")), "ann-index")
    visits = _probe(index, forest, sample.tail(PROBES), k, recall)

    # classes that hold a query are asked once, whatever the number of their rows
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), _key(_plain(vec_col)).alias("key"))
    q = q.where("query_id is not null").distinct().join(found.select("key", "cid"), "key").select("query_id", "cid")
    q = materialize(q, "ann-queries")
    asked = q.select("cid").distinct().join(found.select("cid", "vec"), "cid")
    n_asked, dim = q.select("cid").distinct().count(), forest.planes.shape[2]
    # leaves of a block: as many neighbours of one tree as a task holds, four blocks a tree at least
    span = 2 ** int(max(0, min(depth - 2, np.floor(np.log2(max(1, BLOCK // dim) * width / n)))))
    parts = max(1, -(-n_asked * dim // BLOCK))  # of the queries, each of which meets all blocks

    def walk(batches):
        for b in batches:
            for s in range(0, len(b), 256):
                some, rows = b[s:s + 256], []
                for i, found_ in enumerate(forest.visits(_vectors(some["vec"]), visits)):
                    cells = np.sort(np.array(found_, np.int32))
                    for c in np.split(cells, np.flatnonzero(np.diff(cells // span)) + 1):
                        rows.append((int(c[0] // span), c, i))
                at = [r[2] for r in rows]
                yield pd.DataFrame({"block": pd.Series([r[0] for r in rows], dtype="int32"), "cells": pd.Series([r[1] for r in rows], dtype=object),
                                    "cid": some["cid"].to_numpy()[at], "vec": pd.Series(list(some["vec"].to_numpy()[at]), dtype=object)})

    part = F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int")
    kind = found.schema["vec"].dataType.simpleString()
    asked = asked.repartition(max(1, -(-n_asked * visits // WALK)), "cid").mapInPandas(
        walk, f"block int, cells array<int>, cid long, vec {kind}").withColumn("part", part)
    stored = index.select(F.posexplode("leaves").alias("tree", "leaf"), "cid", "vec").select(
        (F.col("tree") * width + F.col("leaf")).alias("cell"), "cid", "vec")
    stored = stored.withColumn("block", F.floor(F.col("cell") / span).cast("int"))
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))

    def rerank(key, a: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(v):
            return pd.DataFrame({"qcid": pd.Series(dtype="int64"), "cids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        who, ids, score = _answers(_vectors(a["vec"]), list(a["cells"]), _vectors(v["vec"]), v["cid"].to_numpy(), v["cell"].to_numpy(), k + 1)
        cut = np.flatnonzero(np.diff(who)) + 1
        return pd.DataFrame({"qcid": a["cid"].to_numpy()[np.unique(who)], "cids": pd.Series(np.split(ids, cut) if len(ids) else [], dtype=object),
                             "scores": pd.Series(np.split(score, cut) if len(ids) else [], dtype=object)})

    answered = asked.groupBy("block", "part").cogroup(stored.groupBy("block", "part")).applyInPandas(
        rerank, "qcid long, cids array<long>, scores array<double>")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        many = rows["cids"].map(len).to_numpy()
        who, ids, score = _first(np.repeat(rows["qcid"].to_numpy(), many), np.concatenate(list(rows["cids"])),
                                 np.concatenate(list(rows["scores"])), k + 1)
        return pd.DataFrame({"qcid": who, "neg": -score, "cid": ids})

    bins = -(-n_asked * min(visits, forest.trees * width // span) // MERGE)
    top = answered.groupBy(F.pmod(F.xxhash64("qcid"), F.lit(max(1, bins)))).applyInPandas(merge, "qcid long, neg double, cid long")
    members = top.join(found.select("cid", "ids"), "cid").select("qcid", "neg", F.explode("ids").alias("vec_id"))
    # the k + 1 first of a class's answer hold any of its queries' k nearest
    members = members.withColumn("r", F.row_number().over(Window.partitionBy("qcid").orderBy("neg", "vec_id"))).where(F.col("r") <= k + 1)
    answers = q.join(members, q.cid == members.qcid).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy("neg", "vec_id")
    return (answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", (-F.col("neg")).alias("score")))
