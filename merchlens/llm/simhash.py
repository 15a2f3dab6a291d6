"""SimHash near-duplicate detection over Hamming vantage-point trees.

1. **Fingerprint** (one pass over whole texts, Arrow batches): ASCII-lowered
   words, ``width``-word shingles with repeats, XXH64 seed 42, bit majority.
2. **Distinct fingerprints** with their smallest document id: exact copies fold
   map-side, so a group of copies never meets in one task.
3. **Vantage-point tree over shards.**  Level ``k`` of the tree splits by the
   Hamming distance to vantage point ``v_k``; every node has one branch per
   distance (0..64).  A fingerprint's home shard is its path of distances.  By the
   triangle inequality a partner within ``radius`` lies at most ``radius``
   branches away on every level, so a fingerprint is also sent as a query to the
   shards inside that bound - only to those at or after its home path, as each
   pair needs to meet once.
4. **Inside a shard** the residents and the visitors are split further by the
   same rule (fresh vantage points, branch pairs more than ``radius`` apart are
   pruned) until the blocks are small, then compared exactly (xor + popcount).
   The links found are contracted on the spot into a spanning forest, so a
   group of m mutually near fingerprints leaves at most m - 1 rows, not m^2.
5. **Components** of the forest edges: large-star / small-star rounds on Spark,
   each written to the shared checkpoint folder.

Every number of levels gives the same links; the count only sets how finely the
shards are cut.  Nulls: a null text counts as empty (fingerprint 0, linked like
any other); a null ``doc_id`` takes part and never is the smallest id unless all
ids of its component are null.  Repeated rows yield repeated output rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from merchlens.llm.common import fresh, give_back, text_or_empty
from merchlens.session import materialize

#: Fingerprints that a shard should hold at most; more of them add a level to the
#: shard tree.  Around 10 % of all fingerprints share the fullest distance.
SHARD_ROWS = 150_000
#: Product of block sides below which a pair of branches is compared directly.
BLOCK_CELLS = 1 << 20
_SEED = 42


def fingerprint_bytes(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of one UTF-8 text (0 for a text without words)."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at 0x20, 0x09-0x0D only
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), _SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), _SEED) for s in zip(*(words[i:] for i in range(width)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 1 << 16):  # bounded scratch for very long texts
        bits = np.unpackbits(h[start:start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """Column of signed 64-bit SimHash values of a string column."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint_bytes(t, width) for t in texts), np.uint64, len(texts))
            del texts
            yield pd.Series(values.view(np.int64))
            give_back()

    return simhash(F.encode(text_or_empty(text), "UTF-8"))


def _vantage_points(levels: int) -> np.ndarray:
    """Fixed pseudo-random vantage points; any choice gives the same links."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, levels, dtype=np.uint64)


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class _Forest:
    """Union-find over the positions of one shard's fingerprints."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, ix: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[ix]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                p[ix] = r
                return r
            r = up

    def _root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b = a[open_], b[open_]
            # a slice at a time: after it most remaining links already join equal roots
            for x, y in zip(ra[open_][:256].tolist(), rb[open_][:256].tolist()):
                x, y = self._root(x), self._root(y)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
            a, b = a[256:], b[256:]


def _join(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: _Forest, level: int) -> None:
    """Link all pairs of positions (a x b) within ``radius``; a is b for a self-join."""
    if not len(a) or not len(b):
        return
    vantage = _VANTAGE[level] if level < len(_VANTAGE) else None
    if vantage is None or len(a) * len(b) <= BLOCK_CELLS:
        step = max(1, (BLOCK_CELLS * 4) // len(b))
        for s in range(0, len(a), step):
            rows = a[s:s + step]
            i, j = np.nonzero(_distance(fp[rows][:, None], fp[b][None, :]) <= radius)
            forest.union(rows[i], b[j])
        return
    da, db = _distance(fp[a], vantage), _distance(fp[b], vantage)
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    ca, cb = np.searchsorted(da[oa], np.arange(66)), np.searchsorted(db[ob], np.arange(66))
    for x in range(65):
        ax = a[oa[ca[x]:ca[x + 1]]]
        if not len(ax):
            continue
        # a self-join meets each pair of branches once; branches further apart are pruned
        for y in range(x if a is b else max(0, x - radius), min(64, x + radius) + 1):
            by = ax if a is b and x == y else b[ob[cb[y]:cb[y + 1]]]
            _join(fp, ax, by, radius, forest, level + 1)


_VANTAGE = np.random.default_rng(7).integers(0, 1 << 64, 6, dtype=np.uint64)


def shard_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> np.ndarray:
    """Spanning-forest edges (larger, smaller position value) among one shard's
    residents and between residents and visitors; values are uint64 fingerprints."""
    fp = np.concatenate([home, visitors])
    forest = _Forest(len(fp))
    h, v = np.arange(len(home)), np.arange(len(home), len(fp))
    _join(fp, h, h, radius, forest, 0)
    _join(fp, h, v, radius, forest, 0)
    roots = forest.roots(np.arange(len(fp)))
    least = fp.copy()
    np.minimum.at(least, roots, fp)
    top = least[roots]
    moved = top != fp
    return np.unique(np.stack([fp[moved], top[moved]], axis=1), axis=0) if moved.any() else np.empty((0, 2), np.uint64)


def _shards(levels: int, radius: int):
    """mapInArrow: fingerprint -> (shard, is_home, fp), home first, then later shards in reach."""
    vantage = _vantage_points(levels)

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            path = np.stack([_distance(fp, v).astype(np.int64) for v in vantage], axis=1)
            own = np.zeros(len(fp), np.int64)
            code, values, steps = np.zeros(len(fp), np.int64), fp, path
            for k in range(levels):
                own = own * 65 + path[:, k]
            homes = own
            for k in range(levels):
                offs = np.arange(-radius, radius + 1)
                nxt = steps[:, k][:, None] + offs[None, :]
                ok = ((nxt >= 0) & (nxt <= 64)).ravel()
                code = (code[:, None] * 65 + nxt).ravel()[ok]
                rep = np.repeat(np.arange(len(values)), len(offs))[ok]
                values, steps, homes = values[rep], steps[rep], homes[rep]
                # only shards at or after home on this prefix
                keep = code >= homes // 65 ** (levels - 1 - k)
                code, values, steps, homes = code[keep], values[keep], steps[keep], homes[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), pa.array(code == homes), pa.array(values.view(np.int64))], names=["shard", "home", "fp"])

    return run


def links(fps: DataFrame, n: int, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Spanning edges (u, v), u > v as unsigned values, of the graph of distinct
    fingerprints (column ``fp``, ``n`` of them) at most ``radius`` bits apart."""
    levels = 1
    while n * 0.1 ** levels > shard_rows and levels < 8:
        levels += 1
    rows = fps.select("fp").mapInArrow(_shards(levels, radius), "shard long, home boolean, fp long")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy(dtype=bool)
        e = shard_links(fp[home], fp[~home], radius)
        return pd.DataFrame({"u": e[:, 0].view(np.int64), "v": e[:, 1].view(np.int64)})

    return rows.groupBy("shard").applyInPandas(search, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` (u long, v long); returns (node, root) for every node with an edge,
    root being the smallest node of its component.  Each round is written to the
    shared checkpoint folder; the loop ends when a round changes nothing."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "cc-edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = materialize(small, "cc-round")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)
    raise RuntimeError("connected components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: (``id_col``, fp long, text_hash long, root long, component_id).

    ``root`` names the component (its smallest fingerprint), ``text_hash`` tells rows with one id
    apart; ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing fingerprint bits (the document's own id included).  Only the id and
    text columns are read, so other columns cannot clash."""
    ids = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp"),
                      F.xxhash64(text_col).alias("text_hash"))
    ids = materialize(ids, "simhash-ids")
    fps = materialize(ids.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-fps")
    roots = components(links(fps, fps.count(), radius, shard_rows))
    joined = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = joined.join(least, "root").select("fp", "root", "component_id")
    return ids.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "text_hash", "root", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with its smallest id (of
    rows sharing that id the smallest text hash, of repeated rows any one)."""
    groups = materialize(near_duplicates(docs, id_col, text_col, width, radius), "simhash-groups")
    one = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("th"))).alias("k"))
    rid, rth, row = (fresh(docs, n) for n in ("__id", "__th", "__row"))
    one = one.select(F.col("k.id").alias(rid), F.col("k.th").alias(rth))
    kept = docs.join(one, F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64(text_col) == F.col(rth)), "left_semi")
    if groups.groupBy(id_col, "text_hash").count().where("count > 1").limit(1).count():  # repeated rows
        same = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
        kept = kept.withColumn(row, F.row_number().over(same)).where(F.col(row) == 1).drop(row)
    return kept


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
