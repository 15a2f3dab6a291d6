"""Token-id files compressed by Re-Pair grammars, with random access.

Documents are laid out in ascending id order over range partitions.  Each partition
writes *shards* of at most ``shard_ids`` ids (a longer document is a shard of its own
length); a shard is one row of a Parquet table:

=============  ====================================================================
part, shard    place in the global order
part_start     ids of this partition before the shard
doc_ids        ids of its documents, ``doc_tokens`` their token counts (uint64)
base           first nonterminal; smaller symbols are token ids
rules          pairs of symbols (uint32); rule k stands for nonterminal base + k
expansions     expanded length of each rule (uint32)
sequence       the compressed sequence (uint32)
=============  ====================================================================

Re-Pair runs per shard until no pair of neighbours occurs :data:`MIN_COUNT` times: each round
replaces the frequent pairs - where two overlap, the more frequent - by new nonterminals.
Counts are exact.  The first round counts all places; a pair that was not frequent then
never becomes so, so that later rounds count only places beside a new nonterminal and
those of frequent pairs left over.  The expansion lengths make any id range readable without
expanding what lies before it (:func:`decode_range`).

Nulls: a null text is an empty document (the end id alone); null ids sort first.
Repeated ids stay separate documents, ordered by text hash.  An empty table gives an
empty file.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from merchlens.llm.common import shuffle_width
from merchlens.llm.tokens import encoder, lists_to_bytes

SHARD_IDS = 1 << 18
#: A pair is frequent from this many occurrences on.
MIN_COUNT = 4


def _sorted(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending pair keys (below ``top``) and their indices."""
    bits = len(keys).bit_length()
    if top.bit_length() + bits > 63:
        order = np.argsort(keys)
        return keys[order], order
    both = np.sort((keys << bits) | np.arange(len(keys)))  # one plain sort of key and index
    return both >> bits, both & ((1 << bits) - 1)


def _chosen(rank: np.ndarray, joined: np.ndarray, none: int) -> np.ndarray:
    """Which pairs go: of overlapping ones the lower rank, in a run of one pair every other.
    ``joined``: a pair's second symbol is the first of the pair listed after it."""
    right, left = np.full(len(rank), none), np.full(len(rank), none)
    right[:-1][joined] = rank[1:][joined]
    left[1:][joined] = rank[:-1][joined]
    follows, index = left == rank, np.arange(len(rank))
    even = (index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0
    return even & (rank <= right) & (follows | (rank < left))


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules [k, 2], expansions [k], sequence) of an id array."""
    n = len(ids)
    seq = np.append(ids.astype(np.int64), -1)
    base = int(seq.max()) + 1 if n else 1
    n_symbols = base
    rules, sizes, lengths = [], [], np.ones(base, np.int64)
    # symbols stay where they are: places of the following and the preceding one
    following, preceding = np.arange(1, n + 2), np.arange(-1, n)
    alive = np.ones(n + 1, bool)
    alive[n] = False
    places = np.arange(max(n - 1, 0))  # where a frequent pair may start, ascending
    while len(places) >= min_count:
        ks, order = _sorted(seq[places] * n_symbols + seq[following[places]], n_symbols * n_symbols)
        edge = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))
        count = np.diff(np.append(edge, len(ks)))
        frequent = np.flatnonzero(count >= min_count)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-count[frequent], kind="stable")]
        none = len(frequent)
        by_run = np.full(len(edge), none, np.int64)
        by_run[frequent] = np.arange(none)
        rank = np.empty(len(places), np.int64)
        rank[order] = np.repeat(by_run, count)
        places, rank = places[rank < none], rank[rank < none]
        chosen = _chosen(rank, places[1:] == following[places[:-1]], none)
        good = np.bincount(rank[chosen], minlength=none) >= 2  # with four occurrences the most frequent pair always is
        chosen &= good[rank]
        take = places[chosen]
        if not len(take):
            break
        pair = ks[edge[frequent[good]]]
        new = np.stack([pair // n_symbols, pair % n_symbols], axis=1)
        rules.append(new)
        sizes.append(lengths[new].sum(axis=1))
        lengths = np.concatenate([lengths, sizes[-1]])
        seq[take] = n_symbols + (np.cumsum(good) - 1)[rank[chosen]]
        n_symbols += len(new)
        gone = following[take]
        alive[gone] = False
        following[take] = following[gone]
        preceding[following[take]] = take
        # next: frequent pairs left over, and both sides of a new symbol
        mark = np.zeros(n + 1, bool)
        mark[places] = mark[preceding[take]] = True  # before the first place stands the last mark
        places = np.flatnonzero(mark & alive)
        if len(places) and following[places[-1]] == n:
            places = places[:-1]
    r = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    e = np.concatenate(sizes) if rules else np.empty(0, np.int64)
    return base, r, e, seq[alive]


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, expansions: np.ndarray) -> np.ndarray:
    """The ids that a run of symbols stands for.  Each symbol's place in the result follows from the
    lengths, so that a level of the grammar costs its own nonterminals only."""
    s = symbols.astype(np.int64)
    size = np.ones(len(s), np.int64)
    inner = s >= base
    size[inner] = expansions[s[inner] - base]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    while True:
        out[at[~inner]] = s[~inner]
        k, at = s[inner] - base, at[inner]
        if not len(k):
            return out
        left, right = rules[k, 0], rules[k, 1]
        step = np.ones(len(k), np.int64)
        deep = left >= base
        step[deep] = expansions[left[deep] - base]
        s, at = np.concatenate([left, right]), np.concatenate([at, at + step])
        inner = s >= base


def decode_range(base: int, rules: np.ndarray, expansions: np.ndarray, sequence: np.ndarray, start: int, n: int) -> np.ndarray:
    """Ids [start, start + n) of a shard; only the symbols that reach into the range are expanded."""
    size = np.where(sequence < base, 1, expansions[np.maximum(sequence - base, 0)] if len(expansions) else 1)
    ends = np.cumsum(size)
    first = int(np.searchsorted(ends, start, side="right"))
    last = int(np.searchsorted(ends, start + n, side="left"))
    skip = start - (int(ends[first - 1]) if first else 0)
    return expand(sequence[first:last + 1], base, rules, expansions)[skip:skip + n]


def _u32(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<u4").tobytes()


def write_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id",
               text_col: str = "text", shard_ids: int = SHARD_IDS, controls_as_text: bool = False) -> None:
    """Encode whole texts, append ``end_id`` to each, write the shards under ``path``.  A control
    string of the vocabulary gets its control id, or with ``controls_as_text`` is ordinary text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("shard", T.IntegerType()), ("part_start", T.LongType()), ("n_ids", T.LongType()),
        ("doc_ids", T.ArrayType(id_type)), ("doc_tokens", T.BinaryType()), ("base", T.LongType()),
        ("rules", T.BinaryType()), ("expansions", T.BinaryType()), ("sequence", T.BinaryType()))])

    def shards(batches):
        enc, part = encoder(vocabulary, controls_as_text=controls_as_text), TaskContext.get().partitionId()
        shard, part_start, held = 0, 0, 0
        doc_ids, ids, tokens = [], [], []

        def flush():
            nonlocal shard, part_start, held, doc_ids, ids, tokens
            flat = np.concatenate(ids)
            base, rules, expansions, seq = compress(flat)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([part_start]), pa.array([len(flat)]),
                   pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), pa.array(doc_ids, id_arrow)),
                   pa.array([np.array(tokens, "<u8").tobytes()]), pa.array([base]), pa.array([_u32(rules)]),
                   pa.array([_u32(expansions)]), pa.array([_u32(seq)])]
            shard, part_start = shard + 1, part_start + len(flat)
            doc_ids, ids, tokens, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        id_arrow = None
        for big in batches:
            id_arrow = big.schema.field(0).type
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                flat, offs = enc.encode(batch.column(1))
                flat = np.insert(flat, offs[1:], end_id)
                offs = offs + np.arange(len(offs))
                names = batch.column(0).to_pylist()
                for i, name in enumerate(names):
                    n = int(offs[i + 1] - offs[i])
                    if tokens and held + n > shard_ids:
                        yield flush()
                    doc_ids.append(name)
                    ids.append(flat[offs[i]:offs[i + 1]])
                    tokens.append(n)
                    held += n
        if tokens:
            yield flush()

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))
    d = d.repartitionByRange(shuffle_width(spark), F.col("id").asc_nulls_first(), "th")
    d = d.sortWithinPartitions(F.col("id").asc_nulls_first(), "th").select("id", "text")
    d.mapInArrow(shards, schema).write.parquet(path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document with its place in the whole file; ``ids``
    are little-endian uint32."""
    blocks = spark.read.parquet(path)
    # one row per partition of the file, whatever its size: small enough to broadcast
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, doc_tokens, base, rules, sizes, seq, at = (batch.column(i)[row] for i in range(7))
                n = np.frombuffer(doc_tokens.as_py(), "<u8").astype(np.int64)
                grammar = np.frombuffer(rules.as_py(), "<u4").astype(np.int64).reshape(-1, 2)
                ids = expand(np.frombuffer(seq.as_py(), "<u4"), base.as_py(), grammar, np.frombuffer(sizes.as_py(), "<u4"))
                offs = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(offs[:-1] + at.as_py()), pa.array(n), lists_to_bytes(ids, offs)],
                    names=schema.names)

    rows = blocks.join(F.broadcast(starts), "part").select(
        "doc_ids", "doc_tokens", "base", "rules", "expansions", "sequence", (F.col("part_start") + F.col("before")).alias("at"))
    return rows.mapInArrow(documents, schema)
