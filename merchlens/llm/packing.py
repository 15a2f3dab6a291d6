"""Best-fit packing of token sequences by a configuration linear program.

1. **Pieces.**  Documents become ids plus an end id; only longer ones than the
   sequence length are cut, into full pieces from the end, so the first piece may be
   shorter.  Pieces are written once with their rank among the equal lengths of
   their task.
2. **Plan.**  The histogram of lengths (at most ``capacity`` rows, whatever the input)
   goes to the driver.  Patterns of the configuration program (min sum x_p subject to
   sum c_pl x_p >= b_l) come from multiplicative weights: each round prices the
   lengths, one knapsack dynamic program finds the best filling of every capacity, and
   each length still in demand receives a share of the pattern that it forms with
   the best filling of the rest; lengths behind their demand become dearer, those
   ahead cheaper.  The fractional solution is rounded down to whole sequences and the
   bounded rest is filled by best fit on the histogram.
3. **Placement.**  A piece's global rank among equal lengths (task rank plus the
   counts of earlier tasks) addresses its slot: a range of ranks of a length belongs
   to one pattern, so sequence and offset are arithmetic on the rank.  No group of
   equal lengths is gathered anywhere, and no piece is shuffled: the counts of earlier
   tasks, a map of lengths per task, are broadcast.

Nulls: a null text is empty (one piece with the end id alone), a null id stays null.
Repeated rows are packed as separate documents.  An empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from merchlens.llm.tokens import encoder, lists_to_bytes, vocabulary_path
from merchlens.session import materialize

CAPACITY = 2048
#: A pattern's share of the demand per round, patterns per round, the exponent of the
#: weights, and the most rounds (the rest then goes to the best fit).
SHARE, SEEDS, RATE, MAX_ROUNDS = 0.05, 16, 2.0, 400
#: How much dearer than their tokens the longest pieces start: short ones, which fill any
#: gap, are saved for later.
LONG = 1.0


# --------------------------------------------------------------------------- plan

def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``price[l]`` per length l (-inf: none left).  Best value for every capacity over any
    number of each length, and the length placed last there (0: one token stays free)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = best[c - 1::-1] + price[1:c + 1]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], last[c] = v[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _filling(last: np.ndarray, c: int) -> list[int]:
    out = []
    last = last.tolist() if not isinstance(last, list) else last
    while c > 0:
        if last[c]:
            out.append(last[c])
            c -= last[c]
        else:
            c -= 1
    return out


def fractional(demand: np.ndarray, capacity: int, share: float = SHARE, seeds: int = SEEDS, rate: float = RATE
               ) -> tuple[dict[tuple[int, ...], float], float]:
    """Solve the configuration program over ``demand[l]``: the patterns (lengths, longest
    first) with their numbers, and the best dual bound met on the way.

    Each round prices the lengths, runs one knapsack program and lets the lengths that
    are furthest behind their demand form a pattern with the best filling of the rest of
    a sequence; each pattern takes ``share`` of what its scarcest length demands.  Prices
    are length times weight; a weight grows exponentially with the part of its demand
    that a length still lacks against the average."""
    sizes = np.arange(capacity + 1)
    left = demand.astype(float).copy()
    have = demand > 0
    start = 1 + LONG * sizes / capacity
    x: dict[tuple[int, ...], float] = {}
    bound = float(np.ceil((sizes * demand).sum() / capacity))
    rounds = 0
    while rounds < MAX_ROUNDS and (left >= 1).any():
        rounds += 1
        lack = np.zeros(capacity + 1)
        lack[have] = left[have] / demand[have]
        weight = start * np.exp(rate * (lack - (left * sizes).sum() / max((demand * sizes).sum(), 1)))
        price = np.where(left >= 1, sizes * weight, -np.inf)
        best, last = _knapsack(price, capacity)
        dual = np.where(have, sizes * weight, 0.0)
        if (left >= 1).sum() == have.sum():  # every length priced: a bound on the whole program
            bound = max(bound, float((dual * demand).sum() / best[capacity]))
        fill = last.tolist()
        order = np.argsort(-np.where(left >= 1, lack, -1) - sizes * 1e-9, kind="stable")[:seeds]
        for i in order.tolist():
            if left[i] < 1:
                continue
            pattern = [i, *_filling(fill, capacity - i)]
            n: dict[int, int] = {}
            for k in pattern:
                n[k] = n.get(k, 0) + 1
            most = min(left[k] // m for k, m in n.items())
            if most < 1:
                continue
            step = min(most, max(1.0, share * min(demand[k] / m for k, m in n.items())))
            for k, m in n.items():
                left[k] -= step * m
            key = tuple(sorted(pattern, reverse=True))
            x[key] = x.get(key, 0.0) + step
    return x, bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: groups of equal sequences move together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    room = np.zeros(capacity + 1, bool)
    for i in range(len(lengths) - 1, -1, -1):
        n, size = int(counts[i]), int(lengths[i])
        while n:
            fits = np.nonzero(room[size:])[0]
            if not len(fits):
                per = capacity // size
                full, rest = divmod(n, per)
                for k, m in ((per, full), (rest, 1 if rest else 0)):
                    if m and k:
                        left = capacity - k * size
                        group = open_.setdefault(left, {})
                        group[(i,) * k] = group.get((i,) * k, 0) + m
                        room[left] = True
                break
            r = int(fits[0]) + size
            group = open_[r]
            pattern, m = next(iter(group.items()))
            take = min(m, n)
            if take == m:
                del group[pattern]
                if not group:
                    room[r] = False
            else:
                group[pattern] = m - take
            left = r - size
            to = open_.setdefault(left, {})
            key = pattern + (i,)
            to[key] = to.get(key, 0) + take
            room[left] = True
            n -= take
    return [(p, m) for group in open_.values() for p, m in group.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Whole patterns: [(lengths of a sequence, longest first; number of such sequences)].

    Covers exactly ``histogram``.  Work depends on ``capacity`` alone."""
    demand = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        demand[k] = v
    if not demand.any():
        return []
    x, _ = fractional(demand, capacity)
    free = {p: capacity - sum(p) for p in x}
    typical = sum(free[p] * x[p] for p in x) / sum(x.values())
    # patterns looser than a limit are dissolved for the best fit; the tightest rounding wins
    return min((_rounded(demand, x, free, limit, capacity) for limit in (0, typical, capacity)), key=lambda r: sum(m for _, m in r))


def _rounded(demand: np.ndarray, x: dict[tuple[int, ...], float], free: dict[tuple[int, ...], int], limit: float,
             capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of the patterns with at most ``limit`` free tokens, best fit for the rest."""
    out, left = [], demand.copy()
    for p in sorted(x, key=lambda p: (free[p], -x[p], p)):
        m = int(x[p] + 1e-9)
        if m > 0 and free[p] <= limit:
            for k in p:
                left[k] -= m
            out.append((p, m))
    lengths = np.nonzero(left)[0]
    return out + [(tuple(int(lengths[i]) for i in p), m) for p, m in best_fit(lengths, left[lengths], capacity)]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges per length: sorted by (length, lo).  Ranks [lo, next lo) of a length lie in
    sequences ``base + (rank - lo) // per`` at ``at + (rank - lo) % per * length``."""
    rows, base, taken = [], 0, {}
    for pattern, m in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            per = pattern.count(length)
            lo = taken.get(length, 0)
            rows.append((length, lo, base, per, at))
            taken[length] = lo + per * m
            at += per * length
        base += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: a[:, i] for i, k in enumerate(("length", "lo", "base", "per", "at"))}


# ------------------------------------------------------------------------- pieces

def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", controls_as_text: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids, part, nth): ``ids`` are little-endian uint32 token
    ids; ``nth`` is the rank among equal lengths of the writing task ``part``.  A control string of
    the vocabulary gets its control id, or with ``controls_as_text`` is ordinary text."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(n, t) for n, t in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
        ("part", T.IntegerType()), ("nth", T.LongType()))]])

    def cut(batches):
        enc, part = encoder(vocabulary, controls_as_text=controls_as_text), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                ids, offs = enc.encode(batch.column(1))
                n = np.diff(offs)
                # the end id after each text
                ids = np.insert(ids, offs[1:], end_id)
                total = n + 1
                first = np.where(total > capacity, total % capacity, total)
                first = np.where(first == 0, capacity, first)
                k = 1 + (total - first) // capacity
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                length = np.where(piece == 0, first[doc], capacity)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ls = length[order]
                run = np.arange(len(ls)) - np.searchsorted(ls, ls)
                nth = np.empty(len(ls), np.int64)
                nth[order] = seen[ls] + run
                seen += np.bincount(length, minlength=capacity + 1)
                bounds = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), lists_to_bytes(ids, bounds),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def place(written: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``written`` pieces (a table, read more than once) with ``sequence_id`` and ``offset``
    instead of ``part`` and ``nth``."""
    histogram = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}
    s = slots(plan(histogram, capacity))
    lo_key = s["length"] * (1 << 40) + s["lo"]  # 2^40 pieces of a length

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        l, r = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(lo_key, l * (1 << 40) + r, side="right") - 1
        d = r - s["lo"][i]
        return pd.DataFrame({"sequence_id": s["base"][i] + d // s["per"][i], "offset": s["at"][i] + d % s["per"][i] * l})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written.groupBy("part", F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # one row per writing task, at most ``capacity`` entries each: pieces stay in the partitions of their files
    offsets = offsets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    rank = F.col("nth") + F.col("before")[F.col("length").cast("int")]
    keep = [c for c in written.columns if c not in ("part", "nth")]
    # a generator, not a plain column: else the maps would go on to the rows that wait for the Python function
    ranked = written.join(F.broadcast(offsets), "part").select(*keep, F.explode(F.array(rank)).alias("rank"))
    return ranked.withColumn("slot", slot("length", "rank")).select(*keep, "slot.sequence_id", "slot.offset")


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from pieces placed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    written = materialize(pieces(docs, path, end_id, capacity), "pack-pieces")
    return place(written.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
