"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the vectors' covariance V are found without ever forming V: a
block of ``k + EXTRA`` directions is multiplied by V in passes over the table (each
task adds up its part of the centred XᵀXQ, the parts are summed by Spark), and only such blocks
(dimensions x directions) reach the driver.

* **Filter.**  A Chebyshev polynomial of V, by its three-term recurrence one pass a degree,
  grows outside the interval of the unwanted eigenvalues and stays within 1 inside it.  The
  interval's upper end is the block's smallest Ritz value; its lower end comes from a Lanczos
  recurrence that rides along as one more column of the same passes.
* **QR and Rayleigh-Ritz.**  The filtered block is orthonormalised and rotated to its Ritz
  vectors; the pass that this takes is the first degree of the next filter.
* **Certificate.**  Iteration ends when the residuals ``|V y - theta y|`` of the first ``k`` pairs are at
  the rounding level (``TOLERANCE`` of the largest eigenvalue), or no longer fall there.  A
  result whose residuals stay above ``WORST`` is refused with an error.

Values are integers: an entry c counts as floor(1024 c) + 100000, so sums, means (as
fractions) and each vector's squared deviation are exact.  The recurrence and the projections are in
double precision.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as
are vectors of another length than most (of lengths equally frequent the shorter stays).  Null
ids stay, repeated rows count and are returned as often as they occur.  Entries beyond 2^62
after scaling count as that.  Components without variance (eigenvalue zero to rounding) cannot
be whitened and are not returned, so fewer than ``k`` come back for vectors of fewer
dimensions, for fewer vectors, or for constant ones; equal eigenvalues give any orthonormal
basis of their space, the same for all rows.  A deviation beyond 64 bits is exact in
:func:`whiten` (decimal), up to 38 digits, null beyond.  An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.session import materialize

#: Fixed values of the integer scale.
UNIT, SHIFT = 1024, 100_000
#: Directions beside the wanted ones; highest degree of a filter; filters at most.
EXTRA, DEGREE, CYCLES = 24, 10, 60
#: Residuals that end the iteration, and the worst that a result may have, in parts of the largest eigenvalue.
TOLERANCE, WORST = 1e-13, 1e-8
#: An eigenvalue below this part of the trace is zero.
_ZERO = 1e-12
#: Entries converted at once.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with exact per-dimension ``sums``; ``vectors`` [dim, components] and ``values`` (eigenvalues,
    falling) of their covariance, its ``trace``, the table passes made and the largest relative residual."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])


def _matrices(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, [rows, dim] integers) of a list column, a bounded number of entries at a time."""
    step = max(1, _CHUNK // max(dim, 1))
    for s in range(0, len(column), step):
        part = column.slice(s, step)
        yield s, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): the usable vectors as integers, written once."""
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(2 ** 62)

    def scaled(c):
        y = F.floor(F.least(F.greatest(c * F.lit(float(UNIT)), F.lit(-most)), F.lit(most)))
        return y.cast("long") + F.lit(SHIFT).cast("long")

    found = materialize(rows.where(ok).select(F.col(id_col).alias("id"), F.transform(v, scaled).alias("x")), "whiten-integers")
    size = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found.where(F.size("x") == size[0]["d"]) if size else found


def _column_sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum per dimension: each half of the bits adds up within 64 bits per task."""

    def parts(batches):
        total, rows = None, 0
        for b in batches:
            dim = len(b.column(0)[0]) if b.num_rows else 0
            for _, m in _matrices(b.column(0), dim):
                add = np.stack([(m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)])
                total, rows = add if total is None else total + add, rows + len(m)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.shape[1]), pa.int32()), pa.array([rows] * total.shape[1], pa.int64()),
                                              pa.array(total[0]), pa.array(total[1])], names=["d", "n", "high", "low"])

    wide = "decimal(38,0)"
    s = x.select("x").mapInArrow(parts, "d int, n long, high long, low long").groupBy("d").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    s = sorted(s.collect(), key=lambda r: r["d"])
    return (s[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in s]) if s else (0, [])


def _times_covariance(x: DataFrame, n: int, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V block and the trace of V, in one pass: X^T (X block) / n of the centred vectors, summed per dimension."""
    dim, width = block.shape
    names = [f"c{j}" for j in range(width + 1)]

    def parts(batches):
        total, seen = np.zeros((dim, width + 1)), False
        for b in batches:
            for _, m in _matrices(b.column(0), dim):
                c = m - mean
                total[:, :width] += c.T @ (c @ block)
                total[:, width] += np.einsum("ij,ij->j", c, c)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), *[pa.array(t) for t in total.T]], names=["d", *names])

    schema = ", ".join(["d int", *[f"{c} double" for c in names]])
    sums = x.select("x").mapInArrow(parts, schema).groupBy("d").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((dim, width + 1))
    for r in sums:
        out[r["d"]] = r[1:]
    out /= n
    return out[:, :width], float(out[:, width].sum())


def fit(x: DataFrame, k: int = 8, seed: int = 7) -> Whitening | None:
    """Mean and leading eigenpairs of the covariance of ``x`` (see :func:`integers`); None of an empty table."""
    n, sums = _column_sums(x)
    if not n:
        return None
    start = Whitening(n, sums, np.empty((0, 0)), np.empty(0), 0.0, 0, 0.0)
    mean, dim = start.mean, len(sums)
    k, width = min(k, dim), min(dim, k + EXTRA)
    rng = np.random.default_rng(seed)
    passes = 0

    # the Lanczos recurrence of the riding column: unit vectors v, coefficients alpha, beta
    v, before, alpha, beta = rng.normal(size=dim), np.zeros(dim), [], []
    v /= np.linalg.norm(v)
    trace = 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal passes, v, before, trace
        out, trace = _times_covariance(x, n, mean, np.column_stack([block, v]))
        passes += 1
        if len(beta) == len(alpha) and len(alpha) < dim:
            w = out[:, -1] - (beta[-1] * before if beta else 0.0)
            alpha.append(float(v @ w))
            w = w - alpha[-1] * v
            size = float(np.linalg.norm(w))
            if size > 1e-10 * max(abs(a) for a in alpha):
                beta.append(size)
                before, v = v, w / size
        return out[:, :-1]

    def lowest() -> float:
        """Estimate from below of the smallest eigenvalue."""
        t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
        w, s = np.linalg.eigh(t)
        last = beta[len(alpha) - 1] if len(beta) >= len(alpha) else 0.0
        return max(0.0, float(w[0]) - last * abs(float(s[-1, 0])))

    block = rng.normal(size=(dim, width))
    best, stalled = np.inf, 0
    for _ in range(CYCLES):
        q = np.linalg.qr(block)[0]
        vq = multiply(q)
        h = q.T @ vq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, q, vq = theta[order], q @ y[:, order], vq @ y[:, order]
        if theta[0] <= _ZERO * max(trace, 1.0) / dim:  # no variance at all
            return Whitening(n, sums, np.empty((dim, 0)), np.empty(0), trace, passes, 0.0)
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * theta[:k], axis=0).max() / theta[0])
        stalled = stalled + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if residual <= TOLERANCE or width == dim or (best <= 100 * TOLERANCE and stalled >= 2):
            break
        # damp what lies between the spectrum's lower end and the block's smallest Ritz value
        low, high = min(lowest(), float(theta[-1]) * (1 - 1e-6)), float(theta[-1])
        middle, half = (high + low) / 2, max((high - low) / 2, 1e-300)
        reach = max((theta[0] - middle) / half, 1.0)
        # growth of the first direction over the last within 10^10: the block keeps its rank
        degree = int(max(2, min(DEGREE, 23.0 / max(np.arccosh(reach), 1e-3))))
        scale = half / (theta[0] - middle)
        s = scale
        old, block = q, (vq - middle * q) * (s / half)
        for _ in range(degree - 1):
            s2 = 1.0 / (2.0 / scale - s)
            old, block = block, (multiply(block) - middle * block) * (2 * s2 / half) - old * (s * s2)
            s = s2
    if residual > WORST:
        raise RuntimeError(f"subspace iteration ended with a residual of {residual:.2e}")
    good = theta[:k] > _ZERO * trace
    return Whitening(n, sums, q[:, :k][:, good], theta[:k][good], trace, passes, residual)


def project(x: DataFrame, fitted: Whitening) -> DataFrame:
    """(id, deviation decimal(38,0), w array<double>): exact squared deviation times n^2, whitened components."""
    n, mean, scaled = fitted.n, fitted.mean, fitted.vectors / np.sqrt(fitted.values)
    sums, dim = fitted.sums, len(fitted.sums)
    largest = 10 ** 38

    def exact(m: np.ndarray) -> list[int]:
        reach = max((max(abs(n * int(m[:, j].max()) - s), abs(n * int(m[:, j].min()) - s)) for j, s in enumerate(sums)), default=0)
        if reach * reach * dim < 2 ** 63 and n * int(np.abs(m).max()) < 2 ** 63:
            y = n * m - np.array(sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        return [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in m.tolist()]

    def parts(batches):
        for b in batches:
            for s, m in _matrices(b.column(1), dim):
                w = (m - mean) @ scaled
                dev = [d if d < largest else None for d in exact(m)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, len(m)), pa.array(dev, pa.decimal128(38, 0)), flat],
                                                 names=["id", "deviation", "w"])

    return x.select("id", "x").mapInArrow(parts, f"id {x.schema['id'].dataType.simpleString()}, deviation decimal(38,0), w array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened components' covariance minus the identity."""
    mean = projected.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    c = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
    cov = projected.agg(*[F.avg(c[i] * c[j]) for i in range(k) for j in range(i, k)]).first()
    want = [float(i == j) for i in range(k) for j in range(i, k)]
    return max(abs(a - b) for a, b in zip(cov, want))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for every usable row and component."""
    x = integers(rows, id_col, vec_col)
    fitted = fit(x, k)
    found = 0 if fitted is None else len(fitted.values)
    if not found:
        kind = rows.schema[id_col].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                                     "explained double, identity_error double")
    projected = materialize(project(x, fitted), "whiten-projected")
    error = identity_error(projected, found)
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    out = projected.select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("i") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"),
                      "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
