"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. **Document statistics** of every whole text (one Arrow pass): sizes, shares of byte
   classes, word and line repetition.  No label, language, source or id enters.
2. **Random Fourier features** ``sqrt(2/D) cos(W z + b)`` of the standardised statistics
   approximate a Gaussian kernel; W and b come from a fixed seed.
3. **Normal equations** are summed per partition in numpy and then per matrix row on
   Spark; only the (D+1)^2 sums reach the driver, whatever the number of labels.
   The sums are kept per fold, so a model without the other fold is free.
4. **Isotonic calibration** on scores of the model that did not see the label's fold, summed
   over a fixed grid of score bins; pool-adjacent-violators runs on the bins.

Nulls: a null text is empty and is scored; rows with a null id are scored and never
learned from.  Only labels 0 and 1 count; several labels of one id are averaged.
Without usable labels every score is 0.5.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import fresh, give_back, text_or_empty
from merchlens.session import materialize

#: Random features, kernel width in standard deviations per statistic, ridge penalty per label.
FEATURES, WIDTH, RIDGE = 256, 1.5, 1e-3
#: Score bins of the calibration; scores are held within [-0.5, 1.5].
BINS = 2000

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "non_ascii", "stop", "comma", "bang",
    "symbol", "other", "entropy", "top_byte", "distinct_words", "distinct_pairs", "repeat_next", "upper_words",
    "line_bytes", "distinct_lines", "closed_lines", "max_word")

_CLASSES = np.zeros((256, 9))
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f",
                           bytes(range(128, 256)), b".", b",", b"!?", b"#*$%&|<>")):
    _CLASSES[list(_set), _i] = 1


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one UTF-8 text."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist / max(n, 1)
    classes = share @ _CLASSES
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    p = share[share > 0]
    pairs = max(k - 1, 1)
    return np.array([
        np.log1p(n), np.log1p(k), sum(map(len, words)) / max(k, 1), *classes, 1 - classes.sum() if n else 0.0,
        -(p * np.log(p)).sum(), share.max() if n else 0.0,
        # repetition against what a text of this size has by itself
        len(set(words)) / max(k, 1), len(set(zip(words, words[1:]))) / pairs, sum(map(eq, words, words[1:])) / pairs,
        sum(map(bytes.isupper, words)) / max(k, 1), np.log1p(n / max(len(lines), 1)),
        len(set(lines)) / max(len(lines), 1), sum(x.rstrip().endswith(b".") for x in lines) / max(len(lines), 1),
        np.log1p(max(map(len, words), default=0))])


def statistics_column(text: Column) -> Column:
    """array<double> of the statistics of a text column."""

    @F.pandas_udf("array<double>")
    def document_statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(bytes(t)) for t in texts], index=texts.index, dtype=object)
            del texts
            give_back()

    return document_statistics(F.encode(text_or_empty(text), "UTF-8"))


@dataclass(frozen=True)
class Model:
    """A fitted classifier; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        raw = _features(stats, self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    d = len(STATISTICS)
    return rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def _features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w, b = _projection()
    z = np.clip((stats - mean) / scale, -5, 5)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _solve(sums: np.ndarray, n: float) -> np.ndarray:
    a, y = sums[:, :-1], sums[:, -1]
    return np.linalg.solve(a + RIDGE * max(n, 1.0) * np.eye(len(a)), y)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: (weighted centre, mean) of each pool."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist()):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on the labelled rows of ``stats`` (id_col, ``stats`` array) that are not held out."""
    y = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 1))
         .groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y")))
    train = stats.select(F.col(id_col).alias("id"), "stats").join(y, "id").select(
        (F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 2).alias("fold"), "y", "stats")
    train = materialize(train, "quality-train")
    d = len(STATISTICS)
    m = train.agg(F.count("*").alias("n"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
                  *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not m["n"]:
        none = np.empty(0)
        return Model(none, none, none, none, none)
    mean = np.array([m[f"m{i}"] for i in range(d)])
    scale = np.maximum(np.array([m[f"s{i}"] for i in range(d)]), 1e-6)

    def partial(batches):
        total = {}
        for b in batches:
            folds, ys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            phi = _features(_matrix(b.column(2)), mean, scale)
            for f in (False, True):
                p, t = phi[folds == f], ys[folds == f]
                total[f] = total.get(f, 0) + np.hstack([p.T @ p, (p.T @ t)[:, None]])
        for f, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(sums)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(list(sums))],
                names=["fold", "row", "sums"])

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "row": [key[1]], "sums": [np.sum(np.stack(rows["sums"].tolist()), axis=0)]})

    schema = "fold boolean, row int, sums array<double>"
    rows = train.mapInArrow(partial, schema).groupBy("fold", "row").applyInPandas(add, schema).collect()
    sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
    for r in rows:
        sums[int(r["fold"]), r["row"]] = r["sums"]
    n = sums[:, -1, -2]  # the constant feature's square sums to the count
    weights = _solve(sums.sum(axis=0), n.sum())
    # a fold is scored by the other fold's model; a single fold by its own
    other = [_solve(sums[1 - f], n[1 - f]) if n[1 - f] else weights for f in (0, 1)]

    def binned(batches):
        for b in batches:
            folds = b.column(0).to_numpy(zero_copy_only=False).astype(int)
            phi = _features(_matrix(b.column(2)), mean, scale)
            raw = np.where(folds == 1, phi @ other[1], phi @ other[0])
            bins = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column(1)], names=["bin", "y"])

    cells = train.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    cells = sorted((r["bin"], r["y"], r["n"]) for r in cells.collect())
    c = np.array(cells, float)
    knots, levels = isotonic((c[:, 0] + 0.5) / BINS * 2 - 0.5, c[:, 1] / c[:, 2], c[:, 2])
    return Model(mean, scale, weights, knots, levels)


def score_column(model: Model, stats: Column) -> Column:
    """Calibrated score (0 to 1) of a statistics column."""

    @F.pandas_udf("double")
    def quality_score(values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(model.scores(np.stack(values.tolist())), index=values.index)

    return quality_score(stats)


def text_score_column(model: Model, text: Column) -> Column:
    """Calibrated score of a text column, statistics and score in one Python function: two in a row are two
    worker processes per task, and Spark keeps and feeds all of them in the stages that follow."""

    @F.pandas_udf("double")
    def text_quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            stats = [statistics(bytes(t)) for t in texts]
            yield pd.Series(model.scores(np.stack(stats)) if stats else [], index=texts.index, dtype=float)
            del texts, stats
            give_back()

    return text_quality(F.encode(text_or_empty(text), "UTF-8"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every document; texts are read once."""
    stats = materialize(docs.select(F.col(id_col), statistics_column(F.col(text_col)).alias("stats")), "quality-stats")
    model = fit(stats, labels, id_col)
    out = stats.select(id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"),
                       score_column(model, F.col("stats")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5, all columns unchanged."""
    stats = materialize(docs.select(F.col(id_col), statistics_column(F.col(text_col)).alias("stats")), "quality-stats")
    model = fit(stats, labels, id_col)
    name = fresh(docs, "__score")
    scored = docs.withColumn(name, text_score_column(model, F.col(text_col)))
    return scored.where(F.col(name) >= 0.5).drop(name)
