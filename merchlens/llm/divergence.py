"""Source divergence audit: how far each source's vocabulary lies from the others of its language.

1. **Counting.**  Whole texts are cut into terms task by task; a task folds its counts per
   (lang, source, term) in a table of bounded size before anything is shuffled, so neither a
   hot source nor a frequent term moves more than a row per table and task.
2. **Kept terms.**  A language keeps the terms that at least ``min_docs`` of its documents hold; a
   group is a (lang, source) pair, and its rate of a term is the exact integer
   ``1 + floor(10^9 (count + 5) / (N + 5 V))``.
3. **Pairs.**  Sum of rate differences over all kept terms, for every two sources of a
   language.  Terms are dealt into numbered cells of a bounded number of rates, sources into
   numbered blocks; a task fills one dense matrix (terms of the cell by sources) and adds up
   its block's rows, so no pair is ever a row before its sum.
4. **Terms.**  The terms that a group uses more than its language, by the difference of the rates.  The
   difference grows with the group's count and falls with the language's, so a term that
   ``top`` others dominate - at least its group count, at most its lang count, earlier in
   UTF-8, which decides ties - cannot be among the first ``top``.  Each task keeps the terms of a
   group that fewer than ``top`` others dominate (its skyband, folded in over bounded
   buffers), the skybands are merged by (group, numbered part) in the same way, and the few
   terms left are ranked exactly.

Defined cases: null text, lang and source count as ''.  A text without terms still makes its
group occur.  Repeated rows are documents of their own; equal values rank by their item in
UTF-8 order.  A language that keeps no term has pairs of value 0 and no term rows; a language
with one source has no pair rows.  Very long texts are counted whole, one text at a time.
An empty table gives an empty result.  Only the named columns are read.

Memory: a cell holds ``CELL`` rates, a block ``BLOCK`` sources; per (lang, term) the list of its
sources is one row, as long as the language has sources - the answer holds their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.common import text_or_empty
from merchlens.session import materialize

#: Fixed values of the rates.
SCALE, PRIOR = 1_000_000_000, 5
MIN_DOCS, TOP = 30, 50
#: Rates of a cell of the pair sums, and sources of a block.
CELL, BLOCK = 1 << 15, 256
#: Bytes of text that are cut at once; rows after which a task folds its counts (at twice that many distinct ones
#: it passes them on); rows of a skyband buffer; parts of a group's merge.
_SLICE, _TABLE, _BUFFER, _PARTS = 1 << 22, 200_000, 8_192, 8

# A-Z to a-z; what separates terms to a blank.  Bytes from 0x80 belong to terms.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _strings(values) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) in a slice of documents."""
    # one pass over the slice's text buffer; the offsets of the texts stay what they are
    text = pa.concat_arrays([text])  # its own buffers, from offset 0
    offsets, data = text.buffers()[1:]
    clean = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_TO_TERMS))
    words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_binary(), len(text), [None, offsets, clean]).cast(pa.large_string()))
    doc = np.repeat(np.arange(len(text)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    code, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    full = pc.binary_length(vocabulary).to_numpy()[code] > 0 if len(code) else np.zeros(0, bool)
    width = max(len(vocabulary), 1)
    in_doc, n = np.unique(doc[full] * width + code[full], return_counts=True)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
    key, at, docs = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True, return_counts=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, n)
    g = key // width
    return pa.table({"lang": langs.dictionary.take(pa.array(g // max(len(sources.dictionary), 1))),
                     "source": sources.dictionary.take(pa.array(g % max(len(sources.dictionary), 1))),
                     "term": vocabulary.take(pa.array(key % width)).cast(pa.string()),
                     "n": pa.array(total), "docs": pa.array(docs.astype(np.int64))})


def _slices(sizes: np.ndarray):
    """(start, end) of runs of documents with about _SLICE bytes of text each, one document at least."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
        yield i, j
        i = j


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, the rows of a
    (lang, term) in one partition."""

    def fold(batches):
        table, rows, least = [], 0, _TABLE

        def folded():
            t = pa.concat_tables(table).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

        for b in batches:
            text = b.column(2).cast(pa.large_binary())
            for i, j in _slices(pc.binary_length(text).to_numpy()):
                table.append(_counted(b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), text.slice(i, j - i)))
                rows += table[-1].num_rows
                if rows >= least:
                    one = folded()
                    table, rows, least = [one], one.num_rows, max(_TABLE, 2 * one.num_rows)
                    if rows >= 2 * _TABLE:
                        yield from one.combine_chunks().to_batches(max_chunksize=50_000)
                        table, rows, least = [], 0, _TABLE
        if rows:
            yield from folded().combine_chunks().to_batches(max_chunksize=50_000)

    d = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    parts = d.mapInArrow(fold, "lang string, source string, term string, n long, docs long")
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), exact at any count."""
    top = (count.cast("decimal(20,0)") + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + kept.cast("decimal(18,0)") * F.lit(PRIOR).cast("decimal(1,0)")
    return F.call_function("div", top, below) + F.lit(1)


class _Skybands:
    """Terms of each group that fewer than ``k`` others dominate, folded in over buffers."""

    def __init__(self, k: int):
        self.k, self.kept, self.new, self.size = k, {}, {}, 0

    def add(self, group, row) -> None:
        self.new.setdefault(group, []).append(row)
        self.size += 1
        if self.size >= _BUFFER:
            self.fold()

    def fold(self) -> None:
        for g, rows in self.new.items():
            self.kept[g] = skyband(self.kept.get(g, []) + rows, self.k)
        self.new, self.size = {}, 0


def skyband(rows: list[tuple[int, int, bytes]], k: int) -> list[tuple[int, int, bytes]]:
    """The rows (group count, lang count, term) that fewer than ``k`` others dominate.

    In the order of (count down, lang count up, term up) a row comes after all that dominate it, and if
    ``k`` or more do, so do ``k`` kept ones: it is enough to count among the kept."""
    if len(rows) <= k:
        return rows
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    place = {t: i for i, t in enumerate(sorted(r[2] for r in rows))}
    low = np.array([r[1] for r in rows], np.int64)
    at = np.array([place[r[2]] for r in rows], np.int64)
    kl, ka = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    out = []
    for i, r in enumerate(rows):
        m = len(out)
        if m < k or np.count_nonzero((kl[:m] <= low[i]) & (ka[:m] < at[i])) < k:
            kl[m], ka[m] = low[i], at[i]
            out.append(r)
    return out


_BAND = "lang string, source string, term string, n long, lang_n long"


def _keep_skybands(rows: DataFrame, top: int) -> DataFrame:
    """Per task and group the skyband of ``rows`` (columns of ``_BAND``)."""

    def keep(batches):
        bands = _Skybands(top)
        for b in batches:
            lang, source, term = (pc.cast(b.column(i), pa.binary()).to_pylist() for i in range(3))
            for g, h, t, n, m in zip(lang, source, term, b.column(3).to_pylist(), b.column(4).to_pylist()):
                bands.add((g, h), (n, m, t))
        bands.fold()
        for (g, h), band in bands.kept.items():
            yield pa.RecordBatch.from_arrays(
                [_strings([g] * len(band)), _strings([h] * len(band)), _strings([r[2] for r in band]),
                 pa.array([r[0] for r in band], pa.int64()), pa.array([r[1] for r in band], pa.int64())],
                names=["lang", "source", "term", "n", "lang_n"])

    return rows.select("lang", "source", "term", "n", "lang_n").mapInArrow(keep, _BAND)


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def _pair_values(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed rate differences of every two sources of a language."""
    cells = F.greatest(F.ceil(F.col("kept").cast("double") * F.col("sources") / CELL), F.lit(1)).cast("long")
    blocks = F.ceil(F.col("sources") / BLOCK).cast("long")
    g = groups.select("lang", "at", "base", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), blocks.alias("blocks"))
    g = g.select("lang", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "at", "base")
    t = rates.withColumn("cell", F.pmod(F.xxhash64("term"), cells)).groupBy("lang", "cell", "term", blocks.alias("blocks")).agg(
        F.collect_list("at").alias("ats"), F.collect_list("p").alias("ps"))
    t = t.select("lang", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "ats", "ps")

    def add_up(key, t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        base = g.sort_values("at")["base"].to_numpy(np.int64)
        first = int(key[2]) * BLOCK
        own = np.arange(first, min(first + BLOCK, len(base)))
        p = np.tile(base, (len(t), 1))
        if len(t):
            row = np.repeat(np.arange(len(t)), [len(a) for a in t["ats"]])
            p[row, np.concatenate(t["ats"].to_list())] = np.concatenate(t["ps"].to_list())
        sums = np.stack([np.abs(p - p[:, [i]]).sum(axis=0) for i in own])
        return pd.DataFrame({"lang": key[0], "a": np.repeat(own, len(base)), "b": np.tile(np.arange(len(base)), len(own)),
                             "value": sums.ravel()})

    keys = ["lang", "cell", "block"]
    sums = t.groupBy(*keys).cogroup(g.groupBy(*keys)).applyInPandas(add_up, "lang string, a int, b int, value long")
    sums = sums.where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", F.col("at").alias("a"), "source")
    other = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"))
    return sums.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by
    distance, part ``term`` the first ``top`` terms that the group uses more than its language."""
    counts = count_terms(docs, lang_col, source_col, text_col)
    # sums over the rows of a (lang, term), which lie in one partition: nothing moves again
    whole = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)})
    kept = materialize(counts.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"), "divergence-kept")

    # groups, their totals, and their number within the language
    occur = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = occur.join(total, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    none = F.col("kept") == 0  # no rate is asked for then
    groups = groups.withColumn("base", F.when(none, F.lit(0).cast("long")).otherwise(rate(F.lit(0), F.col("total"), F.col("kept"))))
    groups = materialize(groups, "divergence-groups")

    rates = kept.join(groups, ["lang", "source"]).withColumns({
        "p": rate(F.col("n"), F.col("total"), F.col("kept")), "q": rate(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    pairs = _pair_values(rates.select("lang", "term", "at", "p", "kept", "sources"), groups)

    over = rates.where(F.col("p") > F.col("q"))
    bands = _keep_skybands(over, top).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(_PARTS)))
    merged = _keep_skybands(bands.repartition("lang", "source", "part"), top)
    best = merged.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (
        rate(F.col("n"), F.col("total"), F.col("kept")) - rate(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(best, "term", top))


#: DuckDB SQL over a table with text, lang, source.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM {src}),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
l AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS ln FROM c GROUP BY ALL HAVING sum(docs) >= {min_docs}),
k AS (SELECT c.* FROM c JOIN l ON l.lang = c.lang AND l.term = c.term),
lt AS (SELECT lang, CAST(sum(ln) AS HUGEINT) AS lt, CAST(count(*) AS HUGEINT) AS v FROM l GROUP BY lang),
g AS (SELECT o.lang, o.source, coalesce(s.n, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) o
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM k GROUP BY ALL) s ON s.lang = o.lang AND s.source = o.source),
p AS (SELECT g.lang, g.source, l.term, coalesce(k.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)) // (g.total + 5 * lt.v) AS p,
        1 + (1000000000::HUGEINT * (l.ln + 5)) // (lt.lt + 5 * lt.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN lt ON lt.lang = g.lang
      LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tops)
WHERE rank <= {top}
"""
