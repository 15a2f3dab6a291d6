"""Line dedup: remove later occurrences of repeated three-line windows.

Built-in DataFrame functions only.

1. A text's lines are its physical lines; a line of more than :data:`LONG_LINE` words
   (a paragraph on one line) counts as several, cut after its sentence ends, so a
   passage inside a paragraph is seen like one on lines of its own.  Overlapping windows
   of ``span`` consecutive lines are hashed to 96 bits (xxhash64 of the trimmed lines, and 32
   bits of another with a different lead).
2. The first 64 bits are counted globally in the narrowest rows there are; nearly all windows
   are unique and go no further.  The aggregate is partial, so a window that a third of
   all documents share folds map-side to one row per task.  Of the windows that may
   repeat, the first occurrence per whole hash is the smallest (doc_id, text hash, position).
3. Every other occurrence of a repeated window covers ``span`` lines; a
   document's covered positions are merged into intervals (gaps and islands) and
   the lines inside them are removed, with their line ends.

Every window counts, however short its lines.  Only a whole merged run whose trimmed lines
have fewer than :data:`MIN_CHARS` characters together stays: three one-word lines that meet
again, or blank lines alone, are no passage.  A line is removed only when an equal line stays at an
earlier place, so no line content is lost altogether.  Texts with fewer than ``span`` lines
have no window and stay as they are (whole copies are the near-duplicate stage's
work).

Nulls: a null text has no window and stays null; null ids sort before all others.
Repeated rows (same id and same text) are one document: each copy of the row gets
the same result.  Rows with one id and different texts are kept apart by the text
hash.  Extra columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.common import fresh
from merchlens.session import materialize


#: Words (between single blanks) beyond which a physical line is cut at its sentence ends.
LONG_LINE = 40
#: Fewest characters of a merged run's trimmed lines together.
MIN_CHARS = 40


def _lines(text: str) -> Column:
    """The lines of a text with their line ends; together they are the text."""
    # nothing but the element in the lambdas: what else stands there runs once per element
    lines = F.filter(F.split(F.col(text), r"(?<=\n)", -1), lambda x: x != "")
    # plain replacements and a split at one character, unless the text itself has that character
    mark = "\x01"

    def marked(x: Column) -> Column:
        for end in (". ", "! ", "? "):
            x = F.replace(x, F.lit(end), F.lit(end + mark))
        return x

    def cut(x: Column) -> Column:
        pieces = F.when(F.contains(x, F.lit(mark)), F.regexp_extract_all(x, F.lit(r"[^\n]*?[.!?] |[^\n]+\n?|\n"), F.lit(0))).otherwise(
            F.filter(F.split(marked(x), mark, -1), lambda y: y != ""))
        blanks = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
        return F.when(blanks >= LONG_LINE, pieces).otherwise(F.array(x))

    return F.flatten(F.transform(lines, cut))


def _trimmed(line: Column) -> Column:
    return F.trim(F.rtrim(line, F.lit("\n")))


def _text_hash(text_col: str) -> Column:
    """32 bits that tell rows with one id apart."""
    return F.xxhash64(text_col).bitwiseAND(0x7FFFFFFF).cast("int")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """(id, th int, pos, h1 long, h2 int): one row per window of each distinct document."""
    d = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("th"), _lines(text_col).alias("lines"))
    # a line costs its hashes once, a window a hash of its lines' hashes
    d = d.select("id", "th", F.transform("lines", _trimmed).alias("lines"))
    d = d.select("id", "th", F.transform("lines", lambda x: F.struct(
        F.xxhash64(F.lit("a"), x).alias("a"), F.xxhash64(F.lit("b"), x, F.length(x)).alias("b"))).alias("s"))

    def window(i: Column) -> Column:
        at = [F.get("s", i + k) for k in range(span)]
        return F.struct(i.alias("pos"), F.xxhash64(*[x["a"] for x in at]).alias("h1"),
                        F.xxhash64(*[x["b"] for x in at]).bitwiseAND(0x7FFFFFFF).cast("int").alias("h2"))

    # no filter on the lines and an outer explode: Catalyst would copy the splitting into filters below
    n = F.greatest(F.size("s") - span, F.lit(0))
    w = F.when(F.size("s") >= span, F.transform(F.sequence(F.lit(0), n), window))
    d = d.select("id", "th", F.explode_outer(w).alias("w")).select("id", "th", "w.*")
    return d.where(F.col("pos").isNotNull())


def later_intervals(win: DataFrame, span: int = 3) -> DataFrame:
    """(id, th, cuts): per document the merged [start, end) line intervals covered by
    later occurrences of windows that occur more than once."""
    here = F.struct("id", "th", "pos")
    # written, so that both sides of the joins are plain exchanges, which adaptive execution splits
    twice = materialize(win.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "line-twice")
    again = materialize(win.join(twice, "h1"), "line-again")
    first = again.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    first = materialize(first.select("h1", "h2", "first"), "line-first")
    later = again.join(first, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).select("id", "th", "pos").distinct()
    doc = Window.partitionBy("id", "th").orderBy("pos")
    gap = F.col("pos") > F.lag("pos").over(doc) + span
    islands = later.withColumn("opens", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    islands = islands.withColumn("island", F.sum("opens").over(doc))
    cuts = islands.groupBy("id", "th", "island").agg(F.min("pos").alias("s"), (F.max("pos") + span).alias("e"))
    return cuts.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cleaned, plus ``n_lines`` and
    ``n_removed`` (renamed with a trailing underscore where ``docs`` has such columns).
    Removing every line leaves an empty text; the document stays."""
    cuts = later_intervals(materialize(windows(docs, id_col, text_col, span), "line-windows"), span)
    rid, rth, cut, parts = (fresh(docs, n) for n in ("__id", "__th", "__cuts", "__parts"))
    joined = docs.join(cuts.select(F.col("id").alias(rid), F.col("th").alias(rth), F.col("cuts").alias(cut)),
                       F.col(id_col).eqNullSafe(F.col(rid)) & (_text_hash(text_col) == F.col(rth)), "left")
    # a column of its own: inside a lambda the splitting would run again for every interval
    joined = joined.withColumn(parts, _lines(text_col))
    lines = F.col(parts)

    def chars(c: Column) -> Column:
        return F.aggregate(F.slice(lines, c["s"] + 1, c["e"] - c["s"]), F.lit(0), lambda t, x: t + F.length(_trimmed(x)))

    joined = joined.withColumn(cut, F.filter(cut, lambda c: chars(c) >= MIN_CHARS))
    cuts_ = F.col(cut)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    # what stays: before the first cut, between neighbours, after the last
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts_, lambda c: c["e"]))
    ends = F.concat(F.transform(cuts_, lambda c: c["s"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, F.greatest(e - s, F.lit(0)))))
    removed = F.coalesce(F.aggregate(cuts_, F.lit(0), lambda t, c: t + c["e"] - c["s"]), F.lit(0))
    n1, n2 = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = joined.withColumns({n1: n_lines.cast("long"), n2: removed.cast("long")})
    out = out.withColumn(text_col, F.when(cuts_.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "")))
    return out.select(*docs.columns, n1, n2)


#: DuckDB SQL for dedup over a table expression with doc_id, text (distinct doc_id).
LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, text, flatten([CASE WHEN len(string_split(x, ' ')) > 40
      THEN regexp_extract_all(x, '[^\n]*?[.!?] |[^\n]+\n?|\n') ELSE [x] END
    FOR x IN regexp_extract_all(text, '[^\n]*\n|[^\n]+')]) AS ls FROM {src}),
t AS (SELECT doc_id, [trim(rtrim(x, chr(10))) FOR x IN ls] AS ls FROM l),
p AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM t WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM w),
c0 AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE rn > 1),
c1 AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c0),
cov AS (SELECT c1.doc_id, pos FROM c1 JOIN t ON t.doc_id = c1.doc_id
        QUALIFY sum(length(ls[pos + 1])) OVER (PARTITION BY c1.doc_id, run) >= 40),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
j AS (SELECT e.doc_id, string_agg(e.line, '' ORDER BY e.pos) FILTER (WHERE cov.pos IS NULL) AS t,
        count(*) AS n_lines, count(cov.pos) AS n_removed
      FROM e LEFT JOIN cov ON cov.doc_id = e.doc_id AND cov.pos = e.pos GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(j.t, '') AS text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM l LEFT JOIN j ON j.doc_id = l.doc_id
"""
