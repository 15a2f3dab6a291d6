"""Line-first quality rules.

Every line is judged by itself; lines that fail are removed, and a document that
loses more than ``max_lost_percent`` of its words that way is rejected, as is one that
fails the base statistics (too few words, too many words inside repeated eight-word
windows).  A line with words fails when it is

* **punctuation**: symbols ``#*$%&|<>`` make up more than a tenth of its non-blank
  characters, or at least a fifth of its words end in ``!!``, or it has fewer than
  ``MIN_OPEN_WORDS`` words and no closing punctuation;
* **navigation**: at least three separators ``|``, ``»``, ``›``, ``•``, ``·``, or fewer words
  than twice its separators;
* **boilerplate**: one of :data:`BOILERPLATE`, plural and past forms included, occurs in it between
  word edges (any case), and the notice is most of the line: it has at most
  ``MAX_NOTICE_WORDS`` words, or at least half of its words belong to such phrases.

Lines without a word stay.  Long texts are processed whole; the scratch space of a
document is a few numbers per word.  Nulls: a null text counts as a text without
words: it fails the base rule (fewer than 20 words).  Repeated rows are judged
alike; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import fresh, give_back, text_or_empty

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
MIN_OPEN_WORDS = 4
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
MAX_NOTICE_WORDS = 12
CLOSING = ".!?…:;,)\"'”’»。！？"
#: Phrases of notices, consent banners and page furniture.
BOILERPLATE = (
    "all rights reserved", "cookie", "copyright ", "licensed under", "license", "privacy policy", "terms of service",
    "terms of use", "javascript", "sign in", "log in", "subscribe", "newsletter", "click here", "read more",
    "share this", "skip to content",
)

_SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
_SEPARATOR_BYTES = [c.encode() for c in SEPARATORS]
_CLOSING_BYTES = tuple(c.encode() for c in CLOSING)
_BOILERPLATE = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
#: The phrases between (ASCII) word edges, a form that Python and RE2 read alike.
NOTICE = r"\b(?:" + "|".join(p if p.endswith(" ") else p + r"[sd]?\b" for p in BOILERPLATE) + ")"
_NOTICE = re.compile(NOTICE.encode())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line (with its words, at least one) fails one of the line rules."""
    n = len(words)
    seps = sum(map(line.count, _SEPARATOR_BYTES))
    if seps >= 3 or n < 2 * seps:
        return True
    symbols = sum(map(line.count, _SYMBOL_BYTES))
    if symbols:
        solid = b"".join(words)
        chars = len(solid) - sum(c & 0xC0 == 0x80 for c in solid)
        if 10 * symbols > chars:
            return True
    if b"!!" in line and 5 * sum(w.endswith(b"!!") for w in words) >= n:
        return True
    if n < MIN_OPEN_WORDS and not words[-1].endswith(_CLOSING_BYTES):
        return True
    low = line.lower()
    if not _BOILERPLATE.search(low):  # the quick look, without edges
        return False
    notices = _NOTICE.findall(low)
    return bool(notices) and (n <= MAX_NOTICE_WORDS or 2 * sum(len(p.split()) for p in notices) >= n)


def repeated_words(words: list[bytes]) -> int:
    """Words inside ``WINDOW``-word windows that occur at least twice in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter(map(seen.setdefault, words, count()), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    for step in (1, 2, 4):  # names of 2-, 4-, then 8-word runs
        pair = a[:-step] * (len(words) + 1) + a[step:]
        a = np.unique(pair, return_inverse=True)[1]
    twice = np.bincount(a)[a] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: bytes, max_lost_percent: int = MAX_LOST_PERCENT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed,
    kept, failing line numbers) of one UTF-8 text."""
    words = text.split()
    solid = b"".join(words)
    chars = len(solid) - int((np.frombuffer(solid, np.uint8) & 0xC0 == 0x80).sum()) if solid else 0
    lost, dup, bad, seen = 0, 0, [], set()
    for i, line in enumerate(text.split(b"\n")):
        w = line.split()
        if w:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if line_fails(line, w):
                lost += len(w)
                bad.append(i)
    repeat = repeated_words(words)
    base = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not base and 100 * lost <= max_lost_percent * len(words)
    return (len(words), chars, sum(map(text.count, _SYMBOL_BYTES)), dup, repeat, lost, base, kept, bad)


def _strip(text: bytes, bad: list[int]) -> bytes:
    if not bad:
        return text
    drop = set(bad)
    return b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in drop)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


def verdict(text: Column, max_lost_percent: int = MAX_LOST_PERCENT) -> Column:
    """Struct of the counts and the verdict of a text column."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                  "n_lost_words long, base_failed boolean, kept boolean")
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(bytes(t), max_lost_percent)[:8] for t in texts], columns=list(_COLUMNS))
            del texts
            give_back()

    return rules(F.encode(text_or_empty(text), "UTF-8"))


def clean(docs: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The kept documents, all columns, ``text_col`` without its failing lines."""

    @F.pandas_udf("kept boolean, text binary")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in map(bytes, texts):
                *_, kept, bad = judge(t, max_lost_percent)
                rows.append((kept, _strip(t, bad) if kept else b""))
            yield pd.DataFrame(rows, columns=["kept", "text"])
            del texts, rows
            give_back()

    name = fresh(docs, "__rules")
    # as a plain function it would run twice, in two worker processes per task: for the filter and for the text
    out = docs.withColumn(name, cleaned.asNondeterministic()(F.encode(text_or_empty(text_col), "UTF-8")))
    return (out.where(F.col(name)["kept"]).withColumn(text_col, F.col(name)["text"].cast("string")).drop(name))


def _rule_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = lambda s: "".join("\\" + c if c in "\\]^-[" else c for c in s)
    word = r"'[^\x20\x09-\x0D]+'"
    seps = f"(length(line) - length(regexp_replace(line, {q('[' + esc(SEPARATORS) + ']')}, '', 'g')))"
    symbols = f"(length(line) - length(regexp_replace(line, {q('[' + esc(SYMBOLS) + ']')}, '', 'g')))"
    notices = f"regexp_extract_all(lower(line), {q(NOTICE)})"
    boiler = (f"len({notices}) > 0 AND (n <= {MAX_NOTICE_WORDS} "
              f"OR 2 * len(string_split(array_to_string([trim(x) FOR x IN {notices}], ' '), ' ')) >= n)")
    closing = "[" + esc(CLOSING) + "]$"
    return f"""
    SELECT *, n > 0 AND ({seps} >= 3 OR n < 2 * {seps}
      OR 10 * {symbols} > length(array_to_string(ws, ''))
      OR (len([x for x in ws if ends_with(x, '!!')]) > 0
          AND 5 * len([x for x in ws if ends_with(x, '!!')]) >= n)
      OR (n < {MIN_OPEN_WORDS} AND NOT regexp_matches(ws[len(ws)], {q(closing)}))
      OR {boiler}) AS bad
    FROM (SELECT *, len(ws) AS n FROM (SELECT *, regexp_extract_all(line, {word}) AS ws FROM l0))"""


#: DuckDB SQL of the verdict over a table with (distinct) doc_id, text.
RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {src}),
l0 AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
l AS (""" + _rule_sql().replace("{", "{{").replace("}", "}}") + r"""),
lines AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
        coalesce(sum(n) FILTER (WHERE bad), 0) AS n_lost_words,
        string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad) AS cleaned FROM l GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
        (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, n_lost_words, cleaned
      FROM d JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(n_lost_words AS BIGINT) AS n_lost_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {max_lost} * n_words AS kept{extra}
FROM b
"""
