"""Column helpers for text and small derived values (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlens import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-case alphanumeric runs `[a-z0-9]+` of the whole text, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(K.TOKEN_PATTERN), 0)


def token_set(text) -> Column:
    return F.array_distinct(tokens(text))


def value_tier(amount) -> Column:
    a = _c(amount)
    return (
        F.when(a < K.TIER_LOW_BELOW, F.lit("low"))
        .when(a < K.TIER_MID_BELOW, F.lit("mid"))
        .otherwise(F.lit("high"))
    )


def price_symbol(price_range) -> Column:
    return F.repeat(F.lit("$"), F.coalesce(_c(price_range), F.lit(K.DEFAULT_PRICE_RANGE)).cast("int"))


def quarter_label(ts) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_c(ts)).cast("string"))


def year_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy")


def mcc_pad(code) -> Column:
    """Zero-pad to width 4 without truncating longer codes."""
    c = _c(code).cast("string")
    return F.when(F.length(c) < 4, F.lpad(c, 4, "0")).otherwise(c)


def split_categories(text, sep: str = ",") -> Column:
    """Category text -> trimmed array; empty pieces dropped."""
    parts = F.transform(F.split(_c(text), F.lit(sep), -1), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != F.lit(""))


def literal_map(d: dict) -> Column:
    """A literal MAP column from a small fixed dict (kept JVM-side)."""
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def contains_any(text, words) -> Column:
    t = _c(text)
    out = None
    for w in words:
        cond = F.contains(t, F.lit(w))
        out = cond if out is None else (out | cond)
    return out
