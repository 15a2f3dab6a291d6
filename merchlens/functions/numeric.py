"""Deterministic rounding and number-to-text (ledger L1, L9, L30).

Doubles are rounded through DECIMAL(28,8) first so that tiny summation-order
differences between executors (or engines) cannot move a half-way value: the
8-dp decimal absorbs them, and the decimal round is HALF_UP on exact digits.
All helpers are plain Column expressions (JVM-side, codegen-friendly).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dround(x, n: int) -> Column:
    """round(x, n) as DOUBLE via DECIMAL(28,8)."""
    return F.round(_c(x).cast("decimal(28,8)"), n).cast("double")


def dec_text(x, n: int) -> Column:
    """Fixed-point text with exactly n decimals (`{x:.nf}`)."""
    return F.round(_c(x).cast("decimal(28,8)"), n).cast(f"decimal(28,{n})").cast("string")


def pct_text(x, n: int = 1) -> Column:
    """Percent text of a ratio already multiplied by 100: '12.3%'."""
    return F.concat(dec_text(x, n), F.lit("%"))


def money_sum(x) -> Column:
    """Exact money total of 2-dp amounts (sum of DECIMAL(18,2))."""
    return F.sum(_c(x).cast("decimal(18,2)"))


def num_text(x, none: str = "None") -> Column:
    """Python-like str() of a number, with a placeholder for null."""
    return F.coalesce(_c(x).cast("string"), F.lit(none))


def safe_div(a, b) -> Column:
    return _c(a) / F.nullif(_c(b), F.lit(0))
