"""Filters inferred from question text (F6) and question bounds (F8).

Keyword rules are substring tests applied in a fixed order (ledger L15), so
"la " matches inside "cola " and "fast food" can never win over "food".  An
explicit, non-empty filter value always wins.  All of it is one ``CASE`` chain
per filter — a narrow projection over the questions frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens import constants as K
from merchlens.functions.text import contains_any


def _rule_chain(q: Column, explicit: Column, rules) -> Column:
    out = F.when(explicit.isNotNull(), explicit)
    for words, value in rules:
        out = out.when(contains_any(q, words), F.lit(value))
    return out


def infer_filters(questions: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds ``f_city``, ``f_mcc_code``, ``f_value_tier`` and the F8 ``is_valid`` flag."""
    q = F.lower(F.col(query_col))

    def explicit(c: str) -> Column:
        return F.nullif(F.col(c), F.lit("")) if c in questions.columns else F.lit(None).cast("string")

    top_k = F.col("top_k") if "top_k" in questions.columns else F.lit(K.DEFAULT_TOP_K)
    return questions.withColumns({
        "f_city": _rule_chain(q, explicit("city_filter"), K.CITY_RULES),
        "f_mcc_code": _rule_chain(q, explicit("mcc_filter"), K.MCC_RULES),
        "f_value_tier": _rule_chain(q, explicit("value_tier"), K.TIER_RULES),
        "is_valid": F.length(F.col(query_col)).between(K.QUESTION_MIN_CHARS, K.QUESTION_MAX_CHARS)
                    & top_k.between(K.TOP_K_MIN, K.TOP_K_MAX),
    })
