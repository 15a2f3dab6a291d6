"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; its queries and oracle SQL are
registered in :mod:`merchlens.llm.queries`.
"""
