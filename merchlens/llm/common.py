"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read only through Spark's reader (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name derived from ``name`` that ``df`` does not use yet (case-insensitive)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def text_or_empty(c: Column | str) -> Column:
    """Null texts count as empty in every operator of this package."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def give_back() -> None:
    """Hand a Python worker's free memory back to the system: workers outlive their tasks, and the
    next stage of the executor needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
