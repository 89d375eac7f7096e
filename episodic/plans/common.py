"""Shared output shaping for registered queries: long format, rounded doubles.

Oracle comparisons hash values, so every double leaving a query is rounded (6
digits) and ``+ 0.0`` turns -0.0 into 0.0, identically in the Spark code and the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def r6(c, digits: int = DIGITS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def explode_vec(df: DataFrame, keep: list[str], arr: str, value: str = "value", dim: str = "dim") -> DataFrame:
    """Long form of an array column: one row per (keys..., dim)."""
    out = df.select(*keep, F.posexplode(arr).alias(dim, "_v"))
    return out.select(*keep, F.col(dim).cast("bigint").alias(dim), r6("_v").alias(value))


def explode_chunk(df: DataFrame, keep: list[str], arr: str, value: str = "value") -> DataFrame:
    """Long form of an array<array<double>> column: (keys..., slot, dim, value)."""
    out = df.select(*keep, F.posexplode(arr).alias("slot", "_a"))
    out = out.select(*keep, F.col("slot").cast("bigint").alias("slot"), F.posexplode("_a").alias("dim", "_v"))
    return out.select(*keep, "slot", F.col("dim").cast("bigint").alias("dim"), r6("_v").alias(value))
