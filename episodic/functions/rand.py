"""Deterministic pseudo-randomness.

The reference draws unseeded random numbers per op.  We replace every draw with
a hash of (seed, keys), so a result is reproducible, survives task retries, and
can be replayed by any SQL engine that has md5:

    u01(seed, k1, k2, ...) = int(first 8 hex digits of md5("seed|k1|k2|...")) / 2^32

Keys must be integers or strings (their text form is identical across engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _as_col(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    if isinstance(k, str):
        return F.col(k).cast("string")
    return F.lit(str(k))


def u01(seed: int | str, *keys) -> Column:
    """Uniform draw in [0, 1) from md5 of ``seed|key1|key2...``; keys are column names, Columns or literals."""
    parts = [F.lit(str(seed))] + [_as_col(k) for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def u01_sql(seed: int | str, *keys: str) -> str:
    """DuckDB text of the same draw (used by the oracle SQL)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0)"
