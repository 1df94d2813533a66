"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def bounded(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows, or about ``bound`` of them by a hash of ``key`` when there are more."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
