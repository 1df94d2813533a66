"""Materialising a table that several branches of one plan read.

Floating-point sums depend on the order partial results arrive in, so two evaluations of the
same plan can differ in the last bit. Ranking joins values back to themselves and adds offsets
counted in a second branch, which is only safe when every branch reads the same stored rows.
A reliable checkpoint gives that, survives lost executors, and spares recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from respmosaic.session import cut_lineage


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    return cut_lineage(df)


def stable(df: DataFrame, *columns: str) -> DataFrame:
    """Materialise when a named column is a float; integers, dates and text are exact."""
    floats = (T.DoubleType, T.FloatType)
    return materialise(df) if any(isinstance(df.schema[c].dataType, floats) for c in columns) else df
