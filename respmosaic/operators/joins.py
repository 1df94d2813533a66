"""Dimension lookups, key checks and overrides. All joins are equi-joins.

No side is forced to broadcast: AQE does so when the measured size allows, and otherwise
shuffles with skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.operators.integrity import require_empty


def attach_item_attrs(df: DataFrame, panel: DataFrame, *attrs: str) -> DataFrame:
    return df.join(panel.select("item", *attrs), "item")


def log10_size(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.log10(F.coalesce(col.cast("double"), F.lit(0.0)) + 1.0)


def attach_entity_attrs(df: DataFrame, dim: DataFrame, labels: Sequence[str], sizes: Sequence[str] = (), default: str = "unknown") -> DataFrame:
    """Lookup of text labels (``unknown`` when absent) and log10(size + 1) columns."""
    chosen = dim.select("entity", *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in labels], *[log10_size(c).alias(f"log10_{c}") for c in sizes])
    joined = df.join(chosen, "entity", "left")
    return joined.fillna(default, list(labels)).fillna(0.0, [f"log10_{c}" for c in sizes])


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they are missing from."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(True))
    kb = b.select(key).distinct().withColumn("_b", F.lit(True))
    one_sided = ka.join(kb, key, "full").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return one_sided.select(key, F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))


def check_same_keys(a: DataFrame, b: DataFrame, key: str, show: int = 5) -> None:
    diff = key_differences(a, b, key)
    require_empty(diff.filter("missing_in = 'left'"), "keys missing in left table", show)
    require_empty(diff.filter("missing_in = 'right'"), "keys missing in right table", show)


def anti_members(df: DataFrame, gone: DataFrame, key: str = "entity") -> DataFrame:
    """Rows whose key is not listed ("the others")."""
    return df.join(gone.select(key), key, "left_anti")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Keyed override wins over the inferred value; invalid override rows are ignored."""
    usable = overrides.filter(valid) if valid is not None else overrides
    chosen = usable.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = df.join(chosen, key, "left")
    for c in columns:
        joined = joined.withColumn(f"{c}_source", F.when(F.col(f"_o_{c}").isNotNull(), "override").otherwise("inferred"))
        joined = joined.withColumn(c, F.coalesce(f"_o_{c}", c))
    return joined.drop(*[f"_o_{c}" for c in columns])


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")
