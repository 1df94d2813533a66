"""Blocked products of two feature tables: the cell (left, right) is a dot product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot_products(left: DataFrame, right: DataFrame, left_block: int = 4096, right_block: int = 1024) -> DataFrame:
    """``(l, r, value)`` for every l of ``left(l, vec)`` and r of ``right(r, vec)``.

    Both sides are cut into hash blocks and only blocks meet: a task multiplies two matrices
    of bounded size. Vectors share one fixed length.
    """
    spans = {}
    for name, df, size in (("l", left, left_block), ("r", right, right_block)):
        spans[name] = df.agg((F.floor((F.count(F.lit(1)) - 1) / size) + 1).cast("int").alias("n"))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    def keyed(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.select(own, "vec").withColumn("_own", spans[own].scalar()).withColumn("_other", spans[other].scalar())
        out = out.withColumn("b" + own, block(own, "_own")).withColumn("b" + other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        return out.select("bl", "br", own, F.col("vec").alias("vec_" + own))

    schema = T.StructType([left.schema["l"], right.schema["r"], T.StructField("value", T.DoubleType())])

    def multiply(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"l": a["l"][:0], "r": b["r"][:0], "value": np.array([], float)})
        out = np.stack(a["vec_l"].to_list()).astype(float) @ np.stack(b["vec_r"].to_list()).astype(float).T
        return pd.DataFrame({"l": np.repeat(a["l"].to_numpy(), len(b)), "r": np.tile(b["r"].to_numpy(), len(a)), "value": out.ravel()})

    pair = keyed(left, "l", "r").groupBy("bl", "br").cogroup(keyed(right, "r", "l").groupBy("bl", "br"))
    return pair.applyInPandas(multiply, schema)
