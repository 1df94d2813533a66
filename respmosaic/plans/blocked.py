"""Large dense matrices as tables of packed blocks: products, and triangular factors by a tree.

A matrix is a table ``(rb, cb, m)`` of dense blocks of at most ``BLOCK`` x ``BLOCK`` doubles; a tall thin one is a table ``(b, m)`` of row blocks
with all of its few columns. Members of an axis have ordinals from 0, ``BLOCK`` to a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.plans.ranking import ordered_rank
from respmosaic.plans.stable import materialise

BLOCK = 1024
#: Groups of the last level but one of a tree of triangular factors.
FANOUT = 32


def axis(members: DataFrame, name: str) -> DataFrame:
    """``(name, ord)`` with ordinals from 0 in the order of the distinct names."""
    return ordered_rank(members.select(name).distinct(), [], [(name, "asc")], "_r").select(name, (F.col("_r") - 1).alias("ord"))


def pack(cells: DataFrame, rows: DataFrame, row: str, columns: DataFrame, column: str, n_rows: int, n_columns: int, block: int = BLOCK) -> DataFrame:
    """Stored blocks of ``cells(row, column, value)``; absent and null cells are 0."""
    placed = cells.join(rows.select(row, F.col("ord").alias("_i")), row).join(columns.select(column, F.col("ord").alias("_j")), column)
    keyed = placed.select((F.col("_i") / block).cast("long").alias("rb"), (F.col("_j") / block).cast("long").alias("cb"), F.col("_i") % block, F.col("_j") % block, F.col("value").cast("double")).toDF("rb", "cb", "i", "j", "v")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((min(block, n_rows - key[0] * block), min(block, n_columns - key[1] * block)))
        m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].fillna(0.0).to_numpy()
        return pd.DataFrame({"rb": [key[0]], "cb": [key[1]], "m": [m.tobytes()]})

    return materialise(keyed.groupBy("rb", "cb").applyInPandas(fill, "rb long, cb long, m binary"))


def thin(spark: SparkSession, n: int, width: int, make, block: int = BLOCK) -> DataFrame:
    """Row blocks ``make(b, rows) -> array (rows, width)``."""

    def run(frames):
        for pdf in frames:
            for b in pdf["id"]:
                yield pd.DataFrame({"b": [b], "m": [np.ascontiguousarray(make(b, min(block, n - b * block)), float).tobytes()]})

    return spark.range(-(-n // block)).mapInPandas(run, "b long, m binary")


def summed(parts: DataFrame) -> DataFrame:
    """Packed vectors ``(b, m)`` added up by ``b``, one at a time in memory."""

    def add(frames):
        at, total = None, None
        for pdf in frames:
            for b, m in zip(pdf["b"], pdf["m"]):
                m = np.frombuffer(m)
                if b != at and at is not None:
                    yield pd.DataFrame({"b": [at], "m": [total.tobytes()]})
                at, total = b, m if b != at else total + m
        if at is not None:
            yield pd.DataFrame({"b": [at], "m": [total.tobytes()]})

    return parts.repartition("b").sortWithinPartitions("b").mapInPandas(add, "b long, m binary")


def product(blocks: DataFrame, right: DataFrame, width: int, transposed: bool = False) -> DataFrame:
    """Row blocks of ``A @ right`` (or ``A.T @ right``), stored. Thin partial products are shuffled, and added up as they come."""
    own, other = ("cb", "rb") if transposed else ("rb", "cb")
    met = blocks.join(right.select(F.col("b").alias(other), F.col("m").alias("q")), other).select(F.col(own).alias("b"), "m", "q")

    def multiply(frames):
        for pdf in frames:
            for b, m, q in zip(pdf["b"], pdf["m"], pdf["q"]):
                q, m = np.frombuffer(q).reshape(-1, width), np.frombuffer(m)
                part = m.reshape(len(q), -1).T @ q if transposed else m.reshape(-1, len(q)) @ q
                yield pd.DataFrame({"b": [b], "m": [np.ascontiguousarray(part).tobytes()]})

    return materialise(summed(met.mapInPandas(multiply, "b long, m binary")))


def triangle(tall: DataFrame, width: int) -> np.ndarray:
    """R of the QR factorisation of row blocks: factors of blocks are merged inside tasks, then in ``FANOUT`` groups, last on the driver."""

    def merge(frames):
        r = np.zeros((0, width))
        for pdf in frames:
            for m in pdf["m"]:
                r = np.linalg.qr(np.vstack([r, np.frombuffer(m).reshape(-1, width)]), mode="r")
        if len(r):
            yield pd.DataFrame({"m": [np.ascontiguousarray(r).tobytes()]})

    parts = tall.select("m").mapInPandas(merge, "m binary").withColumn("_g", F.spark_partition_id() % FANOUT)
    merged = parts.repartition(FANOUT, "_g").select("m").mapInPandas(merge, "m binary")
    found = [np.frombuffer(r["m"]).reshape(-1, width) for r in merged.collect()]  # at most FANOUT blocks of width x width
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.zeros((0, width))


def times(tall: DataFrame, width: int, small: np.ndarray) -> DataFrame:
    """Row blocks times a small matrix, as a narrow step."""
    shared = tall.sparkSession.sparkContext.broadcast(small)

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"b": pdf["b"], "m": [(np.frombuffer(m).reshape(-1, width) @ shared.value).tobytes() for m in pdf["m"]]})

    return tall.mapInPandas(run, "b long, m binary")


def projection(tall: DataFrame, width: int, seed: int = 7) -> np.ndarray:
    """Products of the columns with one fixed random vector: ``width`` numbers."""

    def run(frames):
        total = np.zeros(width)
        for pdf in frames:
            for b, m in zip(pdf["b"], pdf["m"]):
                m = np.frombuffer(m).reshape(-1, width)
                total += np.random.default_rng([seed, b]).standard_normal(len(m)) @ m
        yield pd.DataFrame({"j": range(width), "v": total})

    out = np.zeros(width)
    for r in tall.mapInPandas(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = r["v"]
    return out


def cells(tall: DataFrame, width: int, members: DataFrame, name: str, column: str, value: str, block: int = BLOCK) -> DataFrame:
    """``(name, column, value)`` rows of row blocks, with the members' names back."""

    def run(frames):
        for pdf in frames:
            for b, m in zip(pdf["b"], pdf["m"]):
                m = np.frombuffer(m).reshape(-1, width)
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"ord": (b * block + i).ravel(), column: j.ravel().astype("int32"), value: m.ravel()})

    return tall.mapInPandas(run, f"ord long, {column} int, {value} double").join(members, "ord").select(name, column, value)
