"""Truncated SVD, PCA coordinates and Procrustes residuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.operators.matrix import double_center
from respmosaic.plans import blocked
from respmosaic.plans.stable import materialise

#: Columns of the sampled subspace beyond k, rounds at most, change of a singular value that ends them, and the share of the first below which one is 0.
SPARE, ROUNDS, CHANGE, RANK = 32, 60, 1e-11, 1e-9
#: A shorter axis of so many members is taken whole: one round, exact.
WHOLE = 1024


@dataclass
class Factors:
    """``scores(entity, pc, score)``, ``loadings(item, pc, loading)``, ``spectrum(pc, sigma, explained)``."""

    scores: DataFrame
    loadings: DataFrame
    spectrum: DataFrame


def _orthonormal(tall: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Row blocks with an orthonormal basis of the column space and their width, by the triangular factor taken twice."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(blocked.triangle(tall, width))
        kept = s > s[0] * 1e-13 if len(s) and s[0] > 0 else s > 0
        tall = materialise(blocked.times(tall, width, vt[: len(s)][kept].T / s[kept]))
        width = int(kept.sum())
        if not width:
            break
    return tall, width


def truncated_svd(x: DataFrame, k: int, block: int = blocked.BLOCK) -> Factors:
    """Leading k singular triples of a complete matrix X(entity, item, value), by distributed subspace iteration.

    A sampled subspace of ``k + SPARE`` columns is multiplied by X and its transpose in blocks and made orthonormal by a tree of triangular
    factors, until the singular values stand still; a subspace as wide as the shorter axis (always, up to ``WHOLE`` members) is exact at once. The bases stay tables; the
    driver sees matrices of that many columns and rows only. Explained shares are taken over the whole sum of squares. Triples whose singular value is
    0 (below ``RANK`` of the first) are left out. Signs follow a fixed projection of the loadings.
    """
    spark = x.sparkSession
    x = materialise(x.select("entity", "item", "value"))
    axes = {name: materialise(blocked.axis(x, name)) for name in ("entity", "item")}
    size = {name: a.count() for name, a in axes.items()}
    short, long = ("entity", "item") if size["entity"] <= size["item"] else ("item", "entity")
    if not 1 <= k <= size[short]:
        raise ValueError(f"k must lie in 1..{size[short]}")
    matrix = blocked.pack(x, axes[long], long, axes[short], short, size[long], size[short], block)
    width = size[short] if size[short] <= WHOLE else min(size[short], max(2 * k, k + SPARE))
    whole = width == size[short]

    def start(b: int, rows: int) -> np.ndarray:
        return np.eye(width)[b * block : b * block + rows] if whole else np.random.default_rng([17, b]).standard_normal((rows, width))

    right, last = blocked.thin(spark, size[short], width, start, block), None
    for _ in range(1 if whole else ROUNDS):
        basis, rank = _orthonormal(blocked.product(matrix, right, width), width)
        if not rank:
            break
        image = blocked.product(matrix, basis, rank, transposed=True)  # X.T @ basis: X is about basis @ image.T
        _, sigma, vt = np.linalg.svd(blocked.triangle(image, rank))
        if last is not None and len(last) == len(sigma) and np.all(np.abs(sigma[:k] - last[:k]) <= CHANGE * sigma[0]):
            break
        last = sigma
        if not whole:
            right, width = _orthonormal(image, rank)
    if not rank:
        empty = [spark.createDataFrame([], T.StructType([x.schema[n], T.StructField("pc", T.IntegerType()), T.StructField(v, T.DoubleType())])) for n, v in (("entity", "score"), ("item", "loading"))]
        return Factors(*empty, spark.createDataFrame([], "pc int, sigma double, explained double"))
    total = x.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    k = min(k, int((sigma > RANK * sigma[0]).sum()))
    sigma, turn = sigma[:k], vt[:k].T
    spectrum = spark.createDataFrame([(i, float(s), float(s * s / total)) for i, s in enumerate(sigma)], "pc int, sigma double, explained double")
    loaded, by = (image, turn / sigma) if long == "entity" else (basis, turn)
    sign = np.where(blocked.projection(loaded, rank) @ by < 0, -1.0, 1.0)
    loadings = blocked.times(loaded, rank, by * sign)
    scores = blocked.times(basis, rank, turn * sigma * sign) if long == "entity" else blocked.times(image, rank, turn * sign)
    return Factors(blocked.cells(scores, k, axes["entity"], "entity", "pc", "score", block), blocked.cells(loadings, k, axes["item"], "item", "pc", "loading", block), spectrum)


def pca_entities(v: DataFrame, k: int) -> Factors:
    """SVD of the double-centred matrix."""
    return truncated_svd(double_center(v).values.select("entity", "item", "value"), k)


def item_centred(v: DataFrame, zscore: bool = False) -> DataFrame:
    moments = v.groupBy("item").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0) if zscore else F.lit(1.0)
    return v.join(moments, "item").select("entity", "item", ((F.col("value") - F.col("_m")) / scale).alias("value"))


def pca_scores(v: DataFrame, k: int, zscore: bool = False) -> Factors:
    """Item-centred (optionally z-scored) PCA coordinates with variance ratios."""
    return truncated_svd(item_centred(v, zscore), k)


def pc_group_auc(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """How well each component separates a 0/1 label: ``pc, auc, separation``."""
    from respmosaic.operators.statistics import roc_auc, separation

    return separation(roc_auc(scores.join(labels.select("entity", "label"), "entity"), "score", "label", ["pc"]))


def procrustes_residual(a: DataFrame, b: DataFrame) -> float:
    """|A R - B| / |B| after column centring with the best rotation R; 0 when |B| = 0.

    ``a`` and ``b``: key, dim, x. Only the k x k product of the two tables reaches the
    driver: residual^2 = |A|^2 + |B|^2 - 2 * (sum of its singular values).
    """
    def centred(df: DataFrame, name: str) -> DataFrame:
        m = df.groupBy("dim").agg(F.avg("x").alias("_m"))
        return df.join(m, "dim").select("key", F.col("dim").alias(f"d{name}"), (F.col("x") - F.col("_m")).alias(name))

    shapes = [tuple(d.agg(F.count_distinct("key"), F.count_distinct("dim"), F.count("x")).first()) for d in (a, b)]
    if shapes[0] != shapes[1]:
        raise ValueError(f"shapes differ: {shapes[0]} and {shapes[1]}")
    ca, cb = centred(a, "a"), centred(b, "b")
    na = ca.agg(F.sum(F.col("a") * F.col("a"))).first()[0] or 0.0
    nb = cb.agg(F.sum(F.col("b") * F.col("b"))).first()[0] or 0.0
    if nb == 0.0:
        return 0.0
    cross = ca.join(cb, "key").groupBy("da", "db").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    dims = {d: i for i, d in enumerate(sorted({r["da"] for r in cross} | {r["db"] for r in cross}))}
    m = np.zeros((len(dims), len(dims)))
    for r in cross:
        m[dims[r["da"]], dims[r["db"]]] = r["s"]
    return float(np.sqrt(max(na + nb - 2.0 * np.linalg.svd(m, compute_uv=False).sum(), 0.0)) / np.sqrt(nb))
