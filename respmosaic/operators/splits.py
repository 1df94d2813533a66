"""Seeded halves, folds and subsets. Draws are md5 ranks, so any engine can repeat them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respmosaic.operators.matrix import CLIP_QUANTILE, fit_matrix
from respmosaic.operators.pairs import compare_sides
from respmosaic.plans.ranking import hash_rank
from respmosaic.plans.stable import materialise


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One copy of a dimension row per seed, as a key column."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def stratified_halves(panel: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """``seed, item, stratum, half``: random 50/50 inside each stratum, odd item dropped."""
    drawn = hash_rank(with_seeds(panel.select("item", "stratum"), seeds), ["seed", "stratum"], "half", ["item"], "_r", hashed=["seed", "item"])
    sizes = panel.groupBy("stratum").agg(F.floor(F.count(F.lit(1)) / 2).alias("_h"))
    half = F.when(F.col("_r") <= F.col("_h"), "a").when(F.col("_r") <= 2 * F.col("_h"), "b")
    return drawn.join(sizes, "stratum").withColumn("half", half).filter(F.col("half").isNotNull()).select("seed", "item", "stratum", "half")


def _place(lead: dict):
    """Each stratum of a seed to the half that is not ahead, from the lead that the first half has."""

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        ahead, half = lead[key[0]], []
        for n in pdf["n"].tolist():
            half.append("a" if ahead <= 0 else "b")
            ahead += n if ahead <= 0 else -n
        return pdf[["seed", "stratum"]].assign(half=half, ahead=ahead)

    return place


#: Strata that one step of the halves places.
CHUNK = 1_000_000


def disjoint_halves(panel: DataFrame, seeds: Sequence[int], chunk: int | None = None) -> DataFrame:
    """``seed, item, stratum, half``: whole strata, shuffled, each to the smaller half.

    Strata are numbered by hash and placed ``CHUNK`` at a time, since each placing depends on those before it; only the difference of the halves goes on.
    """
    limit = chunk or CHUNK
    sizes = panel.groupBy(F.col("stratum").cast("string").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(with_seeds(sizes, seeds), ["seed"], "strata", ["stratum"], "_r", hashed=["seed", "stratum"])
    ranked = materialise(ranked.withColumn("_c", ((F.col("_r") - 1) / limit).cast("long")))
    last = ranked.agg(F.max("_c").alias("c")).first()["c"] or 0
    lead, placed = dict.fromkeys(seeds, 0), None
    for c in range(last + 1):
        part = materialise(ranked.filter(F.col("_c") == c).groupBy("seed").applyInPandas(_place(dict(lead)), f"seed {ranked.schema['seed'].dataType.simpleString()}, stratum string, half string, ahead long"))
        lead = lead | {r["seed"]: r["ahead"] for r in part.groupBy("seed").agg(F.first("ahead").alias("ahead")).collect()}
        placed = part if placed is None else placed.unionAll(part)
    rows = panel.select("item", F.col("stratum").cast("string").alias("stratum"))
    return rows.join(placed.drop("ahead"), "stratum").select("seed", "item", "stratum", "half")


def split_half(v: DataFrame, halves: DataFrame, clip_q: float = CLIP_QUANTILE, pipeline: bool = True) -> DataFrame:
    """Agreement of half-panel distances per seed; all seeds and halves are one plan."""
    # The halves are one short row per item and seed; V itself is joined, not copied.
    halves = materialise(halves.select("seed", "half", "item"))
    keyed = v.join(halves, "item")
    key = ["seed", "half"]
    values = fit_matrix(keyed, clip_q, key).values if pipeline else keyed
    return compare_sides(values, "half", "a", "b", ["seed"])


def split_half_summary(per_seed: DataFrame) -> DataFrame:
    return per_seed.agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.avg("pearson").alias("mean"),
        F.stddev_pop("pearson").alias("std"),
        F.min("pearson").alias("min"),
        F.max("pearson").alias("max"),
    )


def proportional_subset(panel: DataFrame, n: int, seed: int) -> DataFrame:
    """Per stratum round-half-even(n * share) items without replacement."""
    ranked = hash_rank(panel.select("item", "stratum"), ["stratum"], seed, ["item"], "_r")
    targets = subset_targets(panel, n)
    return ranked.join(targets, "stratum").filter(F.col("_r") <= F.col("target")).select("item", "stratum")


def subset_targets(panel: DataFrame, n: int) -> DataFrame:
    counts = panel.groupBy("stratum").agg(F.count(F.lit(1)).alias("full_count"))
    total = panel.agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(n) * F.col("full_count") / F.col("_n")
    return counts.withColumn("_n", total.scalar()).withColumn("target", F.bround(share, 0).cast("long")).drop("_n")


def subset_manifest(panel: DataFrame, n: int) -> DataFrame:
    t = subset_targets(panel, n)
    sums = t.agg(F.struct(F.sum("full_count").alias("f"), F.sum("target").alias("t")))
    return t.withColumn("_s", sums.scalar()).select(
        "stratum",
        "full_count",
        F.col("target").alias("subset_count"),
        F.round(F.col("full_count") / F.col("_s.f"), 4).alias("fraction_full"),
        F.round(F.col("target") / F.col("_s.t"), 4).alias("fraction_subset"),
    )


def kfold(ids: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Shuffled folds 0..n-1 whose sizes differ by at most one (larger folds first)."""
    ranked = hash_rank(ids.select(key).distinct(), [], seed, [key], "_r")
    total = ids.agg(F.count_distinct(key).alias("n"))
    t = ranked.withColumn("_n", total.scalar()).withColumn("_i", F.col("_r") - 1)
    base, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    head = (base + 1) * extra
    fold = F.when(F.col("_i") < head, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - head) / base))
    return t.withColumn("fold", fold.cast("int")).select(key, "fold")


def _level(loads: np.ndarray, n: int, k: np.ndarray) -> np.ndarray:
    """Number of the run's first ``k`` groups of size ``n`` that go to each bin, one row per ``k``.

    The j-th group of a bin would find the load ``L + (j - 1) * n``; the greedy order takes these in ascending order, ties to the lower
    bin. So the first ``k`` are all below some load, found by halving, and the lowest bins at it.
    """
    low, high = np.full(len(k), loads.min()), loads.max() + n * k + 1
    below = lambda t: np.maximum(0, -(-(t[:, None] - loads) // n))  # noqa: E731  # elements under the load t
    while (low < high).any():
        mid = low + (high - low + 1) // 2
        fits = below(mid).sum(1) <= k
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    count = below(low)
    at = (low[:, None] >= loads) & ((low[:, None] - loads) % n == 0)  # bins that have an element at the load itself
    left = (k - count.sum(1))[:, None]
    return count + (at & (np.cumsum(at, axis=1) <= left))


def size_runs(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, list[int]]]:
    """Loads of the bins before each run of equal size, from ``(size, groups)`` with the largest size first."""
    loads, out = np.zeros(folds, np.int64), []
    for n, m in sizes:
        out.append((n, loads.tolist()))
        loads = loads + n * _level(loads, n, np.array([m], np.int64))[0]
    return out


def group_kfold(ids: DataFrame, key: str, group: str, n: int, seed: int) -> DataFrame:
    """No group in two folds: groups by size desc (ties seeded), each to the lightest fold.

    Groups of one size form a run. Only the table of sizes is folded, whose length is at most the root of twice the rows; a
    group's fold follows from its place in its run and the loads before the run.
    """
    from respmosaic.operators.integrity import require_empty

    rows = ids.select(key, F.col(group).cast("string").alias(group))
    sizes = materialise(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    require_empty(sizes.agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") < n), f"need at least {n} groups")
    runs = [(r["n"], r["m"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()]
    table = ids.sparkSession.createDataFrame(size_runs(runs, n), "n long, loads array<long>")
    ranked = hash_rank(sizes, ["n"], seed, [group], "_r").join(table, "n")

    @F.pandas_udf("int")
    def fold(size: pd.Series, rank: pd.Series, loads: pd.Series) -> pd.Series:
        out = pd.Series(0, index=size.index)
        for s, part in rank.groupby(size):
            before = np.array(loads[part.index[0]], np.int64)
            k = part.to_numpy()
            out[part.index] = (_level(before, int(s), k) - _level(before, int(s), k - 1)).argmax(1)
        return out

    placed = ranked.select(group, fold("n", "_r", "loads").alias("fold"))
    return rows.join(placed, group).select(key, group, "fold")


def stratified_kfold(ids: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """Folds balanced inside every class."""
    ranked = hash_rank(ids.select(key, label), [label], seed, [key], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % n).cast("int")).drop("_r")


def leave_one_out(ids: DataFrame, key: str) -> DataFrame:
    """One fold per row: the row's own key."""
    return ids.select(key, F.col(key).alias("fold"))
