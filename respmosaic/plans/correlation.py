"""Correlations as grouped aggregates, with the guards the statistics need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.plans.ranking import value_ranks
from respmosaic.plans.stable import stable


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson r over rows where both are present; null when either side is constant.

    Spark's own ``corr`` raises on a constant side under ANSI arithmetic.
    """
    cx, cy = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = cx.isNotNull() & cy.isNotNull()
    gx, gy = F.when(both, cx), F.when(both, cy)
    sx, sy = F.stddev_pop(gx), F.stddev_pop(gy)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(gx, gy) / (sx * sy))


def slope(y: str, x: str) -> Column:
    """Least-squares slope over complete pairs; null for a constant x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    gx, gy = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.var_pop(gx) > 0, F.covar_pop(gx, gy) / F.var_pop(gx))


def intercept(y: str, x: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.avg(F.when(both, F.col(y))) - slope(y, x) * F.avg(F.when(both, F.col(x)))


def safe_pearson(x: str, y: str, min_n: int = 3) -> Column:
    """Null when fewer than ``min_n`` pairs or either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(F.count_if(both) >= min_n, correlation(x, y))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "spearman", min_n: int = 3) -> DataFrame:
    """Tie-averaged rank correlation per group, as ``(*by, n, out)``.

    Equal pairs are counted first and ranks are joined to the counted pairs, so a value
    that fills a third of the table is one row by the time it meets a join.
    """
    by = list(by)
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    pairs = stable(pairs, "_x", "_y")

    def ranks(side: str) -> DataFrame:
        return value_ranks(pairs, side, by, "_w").select(*by, side, F.col("avg_rank").alias(side + "r"))

    ranked = pairs.join(ranks("_x"), [*by, "_x"]).join(ranks("_y"), [*by, "_y"])
    w, a, b = F.col("_w"), F.col("_xr"), F.col("_yr")
    sums = ranked.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(w * a * b).alias("_ab"),
        F.sum(w * a * a).alias("_aa"),
        F.sum(w * b * b).alias("_bb"),
    )
    mid = F.col("n") * ((F.col("n") + 1) / 2) * ((F.col("n") + 1) / 2)
    va, vb = F.col("_aa") - mid, F.col("_bb") - mid
    rho = F.when((F.col("n") >= min_n) & (va > 0) & (vb > 0), (F.col("_ab") - mid) / F.sqrt(va * vb))
    return sums.select(*by, "n", rho.alias(out))
