"""Exact linear-interpolated quantiles for value sets that fit no single buffer.

A mergeable sketch brackets each wanted rank, then one aggregation counts what lies below
the bracket and keeps only the distinct values inside it, about ``6 / accuracy`` of a group.
These are stored and added up by a window per group, or over ranges where a bracket holds
more than a window should.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respmosaic.plans.ranking import running_total
from respmosaic.plans.stable import materialise

ACCURACY = 50_000
# Groups up to this size are ordered whole; above it the margin spans several ranks.
WHOLE = 50_000
# Distinct values of a bracket that one window adds up; more go over ranges.
ONE_WINDOW = 1_000_000


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Rows ``(*by, q, n, quantile)``; nulls are ignored, groups without values vanish."""
    by = list(by)
    present = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 3.0 / accuracy
    probes = [min(max(q + s, 0.0), 1.0) for q in qs for s in (-margin, margin)]
    # Widened a little: a recomputed float may differ from the sketched one in its last bits.
    slack = lambda c: F.abs(c) * 1e-9 + 1e-300
    low = lambda i: F.col("_p")[2 * i] - slack(F.col("_p")[2 * i])
    high = lambda i: F.col("_p")[2 * i + 1] + slack(F.col("_p")[2 * i + 1])
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("q"),
                (F.lit(float("-inf")) if q - margin <= 0 else F.when(F.col("_size") > WHOLE, low(i)).otherwise(F.lit(float("-inf")))).alias("lo"),
                (F.lit(float("inf")) if q + margin >= 1 else F.when(F.col("_size") > WHOLE, high(i)).otherwise(F.lit(float("inf")))).alias("hi"),
            )
            for i, q in enumerate(qs)
        ]
    )
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in probes]), accuracy)
    if by:
        sketched = present.groupBy(*by).agg(sketch.alias("_p"), F.count(F.lit(1)).alias("_size")).select(*by, brackets.alias("_k"))
        joined = present.join(sketched, by)
    else:
        sketched = present.agg(sketch.alias("_p"), F.count(F.lit(1)).alias("_size")).select(brackets.alias("_k"))
        joined = present.withColumn("_k", sketched.scalar())
    marked = joined.select(*by, "_v", F.explode("_k").alias("_k")).select(
        *by,
        F.col("_k.q").alias("q"),
        F.when(F.col("_v") < F.col("_k.lo"), F.lit("below"))
        .when(F.col("_v") > F.col("_k.hi"), F.lit("above"))
        .otherwise(F.lit("in"))
        .alias("_side"),
        "_v",
    )
    counted = marked.groupBy(*by, "q", "_side", F.when(F.col("_side") == "in", F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialise(counted)
    key = [*by, "q"]
    most = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("c")).first()["c"] or 0
    if most <= ONE_WINDOW:
        whole = Window.partitionBy(*key)
        running = whole.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = counted.withColumn("n", F.sum("_n").over(whole)).filter(F.col("_side") != "above").withColumn("_upto", F.sum("_n").over(running))
    else:
        sizes = counted.groupBy(*key).agg(F.sum("_n").alias("n"))
        placed = running_total(counted.withColumn("_o", F.when(F.col("_side") == "below", float("-inf")).when(F.col("_side") == "above", float("inf")).otherwise(F.col("_v"))), key, "_o", "_n", "_upto")
        placed = placed.withColumn("_upto", F.col("_upto") + F.col("_n")).drop("_o").join(sizes, key).filter(F.col("_side") != "above")
    placed = placed.withColumn("_at", F.col("q") * (F.col("n") - 1))
    at_low = F.min(F.when((F.col("_side") == "in") & (F.col("_upto") > F.floor("_at")), F.col("_v")))
    at_high = F.min(F.when((F.col("_side") == "in") & (F.col("_upto") > F.ceil("_at")), F.col("_v")))
    below = F.coalesce(F.sum(F.when(F.col("_side") == "below", F.col("_n"))), F.lit(0))
    picked = placed.groupBy(*by, "q", "n", "_at").agg(at_low.alias("_lo"), at_high.alias("_hi"), below.alias("_below"))
    part = F.col("_at") - F.floor("_at")
    # Ranks that fall below the bracket would pick its first value, ranks beyond it none.
    missed = F.col("_lo").isNull() | F.col("_hi").isNull() | (F.col("_below") > F.floor("_at"))
    told = F.raise_error(F.concat(F.lit("quantile bracket missed its rank at q = "), F.col("q").cast("string"), F.lit("; raise the accuracy")))
    picked = picked.withColumn("_lo", F.when(missed, told.cast("double")).otherwise(F.col("_lo")))
    return picked.select(*by, "q", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Wide form of :func:`exact_quantiles`: one column per name."""
    long = exact_quantiles(df, value, sorted(set(named.values())), by, accuracy)
    picks = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(name) for name, q in named.items()]
    return long.groupBy(*by).agg(*picks)
