"""Group share of total variance (F_ST / eta squared) and its permutation test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respmosaic.operators.matrix import impute_item_mean
from respmosaic.plans import blocked
from respmosaic.plans.ranking import hash_rank, ordered_rank
from respmosaic.plans.stable import materialise

#: Numbers of the group sums of one block: permutations x groups x items; and sums that a task holds before it hands them on.
GROUP_SUMS, HELD = 1 << 20, 8


def between_group_share(v: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``share`` = sum n_g |C_g - G|^2 / sum |x - G|^2; 0 when nothing varies.

    ``labels``: entity, label. Two partial aggregations: by (label, item) and by item.
    """
    cells = v.select("entity", "item", "value").filter(F.col("value").isNotNull()).join(labels.select("entity", "label"), "entity")
    grand = cells.groupBy("item").agg(F.avg("value").alias("_g"))
    centroids = cells.groupBy("label", "item").agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_c"))
    gap = F.col("_c") - F.col("_g")
    between = centroids.join(grand, "item").agg(F.sum(F.col("_n") * gap * gap).alias("b"))
    off = F.col("value") - F.col("_g")
    total = cells.join(grand, "item").agg(F.sum(off * off).alias("t"))
    both = between.withColumn("t", total.scalar())
    return both.select(F.when(F.col("t") > 0, F.col("b") / F.col("t")).otherwise(0.0).alias("share"))


def multivariate_fst(v: DataFrame, labels: DataFrame) -> DataFrame:
    """The same ratio after item-mean imputation."""
    return between_group_share(impute_item_mean(v), labels)


def permuted_labels(labels: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """``perm, entity, label``: perm 0 is the observed labelling, others shuffle it.

    The r-th entity in the hashed order of a permutation takes the label of the r-th entity
    by id, so every permutation is exact and needs no driver-side shuffle.
    """
    base = ordered_rank(labels.select("entity", "label"), [], [("entity", "asc")], "_r")
    draws = labels.select("entity", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
    ranked = hash_rank(draws, ["perm"], seed, ["entity"], "_r", hashed=["perm", "entity"])
    shuffled = ranked.join(base.select("_r", "label"), "_r").select("perm", "entity", "label")
    return labels.select(F.lit(0).alias("perm"), "entity", "label").unionByName(shuffled)


def permutation_shares(v: DataFrame, labels: DataFrame, n_perm: int, seed: int, block: int = blocked.BLOCK) -> DataFrame:
    """``perm, share`` for the observed labels (perm 0) and each permutation.

    With items centred, the between-group sum of squares is sum_g |sum of g's rows|^2 / n_g. Group sums of many permutations at once are one
    product of a block of one-hot labels with a block of the matrix, so neither pairs nor copies of labels per item block are
    needed: work follows cells x permutations, and each task holds one block of each and the group sums of a few items.
    """
    members = materialise(labels.select("entity", "label"))
    cells = impute_item_mean(v.select("entity", "item", "value").join(members.select("entity"), "entity", "left_semi")).filter(F.col("value").isNotNull())
    means = cells.groupBy("item").agg(F.avg("value").alias("_g"))
    cells = materialise(cells.join(means, "item").select("entity", "item", (F.col("value") - F.col("_g")).alias("value")))
    sizes = materialise(members.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    coded = ordered_rank(sizes, [], [("label", "asc")], "code").select("label", (F.col("code") - 1).cast("int").alias("code"), "n")
    counts = np.array([r["n"] for r in coded.orderBy("code").collect()], float)  # one number per label
    groups = len(counts)
    items_at_once = max(1, min(block, GROUP_SUMS // max(1, groups)))
    perms_at_once = max(1, min(n_perm + 1, GROUP_SUMS // (max(1, groups) * items_at_once)))
    chunks = -(-(n_perm + 1) // perms_at_once)
    rows, columns = materialise(blocked.axis(members, "entity")), materialise(blocked.axis(cells, "item"))
    n_rows, n_columns = rows.count(), columns.count()
    matrix = _cut(blocked.pack(cells, rows, "entity", columns, "item", n_rows, n_columns, block), n_rows, block, items_at_once)
    drawn = permuted_labels(members, n_perm, seed).join(coded.select("label", "code"), "label").join(rows, "entity")
    keyed = drawn.select((F.col("ord") / block).cast("long").alias("rb"), (F.col("perm") / perms_at_once).cast("long").alias("chunk"), (F.col("ord") % block).alias("i"), (F.col("perm") % perms_at_once).alias("p"), "code")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.full((min(block, n_rows - key[0] * block), perms_at_once), -1, np.int32)
        codes[pdf["i"].to_numpy(), pdf["p"].to_numpy()] = pdf["code"].to_numpy()
        return pd.DataFrame({"rb": [key[0]], "chunk": [key[1]], "codes": [codes.tobytes()]})

    draws = keyed.groupBy("rb", "chunk").applyInPandas(fill, "rb long, chunk long, codes binary")

    def group_sums(frames):
        total: dict[int, np.ndarray] = {}
        for pdf in frames:
            for cb, chunk, m, c in zip(pdf["cb"], pdf["chunk"], pdf["m"], pdf["codes"]):
                codes = np.frombuffer(c, np.int32).reshape(-1, perms_at_once)
                hot = np.zeros((len(codes), perms_at_once * groups))
                i, p = np.nonzero(codes >= 0)
                hot[i, p * groups + codes[i, p]] = 1.0
                b = int(cb) * chunks + int(chunk)
                total[b] = total.get(b, 0.0) + hot.T @ np.frombuffer(m).reshape(len(codes), -1)
                if len(total) > HELD:
                    yield pd.DataFrame({"b": list(total), "m": [t.tobytes() for t in total.values()]})
                    total = {}
        yield pd.DataFrame({"b": list(total), "m": [t.tobytes() for t in total.values()]})

    def between(frames):
        for pdf in frames:
            for b, m in zip(pdf["b"], pdf["m"]):
                sums = np.frombuffer(m).reshape(perms_at_once, groups, -1)
                yield pd.DataFrame({"perm": (b % chunks) * perms_at_once + np.arange(perms_at_once, dtype="int32"), "between": ((sums**2).sum(2) / counts).sum(1)})

    summed = blocked.summed(matrix.join(draws, "rb").select("cb", "chunk", "m", "codes").mapInPandas(group_sums, "b long, m binary"))
    total = cells.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("t"))
    out = summed.mapInPandas(between, "perm int, between double").filter(F.col("perm") <= n_perm).groupBy("perm").agg(F.sum("between").alias("_b")).withColumn("_t", total.scalar())
    return out.select("perm", F.when(F.col("_t") > 0, F.col("_b") / F.col("_t")).otherwise(0.0).alias("share"))


def _cut(blocks: DataFrame, n_rows: int, block: int, width: int) -> DataFrame:
    """Blocks cut into strips of ``width`` columns, numbered on."""
    if width >= block:
        return blocks

    def run(frames):
        for pdf in frames:
            for rb, cb, m in zip(pdf["rb"], pdf["cb"], pdf["m"]):
                x = np.frombuffer(m).reshape(min(block, n_rows - rb * block), -1)
                per = -(-block // width)
                for k in range(0, x.shape[1], width):
                    yield pd.DataFrame({"rb": [rb], "cb": [cb * per + k // width], "m": [np.ascontiguousarray(x[:, k : k + width]).tobytes()]})

    return blocks.mapInPandas(run, "rb long, cb long, m binary")


def summarise_permutations(shares: DataFrame) -> DataFrame:
    """Observed share, one-sided p without the +1 correction, 2.5/97.5 % null limits."""
    observed = shares.filter("perm = 0").select("share")
    nulls = shares.filter("perm > 0").withColumn("observed", observed.scalar())
    return nulls.groupBy("observed").agg(
        F.avg((F.col("share") >= F.col("observed")).cast("double")).alias("p_value"),
        F.percentile("share", F.lit(0.025)).alias("null_lo"),
        F.percentile("share", F.lit(0.975)).alias("null_hi"),
        F.count(F.lit(1)).alias("n_perm"),
    )


def fst_permutation(v: DataFrame, labels: DataFrame, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Permutation test with group counts; ``degenerate`` when only one group exists."""
    out = summarise_permutations(permutation_shares(v, labels, n_perm, seed))
    groups = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = groups.agg(F.struct(F.count(F.lit(1)).alias("g"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    out = out.withColumn("_g", counts.scalar())
    return out.select("*", F.col("_g.g").alias("n_groups"), F.col("_g.lo").alias("smallest"), F.col("_g.hi").alias("largest"), (F.col("_g.g") < 2).alias("degenerate")).drop("_g")
