"""Response matrix V, its clipped and double-centred form V_d, and projection of new rows.

Canonical columns: ``entity, item, value``. ``by`` names extra key columns (branch, half,
seed, ...) so independent fits are one plan rather than a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respmosaic.functions import vocab
from respmosaic.operators.integrity import coverage_gate, require_empty
from respmosaic.plans.quantiles import exact_quantiles
from respmosaic.plans.ranking import ordered_rank
from respmosaic.plans.stable import materialise

CLIP_QUANTILE = 0.02


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL: the single null model used after ingest."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ingest(df: DataFrame, entity: str, item: str, value: str, *extra: str) -> DataFrame:
    return df.select(F.col(entity).alias("entity"), F.col(item).alias("item"), finite(value).alias("value"), *extra)


def complete_grid(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Every (entity, item) key, from two one-column dimension tables.

    Items get an ordinal and each entity row is expanded to the ordinals, so the grid is an
    equi-join: AQE broadcasts a small item axis and shuffles a large one.
    """
    numbered = ordered_rank(items.select("item").distinct(), [], [("item", "asc")], "_ord")
    total = items.select("item").agg(F.count_distinct("item").alias("n"))
    expanded = (
        entities.select("entity")
        .distinct()
        .withColumn("_n", total.scalar())
        .filter("_n > 0")
        .select("entity", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_ord"))
    )
    return expanded.join(numbered, "_ord").select("entity", "item")


def align_to_items(scores: DataFrame, panel: DataFrame) -> DataFrame:
    """Panel-ordered left join of one entity's scores; unscored items carry NULL."""
    return panel.join(scores, "item", "left")


def response_matrix(scores: DataFrame, entities: DataFrame, items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(V, status)``: the full grid with NULL for missing cells, and per-entity coverage.

    A score table with duplicate items is reported as corrupt and contributes no cells.
    """
    status = coverage_gate(scores, items, entities)
    if strict:
        require_empty(status.filter(~F.col("ok")), "entities without complete coverage")
    usable = status.filter(~F.col("reason").startswith("duplicate")).select("entity")
    cells = scores.join(usable, "entity", "left_semi").select("entity", "item", finite("value").alias("value"))
    return complete_grid(entities, items).join(cells, ["entity", "item"], "left"), status


def clip_threshold(v: DataFrame, q: float = CLIP_QUANTILE, by: Sequence[str] = ()) -> DataFrame:
    """q-quantile over all non-null cells (of each ``by`` group): ``(*by, threshold)``."""
    return exact_quantiles(v, "value", [q], by).select(*by, F.col("quantile").alias("threshold"))


def floor_at(value: Column, threshold: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, threshold))


def clip_lower(v: DataFrame, q: float = CLIP_QUANTILE, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Floor finite cells at the matrix-wide quantile; null stays null."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile must lie in [0, 1], got {q}")
    thresholds = clip_threshold(v, q, by)
    with_threshold = v.join(thresholds, list(by), "left") if by else v.withColumn("threshold", thresholds.scalar())
    clipped = with_threshold.withColumn("value", floor_at(F.col("value"), F.col("threshold"))).drop("threshold")
    return clipped, thresholds


@dataclass
class Centred:
    values: DataFrame
    row_means: DataFrame
    col_means: DataFrame
    grand_mean: DataFrame


def double_center(v: DataFrame, by: Sequence[str] = ()) -> Centred:
    """Subtract entity means, then item means of the row-centred matrix. Null-aware.

    Means come from partially aggregated ``groupBy`` plus joins: no window has to hold a
    whole entity or item, and small mean tables are broadcast by AQE on their real size.
    """
    by = list(by)
    row_means = v.groupBy(*by, "entity").agg(F.avg("value").alias("row_mean"))
    row_centred = v.join(row_means, [*by, "entity"]).withColumn("_r", F.col("value") - F.col("row_mean")).drop("row_mean")
    col_means = row_centred.groupBy(*by, "item").agg(F.avg("_r").alias("col_mean"))
    values = (
        row_centred.join(col_means, [*by, "item"])
        .withColumn("value", F.col("_r") - F.col("col_mean"))
        .drop("_r", "col_mean")
    )
    grand = v.groupBy(*by).agg(F.avg("value").alias("grand_mean"))
    return Centred(values, row_means, col_means, grand)


@dataclass
class Fit:
    """V_d with the constants needed to place new entities in the same space."""

    values: DataFrame
    thresholds: DataFrame
    row_means: DataFrame
    col_means: DataFrame
    grand_mean: DataFrame


def fit_matrix(v: DataFrame, clip_q: float | None = CLIP_QUANTILE, by: Sequence[str] = ()) -> Fit:
    """Clip and double-centre; distances follow with ``pairwise_sq_distance(fit.values)``."""
    if clip_q is None:
        clipped, thresholds = v, v.groupBy(*by).agg(F.lit(float("-inf")).alias("threshold"))
    else:
        clipped, thresholds = clip_lower(v, clip_q, by)
    centred = double_center(clipped, by)
    return Fit(centred.values, thresholds, centred.row_means, centred.col_means, centred.grand_mean)


def save_fit(fit: Fit, path: str) -> None:
    for name in ("thresholds", "row_means", "col_means", "grand_mean"):
        getattr(fit, name).write.mode("overwrite").parquet(f"{path}/{name}")
    fit.values.write.mode("overwrite").parquet(f"{path}/values")


def load_fit(spark, path: str) -> Fit:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Fit(read("values"), read("thresholds"), read("row_means"), read("col_means"), read("grand_mean"))


def project(new_scores: DataFrame, thresholds: DataFrame, col_means: DataFrame) -> DataFrame:
    """New entities into a fitted space: fitted floor, own mean, fitted item means."""
    clipped = new_scores.withColumn("_t", thresholds.select("threshold").scalar())
    clipped = clipped.withColumn("value", floor_at(F.col("value"), F.col("_t"))).drop("_t")
    own = clipped.groupBy("entity").agg(F.avg("value").alias("_own"))
    return (
        clipped.join(own, "entity")
        .join(col_means.select("item", "col_mean"), "item")
        .withColumn("value", F.col("value") - F.col("_own") - F.col("col_mean"))
        .drop("_own", "col_mean")
    )


def branch_matrices(v: DataFrame, branch: str = "branch", clip_q: float = CLIP_QUANTILE) -> Fit:
    """An independent fit per branch in one plan."""
    return fit_matrix(v, clip_q, [branch])


def combined_matrix(scores: DataFrame, dim: DataFrame, items: DataFrame, synonyms: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both branches in one complete matrix, with folded family names.

    ``dim`` has ``entity, branch, family``. Raises when a listed entity lacks cells or has a
    null one: the joint fit is only defined on a complete matrix.
    """
    members = dim.filter(F.col("branch").isNotNull())
    family = F.col("family")
    for old, new in (synonyms or {}).items():
        family = F.when(F.col("family") == old, F.lit(new)).otherwise(family)
    folded = members.withColumn("family", family)
    gate = coverage_gate(scores, items, members.select("entity"))
    require_empty(gate.filter(~F.col("ok")), "joint matrix needs complete entities")
    return scores.join(members.select("entity"), "entity", "left_semi"), folded


def describe_matrix(v: DataFrame) -> DataFrame:
    return v.agg(
        F.count_distinct("entity").alias("n_entities"),
        F.count_distinct("item").alias("n_items"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )


def impute_item_mean(v: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Null cells take their item's mean; items without any value stay null."""
    means = v.groupBy(*by, "item").agg(F.avg("value").alias("_m"))
    return v.join(means, [*by, "item"]).withColumn("value", F.coalesce("value", "_m")).drop("_m")


def cosine_to_anchor(v: DataFrame, anchor) -> DataFrame:
    """Cosine of each entity to the anchor over items both have; null on a zero norm."""
    ref = v.filter(F.col("entity") == F.lit(anchor)).select("item", F.col("value").alias("_a"))
    sums = (
        v.join(ref, "item")
        .filter(F.col("value").isNotNull() & F.col("_a").isNotNull())
        .groupBy("entity")
        .agg(
            F.sum(F.col("value") * F.col("_a")).alias("_ab"),
            F.sum(F.col("value") * F.col("value")).alias("_bb"),
            F.sum(F.col("_a") * F.col("_a")).alias("_aa"),
        )
    )
    norm = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    return sums.select("entity", F.when(norm > 0, F.col("_ab") / norm).alias("cosine"))


def distance_to_anchor(vd: DataFrame, anchor) -> DataFrame:
    """Squared distance of each entity to one anchor, rescaled for missing items."""
    ref = vd.filter(F.col("entity") == F.lit(anchor)).select("item", F.col("value").alias("_a"))
    total = vd.agg(F.count_distinct("item").alias("n"))
    gap = F.col("value") - F.col("_a")
    sums = vd.join(ref, "item").groupBy("entity").agg(F.sum(gap * gap).alias("_ss"), F.count(gap).alias("_n"))
    sums = sums.withColumn("_total", total.scalar())
    return sums.select("entity", F.when(F.col("_n") > 0, F.col("_ss") * F.col("_total") / F.col("_n")).alias("d"))


def anchor_metrics(v: DataFrame, vd: DataFrame, anchor, partners: DataFrame) -> DataFrame:
    """Distance on V_d and cosine on V and V_d from the anchor to listed partners."""
    raw = cosine_to_anchor(v, anchor).withColumnRenamed("cosine", "cos_v")
    centred = cosine_to_anchor(vd, anchor).withColumnRenamed("cosine", "cos_vd")
    listed = partners.select(F.col("partner").alias("entity"), "label", "position")
    return (
        listed.join(distance_to_anchor(vd, anchor), "entity", "left")
        .join(raw, "entity", "left")
        .join(centred, "entity", "left")
        .orderBy("label", "position")
    )


def anchor_difference(v: DataFrame, pairs: DataFrame) -> DataFrame:
    """Signed per-item difference partner - anchor for each listed (anchor, partner)."""
    a = v.select(F.col("entity").alias("anchor"), "item", F.col("value").alias("_a"))
    p = v.select(F.col("entity").alias("partner"), "item", F.col("value").alias("_p"))
    return pairs.join(p, "partner").join(a, ["anchor", "item"]).withColumn("diff", F.col("_p") - F.col("_a")).drop("_a", "_p")


def winsor_limits(vd: DataFrame, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    from respmosaic.plans.quantiles import quantile_columns

    limits = quantile_columns(vd, "value", {"lo": lo, "hi": hi})
    return limits.withColumn("limit", F.greatest(F.abs("lo"), F.abs("hi")))


def block_order(dim: DataFrame, branch: str, group: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """Entities laid out branch by branch, larger groups first, with block offsets."""
    sizes = dim.groupBy(branch, group).agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(branch), F.col("size").desc(), F.col(group))
    blocks = sizes.withColumn("block_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("block_start", F.col("block_end") - F.col("size"))
    inside = ordered_rank(dim, [branch, group], [(entity, "asc")], "_in")
    placed = inside.join(blocks, [branch, group]).withColumn("position", F.col("block_start") + F.col("_in") - 1)
    return placed.drop("_in", "size", "block_start", "block_end"), blocks


def item_order(items: DataFrame, element: str = "element") -> tuple[DataFrame, DataFrame]:
    """Items laid out by category and element in the display order (other elements after them, by name), with the offsets of the categories.

    ``items``: item and its element. Returns ``(item, element, category, position)`` and ``(category, block_start, block_end)``.
    """
    listed = [(e, i + 1) for i, e in enumerate(vocab.ELEMENT_ORDER)]
    named = [c for c, n in vocab.CATEGORY_SIZES for _ in range(n)]
    category, place = F.lit("Other"), F.lit(len(listed) + 1)
    for (e, i), c in zip(listed, named):
        category = F.when(F.col(element) == e, c).otherwise(category)
        place = F.when(F.col(element) == e, i).otherwise(place)
    placed = items.select("item", F.col(element).alias("element")).withColumns({"category": category, "_p": place})
    ranked = materialise(ordered_rank(placed, [], [("_p", "asc"), ("element", "asc"), ("item", "asc")], "_r").withColumn("position", F.col("_r") - 1).drop("_r", "_p"))
    blocks = ranked.groupBy("category").agg(F.min("position").alias("block_start"), (F.max("position") + 1).alias("block_end"))
    return ranked, blocks


def matrix_to_wide(v: DataFrame, items: Sequence) -> DataFrame:
    """One row per entity with a column per listed item (a bounded axis)."""
    picks = [F.max(F.when(F.col("item") == F.lit(i), F.col("value"))).alias(f"item_{i}") for i in items]
    return v.groupBy("entity").agg(*picks)


def wide_to_long(wide: DataFrame, items: Sequence) -> DataFrame:
    names = [f"item_{i}" for i in items]
    long = wide.unpivot("entity", names, "_name", "value")
    return long.select("entity", F.regexp_replace("_name", "^item_", "").cast("long").alias("item"), "value")


def to_row_form(v: DataFrame) -> DataFrame:
    """(entity, items, values) with arrays aligned by item, for row-at-a-time consumers."""
    packed = F.sort_array(F.collect_list(F.struct("item", "value")))
    return v.groupBy("entity").agg(packed.alias("_c")).select(
        "entity", F.col("_c.item").alias("items"), F.col("_c.value").alias("values")
    )
