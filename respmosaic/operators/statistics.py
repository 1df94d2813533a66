"""Aggregates over V, V_d, D, metric and prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respmosaic.operators.matrix import CLIP_QUANTILE, complete_grid, fit_matrix
from respmosaic.operators.pairs import compare_geometry, compare_sides
from respmosaic.plans.correlation import correlation, safe_pearson, spearman
from respmosaic.plans.quantiles import quantile_columns
from respmosaic.plans.ranking import ordered_rank, with_average_rank
from respmosaic.plans.stable import materialise


def stratum_value_stats(v: DataFrame, panel: DataFrame) -> DataFrame:
    """Per stratum over all cells: items, non-null cells, mean, population std."""
    per_item = v.groupBy("item").agg(
        F.count("value").alias("n"), F.sum("value").alias("_s"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")
    )
    joined = per_item.join(panel.select("item", "stratum"), "item")
    sums = joined.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("n").alias("n_cells"),
        (F.sum("_s") / F.sum("n")).alias("mean"),
    )
    spread = joined.join(sums.select("stratum", F.col("mean").alias("_g")), "stratum")
    gap = F.col("_m") - F.col("_g")
    std = spread.groupBy("stratum").agg(F.sqrt(F.sum(F.col("n") * (F.col("_v") + gap * gap)) / F.sum("n")).alias("std"))
    return sums.join(std, "stratum")


def item_variance(v: DataFrame, ddof: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Per item variance and mean over entities; null below two values."""
    spread = F.var_samp("value") if ddof == 1 else F.var_pop("value")
    out = v.groupBy(*by, "item").agg(F.count("value").alias("n"), spread.alias("variance"), F.avg("value").alias("mean"))
    return out.withColumn("variance", F.when(F.col("n") >= 2, F.col("variance")))


def item_variance_by_stratum(variances: DataFrame, panel: DataFrame) -> DataFrame:
    return (
        variances.join(panel.select("item", "stratum"), "item")
        .groupBy("stratum")
        .agg(
            F.count("variance").alias("n"),
            F.avg("variance").alias("mean_variance"),
            F.max("variance").alias("max_variance"),
            F.avg("mean").alias("mean_of_means"),
        )
        .orderBy(F.desc("mean_variance"), "stratum")
    )


def branch_scale(v: DataFrame, branch: str = "branch") -> DataFrame:
    """Raw value scale per branch, and the ratio of each median to the first branch's."""
    q = quantile_columns(v, "value", {"median": 0.5, "q25": 0.25, "q75": 0.75}, [branch])
    span = v.groupBy(branch).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    table = q.join(span, branch)
    first = table.agg(F.min_by("median", branch).alias("m"))
    table = table.withColumn("ratio", F.col("median") / first.scalar())
    return table.withColumn("passed", F.col("ratio").between(0.5, 2.0))


def row_stats(vd: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean and population std per entity, summarised per group (entity, grp)."""
    per_entity = vd.groupBy("entity").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return per_entity.join(groups, "entity").groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_m").alias("mean_of_means"),
        F.stddev_pop("_m").alias("std_of_means"),
        F.avg("_s").alias("mean_of_stds"),
        F.stddev_pop("_s").alias("std_of_stds"),
    )


def auc_distribution(auc: DataFrame) -> DataFrame:
    """Median/mean/std/min/max per task, overall and per branch, plus the mean series.

    ``auc``: entity, task, branch, auc (nulls ignored). One pass over grouping sets.
    """
    means = auc.groupBy("entity", "branch").agg(F.avg("auc").alias("auc")).withColumn("task", F.lit("__mean__"))
    series = auc.select("entity", "branch", "task", "auc").unionByName(means)
    marked = series.withColumn("branch", F.explode(F.array(F.lit("all"), F.col("branch").cast("string"))))
    moments = marked.groupBy("task", "branch").agg(
        F.count("auc").alias("n"), F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"), F.min("auc").alias("min"), F.max("auc").alias("max")
    )
    medians = quantile_columns(marked, "auc", {"median": 0.5}, ["task", "branch"])
    return moments.join(medians, ["task", "branch"]).orderBy("branch", "median", "task")


def metric_summary(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample std of each metric per key set."""
    aggs = [f(c).alias(f"{c}_{s}") for c in values for s, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return metrics.groupBy(*keys).agg(*aggs)


def baseline_rows(metrics: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and mean of each metric over the "other" entities."""
    by = list(by)
    metrics = materialise(metrics)
    out = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
    for c in columns:
        median = quantile_columns(metrics, c, {f"{c}_median": 0.5}, by)
        out = out.join(median, by) if by else out.withColumn(f"{c}_median", median.scalar())
    return out


def item_means(v: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return v.groupBy(*by, "item").agg(F.avg("value").alias("mean"))


def cross_branch_spearman(v: DataFrame, branch: str, first, second) -> DataFrame:
    """Spearman of raw item means between two branches, with the items compared."""
    means = v.groupBy("item").agg(
        F.avg(F.when(F.col(branch) == F.lit(first), F.col("value"))).alias("a"),
        F.avg(F.when(F.col(branch) == F.lit(second), F.col("value"))).alias("b"),
    )
    return spearman(means, "a", "b")


def hardest_overlap(va: DataFrame, vb: DataFrame, ks: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Overlap of the k items with the lowest means in each table, for each k.

    The largest k is a bounded top-k (TakeOrdered); smaller k are prefixes of it by rank.
    """
    from pyspark.sql import Window

    top = max(ks)
    order = Window.partitionBy(F.lit(0)).orderBy("mean", "item")

    def lowest(v: DataFrame, name: str) -> DataFrame:
        short = item_means(v).filter(F.col("mean").isNotNull()).orderBy("mean", "item").limit(top)
        return short.select("item", F.row_number().over(order).alias(name))

    both = lowest(va, "ra").join(lowest(vb, "rb"), "item", "full").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    ina, inb = F.coalesce(F.col("ra") <= F.col("k"), F.lit(False)), F.coalesce(F.col("rb") <= F.col("k"), F.lit(False))
    out = both.groupBy("k").agg(F.count_if(ina & inb).alias("n_both"), F.count_if(ina | inb).alias("n_any"))
    return out.withColumn("jaccard", F.col("n_both") / F.col("n_any"))


def rank_items(variances: DataFrame) -> DataFrame:
    """Items numbered by falling variance (nulls last, ties by id)."""
    return ordered_rank(variances, [], [("variance", "desc"), ("item", "asc")], "rank")


def pair_scores(a: DataFrame, b: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Cells both tables have, as ``value_a, value_b``, without nulls."""
    if subset is not None:
        a = a.join(subset.select("item"), "item", "left_semi")
    left = a.select("entity", "item", F.col("value").alias("value_a"))
    right = b.select("entity", "item", F.col("value").alias("value_b"))
    return left.join(right, ["entity", "item"]).dropna(subset=["value_a", "value_b"])


def paired_correlation(pairs: DataFrame, min_pairs: int = 100) -> DataFrame:
    """Per entity Pearson and Spearman; entities with fewer pairs are dropped."""
    base = pairs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), safe_pearson("value_a", "value_b").alias("pearson"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b")
    )
    rho = spearman(pairs, "value_a", "value_b", ["entity"]).select("entity", "spearman")
    return base.filter(F.col("n") >= min_pairs).join(rho, "entity", "left")


def correlation_summary(per_entity: DataFrame, column: str = "pearson") -> DataFrame:
    per_entity = materialise(per_entity)
    moments = per_entity.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    quantiles = quantile_columns(per_entity, column, {"q05": 0.05, "median": 0.5, "q95": 0.95})
    packed = quantiles.select(F.struct("q05", "median", "q95"))
    return moments.withColumn("_q", packed.scalar()).select("*", "_q.q05", "_q.median", "_q.q95").drop("_q")


def mantel_two_tables(a: DataFrame, b: DataFrame, clip_q: float | None = CLIP_QUANTILE) -> DataFrame:
    """Agreement of the distances two tables give over their common items and entities."""
    shared = a.join(b.select("entity", "item"), ["entity", "item"], "left_semi").select("entity", "item", F.col("value"), F.lit("a").alias("side"))
    other = b.join(a.select("entity", "item"), ["entity", "item"], "left_semi").select("entity", "item", F.col("value"), F.lit("b").alias("side"))
    values = fit_matrix(shared.unionByName(other), clip_q, ["side"]).values
    return compare_sides(values, "side", "a", "b")


def geometry_preserved(v: DataFrame, branch: str = "branch", clip_q: float = CLIP_QUANTILE, threshold: float = 0.90) -> DataFrame:
    """Distances from a per-branch fit against those of the joint fit, inside each branch."""
    columns = [branch, "entity", "item", "value"]
    own = fit_matrix(v, clip_q, [branch]).values.select(*columns, F.lit("own").alias("fit"))
    joint = fit_matrix(v, clip_q).values.select(*columns, F.lit("joint").alias("fit"))
    out = compare_geometry(own.unionByName(joint), "fit", "own", "joint", [branch])
    return out.withColumn("passed", (F.col("pearson") > threshold) & (F.col("spearman") > threshold))


MEAN_TASK = "__mean_auc__"


def with_mean_task(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the per-entity mean over tasks as one more task."""
    mean = pred.groupBy(*keys, "entity").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    columns = [*keys, "entity", "task", "y_true", "y_pred"]
    return pred.select(*columns).unionByName(mean.withColumn("task", F.lit(MEAN_TASK)).select(*columns))


def regression_metrics(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, Pearson, Spearman, MAE and R^2 = 1 - SSE/SST per key set and task."""
    keys = list(keys)
    full = with_mean_task(pred, keys)
    gap = F.col("y_true") - F.col("y_pred")
    sst = F.var_pop("y_true") * F.count(F.lit(1))
    base = full.groupBy(*keys, "task").agg(
        F.count(F.lit(1)).alias("n"),
        safe_pearson("y_pred", "y_true").alias("pearson"),
        F.avg(F.abs(gap)).alias("mae"),
        F.when(sst > 0, 1 - F.sum(gap * gap) / sst).alias("r2"),
    )
    rho = spearman(full, "y_pred", "y_true", [*keys, "task"]).select(*keys, "task", "spearman")
    return base.join(rho, [*keys, "task"], "left")


def average_predictions(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean true and predicted value per (entity, task) over seeds."""
    return pred.groupBy(*keys, "entity", "task").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))


def format_mean_std(mean, std, digits: int = 3):
    """``m ± s`` cells, null when either part is; a mean that rounds to zero has no sign."""
    mean = F.round(mean, digits) + F.lit(0.0)
    return F.when(mean.isNotNull() & std.isNotNull(), F.format_string(f"%.{digits}f ± %.{digits}f", mean, std))


def metric_table(summary: DataFrame, keys: Sequence[str], tasks: Sequence[str], metrics: Sequence[str] = ("pearson", "spearman")) -> DataFrame:
    """One row per (keys, metric) and a ``m ± s`` column per task in the given order."""
    from respmosaic.operators.integrity import require_empty

    listed = summary.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    require_empty(listed.join(summary, "task", "left_anti"), "tasks without a summary")
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), format_mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias("cell")) for m in metrics])
    )
    long = summary.select(*keys, "task", cells.alias("_c")).select(*keys, "task", "_c.metric", "_c.cell")
    return long.groupBy(*keys, "metric").pivot("task", list(tasks)).agg(F.first("cell"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC per group: (sum of positive ranks - n+(n+ + 1)/2) / (n+ n-).

    Ranks live on distinct scores with their positive counts, so rows never meet a global
    window and tied scores cannot skew it. Null when one class is absent.
    """
    by = list(by)
    usable = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = usable.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("_p"))
    ranked = with_average_rank(counted, score, by)
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("_p").alias("n_pos"), F.sum(F.col("avg_rank") * F.col("_p")).alias("_r")
    )
    n_pos, n_neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    auc = F.when((n_pos > 0) & (n_neg > 0), (F.col("_r") - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))
    return sums.select(*by, "n", "n_pos", auc.alias("auc"))


def separation(auc: DataFrame) -> DataFrame:
    return auc.withColumn("separation", F.greatest(F.col("auc"), 1 - F.col("auc")))


def ovr_weighted_auc(scores: DataFrame) -> DataFrame:
    """One-vs-rest AUC weighted by class size. ``scores``: row, label, class, score."""
    marked = scores.withColumn("_y", (F.col("label") == F.col("class")).cast("int"))
    per_class = roc_auc(marked, "score", "_y", ["class"])
    return per_class.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("auc"))


def valid_auc():
    auc = F.col("auc").try_cast("double")
    return F.when(auc.isNotNull() & ~F.isnan(auc) & auc.between(0.0, 1.0), auc)


def auc_matrix(results: DataFrame) -> DataFrame:
    """Long ``entity, task, auc`` over every axis value any result names; null elsewhere.

    """
    grid = complete_grid(results.select("entity"), results.select(F.col("task").alias("item"))).withColumnRenamed("item", "task")
    valid = results.withColumn("auc", valid_auc()).groupBy("entity", "task").agg(F.max("auc").alias("auc"))
    return grid.join(valid, ["entity", "task"], "left")


def auc_join(entities: DataFrame, auc: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """One row per entity with a column per task and their mean; keys must match."""
    from respmosaic.operators.joins import check_same_keys

    check_same_keys(entities.select("entity"), auc.select("entity"), "entity")
    picks = [F.max(F.when(F.col("task") == t, F.col("auc"))).alias(t) for t in tasks]
    wide = auc.groupBy("entity").agg(*picks, F.avg(F.when(F.col("task").isin(list(tasks)), F.col("auc"))).alias("mean_auc"))
    return entities.join(wide, "entity")


def gc_axis(loadings: DataFrame, attrs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Correlation of each component's loadings with an item attribute, joined by item.

    ``loadings``: pc, item, loading; ``attrs``: item, attr. ``first_free`` is the first
    component not dominated by the attribute (-1 if all are).
    """
    r = (
        loadings.join(attrs, "item")
        .groupBy("pc")
        .agg(F.coalesce(correlation("loading", "attr"), F.lit(0.0)).alias("r"))
        .withColumn("dominated", F.abs("r") > threshold)
    )
    first = r.agg(F.coalesce(F.min(F.when(~F.col("dominated"), F.col("pc"))), F.lit(-1)).alias("f"))
    return r.withColumn("first_free", first.scalar())
