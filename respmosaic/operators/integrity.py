"""Coverage gates, resume checks and outcome buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.plans.correlation import correlation


def require_empty(bad: DataFrame, message: str, show: int = 5) -> None:
    """Raise with at most ``show`` offending rows when ``bad`` has any."""
    sample = bad.limit(show).collect()
    if sample:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in sample))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def coverage_counts(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Per entity: rows, distinct items, items off the panel, finite values.

    Duplicates are folded per (entity, item) first, so the second aggregation only counts
    and a large entity never builds one distinct set.
    """
    panel = items.select("item").distinct().withColumn("_on", F.lit(1))
    value = F.col("value").cast("double")
    per_item = scores.groupBy("entity", "item").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.when(is_finite(value), 1).otherwise(0)).alias("_fin")
    )
    marked = per_item.join(panel, "item", "left")
    return marked.groupBy("entity").agg(
        F.sum("_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.count_if(F.col("_on").isNull()).alias("n_extra"),
        F.count_if(F.col("_on").isNotNull()).alias("n_on_panel"),
        F.sum(F.when(F.col("_on").isNotNull(), F.col("_fin")).otherwise(0)).alias("n_finite"),
    )


def coverage_gate(scores: DataFrame, items: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``entity, ok, reason, counts``; the first failing test names the reason."""
    counts = coverage_counts(scores, items)
    listed = counts if entities is None else entities.select("entity").distinct().join(counts, "entity", "left")
    return judge_counts(listed, items)


def judge_counts(counts: DataFrame, items: DataFrame) -> DataFrame:
    """The gate on counts at hand; absent counts are 0."""
    total = items.agg(F.count_distinct("item").alias("n"))
    g = counts.withColumn("n_panel", total.scalar())
    for c in ("n_rows", "n_distinct", "n_extra", "n_on_panel", "n_finite"):
        g = g.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    g = g.withColumn("n_missing", F.col("n_panel") - F.col("n_on_panel"))
    reason = (
        F.when(F.col("n_rows") == 0, "missing")
        .when(F.col("n_distinct") < F.col("n_rows"), "duplicate items")
        .when(F.col("n_rows") != F.col("n_panel"), "row count")
        .when((F.col("n_extra") > 0) | (F.col("n_missing") > 0), "item set")
        .when(F.col("n_finite") < F.col("n_panel"), "non-finite values")
        .otherwise("")
    )
    return g.withColumn("reason", reason).withColumn("ok", F.col("reason") == "").drop("n_on_panel")


def keep_complete(v: DataFrame, items: DataFrame, strict: bool = False, allow_missing: bool = False) -> DataFrame:
    if strict and allow_missing:
        raise ValueError("strict and allow_missing exclude each other")
    gate = coverage_gate(v, items)
    if strict:
        require_empty(gate.filter(~F.col("ok")), "incomplete entities")
    return v.join(gate.filter("ok").select("entity"), "entity", "left_semi")


def null_share(v: DataFrame) -> DataFrame:
    return v.groupBy("entity").agg((F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("null_share"))


def fallback_fill(a: DataFrame, b: DataFrame, max_null: float = 0.05) -> DataFrame:
    """Entities above ``max_null`` nulls are skipped; the others take null cells from b."""
    kept = null_share(a).filter(F.col("null_share") <= max_null).select("entity")
    other = b.select("entity", "item", F.col("value").alias("_b"))
    return (
        a.join(kept, "entity", "left_semi")
        .join(other, ["entity", "item"], "left")
        .withColumn("value", F.coalesce("value", "_b"))
        .drop("_b")
    )


def finite_features(features: Column) -> Column:
    return F.forall(features, is_finite)


def finite_rows(df: DataFrame, features: str = "features") -> DataFrame:
    return df.filter(finite_features(F.col(features)))


def finite_report(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    dropped = F.count_if(~finite_features(F.col(features)))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_raw"), dropped.alias("n_dropped"))
    return out.withColumn("warn", F.col("n_dropped") / F.greatest(F.col("n_raw"), F.lit(1)) > 0.05)


def embedding_complete(df: DataFrame, n: int, features: str = "features", label: str = "label", min_finite: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Row count, label, one vector size and >= 95 % all-finite rows."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label).isNull()).alias("n_unlabelled"),
        F.min(F.size(features)).alias("dim_min"),
        F.max(F.size(features)).alias("dim_max"),
        F.count_if(finite_features(F.col(features))).alias("n_finite"),
    )
    ok = (
        (F.col("n_rows") == n)
        & (F.col("n_unlabelled") == 0)
        & (F.col("dim_min") == F.col("dim_max"))
        & (F.col("n_finite") >= min_finite * F.col("n_rows"))
    )
    return out.withColumn("ok", ok)


def constant_dim_check(df: DataFrame, features: str = "features") -> DataFrame:
    """One row: vector sizes of non-failed rows; not ok when sizes differ or all failed."""
    size = F.when(F.col(features).isNotNull(), F.size(features))
    out = df.agg(F.min(size).alias("dim_min"), F.max(size).alias("dim_max"), F.count(size).alias("n_ok"))
    return out.withColumn("ok", F.coalesce(F.col("dim_min") == F.col("dim_max"), F.lit(False)))


def class_gate(labelled: DataFrame, n_cv: int, by: Sequence[str] = ()) -> DataFrame:
    """Why a task cannot be fitted, or NULL. Input: ``*by, split ('train'/'test'), label``.

    Class counts are aggregated first; only the distinct labels meet per task.
    """
    counts = labelled.groupBy(*by, "split", "label").agg(F.count(F.lit(1)).alias("n"))
    train, test = F.col("split") == "train", F.col("split") == "test"
    per_label = counts.groupBy(*by, "label").agg(
        F.sum(F.when(train, F.col("n")).otherwise(0)).alias("tr"),
        F.sum(F.when(test, F.col("n")).otherwise(0)).alias("te"),
    )
    g = per_label.groupBy(*by).agg(
        F.sum("tr").alias("n_train"),
        F.sum("te").alias("n_test"),
        F.count_if(F.col("tr") > 0).alias("classes_train"),
        F.count_if(F.col("te") > 0).alias("classes_test"),
        F.count_if((F.col("tr") > 0) != (F.col("te") > 0)).alias("unshared"),
        F.min(F.when(F.col("tr") > 0, F.col("tr"))).alias("smallest"),
    )
    error = F.when((F.col("n_train") < 20) | (F.col("n_test") < 5), "tiny")
    reason = (
        error.when(F.col("classes_train") < 2, "train has one class")
        .when(F.col("classes_test") < 2, "test has one class")
        .when(F.col("unshared") > 0, "class sets differ")
        .when(F.col("smallest") < n_cv, "smallest class below folds")
    )
    kind = F.when(reason == "tiny", "tiny").when(reason.isNotNull(), "class_gate")
    return g.withColumn("reason", reason).withColumn("error_type", kind).drop("unshared")


def stale_results(results: DataFrame, inputs: DataFrame, keys: Sequence[str], params: str, retry: bool = True, refit_legacy: bool = False) -> DataFrame:
    """First reason to refit a stored result, or NULL when it can be kept.

    ``results``: keys, readable, auc (string), skip_reason, error_type, fit_params, mtime.
    ``inputs``: keys, mtime of each input file.
    """
    newest = inputs.groupBy(*keys).agg(F.max("mtime").alias("_newest"))
    r = results.join(newest, list(keys), "left")
    auc = F.col("auc").try_cast("double")
    has_auc = F.col("auc").isNotNull()
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(~has_auc & F.col("skip_reason").isNull(), "no outcome")
        .when(has_auc & auc.isNull(), "auc not numeric")
        .when(has_auc & (F.isnan(auc) | (auc < 0) | (auc > 1)), "auc out of range")
        .when(F.col("_newest") > F.col("mtime"), "input newer")
        .when(F.col("fit_params").isNotNull() & (F.col("fit_params") != params), "params changed")
    )
    if refit_legacy:
        reason = reason.when(F.col("fit_params").isNull(), "no fingerprint")
    if retry:
        reason = reason.when(F.lower("error_type").isin("load_fail", "fit_fail"), "retry error")
    return r.withColumn("refit_reason", reason).drop("_newest")


def pending_work(entities: DataFrame, tasks: Sequence[str], splits: Sequence[str], done: DataFrame) -> DataFrame:
    """(entity, task, split) still to do. Tasks and splits are spec lists, not data."""
    todo = entities.select("entity").distinct()
    todo = todo.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    todo = todo.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return todo.join(done, ["entity", "task", "split"], "left_anti")


def outcome_bucket() -> Column:
    """Bucket of one result row: ``corrupt, success, deliberate, pipeline_error, unknown``."""
    auc = F.col("auc").try_cast("double")
    kind = F.lower(F.coalesce(F.col("error_type"), F.lit("")))
    return (
        F.when(F.coalesce(~F.col("readable"), F.lit(True)), "corrupt")
        .when(F.col("auc").isNotNull() & (auc.isNull() | F.isnan(auc) | (auc < 0) | (auc > 1)), "corrupt")
        .when(F.col("auc").isNotNull(), "success")
        .when(kind.isin("tiny", "class_gate"), "deliberate")
        .when(kind.isin("load_fail", "fit_fail"), "pipeline_error")
        .otherwise("unknown")
    )


def outcome_buckets(results: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """Counts per bucket with the first ``examples`` keys (a top-k, kept by rank)."""
    from pyspark.sql import Window

    marked = results.withColumn("bucket", outcome_bucket())
    counts = marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = marked.withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).filter(F.col("_k") <= examples)
    shown = first.groupBy("bucket").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("examples"))
    return counts.join(shown, "bucket")


def rerun_stability(run1: DataFrame, run2: DataFrame, by: Sequence[str] = ("entity",), threshold: float = 0.95, min_finite: float = 0.0) -> DataFrame:
    """Agreement of two runs on (entity, item): r, max and mean gap, pass flag.

    Constant runs count as r = 1 when all cells agree (relative 1e-9, absolute 1e-12).
    """
    a = run1.select(*by, "item", F.col("value").alias("_a"))
    b = run2.select(*by, "item", F.col("value").alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    gap = F.when(both, F.abs(F.col("_a") - F.col("_b")))
    near = F.greatest(1e-9 * F.greatest(F.abs("_a"), F.abs("_b")), F.lit(1e-12))
    g = a.join(b, [*by, "item"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(gap).alias("n_finite"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        correlation("_a", "_b").alias("_r"),
        F.stddev_pop(F.when(both, F.col("_a"))).alias("_sa"),
        F.stddev_pop(F.when(both, F.col("_b"))).alias("_sb"),
        F.bool_and(F.when(both, gap <= near)).alias("_same"),
    )
    constant = (F.col("n_finite") < 2) | (F.col("_sa") == 0) | (F.col("_sb") == 0)
    r = F.when(constant, F.when(F.col("_same"), 1.0).otherwise(0.0)).otherwise(F.col("_r"))
    enough = F.col("n_finite") >= min_finite * F.col("n_items")
    out = g.withColumn("pearson_r", r).withColumn("passed", (F.col("pearson_r") >= threshold) & enough)
    return out.drop("_r", "_sa", "_sb", "_same")
