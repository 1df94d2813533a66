"""Panel building by quota and the summaries of a panel or a file collection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respmosaic.functions.names import assign_species
from respmosaic.operators.filters import make_item_rows, usable_items
from respmosaic.plans.quantiles import quantile_columns
from respmosaic.plans.ranking import hash_rank, ordered_rank, running_total
from respmosaic.plans.stable import materialise


def sample_quota(df: DataFrame, by: Sequence[str], key: str, n, seed: int) -> DataFrame:
    """At most n rows per group without replacement (n: number or column name)."""
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return hash_rank(df, by, seed, [key], "_q").filter(F.col("_q") <= limit).drop("_q")


def balanced_rank(df: DataFrame, by: Sequence[str], label: str, per_label: str, key: str, seed: int) -> DataFrame:
    """``rank`` per group: up to ``per_label`` rows of every label first, then the rest.

    A null ``per_label`` means plain random order. Taking ``rank <= n`` therefore trims or
    tops up to n exactly as a quota with label balance asks.
    """
    by = list(by)
    inside = hash_rank(df, [*by, label], seed, [key], "_l")
    first = inside.withColumn("_first", F.coalesce(F.col("_l") <= F.col(per_label), F.lit(True))).drop("_l")
    ranked = hash_rank(first, [*by, "_first"], f"{seed}b", [key], "_r")
    heads = first.groupBy(*by).agg(F.count_if("_first").alias("_heads"))
    rank = F.when(F.col("_first"), F.col("_r")).otherwise(F.col("_r") + F.col("_heads"))
    return ranked.join(heads, by).withColumn("rank", rank).drop("_r", "_first", "_heads")


def sample_balanced(df: DataFrame, by: Sequence[str], label: str, key: str, per_label: int, n: int, seed: int) -> DataFrame:
    ranked = balanced_rank(df.withColumn("_per", F.lit(per_label)), by, label, "_per", key, seed)
    return ranked.filter(F.col("rank") <= n).drop("rank", "_per")


def number_items(df: DataFrame, prefix: str, order: Sequence[tuple[str, str]], out: str = "probe_id") -> DataFrame:
    """Running ids ``<prefix>_00001`` inside each prefix value."""
    ranked = ordered_rank(df, [prefix], order, "_n")
    return ranked.withColumn(out, F.format_string("%s_%05d", F.col(prefix), F.col("_n"))).drop("_n")


def panel_pool(records: DataFrame, spec: DataFrame, lo: int = 128, hi: int = 1024) -> DataFrame:
    """Rows that pass the label policy of their dataset, cropped and validated.

    ``records``: dataset, seq, label, row_idx. ``spec``: one row per dataset with stratum,
    species_group, stratum_species, species, target_n, crop_to, policy, keep_labels,
    per_label, position.
    """
    joined = records.join(spec, "dataset")
    wanted = (
        F.col("policy").isin("keep_all", "multiclass_species")
        | ((F.col("policy") == "positive_only") & (F.col("label") == "1"))
        | ((F.col("policy") == "keep_label") & F.array_contains("keep_labels", F.col("label")))
    )
    return usable_items(joined.filter(wanted), "seq", F.col("crop_to"), lo, hi)


def build_panel(records: DataFrame, spec: DataFrame, seed: int = 42, lo: int = 128, hi: int = 1024) -> DataFrame:
    """Quota-controlled panel: filter, validate, sample per dataset, number per stratum.

    Validation precedes sampling, so no oversampling round is needed to reach a quota.
    """
    pool = panel_pool(records, spec, lo, hi).withColumn("_key", F.concat_ws("#", "dataset", F.col("row_idx").cast("string")))
    # Only keys are ranked; texts are read once to validate and once to emit the chosen rows.
    keys = materialise(pool.select("dataset", "label", "per_label", "target_n", "stratum", "position", "_key"))
    ranked = balanced_rank(keys, ["dataset"], "label", "per_label", "_key", seed).filter(F.col("rank") <= F.col("target_n"))
    chosen = materialise(ranked.select("dataset", "_key", "stratum", "position", "rank"))
    numbered = number_items(chosen, "stratum", [("position", "asc"), ("rank", "asc")]).select("dataset", "_key", "probe_id")
    picked = pool.join(numbered, ["dataset", "_key"])
    species = assign_species("species", "stratum_species", "stratum", "label")
    rows = picked.withColumn("species", species).withColumn("label_source", F.col("policy"))
    rows = rows.withColumn("source", F.concat(F.col("dataset"), F.lit("#row_"), F.col("row_idx").cast("string")))
    return make_item_rows(rows.drop("crop_to"), lo, hi)


def scale_spec(spec: DataFrame, factor: float) -> DataFrame:
    """Smaller quotas for a trial panel, at least one item per dataset."""
    return spec.withColumn("target_n", F.greatest(F.lit(1), F.floor(F.col("target_n") * factor)).cast("int"))


def panel_manifest(records: DataFrame, spec: DataFrame, panel: DataFrame, fill: float = 0.95) -> DataFrame:
    """Per dataset: pool size, quota, emitted rows, MISSING/OK, and the >= 95 % flag."""
    pool = records.join(spec.select("dataset"), "dataset", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("pool_size"))
    emitted = panel.groupBy(F.regexp_replace("source", "#row_.*$", "").alias("dataset")).agg(F.count(F.lit(1)).alias("emitted_n"))
    out = spec.select("stratum", "dataset", "target_n").join(pool, "dataset", "left").join(emitted, "dataset", "left")
    out = out.withColumn("status", F.when(F.col("pool_size").isNull(), "MISSING").otherwise("OK"))
    out = out.fillna(0, ["pool_size", "emitted_n"])
    return out.withColumn("filled", F.col("emitted_n") >= fill * F.col("target_n"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Emitted and requested rows per stratum and overall."""
    return manifest.rollup("stratum").agg(F.sum("target_n").alias("requested"), F.sum("emitted_n").alias("emitted"))


# ---------------------------------------------------------------- summaries


def stratum_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gc").alias("gc_mean"), F.min("gc").alias("gc_min"), F.max("gc").alias("gc_max")
    )


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of one column per group."""
    base = df.groupBy(*by).agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    q = quantile_columns(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by)
    if by:
        return base.join(q, list(by))
    return base.withColumn("_q", q.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")


def stratum_species_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("stratum", "species").agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, by: Sequence[str], value: str, out: str = "top") -> DataFrame:
    """Most frequent value per group, smallest name on ties; counts are folded first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*by, F.col("_b.v").alias(out), (-F.col("_b.neg")).alias(f"{out}_n"))


def distinct_count(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact distinct count in two aggregations, so no task holds one group's values."""
    return df.select(*by, value).distinct().groupBy(*by).agg(F.count(value).alias(out))


def composition_table(panel: DataFrame, group_order: Sequence[str] = ()) -> DataFrame:
    """Per group and stratum: N, mean length and GC, species count, commonest dataset."""
    keys = ["grp", "stratum"]
    base = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length_mean"), F.avg("gc").alias("gc_mean"))
    out = base.join(distinct_count(panel, keys, "species", "n_species"), keys).join(most_common(panel, keys, "dataset", "dataset").drop("dataset_n"), keys)
    place = order_position("grp", group_order)
    return out.orderBy(place, "grp", F.desc("n"), "stratum")


def composition_totals(panel: DataFrame) -> DataFrame:
    """Group totals and the grand total (null group) in one pass."""
    return panel.rollup("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length_mean"), F.avg("gc").alias("gc_mean"))


def order_position(column: str, order: Sequence[str]):
    """Position in a custom order, unknown values last."""
    if not order:
        return F.lit(0)
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(len(order) + 1)).otherwise(at)


def ordered_by_list(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(order_position(column, order), column, *then)


def species_label(panel: DataFrame, by: Sequence[str], dominant: float = 0.85) -> DataFrame:
    """One species, a dominant one with its count (>= 85 %), or how many there are."""
    counts = panel.groupBy(*by, "species").agg(F.count(F.lit(1)).alias("_n"))
    g = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_t"), F.min(F.struct((-F.col("_n")).alias("neg"), F.col("species").alias("s"))).alias("_b")
    )
    top, name = -F.col("_b.neg"), F.col("_b.s")
    text = (
        F.when(F.col("_k") == 1, name)
        .when(top / F.col("_t") >= dominant, F.format_string("%s (%d/%d)", name, top, F.col("_t")))
        .otherwise(F.format_string("multi-species (n=%d)", F.col("_k")))
    )
    return g.select(*by, text.alias("species"))


def parent_tasks(panel: DataFrame, by: Sequence[str], path: str = "task_path", top: int = 5, show: int = 3) -> DataFrame:
    """Up to three distinct parent folders of the five most frequent task paths."""
    counts = panel.groupBy(*by, path).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), path)
    best = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    parent = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.col(path))
    listed = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", parent.alias("p")))).alias("_l"))
    return listed.select(*by, F.array_join(F.slice(F.array_distinct(F.col("_l.p")), 1, show), ", ").alias("tasks"))


def stratum_profile(panel: DataFrame) -> DataFrame:
    """Per stratum: medians, quartiles and range of length and GC, panel share, species."""
    by = ["stratum"]
    panel = materialise(panel.select(*by, "length", "gc", "species", "task_path"))  # read ten times
    base = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length_min"), F.max("length").alias("length_max"))
    total = panel.agg(F.count(F.lit(1)).alias("n"))
    base = base.withColumn("panel_pct", 100 * F.col("n") / total.scalar())
    lengths = quantile_columns(panel, "length", {"length_q25": 0.25, "length_median": 0.5, "length_q75": 0.75}, by)
    gcs = quantile_columns(panel, "gc", {"gc_q25": 0.25, "gc_median": 0.5, "gc_q75": 0.75}, by)
    return base.join(lengths, by).join(gcs, by).join(species_label(panel, by), by).join(parent_tasks(panel, by), by)


def dataset_profile(panel: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Per (stratum, task path): n, medians and species label, strata in listed order."""
    by = ["stratum", "task_path"]
    panel = materialise(panel.select(*by, "length", "gc", "species"))  # read six times
    base = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    out = base.join(quantile_columns(panel, "length", {"length_median": 0.5}, by), by)
    out = out.join(quantile_columns(panel, "gc", {"gc_median": 0.5}, by), by).join(species_label(panel, by), by)
    return out.orderBy(order_position("stratum", order), "stratum", F.desc("n"), "task_path")


def split_stats(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, split, label, length`` -> rows per split, length range and minority share."""
    by = list(by)
    base = rows.groupBy(*by).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.min("length").alias("length_min"),
        F.max("length").alias("length_max"),
    )
    labels = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n"))
    minority = labels.groupBy(*by).agg((100 * F.min("_n") / F.sum("_n")).alias("minority_pct"))
    medians = quantile_columns(rows, "length", {"length_median": 0.5}, by)
    if by:
        return base.join(minority, by).join(medians, by)
    return base.withColumn("minority_pct", minority.scalar()).withColumn("length_median", medians.scalar())


def file_stats(records: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Records, letters and mean length per file (empty sequences do not count)."""
    kept = records.filter(F.col("length") > 0)
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.sum("length").alias("total_bp"), F.avg("length").alias("length_mean"))


def label_counts(records: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    return records.filter((F.col("length") > 0) & F.col("label").isNotNull()).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def nearest_rank_percentile(records: DataFrame, by: Sequence[str], value: str, qs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """Smallest value whose cumulative count reaches q * total, from value counts cut into ranges; null values do not count."""
    by = list(by)
    counts = records.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, by, value, "_n", "_before")
    placed = placed.withColumn("_c", F.col("_before") + F.col("_n"))
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_t"))
    if by:
        named = total.select("_t", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
        placed = placed.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]))
    else:
        placed = placed.withColumn("_t", total.scalar())
    marked = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    return marked.filter(F.col("_c") >= F.col("q") * F.col("_t")).groupBy(*by, "q").agg(F.min(value).alias("value"))


def collection_summary(tasks: DataFrame) -> DataFrame:
    """Per collection: files, datasets, groups, records, length range, type counts.

    ``tasks``: collection, dataset, task_group, task_type, n_records, len_min, len_median,
    len_max. The middle of medians is the upper one.
    """
    by = ["collection"]
    base = tasks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_records").alias("n_records_total"), F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max")
    )
    types = tasks.groupBy(*by, "task_type").agg(F.count(F.lit(1)).alias("n"))
    types = types.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task_type", "n")))).alias("task_types"))
    has = tasks.filter(F.col("len_median").isNotNull())
    ranked = ordered_rank(has.select(*by, "len_median", "dataset"), by, [("len_median", "asc"), ("dataset", "asc")], "_r")
    middle = ranked.join(has.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by).filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    out = base.join(distinct_count(tasks, by, "dataset", "n_datasets"), by).join(distinct_count(tasks, by, "task_group", "n_groups"), by)
    return out.join(types, by).join(middle.select(*by, F.col("len_median").alias("len_median_of_medians")), by, "left")


def group_counts(dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of each attribute in one pass: ``attribute, value, n``."""
    entries = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    return dim.select(F.explode(entries).alias("_e")).select("_e.*").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def known_counts(dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    return dim.agg(*[F.count(c).alias(f"n_{c}") for c in columns], F.count(F.lit(1)).alias("n"))


def top_labels(df: DataFrame, by: Sequence[str], label: str, n: int = 6) -> DataFrame:
    """``label:count;...`` of the n most frequent labels, ties by label (a top-k report)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), label)
    best = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    text = F.concat_ws(":", F.col(label).cast("string"), F.col("_n").cast("string"))
    listed = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", text.alias("t")))).alias("_l"))
    return listed.select(*by, F.array_join(F.col("_l.t"), ";").alias("labels"))


def head_items(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows by an explicit key (file order is not stable in Spark)."""
    return df.orderBy(key).limit(n)


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by ``order``; ``min_by`` combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def clean_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Drops '#' comments and blank lines."""
    return df.withColumn(line, F.trim(F.regexp_replace(line, "#.*$", ""))).filter(F.length(line) > 0)


def group_lump(df: DataFrame, column: str, min_count: int, curated: Sequence[str] = (), out: str = "lumped") -> DataFrame:
    """Groups below ``min_count`` become ``Other`` unless curated."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    keep = (F.col("_n") >= min_count) | F.col(column).isin(list(curated))
    return df.join(counts, column).withColumn(out, F.when(keep, F.col(column)).otherwise("Other")).drop("_n")


def lump_order(df: DataFrame, column: str, min_count: int, curated: Sequence[str] = ()) -> DataFrame:
    """Shown groups: the curated list first, then by falling count."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    shown = counts.filter((F.col("n") >= min_count) | F.col(column).isin(list(curated)))
    return shown.orderBy(order_position(column, curated), F.desc("n"), column)


def union_tables(*tables: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy(*order) if order else out
