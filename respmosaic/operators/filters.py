"""Row filters: label policies, entity and item restriction, empty axes, panel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.functions.text import computed, crop_center, dinuc_vec, gc_fraction, trinuc_vec
from respmosaic.operators.integrity import require_empty

POLICIES = ("positive_only", "keep_label", "keep_all", "multiclass_species")


def label_policy(label: Column | str, policy: str, keep: Sequence[str] = ()) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    if policy == "positive_only":
        return c == "1"
    if policy == "keep_label":
        return c.isin(list(keep))
    if policy in ("keep_all", "multiclass_species"):
        return F.lit(True)
    raise ValueError(f"unknown label policy {policy!r}; use one of {POLICIES}")


def filter_label_policy(df: DataFrame, policy: str, keep: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.filter(label_policy(label, policy, keep))


def last_header_field(header: Column | str) -> Column:
    """Label of a ``id|label`` header; null without a '|'."""
    h = F.col(header) if isinstance(header, str) else header
    return F.when(F.instr(h, "|") > 0, F.trim(F.element_at(F.split(h, r"\|"), -1)))


def filter_multilabel_any(df: DataFrame, header: str = "header") -> DataFrame:
    """Drops ids ending ``_negative`` and rows without a positive label; adds ``label``.

    ``label`` lists the 0-based positions of the positive labels.
    """
    parts = F.split(F.col(header), r"\|")
    flags = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    positions = F.filter(F.transform(flags, lambda x, i: F.when(x == "1", i)), lambda i: i.isNotNull())
    kept = df.filter(~F.get(parts, F.lit(0)).endswith("_negative") & F.exists(flags, lambda x: x == "1"))
    return kept.withColumn("label", F.array_join(F.transform(positions, lambda i: i.cast("string")), ","))


def filter_entities(df: DataFrame, ids: Sequence | None = None, contains: Sequence[str] | None = None, entity: str = "entity", strict: bool = True) -> DataFrame:
    """Exact ids (a missing one raises when strict) or any-substring match, not both."""
    if ids is not None and contains is not None:
        raise ValueError("ids and contains exclude each other")
    if ids is not None:
        wanted = df.sparkSession.createDataFrame([(i,) for i in ids], [entity]).select(F.col(entity).cast(df.schema[entity].dataType))
        if strict:
            require_empty(wanted.join(df.select(entity), entity, "left_anti"), "unknown entities")
        return df.join(wanted, entity, "left_semi")
    if contains:
        hit = F.lit(False)
        for needle in contains:
            hit = hit | F.col(entity).contains(needle)
        return df.filter(hit)
    return df


def drop_empty_axes(v: DataFrame) -> DataFrame:
    """Removes entities and items that have no value at all."""
    entities, items = live_axes(v)
    return v.join(entities, "entity", "left_semi").join(items, "item", "left_semi")


def live_axes(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    present = v.filter(F.col("value").isNotNull())
    return present.select("entity").distinct(), present.select("item").distinct()


def empty_axes_report(v: DataFrame) -> DataFrame:
    """``axis, key`` of everything :func:`drop_empty_axes` removes."""
    parts = []
    for axis in ("entity", "item"):
        gone = v.groupBy(axis).agg(F.count("value").alias("n")).filter("n = 0")
        parts.append(gone.select(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("key")))
    return parts[0].unionByName(parts[1])


def restrict_items(v: DataFrame, items: DataFrame) -> DataFrame:
    return v.join(items.select("item"), "item", "left_semi")


def exclude_entities(v: DataFrame, entities: DataFrame) -> DataFrame:
    return v.join(entities.select("entity"), "entity", "left_anti")


def item_columns(seq: str) -> list[Column]:
    return [
        F.length(seq).alias("length_bp"),
        gc_fraction(seq).alias("GC_content"),
        dinuc_vec(seq).alias("dinuc_vec"),
        trinuc_vec(seq).alias("trinuc_vec"),
    ]


def usable_items(df: DataFrame, seq: str = "seq", crop_to: Column | None = None, lo: int = 128, hi: int = 1024) -> DataFrame:
    """Upper-case, crop, then keep ACGT-only sequences inside the length range."""
    s = F.upper(F.col(seq))
    if crop_to is not None:
        s = F.when(crop_to.isNotNull(), crop_center(s, crop_to)).otherwise(s)
    out = computed(df, seq, s)
    return out.filter(F.length(seq).between(lo, hi) & F.col(seq).rlike("^[ACGT]+$"))


def make_item_rows(df: DataFrame, lo: int = 128, hi: int = 1024) -> DataFrame:
    """The 11-column item table. One projection and one filter, no shuffle.

    Input: probe_id, seq, stratum, species_group, species, source, label_source, crop_to.
    """
    kept = usable_items(df, "seq", F.col("crop_to") if "crop_to" in df.columns else None, lo, hi)
    length, gc, dinuc, trinuc = item_columns("seq")
    return kept.select(
        "probe_id",
        F.col("seq").alias("sequence"),
        length,
        F.col("stratum").alias("functional_element"),
        "species_group",
        "species",
        gc,
        dinuc,
        trinuc,
        "source",
        "label_source",
    )
