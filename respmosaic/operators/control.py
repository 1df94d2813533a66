"""Control tables: random, shuffled and motif-spiked sequences, generated inside Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.functions import vocab
from respmosaic.operators.filters import item_columns
from respmosaic.plans.ranking import hash_rank, ordered_rank
from respmosaic.plans.stable import materialise

PER_DIGEST = 8


def random_letters(seed: Column, length: Column, gc: Column) -> Column:
    """Independent letters with P(G or C) = gc, from md5 digests of ``seed|block``.

    Each digest yields eight 16-bit draws, so a text costs length / 8 digests.
    """

    def draws(digest: Column) -> Column:
        return F.array(*[F.conv(F.substring(digest, 4 * j + 1, 4), 16, 10).cast("double") / 65536.0 for j in range(PER_DIGEST)])

    def letter(u: Column) -> Column:
        at = (1 - gc) / 2
        return F.when(u < at, "A").when(u < at + gc / 2, "C").when(u < at + gc, "G").otherwise("T")

    # Chained transforms: a value bound by a lambda is computed once, a repeated expression is not.
    blocks = F.sequence(F.lit(0), F.floor((length - 1) / PER_DIGEST).cast("int"))
    digests = F.transform(blocks, lambda b: F.md5(F.concat_ws("|", seed, b.cast("string"))))
    letters = F.transform(F.flatten(F.transform(digests, draws)), letter)
    return F.substring(F.array_join(letters, ""), F.lit(1), length)


def _pick(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def control_rows(df: DataFrame, subset: str) -> DataFrame:
    """The 11-column item schema for synthetic rows (``probe_id, sequence, source``)."""
    length, gc, dinuc, trinuc = item_columns("sequence")
    return df.select(
        "probe_id",
        "sequence",
        length,
        F.lit(subset).alias("functional_element"),
        F.lit("synthetic").alias("species_group"),
        F.lit("synthetic").alias("species"),
        gc,
        dinuc,
        trinuc,
        "source",
        F.lit("control").alias("label_source"),
    )


def _control_id(subset: str, ordinal: Column) -> Column:
    return F.format_string("%s_%05d", F.lit(subset), ordinal)


def random_sequences(
    rows: DataFrame, n: int | None = None, seed: int = 42, gc_levels: Sequence[float] = vocab.GC_LEVELS, tiers: Sequence[int] = vocab.LENGTH_TIERS
) -> DataFrame:
    """One random sequence per row of ``rows`` (column ``ordinal`` 0..n-1, e.g. a range).

    n rows are split over the GC levels (the first levels take the remainder) and lengths
    cycle through the tiers inside a level.
    """
    total = F.lit(n) if n is not None else rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    levels = len(gc_levels)
    df = rows.select("ordinal").withColumn("_n", total)
    base, extra = F.floor(F.col("_n") / levels), F.col("_n") % levels
    head = (base + 1) * extra
    i = F.col("ordinal")
    df = df.withColumn("_level", F.when(i < head, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - head) / F.greatest(base, F.lit(1)))))
    df = df.withColumn("_at", F.when(i < head, i % (base + 1)).otherwise((i - head) % F.greatest(base, F.lit(1))))
    df = df.withColumn("_gc", _pick(gc_levels, F.col("_level"))).withColumn("_len", _pick(tiers, F.col("_at") % len(tiers)))
    key = F.concat_ws("|", F.lit(str(seed)), F.lit("random"), F.col("ordinal").cast("string"))
    made = df.select(
        _control_id("ctrl_random_ACGT", F.col("ordinal") + 1).alias("probe_id"),
        random_letters(key, F.col("_len"), F.col("_gc")).alias("sequence"),
        F.format_string("synthetic::gc=%.2f::len=%d", F.col("_gc"), F.col("_len")).alias("source"),
    )
    return control_rows(made, "ctrl_random_ACGT")


def motif_spike(
    rows: DataFrame,
    n: int | None = None,
    seed: int = 42,
    motifs: Sequence[str] = vocab.MOTIFS,
    tiers: Sequence[int] = vocab.LENGTH_TIERS,
    background_gc: float = 0.5,
) -> DataFrame:
    """n div (motifs x tiers) sequences per cell with the motif written over the centre.

    Cells too short for a motif (length < motif + 4) are skipped.
    """
    total = F.lit(n) if n is not None else rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = [(m, t) for m in motifs for t in tiers]
    df = rows.select("ordinal").withColumn("_per", F.floor(total / len(cells)))
    df = df.filter((F.col("_per") > 0) & (F.col("ordinal") < F.col("_per") * len(cells)))
    cell = F.floor(F.col("ordinal") / F.col("_per"))
    df = df.withColumn("_motif", _pick([m for m, _ in cells], cell)).withColumn("_len", _pick([t for _, t in cells], cell))
    df = df.filter(F.col("_len") >= F.length("_motif") + 4)
    key = F.concat_ws("|", F.lit(str(seed)), F.lit("motif"), F.col("ordinal").cast("string"))
    at = F.floor((F.col("_len") - F.length("_motif")) / 2).cast("int") + 1
    made = df.select(
        _control_id("ctrl_motif_spiked", F.col("ordinal") + 1).alias("probe_id"),
        F.overlay(random_letters(key, F.col("_len"), F.lit(background_gc)), F.col("_motif"), at).alias("sequence"),
        F.format_string("synthetic::motif=%s::len=%d::bg_gc=%.1f", F.col("_motif"), F.col("_len"), F.lit(background_gc)).alias("source"),
    )
    return control_rows(made, "ctrl_motif_spiked")


def euler_shuffle(text: str, rng: np.random.Generator) -> str:
    """A random text with the same first and last letter and the same 2-letter counts.

    The text is an Eulerian path over its letters. A loop-erased random walk draws the last
    exit of every letter (a tree into the final letter); the other exits are shuffled.
    """
    if len(text) < 3:
        return text
    exits: dict[str, list[str]] = {}
    for a, b in zip(text, text[1:]):
        exits.setdefault(a, []).append(b)
    final = text[-1]
    last: dict[str, int] = {}
    done = {final}
    for start in exits:
        at = start
        while at not in done:
            last[at] = int(rng.integers(len(exits[at])))
            at = exits[at][last[at]]
        at = start
        while at not in done:
            done.add(at)
            at = exits[at][last[at]]
    queue: dict[str, list[str]] = {}
    for letter, nexts in exits.items():
        order = list(nexts)
        tail = [order.pop(last[letter])] if letter != final else []
        rng.shuffle(order)
        queue[letter] = (order + tail)[::-1]
    out = [text[0]]
    while queue.get(out[-1]):
        out.append(queue[out[-1]].pop())
    return "".join(out)


def shuffle_texts(df: DataFrame, seq: str, key: str, seed: int, out: str = "shuffled") -> DataFrame:
    """Adds an Euler shuffle of each text; the draw depends only on ``seed`` and ``key``."""

    @F.pandas_udf("string")
    def shuffled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seeds in batches:
            yield pd.Series([euler_shuffle(t, np.random.default_rng(int(h, 16))) for t, h in zip(texts, seeds)])

    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), F.col(key).cast("string"))), 1, 15)
    return df.withColumn(out, shuffled(F.col(seq), digest))


def shuffle_quota(panel: DataFrame, n_total: int, seed: int) -> DataFrame:
    """Rows of each stratum to shuffle: an equal share, repeated draws when it is short.

    ``panel``: item, stratum and others -> adds ``draw`` (1..share inside the stratum).
    """
    strata = ordered_rank(panel.groupBy("stratum").agg(F.count(F.lit(1)).alias("_pool")), [], [("stratum", "asc")], "_s")
    count = strata.agg(F.count(F.lit(1)).alias("k"))
    strata = strata.withColumn("_k", count.scalar())
    share = F.floor(F.lit(n_total) / F.col("_k")) + F.when(F.col("_s") <= F.lit(n_total) % F.col("_k"), 1).otherwise(0)
    draws = strata.withColumn("_share", share).filter("_share > 0").select("stratum", "_pool", "_s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_share"))).alias("draw"))
    again = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}again"), F.col("stratum").cast("string"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = draws.withColumn("_r", F.when(F.col("draw") <= F.col("_pool"), F.col("draw")).otherwise(F.pmod(again, F.col("_pool")) + 1))
    ranked = hash_rank(panel, ["stratum"], seed, ["item"], "_r")
    return draws.join(ranked, ["stratum", "_r"]).drop("_r", "_pool")


def dinuc_shuffle(panel: DataFrame, n_total: int, seed: int = 42) -> DataFrame:
    """Shuffled copies of panel items that keep every 2-letter count.

    The texts are stored once and meet their draws by row number after these are counted out, so no rank or sort carries them.
    """
    pool = materialise(panel.select("item", "stratum", "seq").withColumn("_row", F.monotonically_increasing_id()))
    drawn = shuffle_quota(pool.drop("seq"), n_total, seed).withColumn("_key", F.concat_ws("|", F.col("item").cast("string"), F.col("draw").cast("string")))
    numbered = ordered_rank(drawn, [], [("_s", "asc"), ("draw", "asc")], "_n")
    made = shuffle_texts(numbered.join(pool.select("_row", "seq"), "_row"), "seq", "_key", seed).select(
        _control_id("ctrl_dinuc_shuffled", F.col("_n")).alias("probe_id"),
        F.col("shuffled").alias("sequence"),
        F.concat(F.lit("shuffled_from::"), F.col("item").cast("string")).alias("source"),
    )
    return control_rows(made, "ctrl_dinuc_shuffled")


def ordinals(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "ordinal")


def build_control_panel(panel: DataFrame, seed: int = 42, n_random: int = 3500, n_shuffled: int = 3500, n_motif: int = 3000) -> DataFrame:
    """Three control subsets in the item schema, with seeds derived from one."""
    spark = panel.sparkSession
    random_part = random_sequences(ordinals(spark, n_random), n_random, seed * 3 + 1)
    shuffled_part = dinuc_shuffle(panel, n_shuffled, seed * 3 + 2)
    motif_part = motif_spike(ordinals(spark, n_motif), n_motif, seed * 3 + 3)
    return random_part.unionByName(shuffled_part).unionByName(motif_part)


def control_manifest(control: DataFrame) -> DataFrame:
    """Count and describe(length), describe(GC) per subset."""
    from respmosaic.operators.panel import describe

    # Generated texts are costly and the summaries read them several times.
    control = materialise(control.select("functional_element", "length_bp", "GC_content"))
    out = None
    for column, name in (("length_bp", "length"), ("GC_content", "gc")):
        d = describe(control, column, ["functional_element"])
        d = d.select("functional_element", *[F.col(c).alias(f"{name}_{c}") for c in d.columns if c != "functional_element"])
        out = d if out is None else out.join(d, "functional_element")
    return out
