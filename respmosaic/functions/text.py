"""Sequence functions as column expressions (no Python per row).

Long texts: overlapping words come from a look-ahead pattern in one pass; repeated ``substr``
would rescan the text from its start for every word.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.functions.words import vector_counts, vector_shares, word_counts

BASES = "ACGT"
# GC bin edges and their labels.
GC_EDGES = (0.2, 0.4, 0.5, 0.6, 0.8)
GC_LABELS = ("very_low", "low", "mid_low", "mid_high", "high", "very_high")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with ``name`` worked out once per row.

    The optimiser copies a plain column into every filter and column that reads it, so a costly one is worked out again for each; it does
    not copy through a generator. The outer form keeps it from adding a test of the array.
    """
    return df.withColumn(name, F.explode_outer(F.array(column)))


def kmer_names(k: int) -> list[str]:
    """All k-letter words over ACGT in lexicographic order."""
    return ["".join(p) for p in product(BASES, repeat=k)]


def keep_letters(c: Column | str, letters: str = BASES) -> Column:
    return F.regexp_replace(F.upper(_col(c)), f"[^{letters}]+", "")


def valid_sequence(c: Column | str) -> Column:
    return F.upper(_col(c)).rlike("^[ACGT]+$")


def in_length_range(c: Column | str, lo: int = 128, hi: int = 1024) -> Column:
    return F.length(_col(c)).between(lo, hi)


def looks_like_dna(c: Column | str) -> Column:
    """At least 20 letters, and 80 % of the first 200 are ACGTN (the rule's own window)."""
    head = F.substring(F.upper(_col(c)), 1, 200)
    share = F.length(F.regexp_replace(head, "[^ACGTN]", "")) / F.greatest(F.length(head), F.lit(1))
    return (F.length(_col(c)) >= 20) & (share >= 0.8)


def gc_fraction(c: Column | str) -> Column:
    """Upper-case G and C over the full length; 0 for an empty sequence."""
    s = _col(c)
    others = F.length(F.translate(s, "GC", ""))
    return F.when(F.length(s) > 0, (F.length(s) - others) / F.length(s)).otherwise(0.0)


def gc_bin(gc: Column | str) -> Column:
    g = _col(gc)
    out = F.when(g < GC_EDGES[0], GC_LABELS[0])
    for edge, label in zip(GC_EDGES[1:], GC_LABELS[1:]):
        out = out.when(g < edge, label)
    return out.otherwise(GC_LABELS[-1])


def windows(c: Column | str, k: int, letters: str = ".") -> Column:
    """All overlapping k-letter words of a text, in order, from one pattern pass.

    The capture sits in a look-ahead, so every start position matches. ``letters`` is a
    pattern for one letter; words with other letters are skipped.
    """
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=({letters}{{{k}}}))"), F.lit(1))


def kmer_count_array(c: Column | str, k: int) -> Column:
    """Counts of the 4^k words in lexicographic order, in one pass and without a shuffle.

    The vector is dense, so its length is the memory a text needs; use :func:`kmer_table` for long words.
    """
    return vector_counts(_col(c), k, BASES)


def kmer_vector(c: Column | str, k: int) -> Column:
    """Word frequencies; the zero vector when no valid word exists."""
    return vector_shares(_col(c), k, BASES)


def dinuc_vec(c: Column | str) -> Column:
    return kmer_vector(c, 2)


def trinuc_vec(c: Column | str) -> Column:
    return kmer_vector(c, 3)


def kmer_table(df: DataFrame, key: Sequence[str], seq: str, k: int) -> DataFrame:
    """Sparse ``(*key, kmer, n)`` for any k; partial sums shrink it before the shuffle."""
    usable = F.regexp_replace(F.col(seq), f"[^{BASES}]+", "N")
    # The outer form: a plain explode makes the optimiser test the array in a second evaluation.
    words = df.select(*key, F.explode_outer(word_counts(usable, k)).alias("_w")).select(*key, F.col("_w.w").alias("kmer"), F.col("_w.n").alias("_n"))
    return words.filter(F.col("kmer").isNotNull() & ~F.col("kmer").contains("N")).groupBy(*key, "kmer").agg(F.sum("_n").alias("n"))


def kmer_features(df: DataFrame, key: str, seq: str, k_min: int = 2, k_max: int = 3, transform: str = "zscore") -> DataFrame:
    """Stacked word frequencies as ``(key, feature, x)``: column z-scores or square roots.

    Feature moments are one small aggregation; a constant feature is scaled by 1.
    """
    if not 1 <= k_min <= k_max:
        raise ValueError("need 1 <= k_min <= k_max")
    if transform not in ("zscore", "hellinger"):
        raise ValueError(f"unknown transform {transform!r}")
    names = [w for k in range(k_min, k_max + 1) for w in kmer_names(k)]
    stacked = F.concat(*[kmer_vector(seq, k) for k in range(k_min, k_max + 1)])
    long = df.select(key, F.posexplode_outer(stacked).alias("_i", "x"))
    long = long.select(key, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1).alias("feature"), "x")
    if transform == "hellinger":
        return long.withColumn("x", F.sqrt(F.greatest(F.col("x"), F.lit(0.0))))
    moments = long.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return long.join(moments, "feature").withColumn("x", (F.col("x") - F.col("_m")) / scale).drop("_m", "_s")


def crop_center(c: Column | str, n: int | Column) -> Column:
    """Middle n letters (start rounded down); shorter sequences unchanged."""
    s, size = _col(c), F.lit(n) if isinstance(n, int) else n
    start = F.floor((F.length(s) - size) / 2).cast("int") + 1
    return F.when(F.length(s) <= size, s).otherwise(F.substring(s, start, size))


def overlapping_kmers(c: Column | str, k: int) -> Column:
    """Space-joined overlapping words; raises on a sequence shorter than k."""
    s = _col(c)
    short = F.raise_error(F.concat(F.lit(f"sequence shorter than {k}: "), s))
    return F.when(F.length(s) < k, short.cast("string")).otherwise(F.array_join(windows(s, k), " "))


def codons(c: Column | str) -> Column:
    """Struct of ``text`` (space-joined triplets of the ACGT letters) and their count."""
    clean = keep_letters(c)
    n = F.floor(F.length(clean) / 3).cast("int")
    cut = F.substring(clean, F.lit(1), n * 3)
    return F.struct(F.rtrim(F.regexp_replace(cut, "(.{3})", "$1 ")).alias("text"), n.alias("n"))


def pad_to_multiple(c: Column | str, k: int = 6, ch: str = "A") -> Column:
    s = _col(c)
    return F.rpad(s, (F.ceil(F.length(s) / k) * k).cast("int"), ch)
