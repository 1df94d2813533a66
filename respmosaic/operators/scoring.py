"""Count-based likelihood scorers that turn (entity, sequence) into response values.

Models are tables fitted by Spark. An item is reduced once to its word counts, and all
entities score it by one blocked product, so cost does not grow as items x letters x
entities rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import product

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.functions.text import BASES, kmer_names, windows
from respmosaic.functions.words import vector_counts, word_counts
from respmosaic.plans.products import dot_products

EDGE_LEFT, EDGE_RIGHT = "^", "$"


def fit_markov(seqs: DataFrame, k: int = 2, alpha: float = 1.0) -> DataFrame:
    """``entity, ctx, next, n, logp``: smoothed log p(next | k letters) per entity.

    Every context of the alphabet is present, so unseen words get their smoothed value.
    """
    full = _model_counts(seqs, F.col("seq"), kmer_names(k + 1), k + 1, BASES)
    full = full.select("entity", F.substring("w", 1, k).alias("ctx"), F.substring("w", k + 1, 1).alias("next"), "n")
    total = F.sum("n").over(Window.partitionBy("entity", "ctx"))
    return full.withColumn("logp", F.log((F.col("n") + alpha) / (total + alpha * len(BASES))))


#: Longest vector of word counts; more words are counted as rows.
WIDE = 4096


def _vectors(text: Column, names: Sequence[str], k: int, letters: str) -> Column:
    """``array<double>`` of a text's counts of the words ``names``."""
    at = {"".join(w): i for i, w in enumerate(product(letters, repeat=k))}
    places = [at[n] for n in names]
    return vector_counts(text, k, letters, None if places == list(range(len(at))) else places).cast("array<double>")


def _summed(rows: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Fixed-length vectors added up by key, as vectors: ``(*keys, vec)``."""
    total = rows.withColumn("_x", array_to_vector(vec)).groupBy(*keys).agg(Summarizer.sum(F.col("_x")).alias("_s"))
    return total.select(*keys, vector_to_array("_s").alias("vec"))


def _model_counts(seqs: DataFrame, text: Column, names: Sequence[str], k: int, letters: str) -> DataFrame:
    """``entity, w, n`` for every entity and word."""
    alphabet = F.array(*[F.lit(w) for w in names])
    if len(letters) ** k <= WIDE:
        summed = _summed(seqs.select("entity", _vectors(text, names, k, letters).alias("v")), ["entity"], "v")
        paired = summed.select("entity", F.explode(F.arrays_zip(alphabet.alias("w"), F.col("vec").alias("n"))).alias("p"))
        return paired.select("entity", F.col("p.w").alias("w"), F.round("p.n").cast("long").alias("n"))
    grid = seqs.select("entity").distinct().select("entity", F.explode(alphabet).alias("w"))
    return grid.join(_counted(seqs.select("entity", text.alias("_t")), "entity", word_counts("_t", k)), ["entity", "w"], "left").fillna(0, ["n"])


def _counted(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """``key, w, n``: word counts of each key, summed up per text before the shuffle."""
    found = rows.select(key, F.explode_outer(words).alias("_w")).select(key, "_w.w", "_w.n")
    return found.filter(F.col("w").isNotNull()).groupBy(key, "w").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, keys: Sequence[str], names: Sequence[str], word: str, value: str) -> DataFrame:
    """Sparse (keys, word, value) -> one fixed-length vector per key in ``names`` order."""
    found = F.map_from_entries(F.collect_list(F.struct(F.col(word), F.col(value).cast("double"))))
    order = F.array(*[F.lit(n) for n in names])
    packed = counts.groupBy(*keys).agg(found.alias("_m"))
    return packed.select(*keys, F.transform(order, lambda n: F.coalesce(F.col("_m")[n], F.lit(0.0))).alias("vec"))


def word_vectors(panel: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """``item, vec``: each item's counts of the words, straight from its text; one row per item."""
    if len(BASES) ** k <= WIDE:
        return panel.select("item", _vectors(F.col("seq"), names, k, BASES).alias("vec"))
    return _dense(_counted(panel, "item", word_counts("seq", k)), ["item"], names, "w", "n")


def with_likelihood_fields(scores: DataFrame, lengths: DataFrame, tokens: Column, base: Column) -> DataFrame:
    """ell_per_base = sum / length and bpb = -ell / ln 2 beside the raw sum."""
    out = scores.join(lengths, "item").withColumn("base_length", base).withColumn("token_length", tokens)
    out = out.withColumn("ell_per_base", F.col("sum_log_p") / F.col("base_length"))
    return out.withColumn("bpb", -F.col("ell_per_base") / math.log(2))


def score_ar(model: DataFrame, panel: DataFrame, k: int = 2, length_override: str | None = None) -> DataFrame:
    """Autoregressive score of every item under every entity.

    Sum of log p(x_t | previous k letters) over t > k. ``panel``: item, seq (non-empty).
    """
    usable = panel.filter(F.length("seq") > 0)
    names = kmer_names(k + 1)
    weights = _dense(model.withColumn("w", F.concat("ctx", "next")), ["entity"], names, "w", "logp")
    items = usable.select("item").join(word_vectors(usable, k + 1, names), "item", "left") if len(names) > WIDE else word_vectors(usable, k + 1, names)
    items = items.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), len(names))))
    scored = dot_products(items.withColumnRenamed("item", "l"), weights.withColumnRenamed("entity", "r"))
    scored = scored.select(F.col("r").alias("entity"), F.col("l").alias("item"), F.col("value").alias("sum_log_p"))
    length = F.length("seq")
    lengths = usable.select("item", length.alias("_t"), (F.col(length_override) if length_override else length).alias("_b"))
    out = with_likelihood_fields(scored, lengths, F.col("_t"), F.col("_b"))
    out = out.withColumn("predictable_tokens", F.greatest(F.col("_t") - 1, F.lit(1)))
    return out.withColumn("ce_loss", -F.col("sum_log_p") / F.col("predictable_tokens")).drop("_t", "_b")


def ar_positions(model: DataFrame, panel: DataFrame, k: int = 2, pairs: DataFrame | None = None) -> DataFrame:
    """Per-position log-probabilities in long form: ``entity, item, pos, logp``; with ``pairs`` (entity, item) for these only.

    With ``pairs``, an entity's model meets its items' texts as one map before they are taken apart, so no row per position is shuffled or sorted.
    """
    keyed = model.select("entity", F.concat("ctx", "next").alias("w"), "logp")
    if pairs is None:
        words = panel.select("item", F.posexplode_outer(windows("seq", k + 1)).alias("_i", "w"))
        return words.join(keyed, "w").select("entity", "item", (F.col("_i") + k).alias("pos"), "logp")
    whole = keyed.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("w", "logp"))).alias("_m"))
    met = panel.select("item", "seq").join(pairs.select("entity", "item"), "item").join(whole, "entity")
    scored = F.transform(windows("seq", k + 1), lambda w: F.when(F.map_contains_key("_m", w), F.struct(F.element_at("_m", w).alias("logp"))))
    rows = met.select("entity", "item", F.posexplode_outer(scored).alias("_i", "_p")).filter(F.col("_p").isNotNull())
    return rows.select("entity", "item", (F.col("_i") + k).alias("pos"), F.col("_p.logp").alias("logp"))


def _edged(seq: str) -> Column:
    return F.concat(F.lit(EDGE_LEFT), F.col(seq), F.lit(EDGE_RIGHT))


def triple_names() -> list[str]:
    return [a + c + b for a in BASES + EDGE_LEFT for c in BASES for b in BASES + EDGE_RIGHT]


def fit_masked(seqs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``entity, lft, mid, rgt, n, logp``: smoothed log p(mid | left, right) per entity."""
    usable = seqs.filter(F.length("seq") > 0)
    full = _model_counts(usable, _edged("seq"), triple_names(), 3, BASES + EDGE_LEFT + EDGE_RIGHT)
    full = full.select("entity", F.substring("w", 1, 1).alias("lft"), F.substring("w", 2, 1).alias("mid"), F.substring("w", 3, 1).alias("rgt"), "n")
    total = F.sum("n").over(Window.partitionBy("entity", "lft", "rgt"))
    return full.withColumn("logp", F.log((F.col("n") + alpha) / (total + alpha * len(BASES))))


def masked_passes(n: Column, stride: int) -> Column:
    """Passes the stride schedule makes: one per position for 1, else the used offsets."""
    return n if stride == 1 else F.least(n, F.lit(stride))


def score_pll(model: DataFrame, panel: DataFrame, stride: int = 6, content_length: str | None = None) -> DataFrame:
    """Pseudo-log-likelihood: every content position once, given its visible neighbours.

    Neighbours are one letter each side; masking every ``stride``-th position (stride >= 2)
    or single positions (stride 1) leaves both visible, so the sum does not depend on the
    stride. ``content_length`` names a column that restricts scoring to a prefix.
    """
    if stride < 1:
        raise ValueError(f"stride must be >= 1, got {stride}")
    usable = panel.filter(F.length("seq") > 0)
    names = triple_names()
    size = F.length("seq")
    n = F.least(F.col(content_length), size) if content_length else size
    edged = F.substring(_edged("seq"), F.lit(1), n + 2)
    items = usable.select("item", _vectors(edged, names, 3, BASES + EDGE_LEFT + EDGE_RIGHT).alias("vec"))
    weights = _dense(model.withColumn("w", F.concat("lft", "mid", "rgt")), ["entity"], names, "w", "logp")
    scored = dot_products(items.withColumnRenamed("item", "l"), weights.withColumnRenamed("entity", "r"))
    scored = scored.select(F.col("r").alias("entity"), F.col("l").alias("item"), F.col("value").alias("sum_log_p"))
    lengths = usable.select("item", size.cast("int").alias("_t"), n.cast("int").alias("_b"))
    out = with_likelihood_fields(scored, lengths, F.col("_t"), F.col("_b"))
    out = out.withColumn("stride", F.lit(stride)).withColumn("content_position_count", F.col("_b")).withColumn("masked_position_count", F.col("_b"))
    return out.withColumn("n_passes", masked_passes(F.col("_b"), stride)).drop("_t", "_b")


def score_panel(panel: DataFrame, scorer: Callable[[], Callable[[str], dict]], fields: str, seq: str = "sequence") -> DataFrame:
    """Score rows with a user scorer inside Spark tasks.

    ``scorer()`` is called once per task and returns ``score(text) -> dict`` with the columns
    named in the DDL string ``fields``. All other columns are carried; a failing row gets
    null fields and the message in ``scoring_error``.
    """
    added = T.StructType.fromDDL(fields)
    carried = [f for f in panel.schema.fields if f.name != seq]
    names = [f.name for f in added.fields]
    schema = T.StructType([*carried, *added.fields, T.StructField("scoring_error", T.StringType())])

    def run(batches):
        score = scorer()
        for pdf in batches:
            rows, errors = [], []
            for text in pdf[seq]:
                try:
                    rows.append(score(text))
                    errors.append("")
                except Exception as exc:  # noqa: BLE001 - any scorer failure is a row result
                    rows.append({})
                    errors.append(f"{type(exc).__name__}: {exc}")
            out = pdf.drop(columns=[seq])
            for name in names:
                out[name] = pd.Series([r.get(name) for r in rows], index=out.index, dtype=object)
            out["scoring_error"] = errors
            yield out

    return panel.mapInPandas(run, schema)


def mean_pool(tokens: DataFrame, key: Sequence[str], vec: str = "vec", mask: str | None = None) -> DataFrame:
    """Mean of token vectors over content tokens, one vector per key; a null component does not count. Vectors of one table share a length."""
    rows = tokens.filter(F.col(mask)) if mask else tokens
    values = F.transform(vec, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    there = F.transform(vec, lambda x: x.isNotNull().cast("double"))
    total = _summed(rows.filter(F.col(vec).isNotNull()).select(*key, F.concat(values, there).alias("_v")), key, "_v")
    half = F.size("vec") / 2
    sums, counts = F.slice("vec", F.lit(1), half.cast("int")), F.slice("vec", (half + 1).cast("int"), half.cast("int"))
    return total.select(*key, F.zip_with(sums, counts, lambda s, n: F.when(n > 0, s / n)).alias("features"))


def concat_layers(pooled: DataFrame, key: Sequence[str], layer: str) -> DataFrame:
    """Per-layer means joined end to end in layer order."""
    packed = F.sort_array(F.collect_list(F.struct(layer, "features")))
    return pooled.groupBy(*key).agg(packed.alias("_l")).select(*key, F.flatten(F.col("_l.features")).alias("features"))


def embed_split(df: DataFrame, vector: Column, key: str, label: str) -> DataFrame:
    """One vector per row; rows whose vector failed become all-null vectors of the size.

    The size is the one every successful row has; differing sizes or no success raise.
    """
    rows = df.select(key, F.col(label).alias("label"), vector.alias("features"))
    size = F.array_size("features")
    bounds = rows.agg(F.struct(F.min(size).alias("lo"), F.max(size).alias("hi")).alias("s"))
    same = F.coalesce(F.col("_s.lo") == F.col("_s.hi"), F.lit(False))
    message = F.lit("vectors of one split must share one size")
    dim = F.when(same, F.col("_s.lo")).otherwise(F.raise_error(message).cast("int"))
    filled = F.coalesce("features", F.array_repeat(F.lit(None).cast("double"), F.col("_dim")))
    sized = rows.withColumn("_s", bounds.scalar()).withColumn("_dim", dim)
    return sized.select(key, "label", F.when(F.col("_dim") > 0, filled).alias("features"))
