"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded labelled sample is fitted in shards (one by default) with per-coordinate rates and L1 sparsity; the mean of their weights is a
compact vector of at most ``2 ** BITS`` floats, which is broadcast and applied to every text in one scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.sampling import bounded, remainder

#: Feature buckets are 2 ** BITS; labelled rows that are fitted; shards fitted apart.
BITS, SAMPLE, SHARDS = 20, 16_000, 1
#: Rates and penalties of FTRL-proximal; passes over a shard.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 6.0, 0.0, 4

_VALUES = chunks.byte_values(fold_case=True)
#: Gaps between the words of a feature: single words, pairs, triples, and pairs that skip one or two words.
PATTERNS = ((), (1,), (1, 2), (2,), (3,))


def buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, bucket)`` of every feature of every text, repeats included."""
    starts, ends, first = chunks.words(data, offsets, chunks.ALPHANUMERIC)
    h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    texts, found = [], []
    for k, gaps in enumerate(PATTERNS):
        reach = gaps[-1] if gaps else 0
        n = max(0, len(h) - reach)
        mixed = h[:n] + np.uint64(k + 1)
        for j, g in enumerate(gaps):
            mixed = mixed + h[g : g + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        inside = owner[:n] == owner[reach : reach + n]
        texts.append(owner[:n][inside])
        found.append((chunks.mix(mixed[inside]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(found)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of one shard (the last is the bias): presence features, one proximal step per text."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, L1)
    penalty[-1] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= penalty[i], 0.0, -(z[i] - np.sign(z[i]) * penalty[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, y in zip(examples, labels):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, shards: int = SHARDS, bits: int = BITS) -> np.ndarray | None:
    """Mean weights over the shards; None without labelled rows of both classes.

    At most about ``sample`` labelled rows are fitted (chosen by a hash of the id). Rows with a null id, label or text are left out.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = F.broadcast(bounded(marked, "id", sample))  # at most about ``sample`` rows of 12 bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(marked, "id")
    schema = "bucket long, weight double, y long, n long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["text"], pdf["id"].to_numpy() * 0x9E3779B1 % (1 << 32)))]
        examples = []
        for text in pdf["text"]:
            raw = np.frombuffer(text.encode(), np.uint8)
            examples.append(np.append(np.unique(buckets(raw, np.array([0, len(raw)]), bits)[1]), 1 << bits))
        w = ftrl(examples, pdf["y"].to_numpy(), bits)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(w[at], 0.0), "y": int(pdf["y"].sum()), "n": len(pdf)})

    fitted = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards))).groupBy("shard").applyInPandas(one, schema)
    mean = fitted.groupBy("bucket").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c"), F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas()
    total = mean[mean["bucket"] == -1]
    if total.empty or total["y"].item() in (0, total["n"].item()):
        return None
    out = np.zeros((1 << bits) + 1, np.float32)
    kept = mean[mean["bucket"] >= 0].sort_values("bucket")
    out[kept["bucket"].to_numpy()] = np.round(kept["w"].to_numpy() / total["c"].item(), 6)
    return out


def score(docs: DataFrame, weights: np.ndarray | None, text_col: str = "text", score_col: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with a probability appended, one row per input row, from the text alone.

    A null or empty text gets the bias's probability; without a fitted model every score is 0. An existing ``score_col`` is replaced.
    """
    names = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scan(batches):
        w = shared.value
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, text_col):
                n = rows.num_rows
                p = np.zeros(n)
                if w is not None:
                    owner, bucket = buckets(data, offsets, bits)
                    used = w[bucket] != 0
                    pairs = np.unique(owner[used] * (1 << bits) + bucket[used])
                    total = np.bincount(pairs >> bits, w[pairs & ((1 << bits) - 1)], n) + w[-1]
                    p = np.round(1 / (1 + np.exp(-np.clip(total, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(p)], names=[*names, score_col])

    return docs.mapInArrow(scan, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: the fifth of the ids by crc32 is held out of the fit."""
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    weights = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
