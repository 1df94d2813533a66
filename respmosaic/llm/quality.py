"""Quality classifier by hierarchical empirical Bayes.

A document's evidence is a sum of log likelihood ratios of binned text statistics, learned from labels by grouped counts.
Its prior comes from its site: the mean quality of a host is shrunk toward the global mean, that of a path toward its
host, each by a strength that the method of moments estimates from the spread between sites. Everything that is learned is an
aggregate over all rows; only the table of (statistic, bin) ratios, whose size is fixed, reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.storage import store

#: Upper bin edges of every statistic of a text (fixed, so that bins mean the same on any data).
EDGES = {
    "words": (0, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096),
    "word_length": (2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0, 14.0),
    "symbols": (0.0, 0.002, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6),
    "capitals": (0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "repeats": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "line_words": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0),
}
#: Pseudo-count of every bin; share of the summed evidence that counts, since the statistics overlap; bounds of a site's strength.
SMOOTH, WEIGHT, STRENGTH = 4.0, 0.7, (2.0, 1000.0)
#: Documents below this posterior are rejected.
REJECT = 0.25

_VALUES = chunks.byte_values(fold_case=True)
_SYMBOL = ~chunks.class_table("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()"))
_CAPITAL = ~chunks.class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = ~chunks.class_table("0123456789")


def _share(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(total, 1)


def bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bin of every statistic (rows) for every text (columns)."""
    starts, ends, first = chunks.words(data, offsets, chunks.SPACED)
    count = np.diff(first)
    h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.bincount(owner[order][1:][same], minlength=len(count))
    size = np.bincount(owner, ends - starts, len(count))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stats = (
        count,
        size / np.maximum(count, 1),
        _share(_SYMBOL, data, offsets, size),
        _share(_CAPITAL, data, offsets, size),
        _share(_DIGIT, data, offsets, size),
        again / np.maximum(count, 1),
        count / (lines[offsets[1:]] - lines[offsets[:-1]] + 1),
    )
    return np.stack([np.searchsorted(np.array(e), s, "left") for e, s in zip(EDGES.values(), stats)]).astype(np.int8)


def _map(docs: DataFrame, text_col: str, schema: T.StructType, names: list[str], columns) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, text_col):
                kept = [rows.column(rows.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *columns(bins(data, offsets))], names=schema.names)

    return docs.mapInArrow(scan, schema)


def ratios(binned: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[dict[tuple[int, int], float], float]:
    """Log likelihood ratio of every (statistic, bin) and the smoothed global share of label 1.

    Grouped counts over all labelled rows; a null id or label counts nowhere; an id that is labelled more than once has its lowest label; without labels every ratio is 0 and the share 1.
    """
    marked = labels.select(F.col("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    rows = binned.join(marked, "id").select("y", F.posexplode("bins").alias("stat", "bin")).groupBy("stat", "bin", "y").count().collect()
    total = {y: sum(r["count"] for r in rows if r["stat"] == 0 and r["y"] == y) for y in (0, 1)}
    if not rows or not all(total.values()):
        return {}, 1.0
    got = {(r["stat"], r["bin"], r["y"]): r["count"] for r in rows}
    out = {}
    for s, edges in enumerate(EDGES.values()):
        k = len(edges) + 1
        for b in range(k):
            share = [(got.get((s, b, y), 0) + SMOOTH / k) / (total[y] + SMOOTH) for y in (0, 1)]
            out[s, b] = round(WEIGHT * math.log(share[1] / share[0]), 9)
    return out, (total[1] + 1) / (sum(total.values()) + 2)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame) -> float:
    """Pseudo-documents of the prior, by the method of moments over sites of two documents or more."""
    r = sites.where("n >= 2").agg(F.sum("n"), F.sum("s"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("q"), F.count(F.lit(1)), F.sum(F.col("n") * F.col("n"))).first()
    if not r[0] or r[4] < 2:
        return STRENGTH[1]
    n, mean = float(r[0]), float(r[1]) / float(r[0])
    between = float(r[2]) - n * mean * mean
    within = max(float(r[3]) - float(r[2]), 0.0) / max(n - r[4], 1.0)
    spread = (between - (r[4] - 1) * within) / max(n - float(r[5]) / n, 1e-9)
    return float(min(max(within / spread if spread > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1]))


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``struct row`` (the input row as it is), ``evidence``, ``site_prior`` and ``quality`` (0 to 1), one row per input row.

    A null host or path is a site of its own. A null text counts as empty. A text's own evidence is taken out of its site's mean before that
    mean becomes its prior. Repeated rows are judged alike, and each counts in its site.
    """
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[host_col].cast("string").alias("host"), docs[path_col].cast("string").alias("path"), docs[text_col].alias("body")
    )
    slim = packed.select("id", "host", "path", "body")
    schema = T.StructType([slim.schema["id"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("bins", T.ArrayType(T.ByteType()))])
    binned = store(_map(slim, "body", schema, ["id", "host", "path"], lambda b: [pa.array(b.T.tolist(), pa.list_(pa.int8()))]), "quality-bins")
    table, share = ratios(binned, labels.select(F.col(id_col).alias("id"), F.col(label_col)), label_col)
    width = max(len(e) for e in EDGES.values()) + 1
    flat = [table.get((s, b), 0.0) for s in range(len(EDGES)) for b in range(width)]
    base = math.log(share / (1 - share)) if 0 < share < 1 else 20.0

    ratio = F.array(*[F.lit(x) for x in flat])
    evidence = F.aggregate(F.transform("bins", lambda b, i: F.element_at(ratio, (i * width + b + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    known = binned.select("host", "path", evidence.alias("e")).withColumn("p", 1 / (1 + F.exp(-(F.col("e") + base))))
    paths = known.groupBy("host", "path").agg(F.sum(F.round("p", 9).cast("decimal(28,9)")).cast("double").alias("s"), F.sum(F.round(F.col("p") * F.col("p"), 9).cast("decimal(28,9)")).cast("double").alias("q"), F.count(F.lit(1)).alias("n"))
    paths = store(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    k_host, k_path = _strength(hosts), _strength(paths)
    sites = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select(
        F.col("p.host").alias("site_host"), F.col("p.path").alias("site_path"), F.col("p.s").alias("ps"), F.col("p.n").alias("pn"), F.col("h.s").alias("hs"), F.col("h.n").alias("hn")
    )
    sites = store(sites, "quality-sites")

    flat_array = np.array(flat).reshape(len(EDGES), width)
    stats = list(range(len(EDGES)))
    full = packed.select("row", "host", "path")
    out_schema = T.StructType([*[full.schema[c] for c in ("row", "host", "path")], T.StructField("evidence", T.DoubleType())])
    scored = _map(full, f"row.{text_col}", out_schema, ["row", "host", "path"], lambda b: [pa.array(np.round(sum(flat_array[s][b[s]] for s in stats), 9))])
    own = F.round(1 / (1 + F.exp(-(F.col("evidence") + base))), 9)
    host_mean = (F.col("hs") - own + k_host * share) / (F.col("hn") - 1 + k_host)
    path_mean = (F.col("ps") - own + k_path * host_mean) / (F.col("pn") - 1 + k_path)
    prior = F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    joined = joined.withColumn("site_prior", F.round(prior, 6))
    return joined.withColumn("quality", F.round(1 / (1 + F.exp(-(F.col("evidence") + _logit(prior)))), 6)).select("row", "evidence", "site_prior", "quality")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = REJECT, **columns: str) -> DataFrame:
    """The documents whose posterior reaches ``threshold``, with their own columns only."""
    return classify(docs, labels, **columns).where(F.col("quality") >= threshold).select("row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: evidence, site prior, posterior and decision."""
    out = classify(docs.select("doc_id", "text", "lang", "source"), labels)
    return out.select("row.doc_id", "evidence", "site_prior", "quality", (F.col("quality") >= REJECT).alias("kept"))
