"""Source divergence audit: how differently the sources of a language use its terms, by one-hot level products.

A group (language, source) has a price for a term that depends on the term's count there alone. So what two groups owe each other over
all terms follows from a joint table: how many terms have level ``a`` in one and level ``b`` in the other. The tables of all pairs are the
product of the indicator columns (group, level) with their transpose. It is taken in blocks: bounded blocks of terms of like frequency (rare
terms have few levels, common terms are few) against blocks of sources, in strips of bounded width. Indicators are 0 or 1 and a block has fewer
than 2 ** 24 terms, so single precision is exact. Level 0 has no column: its cells follow from the margins, which are the product's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.storage import store

#: Documents of a language that a kept term occurs in, and rows of part ``term`` in a group.
MIN_DOCS, TOP = 3, 200
#: Terms and sources of a block; columns of a strip.
TERMS, SOURCES, STRIP = 4096, 32, 512
#: Bytes of text counted at once, counts that a task merges before it hands them on, and rows of a batch.
COUNTED, MERGED, HANDED = 1 << 20, 1_000_000, 50_000
#: Fixed by the contract: prices are counted in parts of a billion.
UNIT = 1_000_000_000

#: Fixed: terms are letters a-z, A-Z and everything beyond ASCII.
_TERM = chunks.class_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
_VALUES = chunks.byte_values(fold_case=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased byte spans as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    return chunks.text_array(_LOWER[data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]], offsets)


class _Tally:
    """Counts of a task by group and term, merged when many have gathered and handed on when the merged ones are many."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, first = chunks.words(data, offsets, _TERM)
        if not len(starts):
            return
        pairs = zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.uint64)
        text = np.repeat(np.arange(rows.num_rows), np.diff(first))
        h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
        # once per text and term, then once per group and term
        _, one, n = np.unique(chunks.mix(h + (text.astype(np.uint64) + np.uint64(1)) * _ODD), return_index=True, return_counts=True)
        g = group[text[one]]
        key, at, back = np.unique(chunks.mix(h[one] + (g + np.uint64(1)) * _ODD), return_index=True, return_inverse=True)
        term = one[at]
        self.parts.append((key, g[at], np.bincount(back, n, len(at)), np.bincount(back, minlength=len(at)).astype(float), _gather(data, starts[term], ends[term])))
        self.held += len(key)

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        key, g, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        terms = pa.concat_arrays([p[4] for p in self.parts])
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        self.parts = [(key, g[at], np.bincount(back, n, len(at)), np.bincount(back, docs, len(at)), terms.take(pa.array(at)))]
        self.held = len(key)

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        names = [pa.array([p[k] for p in self.groups], pa.string()) for k in (0, 1)]
        for _, g, n, docs, terms in self.parts:
            index = pa.array(g.astype(np.int64))
            full = [*(c.take(index) for c in names), terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))]
            batch = pa.RecordBatch.from_arrays(full, names=["lang", "source", "term", "n", "docs"])
            yield from (batch.slice(i, HANDED) for i in range(0, batch.num_rows, HANDED))
        self.groups, self.parts, self.held = {}, [], 0


def _counter(batches):
    """Counts of terms by group, merged inside a task; Spark adds up the tasks."""
    tally = _Tally()
    for batch in batches:
        for rows, data, offsets in chunks.slices(batch, "text", COUNTED):
            tally.add(rows, data, offsets)
            if tally.held > 2 * MERGED:
                tally.merge()
            if tally.held > MERGED:
                yield from tally.hand_on()
    yield from tally.hand_on()


def kept_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, total)``: positive counts of the terms that ``min_docs`` documents of the language hold; ``total`` is the language's.

    Words are told apart by 64-bit hashes inside a task, and by their letters across tasks. The merged counts of the tasks are shuffled once, by
    language and term: a term has one row per task and source there, however often it occurs.
    """
    named = docs.select(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = named.mapInArrow(_counter, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"total": F.sum("n").over(term), "docs": F.sum("docs").over(term)})
    return summed.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total")


def group_sizes(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, size, whole, terms)`` of every occurring group: its kept words, the language's, and the language's kept terms."""
    groups = docs.select(*[F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("terms"))
    return groups.join(own, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["size", "whole", "terms"])


def _product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Non-zero cells of one block: indicator columns of (source, level) times their transpose."""
    lang, low, high = key[0], key[-2], key[-1]
    term, names = pd.factorize(rows["term"])
    columns = rows[["source", "n", "side"]].drop_duplicates().sort_values(["source", "n"], ignore_index=True)
    column = rows[["source", "n"]].merge(columns.reset_index(), on=["source", "n"], how="left")["index"].to_numpy()
    x = np.zeros((len(names), len(columns)), np.float32)
    x[term, column] = 1.0
    source, side = pd.factorize(columns["source"])[0], columns["side"].to_numpy()
    found = []
    for at in range(0, len(columns), STRIP):
        cells = x[:, at : at + STRIP].T @ x
        a, b = np.nonzero(cells)
        n = cells[a, b].astype(np.int64)
        a = a + at
        if low == high:
            keep = (source[a] < source[b]) | (a == b)  # each pair of sources once; the diagonal holds the margins
        else:
            keep = (side[a] == low) & (side[b] == high)
        found.append((a[keep], b[keep], n[keep]))
    a, b, n = (np.concatenate(f) for f in zip(*found))
    name, level = columns["source"].to_numpy(), columns["n"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": name[a], "level": level[a], "other": name[b], "other_level": level[b], "terms": n})


def joint_tables(kept: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``(lang, source, level, other, other_level, terms)``: terms with these positive counts in both sources of a language.

    Each pair of different sources occurs once, in either order; a source with itself has its margin (``level`` = ``other_level``).
    """
    scale = F.floor(F.log2("total")).cast("int").alias("scale")
    height = lambda s: F.greatest(F.lit(64), F.lit(terms) / F.pow(F.lit(2.0), F.greatest(F.lit(0), s - 4)))
    rows = kept.select("lang", "source", "term", "n", scale)
    spread = rows.groupBy("lang", "scale", "term").agg(F.lit(1).alias("one")).groupBy("lang", "scale").agg(F.ceil(F.count(F.lit(1)) / height(F.col("scale"))).cast("int").alias("blocks"))
    spread = store(spread, "term-blocks")  # a few rows a language; read from files, its size is known before the join is planned
    wide = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("sides"))
    wide = store(wide, "source-blocks")
    dealt = rows.join(spread, ["lang", "scale"]).join(wide, "lang")
    dealt = dealt.select("lang", "scale", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("side"), "sides")
    met = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    met = met.select("lang", "scale", "block", "source", "term", "n", "side", F.least("side", "met").alias("low"), F.greatest("side", "met").alias("high"))
    schema = "lang string, source string, level long, other string, other_level long, terms long"
    cells = met.groupBy("lang", "scale", "block", "low", "high").applyInPandas(_product, schema)
    return cells.groupBy("lang", "source", "level", "other", "other_level").agg(F.sum("terms").alias("terms"))


def price(count: str | Column, size: str | Column, terms: str | Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (size + terms))``."""
    c, s, t = (F.col(x) if isinstance(x, str) else x for x in (count, size, terms))
    return F.call_function("div", (c + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (s + t).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def pair_values(joint: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of different sources of a language, priced from the joint tables.

    A cell counts what its two levels add to the prices of level 0; margins add one level each; all terms start at level 0 in both.
    """
    mine = sizes.select("lang", "source", F.col("size").alias("s"), "terms")
    yours = sizes.select("lang", F.col("source").alias("item"), F.col("size").alias("t"))
    zero = F.lit(0).cast("long")
    p0, q0 = price(zero, "s", "v"), price(zero, "t", "v")
    pairs = mine.withColumnRenamed("terms", "v").join(yours, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.when(F.col("v") == 0, F.lit(0)).otherwise(_big(F.col("v")) * _big(gap(p0, q0))).cast("decimal(38,0)").alias("value"))
    margins = joint.where("source = other").select("lang", "source", F.col("level").alias("a"), F.col("terms").alias("n"))
    pa_, qb = price("a", "s", "v"), price("a", "t", "v")
    own = margins.join(pairs, ["lang", "source"]).select("lang", "source", "item", (_big(F.col("n")) * _big(gap(pa_, q0) - gap(p0, q0))).alias("value"))
    other = margins.withColumnRenamed("source", "item").join(pairs, ["lang", "item"]).select("lang", "source", "item", (_big(F.col("n")) * _big(gap(p0, qb) - gap(p0, q0))).alias("value"))
    cells = joint.where("source <> other").withColumnRenamed("other", "item").withColumnRenamed("terms", "n")
    cells = cells.join(mine.withColumnRenamed("terms", "v"), ["lang", "source"]).join(yours, ["lang", "item"])
    pc, qc = price("level", "s", "v"), price("other_level", "t", "v")
    priced = cells.select("lang", "source", "item", _big(F.col("n")).alias("n"), pc.alias("p"), qc.alias("q"), p0.alias("p0"), q0.alias("q0"))
    p, q, z, y = (F.col(c) for c in ("p", "q", "p0", "q0"))
    there = priced.select("lang", "source", "item", (F.col("n") * _big(gap(p, q) - gap(p, y) - gap(z, q) + gap(z, y))).alias("value"))
    back = priced.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * _big(gap(q, p) - gap(q, z) - gap(y, p) + gap(y, z))).alias("value"))
    parts = [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in (base, own, other, there, back)]
    return reduce(DataFrame.unionAll, parts).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: terms that a group holds and prices above its language."""
    priced = kept.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), price("n", "size", "terms").alias("p"), price("total", "whole", "terms").alias("q"))
    return priced.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all other sources of a group, and its ``top`` terms, both by value and then item.

    Null texts, languages and sources count as empty. A language without kept terms has pairs of value 0; a group without terms is
    priced by level 0 throughout; a language with one source has no pairs. Repeated rows count as documents of their own; no documents, no rows.
    """
    kept = store(kept_counts(docs, text_col, lang_col, source_col, min_docs), "kept-counts")
    sizes = store(group_sizes(docs, kept, lang_col, source_col), "group-sizes")
    joint = store(joint_tables(kept), "joint-tables")
    order = "PARTITION BY lang, source ORDER BY value DESC, item"
    ranked = lambda df, part: df.selectExpr("lang", "source", f"'{part}' AS part", "item", "value", f"cast(row_number() OVER ({order}) AS int) AS rank")
    return ranked(pair_values(joint, sizes), "pair").unionAll(ranked(term_values(kept, sizes), "term").where(F.col("rank") <= top))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    return audit(docs.select("doc_id", "text", "lang", "source"))
