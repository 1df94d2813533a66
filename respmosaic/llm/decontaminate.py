"""Benchmark decontamination: broadcast hash set of normalised test n-grams, scanned over token windows.

The hash set is broadcast only in blocks whose size is checked: test texts are cut into blocks of at most ``MAX_WORDS``
words by a running total over bounded groups, and each block makes one pass over the documents.
Hash hits are verified word by word against the block's words before they count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks

#: Words of test texts broadcast at once (about 40 bytes each).
MAX_WORDS = 2_000_000

_VALUES = chunks.byte_values(fold_case=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class TestSet:
    """Windows of one length of a block of test items: sorted hashes, one place per hash where the words stand, and the items that hold it.

    ``more`` has the further ``(place, items)`` of the few hashes that different windows share.
    """

    length: int
    hashes: np.ndarray
    place: np.ndarray
    items: list[frozenset]
    more: dict[int, list[tuple[int, frozenset]]]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def words(self, place: int) -> list[bytes]:
        return _words(self.data, self.starts, self.ends, place, self.length)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: int, n: int) -> list[bytes]:
    return [_LOWER[data[a:b]].tobytes() for a, b in zip(starts[place : place + n], ends[place : place + n])]


def _table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return (data, offsets, *chunks.words(data, offsets, chunks.ALPHANUMERIC))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of ``n``-word windows that stay inside one text; ``first`` is each text's first word."""
    h = chunks.grams(hashes, n)
    inside = np.zeros(len(hashes) + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - n + 1, first[:-1])
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(h)]) > 0)
    return at, h[at]


def build(rows: list[tuple], n: int) -> list[TestSet]:
    """Test sets by window length: ``n``, and the shorter lengths of items with fewer words."""
    ids = [r[0] for r in rows]
    data, offsets, starts, ends, first = _table([r[1] for r in rows])
    h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
    count, out = np.diff(first), []
    for length in sorted({min(n, int(c)) for c in count if c}):
        pick = np.flatnonzero(count >= n if length == n else count == length)
        at, got = windows(h, first, length)
        owner = np.searchsorted(first, at, "right") - 1
        keep = np.isin(owner, pick)
        at, got, owner = at[keep], got[keep], owner[keep]
        order = np.lexsort((at, got))
        at, owner = at[order], owner[order]
        hashes, begin, size = np.unique(got[order], return_index=True, return_counts=True)
        items, more = [frozenset((ids[owner[k]],)) for k in begin], {}
        for s in np.flatnonzero(size > 1):
            found: dict[tuple, tuple[int, set]] = {}
            for k in range(begin[s], begin[s] + size[s]):
                found.setdefault(tuple(_words(data, starts, ends, at[k], length)), (at[k], set()))[1].add(ids[owner[k]])
            (_, mine), *others = found.values()
            items[s] = frozenset(mine)
            if others:
                more[s] = [(place, frozenset(names)) for place, names in others]
        out.append(TestSet(length, hashes, at[begin], items, more, data, starts, ends))
    return out


def _hits(tests: list[TestSet], data, starts, ends, h, first):
    """Word mask of verified hits and ``{document: set of items}`` (None for items without an id)."""
    mask, items = np.zeros(len(starts) + 1, np.int32), {}
    doc_of = None
    for t in tests:
        at, got = windows(h, first, t.length)
        slot = np.searchsorted(t.hashes, got)
        slot[slot == len(t.hashes)] = 0
        found = np.flatnonzero(t.hashes[slot] == got) if len(t.hashes) else np.zeros(0, np.int64)
        seen: set[tuple[int, int]] = set()
        for p, s in zip(at[found], slot[found]):
            mine = _words(data, starts, ends, p, t.length)
            place = next((k for k, (q, _) in enumerate([(t.place[s], None), *t.more.get(s, ())]) if mine == t.words(q)), None)
            if place is None:
                continue
            mask[p] += 1
            mask[p + t.length] -= 1
            if doc_of is None:
                doc_of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
            d = int(doc_of[p])
            if (d, s) not in seen or place:
                seen.add((d, s))
                items.setdefault(d, set()).update(t.more[s][place - 1][1] if place else t.items[s])
    return np.cumsum(mask[:-1]) > 0, items


def _pieces(tests: DataFrame, n: int, max_words: int) -> DataFrame:
    """Each ``(i, t)`` once; texts of many words in pieces that share ``n - 1`` words, so that every window stands in one piece."""
    step = max(1, max_words // 4)

    def cut(frames):
        for pdf in frames:
            out = []
            for i, t in zip(pdf["i"], pdf["t"]):
                data, _, starts, ends, _ = _table([t])
                for k in range(0, max(1, len(starts) - n + 1), step):
                    last = min(len(starts), k + step + n - 1)
                    out.append((i, data[starts[k] : ends[last - 1]].tobytes().decode()) if last > k else (i, ""))
            yield pd.DataFrame(out, columns=["i", "t"])

    long = F.length("t") > 4 * step  # shorter ones cannot have more words than a piece
    if tests.where(long).isEmpty():
        return tests.distinct()
    return tests.where(~long).unionAll(tests.where(long).mapInPandas(cut, "i string, t string")).distinct()


def _blocks(pieces: DataFrame, limit: int) -> tuple[int, list[list[int]]]:
    """Number of hash bins, and groups of bins whose texts stay under ``limit`` characters, but for one bin that alone holds more."""
    load = F.greatest(F.lit(1), F.length("t")).cast("long")
    total = pieces.agg(F.sum(load).alias("n")).first()["n"] or 0
    bins = 16 * (1 + total // limit)
    rows = pieces.groupBy(F.pmod(F.xxhash64("i", "t"), F.lit(bins)).alias("bin")).agg(F.sum(load).alias("n")).collect()  # one number a bin
    out, held = [[]], 0
    for r in sorted(rows):
        if out[-1] and held + r["n"] > limit:
            out.append([])
            held = 0
        out[-1].append(r["bin"])
        held += r["n"]
    return bins, [b for b in out if b]


def find_hits(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", test_text_col: str = "text", n: int = 13, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (array of character [start, end) of hit runs), ``n_hit`` and ``items`` appended.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``n`` consecutive
    words of a test item, or the whole item when it has fewer. A word inside any verified window is hit. ``items`` holds the
    ids (as text, sorted) of test items with a window in the text. Null or empty texts have no words; null test texts
    have no window; test items without an id hit like others and stand in ``items`` as one null, last; repeated test rows count once, and
    long test texts are cut into pieces that share windows. Repeated rows are judged alike; columns of ``docs`` with the new names are replaced.
    """
    spark = docs.sparkSession
    new = ("n_words", "n_hit", "items", "hit_spans")
    kept = docs.select(*[c for c in docs.columns if c not in new])
    src = tests.select(F.col(item_col).cast("string").alias("i"), F.col(test_text_col).alias("t")).where("t is not null")
    src = _pieces(src, n, max_words)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType())))])
    bins, blocks = _blocks(src, 8 * max_words)
    out = None
    for block in blocks or [[]]:
        rows = src.where(F.pmod(F.xxhash64("i", "t"), F.lit(bins)).isin(block)).collect() if block else []
        shared = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in rows], n))
        one = kept.mapInArrow(_scanner(text_col, shared, schema, previous=out is not None), schema)
        out = one
        kept = one
    return (
        out.withColumn("n_hit", F.coalesce(F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
        .drop("hit_words")
        .select(*[c for c in docs.columns if c not in new], *new)
    )


def _scanner(text_col: str, shared, schema: T.StructType, previous: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def scan(batches):
        tests = shared.value
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, text_col):
                starts, ends, first = chunks.words(data, offsets, chunks.ALPHANUMERIC)
                h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
                hit, items = _hits(tests, data, starts, ends, h, first)
                n = rows.num_rows
                found, spans, sizes = [None] * n, [None] * n, [None] * n
                old = rows.to_pydict() if previous else None
                for d in range(n):
                    a, b = first[d], first[d + 1]
                    mine = [(int(starts[x]), int(ends[y - 1]), int(x), int(y)) for x, y in _runs(hit[a:b], a)] if hit[a:b].any() else []
                    begin, text = int(offsets[d]), data[offsets[d] : offsets[d + 1]]
                    runs = _characters(text, [(s - begin, e - begin, y - x) for s, e, x, y in mine])
                    names = set(items.get(d, ()))
                    if previous:
                        runs = _union(runs, old["hit_spans"][d] or [], text)
                        names |= set(old["items"][d] or [])
                    spans[d], sizes[d] = [[s, e] for s, e, _ in runs], [k for *_, k in runs]
                    found[d] = sorted(names, key=lambda x: (x is None, x or ""))
                base = rows.select([f.name for f in target if f.name not in ("n_words", "items", "hit_words", "hit_spans")])
                columns = [*base.columns, pa.array(np.diff(first), pa.int64()), *(pa.array(x, target.field(c).type) for c, x in (("items", found), ("hit_words", sizes), ("hit_spans", spans)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return scan


def _runs(mask: np.ndarray, shift: int):
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(x + shift, y + shift) for x, y in zip(edge[::2], edge[1::2])]


def _characters(text: np.ndarray, runs):
    """Byte spans as character spans."""
    if not runs:
        return []
    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(chars[s]), int(chars[e]), int(k)) for s, e, k in runs]


def _union(runs, old, text: np.ndarray):
    """Union of the spans of two blocks, with their word counts taken anew."""
    whole = text.tobytes().decode()
    merged: list[list[int]] = []
    for s, e in sorted([[s, e] for s, e, _ in runs] + [list(map(int, x)) for x in old]):
        if merged and (s <= merged[-1][1] or not _table([whole[merged[-1][1] : s]])[2].size):
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e, len(_table([whole[s:e]])[2])) for s, e in merged]


def judged(hits: DataFrame, percent: int = 5) -> DataFrame:
    """Adds ``contaminated``: some word is hit and hit words are ``percent`` of all words or more."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def remove_spans(hits: DataFrame, text_col: str = "text") -> DataFrame:
    """Cuts the hit spans out of the text (span form of the decision); other columns stay."""
    pieces = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.struct(F.concat(a["s"], F.substring(text_col, (a["at"] + 1).cast("int"), (x[0] - a["at"]).cast("int"))).alias("s"), x[1].alias("at")),
    )
    cut = F.concat(pieces["s"], F.expr(f"substring(`{text_col}`, cast(aggregate(hit_spans, 0L, (a, x) -> x[1]) + 1 as int))"))
    return hits.withColumn(text_col, F.when(F.size("hit_spans") > 0, cut).otherwise(F.col(text_col)))


def drop_contaminated(docs: DataFrame, tests: DataFrame, text_col: str = "text", n: int = 13, percent: int = 5) -> DataFrame:
    """The documents that are not contaminated, with all their own columns, whatever their names."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return judged(find_hits(packed, tests, f"row.{text_col}", n=n), percent).where(~F.col("contaminated")).select("row.*")


def digest(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per document with the contract's counts and the digest of the items found."""
    hits = judged(find_hits(docs.select("doc_id", "text"), tests))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
