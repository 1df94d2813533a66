"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Texts with equal shingle sets are one class. Two classes can only link when they share a shingle among the first
``n - ceil(0.8 n) + 1`` of each, in one order of all shingles (rare ones before those that many texts share), so a tile is what shares
such a shingle, sorted by set size: only sizes within 4 : 5 meet. Bitmap signatures bound the overlap of a pair from
above (a bit that one has and the other lacks is a shingle not shared); pairs that pass are decided by intersecting the exact sets.

Tiles of up to ``SMALL`` classes give all their pairs. A larger tile gives each member's pairs with the leader of its size band and with
its neighbours in a few orders only; most such tiles are then one component and need no more. Those that are not are cut into bounded blocks,
and only pairs across components are tested. That gives the components; the other pairs of large tiles lie inside them and are tested last,
each once, by exact sets in bounded blocks of a component. No link is lost: every pair that could link is tested.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm import chunks
from respmosaic.llm.components import components
from respmosaic.llm.storage import remove, store, store_at

#: Words of a shingle; the link is 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 80
#: Classes of a tile that give all pairs; classes of a block of a larger tile.
SMALL, BLOCK = 8, 2048
#: Shingles of a block of a component (8 bytes each; a task holds two blocks).
SHINGLES = 500_000
#: Orders besides that of sizes in which neighbours in a large tile are tested at once.
SHUFFLES = 3
#: Ids (8 bytes each) that are broadcast to pick texts; beyond that the texts are joined by shuffles.
FEW = 1_000_000
#: Shingles ordered last because many texts share them (any list gives right results; 16 bytes each are broadcast).
COMMON = 200_000

_VALUES = chunks.byte_values(fold_case=True)
_LOW = np.uint64((1 << 63) - 1)
_TOP = np.uint64(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, shingle)`` sorted by both, without repeats. A text of fewer words has one shingle, its whole sequence."""
    starts, ends, first = chunks.words(data, offsets, chunks.SPACED)
    h = chunks.span_hash(chunks.prefix_hash(data, _VALUES), starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    full = chunks.grams(h, width)
    inside = owner[: len(full)] == owner[width - 1 :] if len(full) else np.zeros(0, bool)
    texts, found = [owner[: len(full)][inside]], [full[inside]]
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            texts.append(short)
            found.append(chunks.grams(h, k)[first[short]])
    text, shingle = np.concatenate(texts), np.concatenate(found) & _LOW
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return text[new], shingle[new]


def _class_ids(shingle: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """64-bit id of each set, from a commutative sum over its shingles."""
    total = np.zeros(len(shingle) + 1, np.uint64)
    np.cumsum(chunks.mix(shingle), out=total[1:])
    n = np.diff(edges).astype(np.uint64)
    return chunks.mix(total[edges[1:]] - total[edges[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signature_bits(n):
    """Bits of the signature of a set of ``n``: a power of two from ``4 n`` to ``8 n``, so that few shingles share a bit."""
    return 1 << (2 + np.clip(np.ceil(np.log2(np.maximum(n, 1))), 4, 18)).astype(np.int64)


def signatures(shingle: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Bitmap of each set; bit ``shingle mod size`` is on, so a larger bitmap folds onto a smaller one by OR."""
    n = np.diff(edges)
    bits = signature_bits(n)
    out = [b""] * len(n)
    for size in np.unique(bits[n > 0]):
        at = np.flatnonzero((bits == size) & (n > 0))
        for part in np.array_split(at, max(1, len(at) * int(size) // (4 << 20))):
            pick = np.repeat(edges[part] - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part]) + np.arange(n[part].sum())
            board = np.zeros((len(part), int(size)), np.uint8)
            board[np.repeat(np.arange(len(part)), n[part]), (shingle[pick] & np.uint64(size - 1)).astype(np.int64)] = 1
            for d, row in zip(part, np.packbits(board, axis=1, bitorder="little")):
                out[d] = row.tobytes()
    return out


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes folded to ``size`` bytes."""
    while bitmap.shape[1] > size:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] | bitmap[:, half:]
    return bitmap


def needed(a, b, percent: int = PERCENT):
    """Smallest intersection that links sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def _common(docs: DataFrame, text_col: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many texts share, and their ranks (the most shared last). At most ``limit``."""

    def count(batches):
        held, texts, total = [], 0, 0

        def flush():
            nonlocal held, texts, total
            value, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(4, texts // 2000)
            held, texts, total = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["shingle", "times"])

        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, text_col):
                shingle = shingle_sets(data, offsets)[1]
                held.append(shingle)
                texts, total = texts + rows.num_rows, total + len(shingle)
                if total > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    often = docs.select(text_col).mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = often.orderBy(F.desc("times"), "shingle").limit(limit).toPandas()
    value = top["shingle"].to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(value), dtype=np.uint64)[::-1]
    order = np.argsort(value)
    return value[order], rank[order]


def _sets(docs: DataFrame, text_col: str, id_col: str, common) -> DataFrame:
    """Per document: class id (null without words), set size, and once per task and class its signature and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def scan(batches):
        value, rank = shared.value
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, "body"):
                text, shingle = shingle_sets(data, offsets)
                edges = np.searchsorted(text, np.arange(rows.num_rows + 1))
                n = np.diff(edges)
                node = _class_ids(shingle, edges)
                key = shingle.copy()
                if len(value):
                    slot = np.minimum(np.searchsorted(value, shingle), len(value) - 1)
                    many = value[slot] == shingle
                    key[many] = _TOP | rank[slot[many]]
                key = key[np.lexsort((key, text))].view(np.int64)
                bits = signatures(shingle, edges)
                prefix = []
                for d in range(rows.num_rows):
                    if not n[d] or int(node[d]) in seen:
                        prefix.append(None)
                        bits[d] = None
                        continue
                    if len(seen) < 1_000_000:  # only spares repeats; tiles drop them anyway
                        seen.add(int(node[d]))
                    prefix.append(key[edges[d] : edges[d] + n[d] + (-PERCENT * int(n[d])) // 100 + 1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(node, mask=n == 0), pa.array(n.astype(np.int64)), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "node", "n", "bits", "prefix"]
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(scan, schema)


_RUNS = "big boolean, key long, a long, na long, b long, nb long, place int"
#: Rows of tiles handled at once.
ROWS = 200_000


def _tiles(batches):
    """Pairs of small tiles, leader and neighbour pairs of large ones, and (``big``) the members of large ones.

    Rows come sorted by key, size and class. Only the open tile is carried on; one that outgrows ``ROWS`` is handled in parts, each of which
    starts with the last row of the part before.
    """
    held, rows, open_key = [], 0, None

    def work(final: bool):
        nonlocal held, rows, open_key
        key, n, node, place = (np.concatenate(x) for x in zip(*held))
        last = len(key) if final else int(np.searchsorted(key, key[-1]))
        if last:
            yield from _emit(key[:last], n[:last], node[:last], place[:last], open_key)
            held = [(key[last:], n[last:], node[last:], place[last:])]
        else:
            open_key = key[-1]
            yield from _emit(key, n, node, place, open_key)
            held = [(key[-1:], n[-1:], node[-1:], place[-1:])]
        rows = len(held[0][0])

    for batch in batches:
        held.append(tuple(np.asarray(c) for c in batch.columns))
        rows += batch.num_rows
        if rows >= ROWS:
            yield from work(False)
    if rows:
        yield from work(True)


def _room(na, pa_, nb, pb):
    """Whether two sets can still link if the shingle at these places is the first that they share (if an earlier one is, its tile has the pair)."""
    return np.minimum(na - pa_, nb - pb) >= needed(na, nb)


def _emit(key: np.ndarray, n: np.ndarray, node: np.ndarray, place: np.ndarray, open_key):
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, n, node, place = key[new], n[new], node[new], place[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    big = np.repeat((size > SMALL) | (key[starts] == open_key if open_key is not None else False), size)
    a, b = [], []
    for lag in range(1, min(SMALL, len(key))):
        i = np.flatnonzero((key[:-lag] == key[lag:]) & (~big[lag:] | (lag == 1)))
        a.append(i)
        b.append(i + lag)
    band = np.floor(np.log(n) / np.log(100 / PERCENT)).astype(np.int64)
    leads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
    lead = np.repeat(leads, np.diff(np.append(leads, len(key))))
    member = np.flatnonzero(big)
    for salt in range(1, SHUFFLES + 1):  # neighbours in other orders of the same size band
        turned = member[np.lexsort((chunks.mix(node[member].view(np.uint64) + np.uint64(salt)), band[member], key[member]))]
        near = (key[turned[1:]] == key[turned[:-1]]) & (band[turned[1:]] == band[turned[:-1]])
        a.append(np.minimum(turned[1:], turned[:-1])[near])
        b.append(np.maximum(turned[1:], turned[:-1])[near])
    a, b = np.concatenate([*a, lead[member]]), np.concatenate([*b, member])
    fits = (node[a] != node[b]) & _room(n[a], place[a], n[b], place[b])
    a, b = a[fits], b[fits]
    low, high = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
    pairs = np.unique(np.stack([node[low], n[low], node[high], n[high]]), axis=1)
    k, m = pairs.shape[1], len(member)
    if k + m:
        none = lambda x: pa.nulls(x, pa.int64())
        names = ["big", "key", "a", "na", "b", "nb", "place"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, bool)), none(k), *map(pa.array, pairs), pa.nulls(k, pa.int32())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(key[member]), pa.array(node[member]), pa.array(n[member]), none(m), none(m), pa.array(place[member].astype(np.int32))], names=names)


def _bound(na: int, nb: int, x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound of the overlap from two bitmaps of one size."""
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _possible(batches):
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        na, nb = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("na", "nb"))
        want = needed(na, nb)
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(batch.schema.get_field_index("bits_a")), batch.column(batch.schema.get_field_index("bits_b")))):
            x, y = (np.frombuffer(v.as_py(), np.uint8)[None] for v in (x, y))
            size = min(x.shape[1], y.shape[1])
            keep.append(_bound(na[i], nb[i], fold(x, size), fold(y, size)) >= want[i])
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "na", "b", "nb"])


def _linked(batches):
    """Pairs whose sorted arrays intersect enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(batch.schema.get_field_index("set_a")), batch.column(batch.schema.get_field_index("set_b"))):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text_col: str, id_col: str, used: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, na, b, nb)`` that link: bitmaps first, then the exact sets of what is left; and those sets, whose folder goes to ``used``."""
    bits = sets.where("bits is not null").groupBy("node").agg(F.min("bits").alias("bits"))
    side = lambda c: bits.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"))
    left, left_at = store_at(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible, "a long, na long, b long, nb long"), "join-possible")
    wanted = left.select(F.col("a").alias("node")).unionAll(left.select("b")).distinct()
    holders = sets.where("id is not null").join(wanted, "node").groupBy("node").agg(F.min("id").alias("id"))
    holders, holders_at = store_at(holders, "join-holders")

    def exact(batches):
        for batch in batches:
            for rows, data, offsets in chunks.slices(batch, "body"):
                text, shingle = shingle_sets(data, offsets)
                edges = np.searchsorted(text, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(shingle, edges)), pa.array([shingle[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())], ["node", "set"])

    ids = holders.select("id").distinct()
    ids = F.broadcast(ids) if holders.count() <= FEW else ids  # few enough to send to every task; else both sides are dealt by id
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(ids, "id", "left_semi")
    arrays = texts.select("body").mapInArrow(exact, "node long, set binary").join(holders.select("node"), "node", "left_semi")
    arrays, arrays_at = store_at(arrays.dropDuplicates(["node"]), "join-arrays")
    one = lambda c: arrays.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    links = store(left.select("a", "b").join(one("a"), "a").join(one("b"), "b").mapInArrow(_linked, "a long, b long"), "join-links")
    remove(docs.sparkSession, left_at, holders_at)
    used.append(arrays_at)
    return links, arrays


def _across(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Candidate pairs across components in large tiles, from bounded blocks; None where no large tile spans two."""
    named = members.join(roots.withColumnRenamed("node", "a"), "a", "left").select("key", F.col("a").alias("node"), F.col("na").alias("n"), "place", F.coalesce("root", "a").alias("root"))
    named = store(named, "join-members")
    open_tiles = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    open_tiles = store(open_tiles.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "join-open")
    if open_tiles.isEmpty():
        return None
    bits = sets.where("bits is not null").groupBy("node").agg(F.min("bits").alias("bits"))
    rows = named.join(open_tiles, "key").join(bits, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "place", "root", "bits"
    )

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values(["n", "node"])
        own = pdf["own"].to_numpy()
        i, j = own == own.min(), own == own.max()
        n, node, root, place = (pdf[c].to_numpy() for c in ("n", "node", "root", "place"))
        raw = [np.frombuffer(x, np.uint8) for x in pdf["bits"]]
        size = min(map(len, raw))
        board = np.concatenate([fold(x[None], size) for x in raw])
        found = []
        for x in np.flatnonzero(i):
            other = np.flatnonzero(j & (root != root[x]) & _room(n[x], place[x], n, place))
            most = np.minimum(n[x] - np.bitwise_count(board[x] & ~board[other]).sum(1), n[other] - np.bitwise_count(board[other] & ~board[x]).sum(1))
            other = other[most >= needed(n[x], n[other])]
            found.append(pd.DataFrame({"a": node[x], "na": n[x], "b": node[other], "nb": n[other]}))
        out = pd.concat(found) if found else pd.DataFrame({"a": [], "na": [], "b": [], "nb": []})
        flip = out["a"] > out["b"]
        out.loc[flip, ["a", "na", "b", "nb"]] = out.loc[flip, ["b", "nb", "a", "na"]].to_numpy()
        return out

    return dealt.groupBy("key", "i", "j").applyInPandas(test, "a long, na long, b long, nb long").distinct()


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between blocks ``i`` and ``j`` of each component: per class those it is the first end of, and the documents at the other end of all."""
    found = []
    for _, part in pdf.drop_duplicates("node").groupby("root"):
        part = part.assign(n=part["set"].map(len) // 8).sort_values(["n", "node"])
        n, node, copies, own = (part[c].to_numpy() for c in ("n", "node", "copies", "own"))
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        edges = np.concatenate([[0], np.cumsum(n)])
        value, flat = np.unique(np.frombuffer(b"".join(part["set"]), np.uint64), return_inverse=True)
        mark = np.zeros(len(value), bool)
        others, linked = [node[:0]] * len(node), np.zeros(len(node), np.int64)
        for x in np.flatnonzero(own == i):
            low = x + 1 if i == j else np.searchsorted(n, -(-PERCENT * n[x] // 100))
            high = np.searchsorted(n, 100 * n[x] // PERCENT, "right")
            if low >= high:
                continue
            mark[flat[edges[x] : edges[x + 1]]] = True
            shared = np.add.reduceat(mark[flat[edges[low] : edges[high]]], edges[low:high] - edges[low], dtype=np.int64)
            mark[flat[edges[x] : edges[x + 1]]] = False
            y = low + np.flatnonzero((own[low:high] == j) & (100 * shared >= PERCENT * (n[x] + n[low:high] - shared)))
            others[x] = node[y]
            linked[x] += copies[y].sum()
            linked[y] += copies[x]
        found.append(pd.DataFrame({"node": node, "others": others, "linked": linked}))
    return pd.concat(found)


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    return _block(pdf).drop(columns="others")


def _within(large: DataFrame, links: DataFrame, roots: DataFrame, copies: DataFrame, arrays: DataFrame, listed: bool, used: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(node, others, linked)``, or without ``others`` unless ``listed``, for the classes of large tiles in components that may have more links than the known ones, and those classes.

    A pair that was not tested shares large tiles only, and lies in one component. Such components are cut into bounded blocks, and all pairs
    of their classes that are in large tiles are decided by the exact sets.
    """
    known = links.join(roots.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    incomplete = roots.groupBy("root").agg(F.count(F.lit(1)).alias("m")).join(known, "root").where("k < m * (m - 1) / 2").select("root")
    rows = large.distinct().join(roots, "node").join(incomplete, "root", "left_semi").join(copies, "node")
    rows = store(rows, "join-within")
    weight = rows.groupBy("root").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"))
    weight = weight.withColumn("blocks", F.ceil(F.greatest(F.col("w") / SHINGLES, F.col("m") / BLOCK)).cast("int"))
    weight = store(weight, "join-weight")
    packs = 1 + (weight.where("blocks = 1").agg(F.sum("w")).first()[0] or 0) // SHINGLES  # components of one block share tasks' groups
    dealt = rows.join(weight, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("pack", F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pack", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "root", "own", "node", "copies").join(arrays, "node")
    groups = dealt.groupBy("pack", "i", "j")
    decided = groups.applyInPandas(_block, "node long, others array<long>, linked long") if listed else groups.applyInPandas(_counted, "node long, linked long")
    decided, decided_at = store_at(decided, "join-others")
    if not listed:
        used.append(decided_at)
    return decided, rows


def _connected(docs: DataFrame, text_col: str, id_col: str, used: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Per class its rows and component (``node, copies, component_id``); sets, links that span all components, roots, classes of large tiles, exact sets."""
    sets = store(_sets(docs, text_col, id_col, _common(docs, text_col, COMMON)), "join-sets")
    tokens = sets.where("prefix is not null").select(F.posexplode("prefix").alias("place", "key"), "n", "node").select("key", "n", "node", F.col("place").cast("long").alias("place"))
    runs, runs_at = store_at(tokens.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_tiles, _RUNS), "join-tiles")
    del tokens  # the tiles' shuffle can go
    used.append(runs_at)
    links, arrays = _links(runs.where("not big").select("a", "na", "b", "nb").distinct(), docs, sets, text_col, id_col, used)
    roots = components(links)
    more = _across(runs.where("big").select("key", "a", "na", "place"), roots, sets)
    if more is not None:
        extra, held = _links(more, docs, sets, text_col, id_col, used)
        links, arrays = links.unionAll(extra), arrays.unionAll(held)
        roots = components(links)
    # Classes first: what is known of a class is joined to its rows once.
    classes = sets.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = store(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-classes")
    smallest = store(classes.groupBy("root").agg(F.min("least").alias("component_id")), "join-smallest")
    classes = store(classes.join(smallest, "root", "left").select("node", "copies", "component_id"), "join-components")
    return classes, sets, links, roots, runs.where("big").select(F.col("a").alias("node"), F.col("na").alias("n")), arrays


def _members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row with the columns of its class; a row without a class is its own component."""
    joined = sets.select("id", "n", "node").join(classes.drop("copies"), "node", "left")
    return joined.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", listed: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``(members, links)``: per input row ``id``, ``n`` (set size), ``node`` (class), ``component_id``, ``n_links``; and all links between classes.

    A text's set holds its distinct ``WIDTH``-word shingles, A-Z lower-cased, words cut at ASCII white space; a text with fewer words has
    one shingle, its whole sequence. Null texts and texts without words have an empty set and stay alone, with their own id
    as component. ``component_id`` is the smallest id of the component; ``n_links`` counts the other rows that a row links to, those of its own
    class too; rows that repeat an id each count with their own text; a row with a null id has n and the component of its class, and a class with
    null ids only is not compared. Each link ``a < b`` is listed once; unless ``listed``, links inside large tiles are only counted, and the second
    result is None. Shingles and sets are 64-bit hashes.
    """
    used: list[str] = []  # folders that nothing returned here reads
    classes, sets, links, roots, large, arrays = _connected(docs, text_col, id_col, used)
    copies = classes.select("node", "copies")
    within, whole = _within(large, links, roots, copies, arrays, listed, used)
    flag = lambda c: whole.select(F.col("node").alias(c), F.lit(True).alias(f"in_{c}"))
    rest = links.join(flag("a"), "a", "left").join(flag("b"), "b", "left").where("in_a is null or in_b is null").select("a", "b")
    ends = rest.select(F.col("a").alias("one"), F.col("b").alias("node")).unionAll(rest.select("b", "a")).join(copies, "node")
    linked = ends.select(F.col("one").alias("node"), F.col("copies").alias("linked")).unionAll(within.select("node", "linked")).groupBy("node").agg(F.sum("linked").alias("linked"))
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    counted = store(classes.join(linked, "node", "left").select("node", "copies", "component_id", n_links.alias("n_links")), "join-degrees")
    remove(docs.sparkSession, *used)
    members = _members(sets, counted).select("id", "n", "node", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    if not listed:
        return members, None
    pairs = within.select("node", F.explode("others").alias("other")).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return members, rest.unionAll(pairs)


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component: the one whose id is the smallest. Empty documents and those with a null id stay.

    Documents are told apart by id: rows that repeat an id stay or go together.
    """
    used: list[str] = []
    classes, sets, *_ = _connected(docs, text_col, id_col, used)
    gone = store(_members(sets, classes).where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "join-gone")
    remove(docs.sparkSession, *used)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns: a row per document with its set size, its component, and the number of documents that it links to."""
    return join(docs.select("doc_id", "text"), listed=False)[0].select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
