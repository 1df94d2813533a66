"""Pairwise distances, neighbours and group structure on the distance table."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.plans.stable import materialise

ENTITY_BLOCK = 1024
ITEM_BLOCK = 2048
#: Block groups that share the pairs out (136 tasks), and bytes of a group from which there are more of them.
GROUPS, GROUP_BYTES = 16, 1 << 24
#: Neighbours kept beyond k, for distances that differ in the last bit only before they are scaled.
SPARE = 4


def packed_pairs(v: DataFrame, by: Sequence[str], entity_block: int, item_block: int, side: str | None = None, carry: str | None = None) -> DataFrame:
    """Dense blocks of the matrix, one task per pair of block groups, sorted for :func:`block_pairs`.

    Entities and items are dealt into hash blocks by their distinct counts, and each (entity block, item block) becomes one packed row with nulls as
    NaN. Entity blocks form groups of up to ``GROUP_BYTES``; a group goes to every other group, so the matrix is shuffled as often as there are groups (``GROUPS``, or
    more where it is larger than that many times ``GROUP_BYTES``), eight bytes a cell, and never once per entity block.
    """
    by = [*by, side] if side else list(by)
    columns = [*by, "entity", "item", "value", *([carry] if carry else [])]
    v = v.select(*columns)
    n_entities, n_items = v.agg(F.count_distinct("entity"), F.count_distinct("item")).first()
    blocks, item_blocks = (max(1, -(-n // size)) for n, size in ((n_entities, entity_block), (n_items, item_block)))
    groups = min(blocks, max(GROUPS, -(-n_entities * n_items * 8 // GROUP_BYTES)))
    cells = v.withColumn("b", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int")).withColumn("ib", F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int"))
    listed = lambda n, c: T.StructField(n, T.ArrayType(v.schema[c].dataType))
    fields = [*[v.schema[c] for c in by], T.StructField("b", T.IntegerType()), T.StructField("ib", T.IntegerType()), listed("entities", "entity"), listed("items", "item")]
    fields += [*([listed("carried", carry)] if carry else []), T.StructField("m", T.BinaryType())]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        again = pdf.duplicated(["entity", "item"])
        if again.any():
            cell = pdf[again].iloc[0]
            raise ValueError(f"entity {cell['entity']!r} has item {cell['item']!r} twice")
        (names, first, row), (items, at) = np.unique(pdf["entity"].to_numpy(), return_index=True, return_inverse=True), np.unique(pdf["item"].to_numpy(), return_inverse=True)
        x = np.full((len(names), len(items)), np.nan)
        x[row, at] = pdf["value"].to_numpy(dtype=float)
        extra = [pdf[carry].to_numpy()[first]] if carry else []
        return pd.DataFrame([[*key, names, items, *extra, x.tobytes()]], columns=[f.name for f in fields])

    packed = cells.groupBy(*by, "b", "ib").applyInPandas(pack, T.StructType(fields))
    own = F.floor(F.col("b") * F.lit(groups) / F.lit(blocks)).cast("int")
    spread = packed.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    spread = spread.withColumn("gi", F.least("_own", "_other")).withColumn("gj", F.greatest("_own", "_other")).withColumn("alone", F.lit(groups == blocks)).withColumn("whole", F.lit(item_blocks == 1)).drop("_other")
    pair = F.col("gi") * groups - (F.col("gi") * (F.col("gi") - 1) / 2).cast("int") + F.col("gj") - F.col("gi")
    keys = [c for c in by if c != side]
    tasks = groups * (groups + 1) // 2
    if keys:
        tasks, pair = max(tasks, int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))), pair + F.xxhash64(*keys)
    return spread.repartitionById(tasks, F.pmod(pair, F.lit(tasks)).cast("int")).sortWithinPartitions(*keys, "gi", "gj", "ib", *([side] if side else []), "b")


class Block(NamedTuple):
    """Rows of one entity block in one item block; ``x`` has NaN where a cell is missing."""

    names: np.ndarray
    items: np.ndarray
    x: np.ndarray


def _over(block: Block, items: np.ndarray) -> np.ndarray:
    if len(items) == len(block.items):
        return block.x
    x = np.full((len(block.names), len(items)), np.nan)
    x[:, np.searchsorted(items, block.items)] = block.x
    return x


def _exact_where_near(ss: np.ndarray, a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> None:
    """What is small against the norms has lost its digits to cancellation: takes those gaps directly."""
    rows = np.flatnonzero(ss.min(1, initial=np.inf) <= 1e-4 * (norm_a + norm_b.max(initial=0.0)))
    if not len(rows):
        return
    near_i, near_j = np.nonzero(ss[rows] <= np.add.outer(1e-4 * norm_a[rows], 1e-4 * norm_b))
    near_i = rows[near_i]
    for part in np.array_split(np.arange(len(near_i)), max(1, len(near_i) * a.shape[1] // (1 << 22))):
        i, j = near_i[part], near_j[part]
        gap = (a[i] - b[j]) * (ma[i] & mb[j])
        ss[i, j] = (gap * gap).sum(1)


def tile_sums(left: Block, right: Block):
    """Entity names of both blocks with partial squared gaps and common-item counts."""
    items = left.items if np.array_equal(left.items, right.items) else np.union1d(left.items, right.items)
    a, b = _over(left, items), _over(right, items)
    ma, mb = ~np.isnan(a), ~np.isnan(b)
    a, b = np.where(ma, a, 0.0), np.where(mb, b, 0.0)
    # Distances do not change when an item's mean is taken out, and the products below lose far fewer digits.
    mean = (a.sum(0) + b.sum(0)) / np.maximum(ma.sum(0) + mb.sum(0), 1.0)
    a, b = (a - mean) * ma, (b - mean) * mb
    aa, bb = a * a, b * b
    if ma.all() and mb.all():
        common = np.full((len(a), len(b)), float(len(items)))
        ss = np.hstack([aa.sum(1)[:, None], np.ones((len(a), 1)), -2.0 * a]) @ np.hstack([np.ones((len(b), 1)), bb.sum(1)[:, None], b]).T
    else:
        common = (ma.astype(np.float32) @ mb.astype(np.float32).T).astype(float)
        ss = np.hstack([aa, ma, -2.0 * a]) @ np.hstack([mb, bb, b]).T
    _exact_where_near(ss, a, b, ma, mb, aa.sum(1), bb.sum(1))
    return left.names, right.names, np.maximum(ss, 0.0, out=ss), common


class BlockPair:
    """Sums of one pair of entity blocks, added up over its item blocks: two bounded matrices, whatever the number of items."""

    def __init__(self) -> None:
        self.left = self.right = np.array([], dtype=object)
        self.ss = self.common = np.zeros((0, 0))

    def add(self, na: np.ndarray, nb: np.ndarray, ss: np.ndarray, common: np.ndarray) -> None:
        if not len(self.left) and not len(self.right):
            self.left, self.right, self.ss, self.common = na, nb, ss, common
            return
        left, right = np.union1d(self.left, na), np.union1d(self.right, nb)
        if len(left) > len(self.left) or len(right) > len(self.right):
            at = np.ix_(np.searchsorted(left, self.left), np.searchsorted(right, self.right))
            grown = np.zeros((2, len(left), len(right)))
            grown[0][at], grown[1][at] = self.ss, self.common
            self.left, self.right, (self.ss, self.common) = left, right, grown
        at = np.ix_(np.searchsorted(self.left, na), np.searchsorted(self.right, nb))
        self.ss[at] += ss
        self.common[at] += common


class Tiles:
    """The block pairs of one pair of block groups: ``tiles()`` gives ``(bi, bj, {side: BlockPair})``.

    Groups of several blocks are held, up to ``GROUP_BYTES`` each; a pair of single blocks is added up item block by item block as its rows arrive.
    """

    def __init__(self, group: tuple, gi: int, gj: int, rows: Iterator[dict], side: str | None, carry: str | None) -> None:
        first = next(rows)
        self.group, self.gi, self.gj, self.rows, self.side, self.carry = group, gi, gj, itertools.chain([first], rows), side, carry
        self.carried: dict = {}
        #: Whether all items are in one item block.
        self.whole: bool = first["whole"]

    def _blocks(self):
        """Item block by item block: ``{(side, group, b): Block}``."""
        for _, rows in itertools.groupby(self.rows, lambda r: r["ib"]):
            found = {}
            for r in rows:
                names, items = np.asarray(r["entities"]), np.asarray(r["items"])
                found[r[self.side] if self.side else None, r["_own"], r["b"]] = Block(names, items, np.frombuffer(r["m"]).reshape(len(names), len(items)))
                if self.carry:
                    self.carried.update(zip(r["entities"], r["carried"]))
                alone = r["alone"]
            yield alone, found

    def tiles(self):
        held, sums = [], {}
        for alone, found in self._blocks():
            if alone:
                for (i, j), side, left, right in self._pairs(found):
                    sums.setdefault((i, j), {}).setdefault(side, BlockPair()).add(*tile_sums(left, right))
            else:
                held.append(found)
        for (i, j), pairs in sums.items():
            yield i, j, pairs
        names = sorted({k for found in held for k in found}, key=str)
        firsts, seconds = (sorted({b for _, g, b in names if g == own}) for own in (self.gi, self.gj))
        for i, j in ((i, j) for i in firsts for j in seconds if self.gi != self.gj or i <= j):
            pairs = {}
            for found in held:
                for _, side, left, right in self._pairs({k: x for k, x in found.items() if k[2] in (i, j)}, (i, j)):
                    pairs.setdefault(side, BlockPair()).add(*tile_sums(left, right))
            yield i, j, pairs

    def whole_blocks(self):
        """``(blocks of gi, blocks of gj)`` by number, of a matrix with all items in one item block."""
        ((_, found),) = self._blocks()
        return tuple({b: x for (_, g, b), x in sorted(found.items(), key=lambda kx: kx[0][2]) if g == own} for own in (self.gi, self.gj))

    def _pairs(self, found: dict, only: tuple | None = None):
        for side in {k[0] for k in found}:
            own = {k[2]: x for k, x in found.items() if k[0] == side}
            i, j = only or (self.gi, self.gj)
            if i in own or j in own:
                some = own.get(i, own.get(j))
                none = Block(some.names[:0], some.items, some.x[:0])
                yield (i, j), side, own.get(i, none), own.get(j, none)


def block_pairs(frames, by: Sequence[str], side: str | None = None, carry: str | None = None) -> Iterator[Tiles]:
    """One :class:`Tiles` per pair of block groups, from the rows of :func:`packed_pairs`. Each is read to its end before the next."""
    rows = (r for frame in frames for r in frame.to_dict("records"))
    for (*group, gi, gj), part in itertools.groupby(rows, lambda r: (*(r[c] for c in by), r["gi"], r["gj"])):
        yield Tiles(tuple(group), gi, gj, part, side, carry)


def pairwise_sums(v: DataFrame, by: Sequence[str] = (), entity_block: int = ENTITY_BLOCK, item_block: int = ITEM_BLOCK, stored: bool = False) -> DataFrame:
    """``(*by, entity_i < entity_j, ss, n_common)``.

    The matrix is read for its axis sizes and again for its cells, so it is stored first unless the caller says it is
    ``stored`` already. A task multiplies the tiles of one block pair and adds them up; each pair leaves it once, finished.
    """
    by = list(by)
    v = v.select(*by, "entity", "item", "value")
    v = v if stored else materialise(v)
    kind = v.schema["entity"].dataType
    schema = T.StructType(
        [*[v.schema[c] for c in by]]
        + [T.StructField("entity_i", kind), T.StructField("entity_j", kind), T.StructField("ss", T.DoubleType()), T.StructField("n_common", T.LongType())]
    )

    def finished(frames):
        for group, bi, bj, pair in ((t.group, bi, bj, pairs[None]) for t in block_pairs(frames, by) for bi, bj, pairs in t.tiles()):
            step = max(1, 200_000 // max(len(pair.right), 1))
            for lo in range(0, len(pair.left), step):
                rows, cols = (a.ravel() for a in np.indices((min(step, len(pair.left) - lo), len(pair.right))))
                rows += lo
                if bi == bj:
                    rows, cols = rows[rows < cols], cols[rows < cols]
                first, second = pair.left[rows], pair.right[cols]
                swap = first > second
                out = {c: np.repeat(np.array([g]), len(rows)) for c, g in zip(by, group)}
                out["entity_i"], out["entity_j"] = np.where(swap, second, first), np.where(swap, first, second)
                out["ss"], out["n_common"] = pair.ss[rows, cols], pair.common[rows, cols].round().astype("int64")
                yield pd.DataFrame(out)

    return packed_pairs(v, by, entity_block, item_block).mapInPandas(finished, schema)


def _scaled(sums: DataFrame, v: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``d``: squared gaps scaled from the common items to all items; null without a common one."""
    if by:
        sums = sums.join(v.groupBy(*by).agg(F.count_distinct("item").alias("_total")), list(by))
    else:
        sums = sums.withColumn("_total", v.agg(F.count_distinct("item").alias("n")).scalar())
    return sums.withColumn("d", F.when(F.col("n_common") > 0, F.col("ss") * F.col("_total") / F.col("n_common"))).drop("_total")


def pairwise_sq_distance(v: DataFrame, by: Sequence[str] = (), entity_block: int = ENTITY_BLOCK, item_block: int = ITEM_BLOCK, stored: bool = False) -> DataFrame:
    """Squared Euclidean distance over common items, scaled by N / n_common; null if none."""
    by = list(by)
    v = v.select(*by, "entity", "item", "value")
    v = v if stored else materialise(v)
    return _scaled(pairwise_sums(v, by, entity_block, item_block, stored=True), v, by).select(*by, "entity_i", "entity_j", "d")


class Nearest:
    """The k nearest others of the entities of one block, over the tiles of a task; ties by name."""

    def __init__(self, names: np.ndarray, k: int) -> None:
        self.names, self.k = names, k
        self.worst = np.full(len(names), np.inf)
        self.kept = pd.DataFrame({"row": [], "d": [], "other": [], "ss": [], "n_common": []}).astype({"row": "int64"})
        self.new: list[tuple[np.ndarray, ...]] = []

    def add(self, others: np.ndarray, d: np.ndarray, ss: np.ndarray, common: np.ndarray) -> None:
        limit = self.worst
        if not len(self.kept) and d.shape[1] > self.k:
            limit = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
        rows, cols = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        self.put(rows, others[cols], ss[rows, cols], common[rows, cols])
        self.merge()

    def put(self, rows: np.ndarray, others: np.ndarray, ss: np.ndarray, common: np.ndarray) -> None:
        """Candidates, merged once they are as many as what is kept; until then ``worst`` stays a bound from above."""
        if len(rows):
            self.new.append((rows, ss / common, others, ss, common))
            if sum(len(c[0]) for c in self.new) >= self.k * len(self.names):
                self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        new = pd.DataFrame({c: np.concatenate(x) for c, x in zip(self.kept.columns, zip(*self.new))})
        both = (pd.concat([self.kept, new]) if len(self.kept) else new).sort_values(["row", "d", "other"], kind="stable")
        self.new = []
        row = both["row"].to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        self.kept = both[place < self.k]
        full = both[place == self.k - 1]
        self.worst[full["row"].to_numpy()] = full["d"].to_numpy()

    def rows(self) -> pd.DataFrame:
        self.merge()
        return pd.DataFrame({"entity": self.names[self.kept["row"].to_numpy()], "other": self.kept["other"].to_numpy(), "ss": self.kept["ss"].to_numpy(dtype=float), "n_common": self.kept["n_common"].to_numpy(dtype=float).round().astype("int64")})


class Screen:
    """A block, ready for squared gaps in single precision that are never above the true ones, and for exact gaps of some pairs.

    With the values over ``scale`` (1 at most), a product of 3 * items terms is off by less than ``(6 * items + 16) / 2**24`` times the squares it adds up;
    that share is taken off the squares beforehand. ``TINY`` covers what single precision cannot hold.
    """

    TINY = np.float32(1e-30)

    def __init__(self, block: Block, items: np.ndarray, mean: np.ndarray, scale: float) -> None:
        self.names, raw = block.names, _over(block, items)
        self.m = ~np.isnan(raw)
        self.raw, self.whole = np.where(self.m, raw, 0.0), bool(self.m.all())
        x = np.where(self.m, (raw - mean) / scale, 0.0)
        squares = x * x * (1 - (6 * len(items) + 16) * 2.0**-24)
        self.seen, a, one = self.m.astype(np.float32), x.astype(np.float32), np.ones((len(x), 1), np.float32)
        cells, total = squares.astype(np.float32), squares.sum(1)[:, None].astype(np.float32)
        self.ends = {False: (np.hstack([cells, self.seen, -2 * a]), np.hstack([self.seen, cells, a]))}
        if self.whole:
            self.ends[True] = (np.hstack([total, one, -2 * a]), np.hstack([one, total, a]))

    def below(self, other: Screen) -> tuple[np.ndarray, np.ndarray | np.float32]:
        """Squared gaps over ``scale`` squared that are not above the true ones, and numbers of common items."""
        whole = self.whole and other.whole
        ss = self.ends[whole][0] @ other.ends[whole][1].T
        return ss, np.float32(self.raw.shape[1]) if whole else self.seen @ other.seen.T

    def exact(self, other: Screen, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ss, common = np.empty(len(i)), np.empty(len(i))
        for part in np.array_split(np.arange(len(i)), max(1, len(i) * self.raw.shape[1] // (1 << 20))):
            both = self.m[i[part]] & other.m[j[part]]
            gap = (self.raw[i[part]] - other.raw[j[part]]) * both
            ss[part], common[part] = (gap * gap).sum(1), both.sum(1)
        return ss, common


def _items_and_means(blocks: Sequence[Block]) -> tuple[np.ndarray, np.ndarray]:
    items = blocks[0].items
    for b in blocks[1:]:
        items = items if np.array_equal(items, b.items) else np.union1d(items, b.items)
    n, total = np.zeros(len(items)), np.zeros(len(items))
    for b in blocks:
        at, seen = np.searchsorted(items, b.items), ~np.isnan(b.x)
        n[at] += seen.sum(0)
        total[at] += np.where(seen, b.x, 0.0).sum(0)
    return items, total / np.maximum(n, 1.0)


#: Rows and columns of the strips of :func:`coded_gaps`: their arrays stay in a core's cache.
STRIP = (256, 256)


class Coded:
    """All entities of some blocks in the order of their codes, ready for products; ``parts``: runs of one code, of strip length."""

    def __init__(self, blocks: Sequence[Block], items: np.ndarray, mean: np.ndarray, code, length: int) -> None:
        codes = code(np.concatenate([b.names for b in blocks]))
        order = np.argsort(codes, kind="stable")
        raw, codes = np.concatenate([_over(b, items) for b in blocks])[order], codes[order]
        self.m = ~np.isnan(raw)
        self.x = np.where(self.m, raw - mean, 0.0)
        self.square, self.seen = self.x * self.x, self.m.astype(float)
        self.norm = self.square.sum(1)
        _, at, self.pattern = np.unique(np.packbits(self.m, axis=1), axis=0, return_index=True, return_inverse=True)
        self.pattern, self.patterns = self.pattern.ravel(), self.seen[at]
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
        self.parts = [(int(codes[lo]), slice(at, min(at + length, hi))) for lo, hi in itertools.pairwise(edges) for at in range(lo, hi, length)]


def coded_gaps(tiles: Tiles, code) -> Iterator[tuple[int, int, np.ndarray]]:
    """Gaps per common item of the known pairs of one pair of groups, strip by strip, with the codes of both entities (``code``: from names to numbers).

    The matrix has all items in one item block. Entities stand in the order of their codes, so that a strip has one pair of codes and nothing is picked out of it.
    """
    first, second = tiles.whole_blocks()
    alone = tiles.gi == tiles.gj
    items, mean = _items_and_means([*first.values(), *([] if alone else second.values())])
    left = Coded(list(first.values()), items, mean, lambda names: code(names, tiles.carried), STRIP[0])
    right = Coded(list((first if alone else second).values()), items, mean, lambda names: code(names, tiles.carried), STRIP[1])
    # Where few sets of items are missing, squares over the common items and their numbers are those of the sets.
    few = len(left.patterns) + len(right.patterns) <= len(items)
    if few:
        own, other, n_common = left.square @ right.patterns.T, left.patterns @ right.square.T, left.patterns @ right.patterns.T
        a, b = -2.0 * left.x, right.x
    else:
        a, b = np.hstack([left.square, left.seen, -2.0 * left.x]), np.hstack([right.seen, right.square, right.x])
        m, n = left.seen.astype(np.float32), right.seen.astype(np.float32)
    for i, r in left.parts:
        for j, c in right.parts:
            if alone and c.stop <= r.start + 1:
                continue
            ss = a[r] @ b[c].T
            if few:
                ss += own[r].take(right.pattern[c], axis=1)
                ss += other[left.pattern[r], c]
                common = n_common[left.pattern[r]].take(right.pattern[c], axis=1)
            else:
                common = m[r] @ n[c].T
            _exact_where_near(ss, left.x[r], right.x[c], left.m[r], right.m[c], left.norm[r], right.norm[c])
            np.maximum(ss, 0.0, out=ss)
            known = None if common.min() > 0 else common > 0
            gaps = np.divide(ss, common if known is None else np.maximum(common, 1.0), out=ss)
            if alone and c.start <= r.stop - 1:
                later = np.arange(c.start, c.stop)[None] > np.arange(r.start, r.stop)[:, None]
                known = later if known is None else known & later
            gaps = gaps.ravel() if known is None else gaps[known]
            if len(gaps):
                yield i, j, gaps


def _screened(tiles: Tiles, k: int) -> Iterator[Nearest]:
    """Neighbours from all tiles of one pair of groups: bounds in single precision leave few candidates, whose gaps are taken directly.

    The bounds never leave out a true neighbour; gaps are those of the values as they are, so equal ones tie.
    """
    first, second = tiles.whole_blocks()
    blocks = [*first.values(), *([] if tiles.gi == tiles.gj else second.values())]
    items, mean = _items_and_means(blocks)
    scale = max([0.0, *(float(np.nanmax(np.abs(b.x - mean[np.searchsorted(items, b.items)]), initial=0.0)) for b in blocks)]) or 1.0
    left = {b: Screen(x, items, mean, scale) for b, x in first.items()}
    right = left if tiles.gi == tiles.gj else {b: Screen(x, items, mean, scale) for b, x in second.items()}
    found = {(0, b): Nearest(x.names, k) for b, x in left.items()}
    found |= {(tiles.gi != tiles.gj, b): Nearest(x.names, k) for b, x in right.items()} if right is not left else {}

    def bounds(near: Nearest, a: Screen, b: Screen, ss: np.ndarray, common: np.ndarray | np.float32) -> np.ndarray:
        """Bounds from above of the k-th least gap per common item: where there is none yet, some k others are measured exactly."""
        at, fresh = near.worst.copy(), np.flatnonzero(~np.isfinite(near.worst))
        if len(fresh) and ss.shape[1] > k:
            share = ss[fresh] / np.maximum(common[fresh] if np.ndim(common) else common, np.float32(0.5))
            if np.ndim(common):
                share[common[fresh] == 0] = np.inf
            some = np.argpartition(share, k - 1, axis=1)[:, :k]
            gap, n_some = a.exact(b, np.repeat(fresh, k), some.ravel())
            known = (n_some > 0) & np.isfinite(np.take_along_axis(share, some, 1)).ravel()
            at[fresh] = np.divide(gap, n_some, out=np.full(len(gap), np.inf), where=known).reshape(-1, k).max(1)
        return at

    single = lambda at: np.nextafter((at / scale / scale).astype(np.float32), np.float32(np.inf)) * (1 + np.float32(2**-22))
    for i, a in left.items():
        for j, b in right.items():
            if right is left and i > j:
                continue
            ss, common = a.below(b)
            rows, cols = found[0, i], found[int(tiles.gi != tiles.gj), j]
            if a is b:
                np.fill_diagonal(ss, np.inf)
            by_row = bounds(rows, a, b, ss, common)
            by_col = by_row if a is b else bounds(cols, b, a, ss.T, common.T if np.ndim(common) else common)
            limit = np.maximum.outer(single(by_row), single(by_col))
            limit *= np.maximum(common, np.float32(0.5))
            limit += Screen.TINY
            at_i, at_j = np.divmod(np.flatnonzero(ss <= np.minimum(limit, np.finfo(np.float32).max)), ss.shape[1])
            gap, n_common = a.exact(b, at_i, at_j)
            share = np.divide(gap, n_common, out=np.full(len(gap), np.inf), where=n_common > 0)
            for near, names, mine, theirs, at in ((rows, b.names, at_i, at_j, by_row), *([] if a is b else [(cols, a.names, at_j, at_i, by_col)])):
                keep = np.flatnonzero((share <= at[mine]) & (n_common > 0))
                near.put(mine[keep], names[theirs[keep]], gap[keep], n_common[keep])
    yield from found.values()


def nearest_entities(v: DataFrame, k: int, by: Sequence[str] = (), entity_block: int = ENTITY_BLOCK, item_block: int = ITEM_BLOCK, stored: bool = False) -> DataFrame:
    """``(*by, entity, other, rank, d)``: the k nearest others of every entity, ties by id.

    Each task keeps the k best of its own for every entity, so entities x block groups x k rows are shuffled instead of all pairs.
    """
    by = list(by)
    v = v.select(*by, "entity", "item", "value")
    v = v if stored else materialise(v)
    kind = v.schema["entity"].dataType
    schema = T.StructType(
        [*[v.schema[c] for c in by]] + [T.StructField("entity", kind), T.StructField("other", kind), T.StructField("ss", T.DoubleType()), T.StructField("n_common", T.LongType())]
    )

    def best(frames):
        for t in block_pairs(frames, by):
            found: dict[tuple, Nearest] = dict(enumerate(_screened(t, k + SPARE))) if t.whole else {}
            for bi, bj, pairs in () if t.whole else t.tiles():
                pair = pairs[None]
                d = np.full(pair.ss.shape, np.inf)
                np.divide(pair.ss, pair.common, out=d, where=pair.common > 0)
                if bi == bj:
                    np.fill_diagonal(d, np.inf)
                found.setdefault((0, bi), Nearest(pair.left, k + SPARE)).add(pair.right, d, pair.ss, pair.common)
                if bi != bj:
                    found.setdefault((t.gi != t.gj, bj), Nearest(pair.right, k + SPARE)).add(pair.left, d.T, pair.ss.T, pair.common.T)
            for near in found.values():
                rows = near.rows()
                yield pd.DataFrame({c: np.repeat(np.array([g]), len(rows)) for c, g in zip(by, t.group)} | {c: rows[c].to_numpy() for c in rows})

    close = _scaled(packed_pairs(v, by, entity_block, item_block).mapInPandas(best, schema), v, by)
    w = Window.partitionBy(*by, "entity").orderBy("d", "other")
    return close.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*by, "entity", "other", "rank", "d")


def entity_pairs(v: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unordered entity pairs with the number of items both have."""
    return pairwise_sums(v, by).select(*by, "entity_i", "entity_j", "n_common")


def symmetric(d: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both directions of each pair from one evaluation of the distance plan."""
    both = F.array(F.struct(F.col("entity_i").alias("entity"), F.col("entity_j").alias("other")), F.struct(F.col("entity_j").alias("entity"), F.col("entity_i").alias("other")))
    return d.select(*by, F.explode(both).alias("_p"), "d").select(*by, "_p.entity", "_p.other", "d")


def nearest(d: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """k nearest entities, ties by id. The rank filter becomes a map-side group limit."""
    w = Window.partitionBy(*by, "entity").orderBy("d", "other")
    ranked = symmetric(d.filter(F.col("d").isNotNull()), by).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k)


def knn_same_group(d: DataFrame, labels: DataFrame, ks: Sequence[int] = (5, 10), tolerance: float = 0.10) -> DataFrame:
    """Share of same-label neighbours against the share expected at random.

    ``labels``: entity, label. Expected = mean over entities of (own group - 1) / (M - 1).
    """
    return _same_group(nearest(d, max(ks)), labels, ks, tolerance)


def nearest_same_group(v: DataFrame, labels: DataFrame, ks: Sequence[int] = (5, 10), tolerance: float = 0.10) -> DataFrame:
    """:func:`knn_same_group` from the matrix itself, without a table of all pairs."""
    return _same_group(nearest_entities(v, max(ks)), labels, ks, tolerance)


def _same_group(close: DataFrame, labels: DataFrame, ks: Sequence[int], tolerance: float) -> DataFrame:
    same = (F.col("_l") == F.col("_m")).cast("int")
    own = labels.select("entity", F.col("label").alias("_l"))
    other = labels.select(F.col("entity").alias("other"), F.col("label").alias("_m"))
    marked = close.join(own, "entity").join(other, "other").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    share = marked.groupBy("k", "entity").agg((F.sum(same) / F.col("k")).alias("_s"))
    observed = share.groupBy("k").agg(F.avg("_s").alias("observed"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n")
    chance = sizes.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (m * (m - 1))).alias("expected"))
    out = observed.withColumn("expected", chance.scalar())
    return out.withColumn("excess", F.col("observed") - F.col("expected")).withColumn("passed", F.abs("excess") <= tolerance)
