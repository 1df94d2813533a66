"""Moments of the squared distances of all entity pairs in two matrices, from sums over entities.

Entities that miss the same items have the same number of common items with any such group of others. Inside a pair of such groups a product of two
squared gaps is a polynomial in the cells of one entity and of the other, so its sum over all pairs follows from the groups' sums of products of up to
two items: work and rows grow with the entities and with the pairs of groups, not with the pairs of entities. A complete matrix is one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entities from which groups are tried, items of both sides and bytes of all sums up to which they are, and entities that are summed at a time.
MANY, ITEMS, SUMS_BYTES, CHUNK = 4096, 256, 1 << 26, 8192
#: Part of the sum of squares that a variance must be, else it has lost too many digits and the pairs are taken one by one.
DIGITS = 1e-7

_FIELDS = ["mx", "my", "n", "xx", "yy", "xy"]


def _sums(x: np.ndarray) -> np.ndarray:
    """Row 0: number of rows; row 1: sums by item; then the products ``x_k x_l``, ``x_k^2 x_l`` and ``x_k^2 x_l^2``, all items by all items."""
    square, p = x * x, x.shape[1]
    return np.vstack([np.full((1, p), float(len(x))), x.sum(0)[None], x.T @ x, square.T @ x, square.T @ square])


def group_sums(values: DataFrame, by: Sequence[str], side: str, axes: dict[tuple, list[tuple]], entities: int) -> DataFrame:
    """``(*by, seen, sums)``: packed :func:`_sums` of all entities that have the same items. ``axes``: sides, items and shifts of every group, in order."""
    place = {key: {(s, i): (k, shift) for k, (s, i, shift) in enumerate(cells)} for key, cells in axes.items()}
    chunks = max(1, -(-entities // CHUNK))
    schema = T.StructType([*[values.schema[c] for c in by], T.StructField("seen", T.BinaryType()), T.StructField("sums", T.BinaryType())])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        again = pdf.duplicated([side, "entity", "item"])
        if again.any():
            cell = pdf[again].iloc[0]
            raise ValueError(f"entity {cell['entity']!r} has item {cell['item']!r} twice")
        group = key[:-1]
        pdf = pdf[pdf["value"].notna()]
        names, row = np.unique(pdf["entity"].to_numpy(), return_inverse=True)
        known = place[group]
        x, seen = np.zeros((len(names), len(known))), np.zeros((len(names), len(known)), bool)
        for cell, part in pdf.assign(_row=row).groupby([side, "item"], sort=False):
            k, shift = known[cell]
            at = part["_row"].to_numpy()
            x[at, k], seen[at, k] = part["value"].to_numpy(dtype=float) - shift, True
        patterns, which = np.unique(np.packbits(seen, axis=1), axis=0, return_inverse=True)
        rows = [[*group, p.tobytes(), _sums(x[which.ravel() == i]).tobytes()] for i, p in enumerate(patterns)]
        return pd.DataFrame(rows, columns=schema.names)

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]], columns=schema.names)

    dealt = values.withColumn("_b", F.pmod(F.xxhash64("entity"), F.lit(chunks)).cast("int"))
    return dealt.groupBy(*by, "_b").applyInPandas(add, schema).groupBy(*by, "seen").applyInPandas(total, schema)


def _between(sums: np.ndarray, seen: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sums over the entity pairs of every two groups of ``(gap in the items first) * (gap in the items second)``; ``sums``: groups x (2 + 3 items) x items."""
    p = seen.shape[1]
    n, one, m11, m21, m22 = sums[:, 0, 0], sums[:, 1], *(sums[:, 2 + i * p : 2 + (i + 1) * p] for i in range(3))
    two = np.diagonal(m11, axis1=1, axis2=2)
    out = np.zeros((len(sums), len(sums)))
    for k in first:
        # Sums of x_k^i x_l^j over the entities that have both items, for the items l.
        both = seen[:, k : k + 1] * seen[:, second]
        s = {(0, 0): n[:, None] * both, (1, 0): one[:, k : k + 1] * both, (2, 0): two[:, k : k + 1] * both, (0, 1): one[:, second] * both, (0, 2): two[:, second] * both}
        s |= {(1, 1): m11[:, k][:, second], (2, 1): m21[:, k][:, second], (1, 2): m21[:, second, k], (2, 2): m22[:, k][:, second]}
        weights = {(i, j): (1, -2, 1)[i] * (1, -2, 1)[j] for i in range(3) for j in range(3)}
        left = np.hstack([w * s[i, j] for (i, j), w in weights.items()])
        out += left @ np.hstack([s[2 - i, 2 - j] for i, j in weights]).T
    return out


def _gap_sums(sums: np.ndarray, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    p = seen.shape[1]
    n, one, two = sums[:, 0, :1] * seen[:, at], sums[:, 1][:, at], np.diagonal(sums[:, 2 : 2 + p], axis1=1, axis2=2)[:, at]
    here = seen[:, at].astype(float)
    return two @ n.T + n @ two.T - 2.0 * (one @ one.T) if here.size else np.zeros((len(seen), len(seen)))


def pair_totals(sums: np.ndarray, seen: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, ...] | None:
    """``mx, my, n, xx, yy, xy`` of the gaps per common item over all pairs; none where they have lost their digits, or without pairs."""
    n = sums[:, 0, 0]
    pairs = (np.outer(n, n) - np.diag(n)) / 2
    half = np.full(pairs.shape, 0.5)  # two groups come twice, and pairs inside a group too: an entity has no gap to itself
    nx, ny = (seen[:, at].astype(float) @ seen[:, at].T for at in (x, y))
    known = (nx > 0) & (ny > 0)
    pairs = np.where(np.eye(len(n), dtype=bool), pairs, np.outer(n, n) / 2)
    total = np.where(known, pairs, 0.0).sum()
    if not total:
        return None
    part = lambda s, scale: np.where(known, s * half / np.where(known, scale, 1.0), 0.0).sum()
    mx, my = part(_gap_sums(sums, seen, x), nx) / total, part(_gap_sums(sums, seen, y), ny) / total
    sxx, syy, sxy = part(_between(sums, seen, x, x), nx * nx), part(_between(sums, seen, y, y), ny * ny), part(_between(sums, seen, x, y), nx * ny)
    xx, yy, xy = sxx - total * mx * mx, syy - total * my * my, sxy - total * mx * my
    if not (xx > DIGITS * sxx and yy > DIGITS * syy and np.isfinite(xy)):
        return None
    return mx, my, round(total), xx, yy, xy


def grouped_moments(values: DataFrame, by: Sequence[str], side: str, first, second) -> tuple[DataFrame | None, DataFrame | None]:
    """``(*by, mx, my, n, xx, yy, xy)`` of the ``by`` groups that can be summed in this way, and the stored ``values`` of the others (none if there are none)."""
    by = list(by)
    sizes = {tuple(r[c] for c in by): r for r in values.groupBy(*by).agg(F.count_distinct("entity").alias("n"), F.count_distinct(side, "item").alias("p")).collect()}
    most = max((r["n"] for r in sizes.values()), default=0)
    plain = all(isinstance(values.schema[c].dataType, (T.IntegralType, T.StringType)) for c in by)
    if most < MANY or sum(r["p"] for r in sizes.values()) > 64 * ITEMS or any(None in key for key in sizes) or not plain:
        return None, values
    number = F.col("value").isNotNull() & ~F.isnan("value")
    seen = F.bit_xor(F.when(number, F.xxhash64(side, "item")))
    patterns = {tuple(r[c] for c in by): r["g"] for r in values.groupBy(*by, "entity").agg(seen.alias("_g")).groupBy(*by).agg(F.count_distinct(F.coalesce("_g", F.lit(0))).alias("g")).collect()}
    good = {key for key, r in sizes.items() if r["p"] <= ITEMS and patterns[key] * r["p"] * (3 * r["p"] + 2) * 8 <= SUMS_BYTES // len(sizes)}
    if not good:
        return None, values
    keep = lambda keys: values.join(values.sparkSession.createDataFrame(sorted(keys), T.StructType([values.schema[c] for c in by])), by, "left_semi") if by else values
    chosen = keep(good)
    # Values are taken about their item's mean, or about the value itself where there is only one, so that equal rows have no gap at all.
    middle = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.avg("value"))
    axes: dict[tuple, list[tuple]] = {}
    for r in chosen.filter(number).groupBy(*by, side, "item").agg(middle.alias("m")).collect():
        axes.setdefault(tuple(r[c] for c in by), []).append((r[side], r["item"], r["m"]))
    rows = {}
    groups: dict[tuple, list] = {}
    for r in group_sums(chosen, by, side, axes | {key: [] for key in good - axes.keys()}, most).collect():
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    for key, parts in groups.items():
        p = len(axes.get(key, ()))
        if not p:
            continue
        seen = np.array([np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=p) for r in parts]).astype(bool)
        sums = np.array([np.frombuffer(r["sums"]) for r in parts]).reshape(len(parts), -1, p)
        x, y = (np.array([k for k, cell in enumerate(axes[key]) if cell[0] == s], int) for s in (first, second))
        found = pair_totals(sums, seen, x, y)
        if found is not None:
            rows[key] = found
    if not rows:
        return None, values
    schema = T.StructType([*[values.schema[c] for c in by], *[T.StructField(c, T.LongType() if c == "n" else T.DoubleType()) for c in _FIELDS]])
    out = values.sparkSession.createDataFrame([(*key, *(int(v) if c == "n" else float(v) for c, v in zip(_FIELDS, found))) for key, found in rows.items()], schema)
    rest = sizes.keys() - rows.keys()
    return out, keep(rest) if rest else None
