"""Vector code compression: product codes whose codebooks come from ball k-means, in exact integers.

A vector is cut into parts, and each part position has a small codebook. The members of an entry form a ball; only entries whose
centre is nearer than twice the ball's radius are its neighbours. A member nearer to its centre than half the way to the nearest
neighbour lies in the stable core and is not compared with anything; the others lie in annular rings, and a member of ring k is compared
with the k nearest neighbours only. A ball is skipped while neither its entry nor a neighbour has moved. All tests are made on squared
integer distances, so the codes are those of a full comparison, ties included.

A round is one pass: tasks read the rows with their last codes, move them, and add one row with their sums per entry. The driver sees
the sums of the codebooks only, whose size does not depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.llm.storage import remove, store_at

#: Parts of a vector, entries of a codebook, rounds, and steps per unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums travel in digits of so many bits, as many as the component type can need.
DIGIT = 40
_DIGITS = {"float": 4, "double": 27}
_MOST = (1 << 63) - 1


class Coded(NamedTuple):
    """Rows with ``row`` (all their columns), ``code`` (one byte per part) and ``error``; final codebooks by part and entry."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * value)``: 64-bit where squared distances fit, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not values.size or np.abs(scaled).max() < 2**29 / np.sqrt(max(1, values.shape[-1])):
        return scaled.astype(np.int64)
    whole = [int(s) if np.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(whole, dtype=object).reshape(values.shape)


def _square(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each part by comparison with every entry, ties to the lower index."""
    code, best = np.zeros(len(x), np.int64), _square(x - entries[0])
    for j in range(1, len(entries)):
        d = _square(x - entries[j])
        less = d < best
        code[less], best[less] = j, d[less]
    return code, best


def move(x: np.ndarray, own: np.ndarray, entries: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and squared distance of each part, given its code before the entries marked ``changed`` moved to ``entries``."""
    gap = _square(entries[:, None] - entries[None])
    best = _square(x - entries[own])
    code, reach = own.copy(), 4 * best
    order = np.argsort(own, kind="stable")
    bound = np.searchsorted(own[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[bound[i] : bound[i + 1]]
        if not len(ball):
            continue
        radius = reach[ball].max()
        near = np.array([j for j in np.argsort(gap[i], kind="stable") if j != i and gap[i][j] <= radius], dtype=np.int64)
        if not len(near) or not (changed[i] or changed[near].any()):
            continue
        ring = np.searchsorted(gap[i][near], reach[ball], "right")
        for k, j in enumerate(near):
            pick = ball[ring > k]
            d = _square(x[pick] - entries[j])
            wins = (d < best[pick]) | ((d == best[pick]) & (j < code[pick]))
            code[pick[wins]], best[pick[wins]] = j, d[wins]
    return code, best


def _array(entries: list[list[int]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries as an array, with parts of a type in which their distances are exact."""
    bound = 2**29 / np.sqrt(max(1, like.shape[-1]))
    if like.dtype != object and all(-bound < v < bound for e in entries for v in e):
        return np.array(entries, np.int64), like
    return np.array(entries, dtype=object), like.astype(object)


def _pass(books, previous, parts: int, width: int, digits: int, scale: int, vec: str, schema):
    """One round over batches: new codes, errors, and a last row with the sums of this task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def digit_row(count: np.ndarray, total: list) -> list[int]:
        flat = []
        for p in range(parts):
            for e in range(len(books.value[p])):
                flat.append(int(count[p][e]))
                for v in total[p][e]:
                    flat += [(v >> (DIGIT * k)) & ((1 << DIGIT) - 1) for k in range(digits - 1)] + [v >> (DIGIT * (digits - 1))]
        return flat

    def run(batches):
        now, before = books.value, previous
        count = [np.zeros(len(b), np.int64) for b in now]
        total = [[[0] * width for _ in b] for b in now]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = batch.column("row")
            vectors = rows.field(vec)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            padded = np.zeros((n, parts * width))
            padded[:, : flat.shape[1]] = flat
            x = integers(padded.reshape(n, parts, width), scale)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts) if before else None
            codes, error = np.zeros((n, parts), np.uint8), [0] * n if x.dtype == object else np.zeros(n, np.int64)
            for p in range(parts):
                entries, part = _array(now[p], x[:, p])
                if before:
                    changed = np.array([a != b for a, b in zip(now[p], before.value[p])])
                    code, d = move(part, old[:, p].astype(np.int64), entries, changed)
                else:
                    code, d = nearest(part, entries)
                codes[:, p] = code
                error = error + d
                count[p] += np.bincount(code, minlength=len(now[p]))
                for e in np.unique(code).tolist():
                    total[p][e] = [a + int(b) for a, b in zip(total[p][e], part[code == e].sum(axis=0))]
            error = [min(int(v), _MOST) for v in error]
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64()), pa.nulls(n, target.field("sums").type)], schema=target
            )
        if any(c.any() for c in count):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, target.field("row").type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([digit_row(count, total)], target.field("sums").type)], schema=target)

    return run


def _means(stored: DataFrame, books: list, digits: int) -> list:
    """Entries replaced by the floors of their members' means; entries without members stay."""
    cells = stored.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    flat = {r["at"]: r["v"] for r in cells.collect()}  # one number per digit of a codebook
    at, out = 0, []
    for entries in books:
        new = []
        for entry in entries:
            n = flat.get(at, 0)
            at += 1
            values = [sum(flat.get(at + digits * w + k, 0) << (DIGIT * k) for k in range(digits)) for w in range(len(entry))]
            at += digits * len(entry)
            new.append([v // n for v in values] if n else entry)
        out.append(new)
    return out


def encode(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded:
    """Codebooks of ``vectors`` and one coded row per usable vector.

    Vectors that are null, empty or hold null or non-finite components are left out. Components become ``floor(scale * x)``; a length that
    ``parts`` does not divide is filled up with zeros at the end. The length is that of the usable vector with the smallest id; vectors of
    another length are left out. Codebooks start as the vectors of the smallest ids (equal ids by vector; fewer vectors give fewer entries).
    Repeated rows are coded alike and count as often as they occur; null ids come last. Of no vectors, the result is empty. Components of any size
    are exact; an error over 2**63 - 1 is returned as that number.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    element = kind if kind in _DIGITS else "double"
    values = vectors.select(F.struct(*[vectors[f"`{c}`"] for c in vectors.columns]).alias("row"))
    vec = F.col("row").getField(vec_col)
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = values.where(vec.isNotNull() & (F.size(vec) > 0) & ~bad)
    first = usable.select(F.col("row").getField(id_col).alias("id"), vec.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    schema = T.StructType([T.StructField("row", values.schema["row"].dataType), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    if not first:
        return Coded(values.where("false").select("row", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), [[] for _ in range(parts)])
    size = len(first[0]["v"])
    width = -(-size // parts)
    usable = usable.where(F.size(vec) == size)
    start = usable.select(F.col("row").getField(id_col).alias("id"), vec.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    heads = [integers(np.array([[float(v) for v in r["v"]] + [0.0] * (parts * width - size)]), scale)[0] for r in start]
    books = [[[int(v) for v in h[p * width : (p + 1) * width]] for h in heads] for p in range(parts)]
    previous, state, old = None, usable, None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        stored, path = store_at(state.mapInArrow(_pass(shared, previous, parts, width, _DIGITS[element], scale, vec_col, schema), schema), "vector-codes")
        if old:
            remove(spark, old)
        state, old, previous = stored.where("sums is null").select("row", "code", "error"), path, shared
        if turn < rounds:
            books = _means(stored, books, _DIGITS[element])
    return Coded(state, books)


def approximate(coded: Coded, scale: int = SCALE, out_col: str = "approximation") -> DataFrame:
    """The coded rows with the vector that a code stands for (the middle of each component's step)."""
    table = F.array(*[F.array(*[F.array(*[F.lit((v + 0.5) / scale) for v in e]) for e in b]) for b in coded.codebooks])
    at = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return coded.rows.withColumn(out_col, F.concat(*[table[p][at(p)] for p in range(len(coded.codebooks))]) if any(coded.codebooks) else F.lit(None).cast("array<double>"))


def digest(vectors: DataFrame) -> DataFrame:
    """Contract columns: code in hex, error, error summed over equal labels, and the digest of the final codebooks."""
    coded = encode(vectors.select("vec_id", "embedding", "label"))
    final = hashlib.sha256(",".join(str(v) for b in coded.codebooks for e in b for v in e).encode()).hexdigest()
    rows = coded.rows.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error")
    most = F.lit(_MOST).cast("decimal(38,0)")
    total = rows.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    joined = rows.join(total, rows["label"].eqNullSafe(total["l"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(final).alias("codebooks_sha256"))
