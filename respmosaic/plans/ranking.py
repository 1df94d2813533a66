"""Exact ranks and running totals without a one-partition window.

All helpers follow one scheme: put each row into an order-preserving bucket, number rows
inside the bucket, and add the number of rows in earlier buckets. Ordered ranks take Spark's
own range partitioning by all order columns; hashed ranks take the first digits of the hash.
The bucket table is small (buckets x groups), so a group that holds most of the rows is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.plans.stable import materialise, stable

#: Rows that one range may hold before all rows are cut anew, and how often that is tried.
RANGE_ROWS, MOST_CUTS = 4_000_000, 4


def seeded_key(seed: int | str, *cols: str) -> Column:
    """md5 over ``seed|col|...``: a random-looking order any engine can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _number_in_buckets(df: DataFrame, by: Sequence[str], buckets: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    inside = Window.partitionBy(*by, *buckets).orderBy(*order)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, *buckets)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    numbered = df.withColumn("_at", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*by, *buckets])
        .withColumn(out, (F.col("_at") + F.col("_before")).cast("long"))
        .drop("_at", "_before", *buckets)
    )


def hash_rank(df: DataFrame, by: Sequence[str], seed: int | str, keys: Sequence[str], out: str = "rank", hashed: Sequence[str] | None = None) -> DataFrame:
    """1-based rank by ``md5(seed|hashed)`` inside each group; ``keys`` break equal hashes.

    The first three hex digits are the bucket: uniform by construction, 4096 per group.
    """
    keyed = df.withColumn("_h", seeded_key(seed, *(hashed or keys)))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, 3))
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    return _number_in_buckets(keyed, list(by), ["_b"], order, out).drop("_h")


def _ranged(df: DataFrame, keys: Sequence[Column], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` in the order of ``keys``, cut into ranges, stored with ``_part`` and ``_at``, and the sizes ``(_part, _n)`` of the ranges.

    Spark draws the cuts from a sample of all keys, so rows that tie on the first are cut by the next ones; a hash of the whole row comes last and
    cuts full ties. The sizes are counted on the stored rows: while a range holds more than ``rows``, all are cut anew into as many as the count asks for.
    """
    limit = rows or RANGE_ROWS
    hashable = [c.name for c in df.schema.fields if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    keys = [*keys, F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(MOST_CUTS):
        placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
        # The id is the number of the range, then the place inside it in the low 33 bits.
        stored = materialise(placed).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
        sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        most = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("total")).first()
        if (most["most"] or 0) <= limit:
            break
        parts = max(2 * parts, -(-2 * most["total"] // limit))
    return stored, sizes


def _directed(name: str, direction: str) -> Column:
    return F.col(name).asc_nulls_last() if direction == "asc" else F.col(name).desc_nulls_last()


def ordered_rank(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, str]], out: str = "rank", rows: int | None = None) -> DataFrame:
    """1-based ``row_number`` by ``order`` (pairs of column and 'asc'/'desc'; nulls last).

    One sort by group and order over all ranges: a row's rank is its place less the place where its group starts in its range, plus
    the group's rows in earlier ranges. ``rows`` bounds a range.
    """
    by = list(by)
    stored, _ = _ranged(df, [*[F.col(c).asc_nulls_last() for c in by], *[_directed(c, d) for c, d in order]], rows)
    pieces = stored.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return _with_pieces(stored, offsets, by).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _with_pieces(rows: DataFrame, pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their group's piece in their range (null groups meet null groups)."""
    named = pieces.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_part"])], *[c for c in pieces.columns if c not in (*by, "_part")])
    same = F.lit(True)
    for i, c in enumerate([*by, "_part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same).drop(*[f"_k{i}" for i in range(len(by) + 1)])


def running_total(df: DataFrame, by: Sequence[str], value: str, amount: str, out: str = "before", rows: int | None = None) -> DataFrame:
    """Sum of ``amount`` over rows with a smaller ``value`` in the group; ``value`` must be distinct inside a group (pre-aggregate first)."""
    by = list(by)
    stored, _ = _ranged(df, [*[F.col(c).asc_nulls_last() for c in by], F.col(value).asc_nulls_last()], rows)
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored.groupBy(*by, "_part").agg(F.sum(amount).alias("_n"))
    offsets = pieces.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    summed = stored.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return _with_pieces(summed, offsets, by).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off", "_part", "_at")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct value: ``n``, number of smaller rows, tie-averaged rank.

    Counting values first folds any hot value into one row before the ordering.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.alias("n"))
    return with_average_rank(counted, value, by)


def with_average_rank(counted: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``n_below, avg_rank`` to one row per distinct value with its count ``n``."""
    ranked = running_total(counted, by, value, "n", "n_below")
    return ranked.withColumn("avg_rank", F.col("n_below") + (F.col("n") + 1) / 2)


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Tie-averaged rank of every row (rows with a null value are dropped)."""
    df = stable(df, value)
    ranks = value_ranks(df, value, by).select(*by, value, F.col("avg_rank").alias(out))
    return df.join(ranks, [*by, value])
