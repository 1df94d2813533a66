"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respmosaic.llm.storage import store


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: nodes share a root exactly when a path joins them.

    Each round points every node at its smallest neighbour, jumps twice along the pointers and contracts the edges; a round
    is stored, so a lost executor repeats one round at most. Null ends and loops are ignored; no edges give no rows.
    """
    left = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while not left.isEmpty():
        near = left.unionAll(left.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        near = store(near, "cc-near")
        for _ in range(2):
            up = near.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            near = near.join(up, "p").select("v", F.col("pp").alias("p"))
        near = store(near, "cc-up")
        if roots is None:
            roots = near.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            roots = store(roots.join(near.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        moved = left.join(near.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(near.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        left = store(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
