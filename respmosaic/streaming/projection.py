"""Projection of new entities as rows arrive; stateless, equal to the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.operators.matrix import floor_at

ROW_SCHEMA = "entity long, items array<long>, values array<double>"


def project_rows(rows: DataFrame, thresholds: DataFrame, col_means: DataFrame) -> DataFrame:
    """Row-form input (item-aligned arrays) to long ``entity, item, value``.

    An entity's own mean comes from its array alone, so no state is kept; cells then meet the
    fitted item means in a stream-static equi-join. The floor is a one-row static side.
    """
    floor = F.broadcast(thresholds.select(F.lit(1).alias("_one"), F.col("threshold").alias("_floor")))
    keyed = rows.withColumn("_one", F.lit(1)).join(floor, "_one").drop("_one")
    clipped = keyed.withColumn("_c", F.transform("values", lambda x: floor_at(x, F.col("_floor"))))
    n = F.size(F.filter("_c", lambda x: x.isNotNull()))
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    own = clipped.withColumn("_own", F.when(n > 0, total / n))
    cells = own.select("entity", "_own", F.explode(F.arrays_zip("items", "_c")).alias("_z"))
    cells = cells.select("entity", F.col("_z.items").alias("item"), (F.col("_z._c") - F.col("_own")).alias("value"))
    fitted = col_means.select("item", "col_mean")
    return cells.join(fitted, "item").select("entity", "item", (F.col("value") - F.col("col_mean")).alias("value"))


def run_stream_project(spark: SparkSession, source: str, thresholds: DataFrame, col_means: DataFrame, target: str, checkpoint: str, schema: str = ROW_SCHEMA):
    out = project_rows(spark.readStream.schema(schema).parquet(source), thresholds, col_means)
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
