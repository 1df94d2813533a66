"""Coverage of score files as they arrive (file source, keyed state)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from respmosaic.operators.integrity import judge_counts

SCORE_SCHEMA = "entity string, item long, value double"
#: What is kept of an entity, packed: its items in order, how often the latest batch of each had it, and whether the value is there and the item on the panel.
STATE, KINDS = "items binary, copies binary, finite binary, listed binary", (np.int64, np.int32, bool, bool)
COUNTS = "entity string, n_rows long, n_distinct long, n_extra long, n_on_panel long, n_finite long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def seen_items(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the items an entity has been scored on; a batch replaces what earlier ones said about its items, and gives the new counts.

    State and counts are plain arrays, and Spark sends many entities at once with their state: an entity costs no round trip and no grouping of its own.
    """
    item, value, on_panel = (np.concatenate(x) for x in zip(*((f["item"].to_numpy(), f["value"].to_numpy(float), f["listed"].to_numpy(bool)) for f in frames)))
    known = ~pd.isna(item)
    items, at = np.unique(item[known].astype(np.int64), return_inverse=True)
    new = [items, np.bincount(at, minlength=len(items)), *(np.bincount(at, x[known], len(items)) > 0 for x in (np.isfinite(value), on_panel))]
    if state.exists:
        old = [np.frombuffer(x, kind) for x, kind in zip(state.get, KINDS)]
        kept = ~np.isin(old[0], items)
        new = [np.concatenate([o[kept], n]) for o, n in zip(old, new)]
    order = np.argsort(new[0])
    items, copies, finite, listed = (x[order].astype(kind) for x, kind in zip(new, KINDS))
    state.update(tuple(x.tobytes() for x in (items, copies, finite, listed)))
    yield pd.DataFrame({
        "entity": [key[0]], "n_rows": [int(copies.sum())], "n_distinct": [len(items)], "n_extra": [int((~listed).sum())],
        "n_on_panel": [int(listed.sum())], "n_finite": [int((listed & finite).sum())],
    })


def score_stream(spark: SparkSession, path: str, schema: str = SCORE_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_stream_coverage(spark: SparkSession, source: str, store: str, checkpoint: str, items: DataFrame, schema: str = SCORE_SCHEMA):
    """Counts of every entity that a micro-batch touches, written to ``store``, one folder per batch id.

    What an entity has been scored on is kept as keyed state (RocksDB) in the checkpoint, so neither a batch nor a later question reads
    earlier score files again. Rewriting a folder makes a replayed batch idempotent; files that come late or repeat cells replace those cells.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    panel = items.select("item").distinct().withColumn("listed", F.lit(True))
    marked = score_stream(spark, source, schema).join(panel, "item", "left").select("entity", "item", "value", F.coalesce("listed", F.lit(False)).alias("listed"))
    changed = marked.groupBy("entity").applyInPandasWithState(seen_items, COUNTS, STATE, "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return changed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_coverage(spark: SparkSession, store: str, items: DataFrame) -> DataFrame:
    """DONE when the gate passes, else PARTIAL with its reason, from the latest counts of each entity."""
    names = ["n_rows", "n_distinct", "n_extra", "n_on_panel", "n_finite"]
    latest = spark.read.parquet(store).groupBy("entity").agg(F.max_by(F.struct(*names), "batch").alias("c")).select("entity", "c.*")
    gate = judge_counts(latest, items)
    return gate.select("entity", F.when(F.col("ok"), "DONE").otherwise("PARTIAL").alias("state"), "reason", "n_finite", "n_panel")
