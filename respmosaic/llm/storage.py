"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from respmosaic.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    return store_at(df, name)[0]


def store_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`store`, with the folder, for :func:`remove` once no later stage reads it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes stored folders by Hadoop's file system, wherever they are, and lets the driver drop the shuffle files of finished steps."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()  # plans that Python still holds keep their shuffles
    jvm.System.gc()
