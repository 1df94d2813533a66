"""Table sinks."""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, CSV (with header) or JSON."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite", files: int = 16) -> None:
    """One folder per entity. Rows meet by entity and a slice of its items, so a folder has at most ``files`` files."""
    scores = scores.repartition("entity", F.pmod(F.xxhash64("item"), F.lit(files)))
    write_table(scores.withColumnRenamed("item", "probe_id").withColumnRenamed("value", "sum_log_p"), path, "parquet", ["entity"], mode)


#: Folder name of a null or empty key, and what a folder name has as ``%XX``, as Spark writes them.
NO_KEY, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def key_folder(key: str, value: str | None) -> str:
    """``key=value`` as Spark names the folder of a partition."""
    return f"{key}=" + (ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else NO_KEY)


def write_text_tree(df: DataFrame, root: str, keys: Sequence[str], value: str = "value") -> None:
    """One small text file per set of ``keys`` (strings) in ``<root>/<key>=<id>/...``, with a line for each of its rows.

    In a ``file:`` folder, which all machines mount, tasks make the files themselves: Hadoop's local file system starts a process for the mode of every
    folder and file, which takes longer than all else. Other stores take Spark's writer; its tasks commit their own files (version 2).
    """
    # A given number of parts: the rows are few bytes, so adaptive execution would let one task write all files.
    dealt = df.select(*keys, value).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    if not root.startswith("file:"):
        dealt.write.partitionBy(*keys).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
        return
    top = "/" + root.removeprefix("file:").lstrip("/")

    def put(frames):
        n = 0
        rows = (r for pdf in frames for r in pdf.itertuples(index=False, name=None))
        for ids, same in itertools.groupby(rows, lambda r: r[:-1]):
            folder = "/".join([top, *map(key_folder, keys, ids)])
            os.makedirs(folder, exist_ok=True)
            # A task that runs again writes the same file; the hidden name keeps half a file from being read. Null and empty ids share a folder.
            hidden, name = f"{folder}/.{uuid.uuid4().hex}", "".join("0" if i is None else "1" for i in ids)
            with open(hidden, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{text or ''}\n" for *_, text in same)
            os.replace(hidden, f"{folder}/part-{name}.txt")
            n += 1
        yield pd.DataFrame({"n": [n]})

    os.makedirs(top)
    dealt.sortWithinPartitions(*keys).mapInPandas(put, "n long").agg(F.sum("n")).collect()
