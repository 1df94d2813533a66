"""Corpus preparation in five stages, each a function ``(spark, docs, sf_dir) -> DataFrame`` over all its predecessor kept.

Rejected documents, all but one of each near-duplicate group, and contaminated documents leave; secrets are replaced in the
text; the last stage adds token ids. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.llm import bpe, decontaminate, ngram_join, quality, secret_scan
from respmosaic.llm.queries import table
from respmosaic.llm.storage import store


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows: buffers of workers and executors follow them, and texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more stands in benchmark windows."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text and counts its characters anew; every document stays."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    small_batches(spark)
    encoded = bpe.decode(bpe.encode(docs))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmarks),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]

#: The classifier is learned, so SQL cannot express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
