"""File sources: FASTA, labelled CSV, score tables, result JSON, pair lists, embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respmosaic.functions import vocab
from respmosaic.functions.text import looks_like_dna
from respmosaic.operators.integrity import require_empty


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_idx, header, seq`` from plain or gzipped FASTA.

    Spark splits records itself on ``\\n>``, so a large plain file is read by many tasks.
    Text before the first '>' of a file is ignored; ``row_idx`` counts every record.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
        F.regexp_replace("value", "\r", "").alias("_rec"),
    )
    # Ids count up within a block, so a block's records are numbered from its first id and the records of the blocks before it.
    # Only these small sums are shuffled, never a text. Only the record that opens a file still has its '>' (or is junk).
    blocks = raw.groupBy("file", "_block").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min_by(F.col("_rec").startswith(">"), "_order").alias("_opened"))
    junk = ((F.col("_block") == 0) & ~F.col("_opened")).cast("long")
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", (F.col("_first") + junk).alias("_first"), (F.col("_n") - junk).alias("_n"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    records = raw.join(blocks, ["file", "_block"]).filter(F.col("_order") >= F.col("_first"))
    body = F.when(F.col("_rec").startswith(">"), F.substring(F.col("_rec"), F.lit(2), F.length("_rec"))).otherwise(F.col("_rec"))
    split = records.select("file", (F.col("_before") + F.col("_order") - F.col("_first")).alias("row_idx"), F.split(body, "\n", 2).alias("_p"))
    return split.select(
        "file",
        "row_idx",
        F.trim(F.get("_p", F.lit(0))).alias("header"),
        F.regexp_replace(F.coalesce(F.get("_p", F.lit(1)), F.lit("")), r"\s", "").alias("seq"),
    )


def fasta_lengths(records: DataFrame) -> DataFrame:
    """Length-only view of FASTA records with the short header label."""
    from respmosaic.functions.names import header_label

    return records.filter(F.length("seq") > 0).select("file", F.length("seq").alias("length"), header_label("header").alias("label"))


def delimiter(path: str) -> str:
    name = path.lower()
    return "\t" if name.endswith((".tsv", ".tsv.gz")) else ","


def resolve_columns(df: DataFrame, candidates: dict[str, Sequence[str]], ignore_case: bool = False, required: bool = True) -> DataFrame:
    """Rename the first candidate present in the header to each canonical name."""
    present = {c.lower() if ignore_case else c: c for c in df.columns}
    for target, names in candidates.items():
        found = next((present[n.lower() if ignore_case else n] for n in names if (n.lower() if ignore_case else n) in present), None)
        if found is None:
            if required:
                raise ValueError(f"no column for {target!r} among {list(names)}; header is {df.columns}")
            df = df.withColumn(target, F.lit(None).cast("string"))
        elif found != target:
            df = df.withColumnRenamed(found, target)
    return df


def name_columns(df: DataFrame, seq_names: Sequence[str] = vocab.SEQ_COLUMNS, label_names: Sequence[str] = vocab.LABEL_COLUMNS) -> DataFrame:
    """Renames the sequence and label columns; without a header name for the sequence, the first text column whose first value looks like DNA is it.

    A table without such a column keeps a null ``sequence`` (its records can still be counted), one without a label a null ``label``.
    """
    if not any(n in df.columns for n in seq_names):
        texts = [c.name for c in df.schema.fields if isinstance(c.dataType, T.StringType)]
        first = df.select(*[looks_like_dna(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(texts)]).first() if texts else None
        found = next((c for i, c in enumerate(texts) if first is not None and first[i]), None)
        if found is not None:
            df = df.withColumnRenamed(found, "sequence")
    return resolve_columns(df, {"sequence": ("sequence", *seq_names), "label": ("label", *label_names)}, required=False)


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV/TSV (plain or gz), all columns as text.

    ``multi_line`` allows line breaks inside quotes; each file is then read by one task.
    """
    return spark.read.option("header", True).option("sep", delimiter(path)).option("escape", '"').option("multiLine", multi_line).csv(path)


def read_labelled_csv(spark: SparkSession, path: str, seq_col: str = "sequence", label_col: str = "label") -> DataFrame:
    """``file, seq, label``, both trimmed; rows without a sequence are dropped."""
    df = read_csv(spark, path)
    return df.select(
        F.col("_metadata.file_path").alias("file"), F.trim(F.col(seq_col)).alias("seq"), F.trim(F.coalesce(F.col(label_col), F.lit(""))).alias("label")
    ).filter(F.length("seq") > 0)


def read_task_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``sequence`` in upper case and an integer ``label`` from ``<folder>/<split>.csv``."""
    df = resolve_columns(
        read_csv(spark, f"{folder}/{split}.csv"), {"sequence": ("sequence", "seq", "dna"), "label": ("label", "labels", "target", "y")}, ignore_case=True
    )
    return df.select(F.upper(F.trim("sequence")).alias("sequence"), F.col("label").cast("int").alias("label"))


def read_scores(spark: SparkSession, folder: str, item: str = "probe_id", value: str = "sum_log_p") -> DataFrame:
    """Long scores from a folder partitioned by ``entity=``; only two columns are read."""
    # Declared as text: inferred from folder names, "007" and "7" would be one number.
    found = spark.read.parquet(folder).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "entity" else f for f in found]
    df = spark.read.schema(T.StructType(fields)).parquet(folder)
    return df.select(F.col("entity"), F.col(item).alias("item"), F.col(value).cast("double").alias("value"))


RESULT_SCHEMA = (
    "model string, task string, auc_test string, auc_cv_mean double, auc_cv_std double, best_C double, n_train long, n_test long, "
    "embed_dim int, n_classes int, multiclass boolean, classifier string, skip_reason string, error_type string, refit_reason string, "
    "fit_params struct<n_cv:int,c_grid:array<double>,seed:int>, train_class_counts map<string,long>, _corrupt string"
)


def read_results(spark: SparkSession, root: str, pattern: str = "result.json") -> DataFrame:
    """A tree ``<root>/<entity>/<task>/result.json``; corrupt files stay as unreadable rows.

    Ids come from the path, so a file that cannot be parsed still names its cell; folders may be written as ``key=id``.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(RESULT_SCHEMA)
        .json(root)
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    df = raw.select(
        F.element_at(parts, -3).alias("_e"),
        F.element_at(parts, -2).alias("_t"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("auc_test").alias("auc"),
        "skip_reason",
        "error_type",
        F.to_json("fit_params").alias("fit_params"),
        "_corrupt",
    )
    name = lambda c: F.replace(F.regexp_replace(F.col(c), "^[a-z]+=", ""), F.lit("__"), F.lit("/"))
    return df.select(
        name("_e").alias("entity"), name("_t").alias("task"), F.col("_corrupt").isNull().alias("readable"), "auc", "skip_reason", "error_type", "fit_params", "mtime"
    )


def read_entity_json(spark: SparkSession, path: str, field: str = "models") -> DataFrame:
    """One JSON document holding a list of entities -> one row per entity."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("_m")).select("_m.*")


def read_pairs_csv(spark: SparkSession, path: str, min_pairs: int = 4) -> DataFrame:
    """Headerless ``anchor, partner, label``; at least four rows and one single anchor."""
    df = spark.read.schema("anchor string, partner string, label string").option("mode", "DROPMALFORMED").csv(path)
    return check_pairs(df.select(*[F.trim(c).alias(c) for c in df.columns]).dropna(), min_pairs)


def check_pairs(pairs: DataFrame, min_pairs: int = 4) -> DataFrame:
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("anchor").alias("anchors"))
    require_empty(counts.filter((F.col("pairs") < min_pairs) | (F.col("anchors") != 1)), f"need >= {min_pairs} pairs and one anchor")
    return pairs


def list_data_files(spark: SparkSession, root: str, skip_dirs: Sequence[str] = vocab.SKIP_DIRS, blacklist: Sequence[str] = ()) -> DataFrame:
    """``path`` (relative) of data files; a gzipped twin of a plain file is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("_full"), F.col("length").alias("bytes"))
    clean = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("_full", "^file:/+", "/"), "^" + clean + "/", "")
    skip = F.exists(F.split(rel, "/"), lambda p: p.isin(list(skip_dirs)))
    listed = files.withColumn("path", rel).filter(F.col("path").rlike(vocab.DATA_SUFFIX_PATTERN) & ~skip & ~F.col("path").rlike(r"(^|/)(README|readme)[^/]*$"))
    if blacklist:
        listed = listed.filter(~F.col("path").isin(list(blacklist)))
    twins = listed.select(F.concat("path", F.lit(".gz")).alias("path"))
    return listed.join(twins, "path", "left_anti").select("path", "bytes")


def feature_columns(columns: Sequence[str], prefix: str = "embed_") -> list[str]:
    """Wide feature columns by numeric suffix; suffixes must be exactly 0..D-1."""
    found = sorted((int(c[len(prefix) :]), c) for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit())
    if not found or [i for i, _ in found] != list(range(len(found))):
        raise ValueError(f"columns {prefix}* must have dense suffixes from 0")
    return [c for _, c in found]


def pack_features(df: DataFrame, prefix: str = "embed_", out: str = "features") -> DataFrame:
    names = feature_columns(df.columns, prefix)
    rest = [c for c in df.columns if c not in set(names)]
    return df.select(*rest, F.array(*[F.col(n).cast("float") for n in names]).alias(out))


def unpack_features(df: DataFrame, dim: int, features: str = "features", prefix: str = "embed_") -> DataFrame:
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.get(features, F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)])


class Catalog:
    """Named datasets: ``load_panel("main")`` with unknown names rejected."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, dict(paths)

    def load_panel(self, name: str) -> DataFrame:
        if name not in self.paths:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(self.paths)}")
        return self.spark.read.parquet(self.paths[name])

    def load_control_panel(self) -> DataFrame:
        return self.load_panel("control")


def record_path(row_idx: Column | str, path: Column | str) -> Column:
    """Provenance text ``<path>#row_<i>``."""
    p = F.col(path) if isinstance(path, str) else path
    r = F.col(row_idx) if isinstance(row_idx, str) else row_idx
    return F.concat(p, F.lit("#row_"), r.cast("string"))
