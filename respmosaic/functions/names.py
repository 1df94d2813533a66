"""Rules over names, paths, headers and small JSON configs, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respmosaic.functions import vocab


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match_rules(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None = None) -> Column:
    """Label of the first rule whose needle occurs in the lower-cased text."""
    text = F.lower(_col(c))
    out = None
    for needle, label in rules:
        hit = text.contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    fallback = F.lit(default) if isinstance(default, str) or default is None else default
    return fallback if out is None else out.otherwise(fallback)


def basename(c: Column | str) -> Column:
    s = _col(c)
    return F.when(F.instr(s, "/") > 0, F.regexp_replace(s, "^[^/]*/", "")).otherwise(s)


def slug(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("/"), F.lit("__"))


def unslug(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("__"), F.lit("/"))


def organization(c: Column | str, exceptions: Sequence[tuple[str, str]] = vocab.ORGANIZATION_EXCEPTIONS) -> Column:
    """Part before the first '/', unless an exception needle names the owner first."""
    s = _col(c)
    owner = F.when(F.instr(s, "/") > 0, F.substring_index(s, "/", 1)).otherwise("")
    return first_match_rules(s, exceptions, owner)


def family(c: Column | str) -> Column:
    return first_match_rules(c, vocab.FAMILY_RULES, F.substring_index(basename(c), "-", 1))


def branch(c: Column | str) -> Column:
    return first_match_rules(c, vocab.BRANCH_RULES, "manual_unknown")


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(c == key, value).otherwise(out)
    return out


def training_paradigm(branch_col: Column | str) -> Column:
    return _lookup(_col(branch_col), vocab.PARADIGM_BY_BRANCH, "unknown")


def score_protocol(c: Column | str, branch_col: Column | str) -> Column:
    special = F.lower(_col(c)).contains("dnabert-s")
    return F.when(special, "embedding_or_mlm_manual").otherwise(_lookup(_col(branch_col), vocab.PROTOCOL_BY_BRANCH, "manual_unknown"))


def architecture(c: Column | str, model_type: Column | str | None = None, class_name: Column | str | None = None) -> Column:
    """Struct of label and the source that decided it: name, config type, config class."""
    by_name = first_match_rules(c, vocab.ARCHITECTURE_RULES)
    by_type = first_match_rules(model_type, vocab.MODEL_TYPE_RULES) if model_type is not None else F.lit(None).cast("string")
    by_class = first_match_rules(class_name, vocab.MODEL_TYPE_RULES) if class_name is not None else F.lit(None).cast("string")
    sources = [(by_name, "name"), (by_type, "config_type"), (by_class, "config_class")]
    return priority_coalesce(sources, "unknown", "unknown")


def tokenizer_type(c: Column | str, model_type: Column | str | None = None) -> Column:
    """Tokenizer kind by name, else by the config's model type, else ``manual_unknown``."""
    text = F.lower(_col(c))
    by_type = first_match_rules(model_type, vocab.TOKENIZER_BY_MODEL_TYPE, "manual_unknown") if model_type is not None else F.lit("manual_unknown")
    k = F.regexp_extract(text, r"dna_bert_(\d+)", 1)
    overlapping = F.concat(F.lit("overlapping_"), k, F.lit("mer"))
    return F.when(k != "", overlapping).otherwise(first_match_rules(text, vocab.TOKENIZER_RULES, by_type))


def priority_coalesce(sources: Sequence[tuple[Column, str]], default=None, default_source: str = "") -> Column:
    """Struct (value, source) of the first non-null candidate."""
    tag = None
    for value, name in sources:
        tag = F.when(value.isNotNull(), name) if tag is None else tag.when(value.isNotNull(), name)
    value = F.coalesce(*[v for v, _ in sources], F.lit(default)) if default is not None else F.coalesce(*[v for v, _ in sources])
    return F.struct(value.alias("value"), tag.otherwise(default_source).alias("source"))


def extract_size(c: Column | str) -> Column:
    """Largest ``<number>m`` or ``<number>b`` in a name, in units; null without one."""
    text = F.lower(_col(c))
    guard, tail = r"(?<![a-z\d])", r"(?![a-z])"
    numbers = F.regexp_extract_all(text, F.lit(guard + r"(\d+(?:\.\d+)?)\s*[mb]" + tail), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(guard + r"\d+(?:\.\d+)?\s*([mb])" + tail), F.lit(1))
    sizes = F.zip_with(numbers, units, lambda n, u: (n.cast("double") * F.when(u == "b", 1e9).otherwise(1e6)).cast("long"))
    best = F.array_max(sizes)
    return F.when(best > 0, best)


def infer_context(c: Column | str) -> Column:
    """Context length from name shorthands: marked power-of-two tokens, then patterns."""
    text = F.lower(_col(c))
    marked = F.lit(False)
    for m in vocab.CONTEXT_MARKERS:
        marked = marked | text.contains(m)
    out = None
    for token, value in vocab.CONTEXT_TOKENS:
        hit = marked & text.contains(token)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    for pattern, unit in vocab.CONTEXT_PATTERNS:
        found = F.regexp_extract(text, pattern, 1)
        out = out.when(found != "", found.try_cast("long") * unit)
    return out.cast("long")


def context_from_name(c: Column | str) -> Column:
    """Struct (value, source) of :func:`infer_context`; the source tells shorthands of powers of two from other numbers."""
    text = F.lower(_col(c))
    marked = F.lit(False)
    for m in vocab.CONTEXT_MARKERS:
        marked = marked | text.contains(m)
    rounded = F.lit(False)
    for token, value in vocab.CONTEXT_TOKENS:
        if value & (value - 1) == 0:
            rounded = rounded | text.contains(token)
    value = infer_context(c)
    source = F.when(value.isNull(), "").when(marked & rounded, "model_name_power_of_two").otherwise("model_name")
    return F.struct(value.alias("value"), source.alias("source"))


def context_hits(config: Column | str, keys: Sequence[str] = vocab.CONTEXT_KEYS) -> Column:
    """``array<struct<path, found>>``: every wanted number of a JSON text, at any depth, in document order."""
    wanted = frozenset(keys)

    @F.pandas_udf("array<struct<path:string,found:bigint>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "found": n} for p, n in _walk(t, wanted)] for t in texts])

    return find(_col(config).cast("string"))


def _ends_with(key: str):
    return lambda hit: (hit["path"] == key) | hit["path"].endswith(f".{key}")


def choose_context(override: Column, override_source: Column, config: Column, tokenizer: Column, name: Column | str) -> Column:
    """Struct (value, source): an override, a config number (listed keys in their order, then any), a tokenizer number, the name.

    ``config`` and ``tokenizer`` are columns of :func:`context_hits`. Empty or null hits pass on to the next.
    """
    listed = [F.get(F.filter(config, _ends_with(key)), F.lit(0)) for key in vocab.CONTEXT_PRIORITY]
    from_config = F.coalesce(*listed, F.get(config, F.lit(0)))
    from_tokenizer = F.get(tokenizer, F.lit(0))
    from_name = context_from_name(name)
    tagged = [
        (override.cast("long"), F.concat(F.lit("override:"), override_source)),
        (from_config["found"], F.concat(F.lit("config:"), from_config["path"])),
        (from_tokenizer["found"], F.concat(F.lit("tokenizer_config:"), from_tokenizer["path"])),
        (from_name["value"], from_name["source"]),
    ]
    source = F.lit("")
    for value, tag in reversed(tagged):
        source = F.when(value.isNotNull(), tag).otherwise(source)
    return F.struct(F.coalesce(*[v for v, _ in tagged]).alias("value"), source.alias("source"))


def context_bp(tokens: Column | str, kind: Column | str, fam: Column | str) -> Column:
    """Letters a context covers, by tokenizer kind; null when the ratio is unknown."""
    t, k = _col(tokens), _col(kind)
    overlap = F.regexp_extract(k, r"overlapping_(\d+)mer", 1)
    ratio = F.lit(None).cast("double")
    for name, value in vocab.LETTERS_PER_TOKEN:
        ratio = F.when(_col(fam) == name, F.lit(value)).otherwise(ratio)
    word_pieces = k.contains("bpe") | k.contains("wordpiece")
    return (
        F.when(t.isNull() | (t <= 0), F.lit(None).cast("long"))
        .when((overlap != "") & ~k.contains("non_overlapping"), t + overlap.try_cast("long") - 1)
        .when(k.contains("6mer"), t * 6)
        .when(k.contains("3mer") | k.contains("codon"), t * 3)
        .when(k.contains("single_nucleotide") | k.contains("byte"), t)
        .when(word_pieces, F.floor(t * ratio))
        .cast("long")
    )


def modality_flags(c: Column | str, kind: Column | str) -> Column:
    text, k = F.lower(_col(c)), _col(kind)
    codon = k.contains("codon") | text.contains("genslm")
    mixed = F.lit(False)
    for marker in vocab.MIXED_MODALITY_MARKERS:
        mixed = mixed | text.contains(marker)
    classes = F.when(mixed, "coding_only_pending_manual").when(codon, "coding_only").otherwise("coding_and_noncoding")
    return F.struct(codon.alias("is_codon"), mixed.alias("mixed"), classes.alias("valid_classes"))


def param_scale(c: Column | str) -> Column:
    return first_match_rules(c, vocab.PARAM_SCALE_RULES, "unknown")


def family_short(c: Column | str) -> Column:
    return first_match_rules(c, vocab.FAMILY_SHORT_RULES, "other")


def estimate_params(config: Column | str) -> Column:
    """12 * layers * hidden^2 from a JSON config, with key fallbacks; null when missing."""
    def first_key(keys: Sequence[str]) -> Column:
        found = [F.get_json_object(_col(config), f"$.{k}").try_cast("double").cast("long") for k in keys]
        return F.coalesce(*[F.when(f != 0, f) for f in found])

    return (12 * first_key(vocab.LAYER_KEYS) * first_key(vocab.HIDDEN_KEYS) * first_key(vocab.HIDDEN_KEYS)).cast("long")


def preset_size(c: Column | str) -> Column:
    """Size that a preset in a name stands for; null without one."""
    text, out = F.lower(_col(c)), F.lit(None).cast("long")
    for token, size in reversed(vocab.SIZE_PRESETS):
        out = F.when(text.contains(token), F.lit(size).cast("long")).otherwise(out)
    return out


def choose_size(name: Column | str, config: Column | str, override: Column | None = None, weights: Column | None = None, metadata: Column | None = None, weight_file: Column | None = None) -> Column:
    """Struct (value, source): the first known size of seven levels, counted ones before guesses.

    An override, loaded weights, published metadata and a weight file's shapes are given as columns (or left out); then come the number in
    the name, the preset in the name and the estimate from the config. Without any the value is null and the source ``unknown``.
    """
    given = [(override, "override"), (weights, "weights_loaded"), (metadata, "hf_safetensors_metadata"), (weight_file, "hf_weight_file_loaded")]
    levels = [(c.cast("long"), tag) for c, tag in given if c is not None]
    levels += [(extract_size(name), "hf_id_name"), (preset_size(name), "hyenadna_preset"), (estimate_params(config), "hf_config_estimate")]
    return priority_coalesce(levels, default_source="unknown")


def _walk(text: str | None, keys: frozenset[str]):
    """``(path, number)`` of wanted keys at any depth, in document order; nothing for text that is not JSON."""
    try:
        root = json.loads(text, parse_constant=lambda name: None) if text is not None else None
    except ValueError:
        return
    stack = [("", None, root)]
    while stack:
        path, key, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}" if path else k, k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", None, v) for i, v in reversed(list(enumerate(value)))]
        elif key in keys and isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < 10_000_000:
            yield path, int(value)


def json_find_keys(df: DataFrame, json: str, keys: Sequence[str] = vocab.CONTEXT_KEYS) -> DataFrame:
    """Every wanted numeric key in nested JSON, at any depth: ``*df.columns, path, found`` (one row each).

    Values must be numbers in (0, 1e7), booleans excluded. A document is parsed once.
    """
    hits = df.select(*df.columns, F.explode_outer(context_hits(json, keys)).alias("_hit"))
    return hits.filter(F.col("_hit").isNotNull()).select(*df.columns, "_hit.path", "_hit.found")


def file_stem(path: Column | str) -> Column:
    name = F.substring_index(_col(path), "/", -1)
    known = F.regexp_replace(name, vocab.DATA_SUFFIX_PATTERN, "")
    return F.when(known != name, known).otherwise(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))


def derive_dataset_split(path: Column | str) -> Column:
    """Struct (dataset, split) from a relative path, first matching layout wins."""
    p = _col(path)
    parts = F.split(p, "/")
    n, stem = F.size(parts), file_stem(p)
    words = list(vocab.SPLIT_WORDS)
    parent_name = F.lower(F.get(parts, n - 2))
    parent = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "/")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "/")
    suffix = r"(?i)^(.*)_(" + "|".join(words) + r")$"
    by_suffix = F.regexp_extract(stem, suffix, 1)
    tail = F.lower(F.regexp_extract(stem, suffix, 2))

    def pair(dataset: Column, split: Column) -> Column:
        return F.struct(dataset.alias("dataset"), split.alias("split"))

    return (
        F.when((n >= 3) & parent_name.isin(words) & ~F.lower(stem).isin(words), pair(above, parent_name))
        .when((n >= 2) & F.lower(stem).isin(words), pair(parent, F.lower(stem)))
        .when((n >= 2) & (tail != ""), pair(F.concat_ws("/", parent, by_suffix), tail))
        .when(n >= 2, pair(F.concat_ws("/", parent, stem), F.lit("")))
        .otherwise(pair(stem, F.lit("")))
    )


def derive_task_group(dataset: Column | str) -> Column:
    return F.substring_index(_col(dataset), "/", 1)


def derive_task_type(dataset: Column | str, n_labels: Column | str) -> Column:
    n = _col(n_labels)
    regression = F.lit(False)
    for word in vocab.REGRESSION_WORDS:
        regression = regression | F.lower(_col(dataset)).contains(word)
    return (
        F.when(regression, "regression").when(n == 0, "unlabeled").when(n == 1, "single_label").when(n == 2, "binary").when(n > 2, "multiclass").otherwise("unknown")
    )


def parse_source(c: Column | str) -> Column:
    """Struct (benchmark, task_path) of ``data/<benchmark>/<path>#row_n``."""
    s = _col(c)
    ours = F.startswith(s, F.lit("data/"))
    rest = F.regexp_replace(F.regexp_replace(s, r"^data/[^/]*/?", ""), r"#row_\d+.*$", "")
    bench = F.get(F.split(s, "/"), F.lit(1))
    return F.struct(F.when(ours, bench).otherwise("other").alias("benchmark"), F.when(ours, rest).otherwise(s).alias("task_path"))


def source_dataset(c: Column | str, rename: dict[str, str] | None = None) -> Column:
    """Short dataset name: no row suffix, no ``data/``, no file, then a rename map."""
    s = F.regexp_replace(F.substring_index(_col(c), "#", 1), "^data/", "")
    s = F.when(s.endswith(".csv") & (F.instr(s, "/") > 0), F.regexp_replace(s, "/[^/]*$", "")).otherwise(s)
    s = F.regexp_replace(s, "/train$", "")
    s = F.when((s.endswith(".fasta") | s.endswith(".fa")) & (F.instr(s, "/") > 0), F.regexp_replace(s, "/[^/]*$", "")).otherwise(s)
    for old, new in (rename or {}).items():
        s = F.when(s == old, new).otherwise(s)
    return s


def assign_species(dataset_species: Column | str, stratum_species: Column | str, stratum: Column | str, label: Column | str) -> Column:
    """Dataset species, else stratum species, else a prefix with the row's label."""
    d, e, s, lab = _col(dataset_species), _col(stratum_species), _col(stratum), _col(label)
    prefix = F.concat(s, F.lit("_label_"))
    for name, start in vocab.SPECIES_PREFIXES:
        prefix = F.when(s == name, F.lit(start)).otherwise(prefix)
    use_d = d.isNotNull() & (d != "") & (d != "per_row")
    use_e = e.isNotNull() & (e != "") & ~e.isin("per_row", "per_dataset")
    return F.when(use_d, d).when(use_e, e).otherwise(F.concat(prefix, lab))


def header_label(c: Column | str) -> Column:
    """Last '|' part of a header when it has 1-4 characters."""
    s = _col(c)
    tail = F.trim(F.element_at(F.split(s, r"\|"), -1))
    return F.when((F.instr(s, "|") > 0) & F.length(tail).between(1, 4), tail)


def filename_label(files: DataFrame) -> DataFrame:
    """Stem as class label for files without labels that sit next to sibling classes.

    ``files``: path, n_records, n_labels.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    words = list(vocab.SPLIT_WORDS)
    marked = files.withColumn("_dir", folder).withColumn("_stem", file_stem("path"))
    plain = ~F.lower("_stem").isin(words)
    siblings = marked.groupBy("_dir").agg(F.count_if(plain).alias("_n"))
    split_name = F.lower("_stem").isin(words) | F.col("_stem").rlike(r"(?i)^.*_(" + "|".join(words) + r")$")
    fits = (F.col("n_records") > 0) & (F.col("n_labels") == 0) & ~split_name & (F.col("_n") - plain.cast("int") > 0)
    return marked.join(siblings, "_dir").withColumn("label", F.when(fits, F.col("_stem"))).drop("_dir", "_stem", "_n")


def format_range(lo: Column, hi: Column) -> Column:
    text = F.when(lo == hi, F.format_string("%d", lo)).otherwise(F.format_string("%d–%d", lo, hi))
    return F.when(lo.isNotNull() & hi.isNotNull(), text)


def format_median_iqr(median: Column, q25: Column, q75: Column, digits: int = 2) -> Column:
    return F.when(median.isNotNull(), F.format_string(f"%.{digits}f (%.{digits}f–%.{digits}f)", median, q25, q75))
