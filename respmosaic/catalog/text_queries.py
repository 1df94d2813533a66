"""Scalar functions over texts, names, paths and JSON; row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from respmosaic.catalog.base import ITEMS, LAB, SEQ, V, VN, fx_items, fx_lab, fx_seq, fx_v, fx_vn, query, r, rounded, table
from respmosaic.functions import names, text, vocab
from respmosaic.operators import filters, integrity

KMERS2 = text.kmer_names(2)
KMERS3 = text.kmer_names(3)


@query("c1_gc_fraction", f"WITH {ITEMS} SELECT item, round(gc,6)+0.0 AS gc FROM i")
def c1(spark, sf):
    return fx_items(spark, sf).select("item", r("gc").alias("gc"))


def kmer_sql(k: int) -> str:
    return f"km AS (SELECT item, substr(seq, p, {k}) AS kmer FROM (SELECT item, seq, unnest(range(1, greatest(length(seq)-{k - 1}, 0)+1)) AS p FROM s))"


@query("c2_kmer_table", f"WITH {SEQ}, {kmer_sql(4)} SELECT item, kmer, count(*) AS n FROM km GROUP BY 1,2")
def c2(spark, sf):
    return text.kmer_table(fx_seq(spark, sf), ["item"], "seq", 4)


@query(
    "c2_kmer_count_array",
    f"WITH {SEQ}, {kmer_sql(2)}, c AS (SELECT item, kmer, count(*) AS n FROM km GROUP BY 1,2), w AS (SELECT unnest({KMERS2}) AS kmer) SELECT s.item, string_agg(coalesce(c.n,0)::VARCHAR, ',' ORDER BY w.kmer) AS counts FROM s CROSS JOIN w LEFT JOIN c ON c.item = s.item AND c.kmer = w.kmer GROUP BY 1",
)
def c2_array(spark, sf):
    counts = text.kmer_count_array("seq", 2)
    return fx_seq(spark, sf).select("item", F.array_join(F.transform(counts, lambda x: x.cast("string")), ",").alias("counts"))


def vec_sql(k: int, words: list[str]) -> str:
    return f"""{kmer_sql(k)}, c AS (SELECT item, kmer, count(*) AS n FROM km GROUP BY 1,2), t AS (SELECT item, sum(n) AS t FROM c GROUP BY 1), w AS (SELECT unnest({words}) AS kmer),
 vec AS (SELECT s.item, w.kmer AS feature, coalesce(c.n::DOUBLE / t.t, 0.0) AS x FROM s CROSS JOIN w LEFT JOIN c ON c.item = s.item AND c.kmer = w.kmer LEFT JOIN t ON t.item = s.item)"""


def _vector_rows(df, column, words):
    rows = df.select("item", F.posexplode_outer(column).alias("_i", "x"))
    return rows.select("item", F.element_at(F.array(*[F.lit(w) for w in words]), F.col("_i") + 1).alias("feature"), r("x").alias("x"))


@query("c3_dinuc_vec", f"WITH {SEQ}, {vec_sql(2, KMERS2)} SELECT item, feature, round(x,6)+0.0 AS x FROM vec")
def c3_di(spark, sf):
    return _vector_rows(fx_seq(spark, sf), text.dinuc_vec("seq"), KMERS2)


@query("c3_trinuc_vec", f"WITH {SEQ}, {vec_sql(3, KMERS3)} SELECT item, feature, round(x,6)+0.0 AS x FROM vec")
def c3_tri(spark, sf):
    return _vector_rows(fx_seq(spark, sf), text.trinuc_vec("seq"), KMERS3)


@query(
    "c4_gc_bin",
    f"WITH {ITEMS} SELECT item, CASE WHEN gc < 0.2 THEN 'very_low' WHEN gc < 0.4 THEN 'low' WHEN gc < 0.5 THEN 'mid_low' WHEN gc < 0.6 THEN 'mid_high' WHEN gc < 0.8 THEN 'high' ELSE 'very_high' END AS bin FROM i",
)
def c4(spark, sf):
    return fx_items(spark, sf).select("item", text.gc_bin("gc").alias("bin"))


@query(
    "c5_kmer_features_zscore",
    f"""WITH {SEQ}, {vec_sql(2, KMERS2)}, m AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS sd FROM vec GROUP BY 1)
 SELECT item, feature, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END,6)+0.0 AS x FROM vec JOIN m USING (feature)""",
)
def c5(spark, sf):
    return rounded(text.kmer_features(fx_seq(spark, sf), "item", "seq", 2, 2), "x")


@query("c5_kmer_features_hellinger", f"WITH {SEQ}, {vec_sql(3, KMERS3)} SELECT item, feature, round(sqrt(greatest(x,0)),6)+0.0 AS x FROM vec")
def c5_hellinger(spark, sf):
    return rounded(text.kmer_features(fx_seq(spark, sf), "item", "seq", 3, 3, "hellinger"), "x")


@query("c6_crop_center", f"WITH {SEQ} SELECT item, CASE WHEN length(seq) <= 128 THEN seq ELSE substr(seq, (length(seq)-128)//2 + 1, 128) END AS seq FROM s")
def c6(spark, sf):
    return fx_seq(spark, sf).select("item", text.crop_center("seq", 128).alias("seq"))


@query(
    "c7_overlapping_kmers",
    f"WITH {SEQ} SELECT item, array_to_string(list_transform(range(1, length(seq)-4), lambda p: substr(seq, p, 6)), ' ') AS words FROM s WHERE length(seq) >= 6",
)
def c7(spark, sf):
    return fx_seq(spark, sf).filter(F.length("seq") >= 6).select("item", text.overlapping_kmers("seq", 6).alias("words"))


@query(
    "c8_codons",
    f"WITH {SEQ} SELECT item, (length(seq)//3)::INT AS n, rtrim(regexp_replace(substr(seq, 1, length(seq)//3*3), '(.{{3}})', '\\1 ', 'g')) AS words FROM s",
)
def c8(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), text.codons("text").alias("c"))
    return d.select("item", F.col("c.n").alias("n"), F.col("c.text").alias("words"))


@query("c9_pad_to_multiple", f"WITH {SEQ} SELECT item, seq || repeat('A', ((6 - length(seq) % 6) % 6)::INT) AS seq FROM s")
def c9(spark, sf):
    return fx_seq(spark, sf).select("item", text.pad_to_multiple("seq").alias("seq"))


# ------------------------------------------------------------------ names

NEEDLES = [n for n, _ in vocab.FAMILY_RULES] + ["annotator", "hyenadna", "megadna", "generator", "unlisted"]
NAMES = f"""nm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'org' || (p_partkey % 5) || '/' END || {NEEDLES}[(p_partkey % {len(NEEDLES)})::INT + 1]
 || '-v' || (p_partkey % 3) || '-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'm' ELSE 'b' END || CASE WHEN p_partkey % 3 = 0 THEN '-seqlen-' || p_size || 'k' WHEN p_partkey % 3 = 1 THEN '_8kb' ELSE '' END AS name, p_size, p_name, p_brand FROM part)"""


def fx_names(spark, sf):
    """Model-like names built from the part table, one per row."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    owner = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("org"), (k % 5).cast("string"), F.lit("/")))
    needle = F.element_at(F.array(*[F.lit(n) for n in NEEDLES]), (k % len(NEEDLES)).cast("int") + 1)
    size = F.concat(F.lit("-v"), (k % 3).cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.when(k % 2 == 0, "m").otherwise("b"))
    tail = F.when(k % 3 == 0, F.concat(F.lit("-seqlen-"), F.col("p_size").cast("string"), F.lit("k"))).when(k % 3 == 1, "_8kb").otherwise("")
    return p.select(k.alias("id"), F.concat(owner, needle, size, tail).alias("name"), "p_size", "p_name", "p_brand")


def rules_sql(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{n}') THEN '{lab}'" for n, lab in rules) + f" ELSE {default} END"


PART_RULES = (("red", "warm"), ("blue", "cold"), ("hot", "warm"), ("small", "tiny"))


@query("c10_first_match_rules", f"SELECT p_partkey AS id, {rules_sql('p_name', PART_RULES, chr(39) + 'other' + chr(39))} AS label FROM part")
def c10(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.first_match_rules("p_name", PART_RULES, "other").alias("label"))


BASE_SQL = "regexp_replace(name, '^[^/]*/', '')"


@query(
    "c10_name_labels",
    f"""WITH {NAMES} SELECT id, {rules_sql('name', vocab.FAMILY_RULES, f"split_part({BASE_SQL}, '-', 1)")} AS family, {rules_sql('name', vocab.BRANCH_RULES, "'manual_unknown'")} AS branch,
 {rules_sql('name', vocab.ARCHITECTURE_RULES, "'unknown'")} AS architecture,
 CASE WHEN regexp_extract(lower(name), 'dna_bert_(\\d+)', 1) <> '' THEN 'overlapping_' || regexp_extract(lower(name), 'dna_bert_(\\d+)', 1) || 'mer' ELSE {rules_sql('name', vocab.TOKENIZER_RULES, "'manual_unknown'")} END AS tokenizer FROM nm""",
)
def c10_names(spark, sf):
    return fx_names(spark, sf).select(
        "id",
        names.family("name").alias("family"),
        names.branch("name").alias("branch"),
        names.architecture("name")["value"].alias("architecture"),
        names.tokenizer_type("name").alias("tokenizer"),
    )


def map_sql(column: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


@query(
    "c10_paradigm_and_protocol",
    f"""WITH {NAMES}, b AS (SELECT *, {rules_sql('name', vocab.BRANCH_RULES, "'manual_unknown'")} AS branch FROM nm)
 SELECT id, {map_sql('branch', vocab.PARADIGM_BY_BRANCH, 'unknown')} AS paradigm, CASE WHEN contains(lower(name), 'dnabert-s') THEN 'embedding_or_mlm_manual' ELSE {map_sql('branch', vocab.PROTOCOL_BY_BRANCH, 'manual_unknown')} END AS protocol FROM b""",
)
def c10_protocol(spark, sf):
    n = fx_names(spark, sf).withColumn("branch", names.branch("name"))
    return n.select("id", names.training_paradigm("branch").alias("paradigm"), names.score_protocol("name", "branch").alias("protocol"))


@query(
    "c11_extract_size",
    f"""WITH {NAMES}, x AS (SELECT id, (' ' || lower(name) || ' ') AS t FROM nm), f AS (SELECT id, unnest(regexp_extract_all(t, '[^a-z0-9](\\d+(?:\\.\\d+)?)\\s*[mb][^a-z]', 1)) AS num, unnest(regexp_extract_all(t, '[^a-z0-9]\\d+(?:\\.\\d+)?\\s*([mb])[^a-z]', 1)) AS unit FROM x)
 SELECT x.id, max((num::DOUBLE * CASE unit WHEN 'b' THEN 1e9 ELSE 1e6 END)::BIGINT) AS size FROM x LEFT JOIN f USING (id) GROUP BY 1""",
)
def c11(spark, sf):
    return fx_names(spark, sf).select("id", names.extract_size("name").alias("size"))


TOKENS_SQL = " ".join(f"WHEN marked AND contains(t, '{tok}') THEN {val}" for tok, val in vocab.CONTEXT_TOKENS)
PATTERNS_SQL = " ".join(f"WHEN regexp_extract(t, '{pat}', 1) <> '' THEN regexp_extract(t, '{pat}', 1)::BIGINT * {unit}" for pat, unit in vocab.CONTEXT_PATTERNS)
MARKED_SQL = " OR ".join(f"contains(lower(name), '{m}')" for m in vocab.CONTEXT_MARKERS)


@query("c12_infer_context", f"WITH {NAMES}, x AS (SELECT id, lower(name) AS t, {MARKED_SQL} AS marked FROM nm) SELECT id, (CASE {TOKENS_SQL} {PATTERNS_SQL} END)::BIGINT AS context FROM x")
def c12(spark, sf):
    return fx_names(spark, sf).select("id", names.infer_context("name").alias("context"))


@query(
    "c13_priority_coalesce",
    """SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 40 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2 END, CASE WHEN p_partkey % 2 = 0 THEN 7 END)::INT AS value,
 CASE WHEN p_size > 40 THEN 'override' WHEN p_partkey % 3 = 0 THEN 'config' WHEN p_partkey % 2 = 0 THEN 'name' ELSE '' END AS source FROM part""",
)
def c13(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    picked = names.priority_coalesce(
        [(F.when(F.col("p_size") > 40, F.col("p_size")), "override"), (F.when(k % 3 == 0, F.col("p_size") * 2), "config"), (F.when(k % 2 == 0, F.lit(7)), "name")]
    )
    return p.select(k.alias("id"), picked["value"].alias("value"), picked["source"].alias("source"))


@query(
    "c13_choose_size",
    """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN p_size + 100 WHEN 2 THEN p_size + 200 WHEN 3 THEN p_size + 300 WHEN 4 THEN 117000000 WHEN 5 THEN 6600000 WHEN 6 THEN 12 * p_size * 64 * 64 END::BIGINT AS value,
 CASE p_partkey % 8 WHEN 0 THEN 'override' WHEN 1 THEN 'weights_loaded' WHEN 2 THEN 'hf_safetensors_metadata' WHEN 3 THEN 'hf_weight_file_loaded' WHEN 4 THEN 'hf_id_name' WHEN 5 THEN 'hyenadna_preset' WHEN 6 THEN 'hf_config_estimate' ELSE 'unknown' END AS source FROM part""",
)
def c13_size(spark, sf):
    """Each level wins where the ones before it are absent; later levels are present too."""
    p, case, size = table(spark, sf, "part"), F.col("p_partkey") % 8, F.col("p_size")
    name = F.when(case <= 4, "x/model-117m").when(case == 5, "x/hyenadna-small-32k").otherwise("x/plain")
    config = F.when(case <= 6, F.format_string('{"num_hidden_layers": %d, "hidden_size": 64}', size))
    given = [F.when(case == 0, size), F.when(case <= 1, size + 100), F.when(case <= 2, size + 200), F.when(case <= 3, size + 300)]
    rows = p.select(F.col("p_partkey").alias("id"), name.alias("name"), config.alias("config"), *[g.alias(f"g{i}") for i, g in enumerate(given)])
    picked = names.choose_size("name", "config", *[F.col(f"g{i}") for i in range(4)])
    return rows.select("id", picked["value"].alias("value"), picked["source"].alias("source"))


@query(
    "c13_choose_context",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_size WHEN p_partkey % 7 = 1 THEN p_size + 100 WHEN p_partkey % 7 = 2 THEN p_size + 200
 WHEN p_partkey % 7 = 3 THEN p_size + 300 WHEN p_partkey % 7 = 4 THEN 8192 WHEN p_partkey % 7 = 5 THEN 450000 END::BIGINT AS value,
 CASE p_partkey % 7 WHEN 0 THEN 'override:card' WHEN 1 THEN 'config:text.n_positions' WHEN 2 THEN 'config:inner[0].model_max_length' WHEN 3 THEN 'tokenizer_config:model_max_length'
 WHEN 4 THEN 'model_name_power_of_two' WHEN 5 THEN 'model_name' ELSE '' END AS source FROM part""",
)
def c13_choose(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    case = F.col("p_partkey") % 7
    config = (
        F.when(case == 1, F.format_string('{"seq_length": 5, "model_max_length": 9, "text": {"n_positions": %d}}', size + 100))
        .when(case == 2, F.format_string('{"inner": [{"model_max_length": %d}], "max_seq_len": true}', size + 200))
        .when(case == 3, "{broken")
    )
    tokenizer = F.when(case.isin(1, 2, 3), F.format_string('{"model_max_length": %d}', size + 300))
    name = F.when(case == 4, "x/evo-8k").when(case == 5, "x/evo-450k").when(case == 6, "x/plain").otherwise("x/evo-8k")
    hits = p.select("p_partkey", "p_size", case.alias("k"), names.context_hits(config).alias("config"), names.context_hits(tokenizer).alias("tokenizer"), name.alias("name"))
    picked = names.choose_context(F.when(F.col("k") == 0, F.col("p_size")), F.lit("card"), F.col("config"), F.col("tokenizer"), "name")
    chosen = hits.select(F.col("p_partkey").alias("id"), picked.alias("c"))
    return chosen.select("id", "c.value", "c.source")


@query(
    "c10_tokenizer_by_config",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'wordpiece_or_bpe' WHEN 1 THEN 'bpe_or_byte' WHEN 2 THEN 'bpe_or_byte' WHEN 3 THEN 'manual_unknown'
 ELSE 'single_nucleotide_or_byte' END AS tokenizer FROM part""",
)
def c10_tokenizer(spark, sf):
    case = F.col("p_partkey") % 5
    kind = F.when(case == 0, "RoBERTa").when(case == 1, "gpt_neox").when(case == 2, "mixtral").when(case == 4, "bert")
    name = F.when(case == 4, F.concat(F.lit("x/hyenadna-"), "p_name")).otherwise("x/unlisted")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.tokenizer_type(name, kind).alias("tokenizer"))


KINDS = ["overlapping_6mer", "non_overlapping_6mer", "non_overlapping_3mer_or_codon", "single_nucleotide_or_byte", "bpe_or_wordpiece", "manual_unknown"]
FAMILIES = ["GENA-LM", "GROVER", "GenomeOcean", "Other"]


@query(
    "c14_context_bp",
    f"""WITH k AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 100 END::BIGINT AS tokens, {KINDS}[(p_partkey % 6)::INT + 1] AS kind, {FAMILIES}[((p_partkey // 6) % 4)::INT + 1] AS fam FROM part)
 SELECT id, (CASE WHEN tokens IS NULL THEN NULL WHEN kind = 'overlapping_6mer' THEN tokens + 5 WHEN kind = 'non_overlapping_6mer' THEN tokens * 6 WHEN kind = 'non_overlapping_3mer_or_codon' THEN tokens * 3
 WHEN kind = 'single_nucleotide_or_byte' THEN tokens WHEN kind = 'bpe_or_wordpiece' THEN floor(tokens * CASE fam WHEN 'GENA-LM' THEN 8.7890625::DOUBLE WHEN 'GROVER' THEN 4.0::DOUBLE WHEN 'GenomeOcean' THEN 5.0::DOUBLE END) END)::BIGINT AS bp FROM k""",
)
def c14(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        k.alias("id"),
        F.when(F.col("p_size") % 10 != 0, (F.col("p_size") * 100).cast("long")).alias("tokens"),
        F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 6).cast("int") + 1).alias("kind"),
        F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), (F.floor(k / 6) % 4).cast("int") + 1).alias("fam"),
    )
    return p.select("id", names.context_bp("tokens", "kind", "fam").alias("bp"))


@query("c15_json_find_keys", "SELECT event_id, 'k' AS path, (props->>'$.k')::BIGINT AS found FROM events WHERE (props->>'$.k')::BIGINT > 0")
def c15(spark, sf):
    return names.json_find_keys(table(spark, sf, "events").select("event_id", "props"), "props", ["k"]).select("event_id", "path", "found")


@query(
    "c15_json_find_keys_nested",
    """SELECT event_id, 'model.text[0].max_seq_len' AS path, user_id AS found FROM events WHERE user_id > 0
 UNION ALL SELECT event_id, 'n_positions', event_id FROM events WHERE event_id > 0 AND event_id < 10000000
 UNION ALL SELECT event_id, 'a.b.c.d.e.f.g.seq_length', event_id + 1 FROM events WHERE event_id + 1 < 10000000""",
)
def c15_nested(spark, sf):
    e = table(spark, sf, "events")
    doc = F.format_string('{"n_positions": %d, "model": {"text": [{"max_seq_len": %d, "n_positions": true}], "max_seq_len": "x"}, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"seq_length": %d}}}}}}}}', "event_id", "user_id", F.col("event_id") + 1)
    return names.json_find_keys(e.select("event_id", doc.alias("doc")), "doc").select("event_id", "path", "found")


LAYOUTS = ["{g}/{n}/train/pos.csv", "{g}/{n}/test.csv.gz", "{g}/{n}_dev.fa", "{g}/{n}.csv", "{n}.tsv"]
PATHS = """ph AS (SELECT p_partkey AS id, (p_partkey % 5)::INT AS lay, replace(p_brand, '#', '') AS g, replace(p_name, ' ', '-') AS n FROM part)"""


def fx_paths(spark, sf):
    k = F.col("p_partkey")
    g, n = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    path = None
    for j, layout in enumerate(LAYOUTS):
        text_ = F.replace(F.replace(F.lit(layout), F.lit("{g}"), g), F.lit("{n}"), n)
        path = F.when(k % 5 == j, text_) if path is None else path.when(k % 5 == j, text_)
    return table(spark, sf, "part").select(k.alias("id"), path.alias("path"))


@query(
    "c16_derive_dataset_split",
    f"WITH {PATHS} SELECT id, CASE lay WHEN 4 THEN n ELSE g || '/' || n END AS dataset, CASE lay WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'dev' ELSE '' END AS split FROM ph",
)
def c16(spark, sf):
    d = fx_paths(spark, sf).select("id", names.derive_dataset_split("path").alias("d"))
    return d.select("id", "d.dataset", "d.split")


@query(
    "c17_task_group_and_type",
    """WITH c AS (SELECT source AS dataset, count(DISTINCT lang) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'expression/' || source, count(DISTINCT lang) FROM documents GROUP BY 1 UNION ALL SELECT lang || '/' || source, 1 FROM documents GROUP BY 1)
 SELECT dataset, split_part(dataset, '/', 1) AS task_group, CASE WHEN contains(dataset, 'expression') THEN 'regression' WHEN n = 0 THEN 'unlabeled' WHEN n = 1 THEN 'single_label' WHEN n = 2 THEN 'binary' ELSE 'multiclass' END AS task_type FROM c""",
)
def c17(spark, sf):
    d = table(spark, sf, "documents")
    per = d.groupBy(F.col("source").alias("dataset")).agg(F.count_distinct("lang").alias("n"))
    tasks = per.unionByName(per.withColumn("dataset", F.concat(F.lit("expression/"), "dataset")))
    tasks = tasks.unionByName(d.select(F.concat_ws("/", "lang", "source").alias("dataset")).distinct().withColumn("n", F.lit(1).cast("long")))
    return tasks.select("dataset", names.derive_task_group("dataset").alias("task_group"), names.derive_task_type("dataset", "n").alias("task_type"))


SOURCES = """so AS (SELECT doc_id AS item, CASE WHEN doc_id % 4 = 3 THEN 'x/' || source ELSE 'data/' || source || '/' || lang || '/train.csv#row_' || doc_id END AS src, source, lang FROM documents)"""


def fx_sources(spark, sf):
    d = table(spark, sf, "documents")
    full = F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("/train.csv#row_"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("x/"), "source")).otherwise(full).alias("src"))


@query(
    "c18_parse_source",
    f"""WITH {SOURCES} SELECT item, CASE WHEN item % 4 = 3 THEN 'other' ELSE source END AS benchmark, CASE WHEN item % 4 = 3 THEN src ELSE lang || '/train.csv' END AS task_path,
 CASE WHEN item % 4 = 3 THEN 'x/' || source WHEN source = 'src1' AND lang = 'en' THEN 'First/en' ELSE source || '/' || lang END AS dataset FROM so""",
)
def c18(spark, sf):
    s = fx_sources(spark, sf).withColumn("p", names.parse_source("src"))
    return s.select("item", "p.benchmark", "p.task_path", names.source_dataset("src", {"src1/en": "First/en"}).alias("dataset"))


@query(
    "c19_assign_species",
    """WITH d AS (SELECT doc_id AS item, CASE doc_id % 3 WHEN 0 THEN 'sp' || lang WHEN 1 THEN 'per_row' END AS ds, CASE WHEN doc_id % 2 = 0 THEN 'es' || source ELSE 'per_dataset' END AS es, CASE WHEN doc_id % 5 = 0 THEN 'fungi_genome' ELSE source END AS stratum, lang AS label FROM documents)
 SELECT item, CASE WHEN ds IS NOT NULL AND ds <> 'per_row' THEN ds WHEN es <> 'per_dataset' THEN es WHEN stratum = 'fungi_genome' THEN 'fungi_sp_' || label ELSE stratum || '_label_' || label END AS species FROM d""",
)
def c19(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        k.alias("item"),
        F.when(k % 3 == 0, F.concat(F.lit("sp"), "lang")).when(k % 3 == 1, "per_row").alias("ds"),
        F.when(k % 2 == 0, F.concat(F.lit("es"), "source")).otherwise("per_dataset").alias("es"),
        F.when(k % 5 == 0, "fungi_genome").otherwise(F.col("source")).alias("stratum"),
        "lang",
    )
    return d.select("item", names.assign_species("ds", "es", "stratum", "lang").alias("species"))


@query(
    "c20_slug_basename_organization",
    f"""WITH {NAMES} SELECT id, replace(name, '/', '__') AS slug, {BASE_SQL} AS basename, CASE WHEN contains(lower(name),'evo2_') OR contains(lower(name),'evo-2') OR contains(lower(name),'evo-1') THEN 'arcinstitute' WHEN contains(name,'/') THEN split_part(name,'/',1) ELSE '' END AS organization FROM nm""",
)
def c20(spark, sf):
    return fx_names(spark, sf).select("id", names.slug("name").alias("slug"), names.basename("name").alias("basename"), names.organization("name").alias("organization"))


@query(
    "c21_filename_label",
    f"""WITH {PATHS}, f AS (SELECT DISTINCT g || '/' || CASE WHEN lay < 2 THEN 'train' ELSE n END AS stem_path, g, CASE WHEN lay < 2 THEN 'train' ELSE n END AS stem FROM ph),
 c AS (SELECT *, count(*) FILTER (stem <> 'train') OVER (PARTITION BY g) AS k FROM f) SELECT stem_path || '.csv' AS path, CASE WHEN stem <> 'train' AND k > 1 THEN stem END AS label FROM c""",
)
def c21(spark, sf):
    k = F.col("p_partkey")
    g, n = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    files = table(spark, sf, "part").select(F.concat(g, F.lit("/"), F.when(k % 5 < 2, "train").otherwise(n), F.lit(".csv")).alias("path")).distinct()
    return names.filename_label(files.withColumn("n_records", F.lit(1)).withColumn("n_labels", F.lit(0))).select("path", "label")


@query(
    "c22_modality_flags",
    f"""WITH {NAMES}, x AS (SELECT *, {rules_sql('name', vocab.TOKENIZER_RULES, "'manual_unknown'")} AS kind FROM nm)
 SELECT id, contains(kind,'codon') OR contains(lower(name),'genslm') AS is_codon, contains(lower(name),'glm2') OR contains(lower(name),'lucaone') AS mixed,
 CASE WHEN contains(lower(name),'glm2') OR contains(lower(name),'lucaone') THEN 'coding_only_pending_manual' WHEN contains(kind,'codon') OR contains(lower(name),'genslm') THEN 'coding_only' ELSE 'coding_and_noncoding' END AS valid_classes,
 {rules_sql('name', vocab.PARAM_SCALE_RULES, "'unknown'")} AS scale, {rules_sql('name', vocab.FAMILY_SHORT_RULES, "'other'")} AS family_short FROM x""",
)
def c22(spark, sf):
    n = fx_names(spark, sf)
    flags = n.withColumn("m", names.modality_flags("name", names.tokenizer_type("name")))
    return flags.select("id", "m.is_codon", "m.mixed", "m.valid_classes", names.param_scale("name").alias("scale"), names.family_short("name").alias("family_short"))


@query(
    "c23_estimate_params",
    "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 3 THEN NULL ELSE 12 * (p_size % 7 + 1)::BIGINT * (p_size * 8)::BIGINT * (p_size * 8)::BIGINT END AS params FROM part",
)
def c23(spark, sf):
    size = F.col("p_size")
    layers = F.when(size % 2 == 0, "num_hidden_layers").otherwise("n_layer")
    hidden = F.when(size % 4 == 3, "unknown").when(size % 3 == 0, "d_model").otherwise("hidden_size")
    config = F.format_string('{"%s": %d, "%s": %d}', layers, size % 7 + 1, hidden, size * 8)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.estimate_params(config).alias("params"))


HEADERS = """hd AS (SELECT item, CASE WHEN item % 6 = 0 THEN 'id' || item ELSE 'id' || item || CASE WHEN quality = 0 THEN '_negative' ELSE '' END || '|' || toxic || '|' || quality || '|' || (item % 2) || CASE WHEN item % 7 = 0 THEN '|longlabel' ELSE '' END END AS header, quality, toxic, seq FROM lab)"""


def fx_headers(spark, sf):
    k = F.col("item")
    cast = lambda c: c.cast("string")
    parts = F.concat_ws("|", F.concat(F.lit("id"), cast(k), F.when(F.col("quality") == 0, "_negative").otherwise("")), cast(F.col("toxic")), cast(F.col("quality")), cast(k % 2))
    header = F.when(k % 6 == 0, F.concat(F.lit("id"), cast(k))).otherwise(F.concat(parts, F.when(k % 7 == 0, "|longlabel").otherwise("")))
    return fx_lab(spark, sf).select("item", header.alias("header"), "quality", "toxic", "seq")


@query("c24_header_label", f"WITH {LAB}, {HEADERS} SELECT item, CASE WHEN contains(header,'|') AND item % 7 <> 0 THEN (item % 2)::VARCHAR END AS label FROM hd")
def c24(spark, sf):
    return fx_headers(spark, sf).select("item", names.header_label("header").alias("label"))


@query(
    "c25_formats",
    f"""WITH {ITEMS}, q AS (SELECT dataset, min(length) AS lo, max(length) AS hi, avg(gc) AS m, stddev_samp(gc) AS sd, median(gc) AS q50, quantile_cont(gc,0.25) AS q25, quantile_cont(gc,0.75) AS q75 FROM i GROUP BY 1)
 SELECT dataset, printf('%.3f ± %.3f', m, sd) AS mean_std, CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '–' || hi END AS "range", printf('%.2f (%.2f–%.2f)', q50, q25, q75) AS iqr FROM q""",
)
def c25(spark, sf):
    from respmosaic.operators.statistics import format_mean_std
    from respmosaic.plans.quantiles import quantile_columns
    from respmosaic.plans.stable import materialise

    i = materialise(fx_items(spark, sf).select("dataset", "length", "gc"))
    base = i.groupBy("dataset").agg(F.min("length").alias("lo"), F.max("length").alias("hi"), F.avg("gc").alias("m"), F.stddev_samp("gc").alias("sd"))
    q = quantile_columns(i, "gc", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["dataset"])
    return base.join(q, "dataset").select(
        "dataset",
        format_mean_std(F.col("m"), F.col("sd")).alias("mean_std"),
        names.format_range(F.col("lo"), F.col("hi")).alias("range"),
        names.format_median_iqr(F.col("q50"), F.col("q25"), F.col("q75")).alias("iqr"),
    )


# ---------------------------------------------------------------- filters


@query(
    "f1_filter_label_policy",
    f"WITH {LAB} SELECT 'positive_only' AS policy, item FROM lab WHERE quality = 1 UNION ALL SELECT 'keep_label', item FROM lab WHERE stratum IN ('fr','de') UNION ALL SELECT 'keep_all', item FROM lab",
)
def f1(spark, sf):
    lab = fx_lab(spark, sf).withColumn("label", F.col("quality").cast("string"))
    part = lambda df, name: df.select(F.lit(name).alias("policy"), "item")
    out = part(filters.filter_label_policy(lab, "positive_only"), "positive_only")
    out = out.unionByName(part(filters.filter_label_policy(lab, "keep_label", ["fr", "de"], "stratum"), "keep_label"))
    return out.unionByName(part(filters.filter_label_policy(lab, "keep_all"), "keep_all"))


@query("f1_header_policy", f"WITH {LAB}, {HEADERS} SELECT item FROM hd WHERE contains(header,'|') AND item % 7 <> 0 AND item % 2 = 1")
def f1_header(spark, sf):
    h = fx_headers(spark, sf).withColumn("label", filters.last_header_field("header"))
    return filters.filter_label_policy(h, "positive_only").select("item")


@query(
    "f2_filter_multilabel_any",
    f"""WITH {LAB}, {HEADERS} SELECT item, array_to_string(list_filter([CASE WHEN toxic=1 THEN '0' END, CASE WHEN quality=1 THEN '1' END, CASE WHEN item%2=1 THEN '2' END], lambda x: x IS NOT NULL), ',') AS label
 FROM hd WHERE item % 6 <> 0 AND quality <> 0""",
)
def f2(spark, sf):
    return filters.filter_multilabel_any(fx_headers(spark, sf)).select("item", "label")


@query("f3_valid_sequence", f"WITH {SEQ} SELECT item, regexp_full_match(seq, '[ACGT]+') AS valid FROM s")
def f3(spark, sf):
    return fx_seq(spark, sf).select("item", text.valid_sequence("seq").alias("valid"))


@query("f4_filter_length", f"WITH {SEQ} SELECT item, length(seq)::INT AS length FROM s WHERE length(seq) BETWEEN 128 AND 1024")
def f4(spark, sf):
    return fx_seq(spark, sf).filter(text.in_length_range("seq")).select("item", F.length("seq").alias("length"))


@query(
    "f5_make_item_rows",
    f"""WITH {SEQ}, c AS (SELECT item, stratum, dataset, CASE WHEN item % 2 = 0 AND length(seq) > 300 THEN substr(seq, (length(seq)-300)//2+1, 300) ELSE seq END AS seq FROM s)
 SELECT stratum || '_' || item AS probe_id, seq AS sequence, length(seq)::INT AS length_bp, stratum AS functional_element, 'g' AS species_group, dataset AS species,
 round(length(regexp_replace(seq,'[^GC]','','g'))::DOUBLE/length(seq),6)+0.0 AS gc, dataset || '#row_' || item AS source, 'keep_all' AS label_source FROM c WHERE length(seq) BETWEEN 128 AND 1024""",
)
def f5(spark, sf):
    s = fx_seq(spark, sf)
    rows = s.select(
        F.concat_ws("_", "stratum", F.col("item").cast("string")).alias("probe_id"),
        "seq",
        "stratum",
        F.lit("g").alias("species_group"),
        F.col("dataset").alias("species"),
        F.concat(F.col("dataset"), F.lit("#row_"), F.col("item").cast("string")).alias("source"),
        F.lit("keep_all").alias("label_source"),
        F.when(F.col("item") % 2 == 0, F.lit(300)).alias("crop_to"),
    )
    made = filters.make_item_rows(rows)
    return made.withColumn("gc", r("GC_content")).drop("GC_content", "dinuc_vec", "trinuc_vec")


@query(
    "f6_looks_like_dna",
    f"""WITH {SEQ}, x AS (SELECT item, seq, upper(text) AS t FROM s JOIN documents ON doc_id = item)
 SELECT item, length(seq) >= 20 AS seq_is, length(t) >= 20 AND length(regexp_replace(substr(t,1,200),'[^ACGTN]','','g'))::DOUBLE / greatest(length(substr(t,1,200)),1) >= 0.8 AS text_is FROM x""",
)
def f6(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), "text")
    return fx_seq(spark, sf).join(d, "item").select("item", text.looks_like_dna("seq").alias("seq_is"), text.looks_like_dna("text").alias("text_is"))


@query("f7_filter_entities_contains", "SELECT s_suppkey, s_name FROM supplier WHERE contains(s_name, '07') OR contains(s_name, '3')")
def f7(spark, sf):
    return filters.filter_entities(table(spark, sf, "supplier"), contains=["07", "3"], entity="s_name").select("s_suppkey", "s_name")


@query("f7_filter_entities_ids", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (1, 2, 7)")
def f7_ids(spark, sf):
    return filters.filter_entities(table(spark, sf, "orders"), ids=[1, 2, 7], entity="o_custkey", strict=False).select("o_orderkey", "o_orderpriority")


def _features(spark, sf):
    """Row form with nulls, features in item order."""
    v = fx_vn(spark, sf)
    rows = v.groupBy("entity").agg(F.first("grp").alias("label"), F.sort_array(F.collect_list(F.struct("item", "value"))).alias("c"))
    return rows.select("entity", "label", F.col("c.value").alias("features"))


@query("f8_finite_rows", f"WITH {VN} SELECT entity FROM vn GROUP BY 1 HAVING count(value) = count(*)")
def f8(spark, sf):
    return integrity.finite_rows(_features(spark, sf)).select("entity")


@query(
    "f8_finite_report",
    f"""WITH {VN}, e AS (SELECT entity, any_value(grp) AS label, count(value) = count(*) AS good FROM vn GROUP BY 1)
 SELECT label, count(*) AS n_raw, count(*) FILTER (NOT good) AS n_dropped, count(*) FILTER (NOT good) / count(*)::DOUBLE > 0.05 AS warn FROM e GROUP BY 1""",
)
def f8_report(spark, sf):
    return integrity.finite_report(_features(spark, sf), by=["label"])


HOLES = "ho AS (SELECT entity, item, CASE WHEN entity % 9 <> 0 AND item % 16 <> 5 THEN value END AS value FROM vn)"


def _holes(spark, sf):
    v = fx_vn(spark, sf).select("entity", "item", "value")
    return v.withColumn("value", F.when((F.col("entity") % 9 != 0) & (F.col("item") % 16 != 5), F.col("value")))


@query("f9_drop_empty_axes", f"WITH {VN}, {HOLES} SELECT entity, item, round(value,6)+0.0 AS value FROM ho WHERE entity % 9 <> 0 AND item % 16 <> 5")
def f9(spark, sf):
    return rounded(filters.drop_empty_axes(_holes(spark, sf)), "value")


@query(
    "f9_empty_axes_report",
    f"WITH {VN}, {HOLES} SELECT 'entity' AS axis, entity::VARCHAR AS key FROM ho GROUP BY entity HAVING count(value) = 0 UNION ALL SELECT 'item', item::VARCHAR FROM ho GROUP BY item HAVING count(value) = 0",
)
def f9_report(spark, sf):
    return filters.empty_axes_report(_holes(spark, sf))


@query("f10_restrict_and_exclude", f"WITH {V} SELECT entity, item, round(value,6)+0.0 AS value FROM v WHERE item IN (SELECT doc_id % 40 FROM labels) AND entity NOT IN (SELECT doc_id FROM labels)")
def f10(spark, sf):
    v = fx_v(spark, sf).select("entity", "item", "value")
    labels = table(spark, sf, "labels")
    kept = filters.restrict_items(v, labels.select((F.col("doc_id") % 40).alias("item")))
    return rounded(filters.exclude_entities(kept, labels.select(F.col("doc_id").alias("entity"))), "value")
