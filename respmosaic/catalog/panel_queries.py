"""Panel summaries, ordering, sampling and control tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from respmosaic.catalog.base import ITEMS, LAB, SEQ, fx_items, fx_lab, fx_seq, query, r, rounded, table
from respmosaic.functions import text
from respmosaic.operators import control, panel
from respmosaic.plans.ranking import ordered_rank

ORDER = ["fr", "en", "es"]


def _panel(spark, sf):
    """FX-SEQ in panel shape: grp from the source number, species = dataset."""
    i = fx_items(spark, sf)
    grp = F.concat(F.lit("g"), (F.regexp_extract("dataset", r"(\d+)", 1).cast("int") % 3).cast("string"))
    path = F.concat("stratum", F.lit("/"), "dataset", F.lit("/train.csv"))
    return i.withColumn("grp", grp).withColumn("species", F.col("dataset")).withColumn("task_path", path)


PANEL = ITEMS + """, p AS (SELECT *, 'g' || (regexp_extract(dataset,'(\\d+)',1)::INT % 3) AS grp, dataset AS species, stratum || '/' || dataset || '/train.csv' AS task_path FROM i)"""


@query("g1_stratum_summary", f"WITH {PANEL} SELECT stratum, count(*) AS n, round(avg(gc),6)+0.0 AS gc_mean, round(min(gc),6)+0.0 AS gc_min, round(max(gc),6)+0.0 AS gc_max FROM p GROUP BY 1")
def g1(spark, sf):
    return rounded(panel.stratum_summary(_panel(spark, sf)), "gc_mean", "gc_min", "gc_max")


@query(
    "g1_length_describe",
    f"""WITH {PANEL} SELECT count(length) AS "count", round(avg(length),6)+0.0 AS mean, round(stddev_samp(length),6)+0.0 AS std, min(length) AS min, max(length) AS max,
 round(quantile_cont(length,0.25),6)+0.0 AS q25, round(quantile_cont(length,0.5),6)+0.0 AS q50, round(quantile_cont(length,0.75),6)+0.0 AS q75 FROM p""",
)
def g1_describe(spark, sf):
    return rounded(panel.describe(_panel(spark, sf), "length"), "mean", "std", "q25", "q50", "q75")


@query("g1_stratum_species_counts", f"WITH {PANEL} SELECT stratum, species, count(*) AS n FROM p GROUP BY 1,2")
def g1_counts(spark, sf):
    return panel.stratum_species_counts(_panel(spark, sf))


@query(
    "g2_composition_table",
    f"""WITH {PANEL}, c AS (SELECT grp, stratum, task_path, count(*) AS k FROM p GROUP BY 1,2,3), t AS (SELECT *, row_number() OVER (PARTITION BY grp, stratum ORDER BY k DESC, task_path) AS rk FROM c),
 b AS (SELECT grp, stratum, count(*) AS n, avg(length) AS l, avg(gc) AS g, count(DISTINCT species) AS n_species FROM p GROUP BY 1,2)
 SELECT b.grp, b.stratum, n, round(l,6)+0.0 AS length_mean, round(g,6)+0.0 AS gc_mean, n_species, task_path AS dataset FROM b JOIN t ON t.grp = b.grp AND t.stratum = b.stratum AND rk = 1""",
)
def g2(spark, sf):
    p = _panel(spark, sf).withColumn("dataset", F.col("task_path"))
    return rounded(panel.composition_table(p, ["g1", "g0"]), "length_mean", "gc_mean")


@query("g2_composition_totals", f"WITH {PANEL} SELECT grp, count(*) AS n, round(avg(length),6)+0.0 AS length_mean, round(avg(gc),6)+0.0 AS gc_mean FROM p GROUP BY ROLLUP(grp)")
def g2_totals(spark, sf):
    return rounded(panel.composition_totals(_panel(spark, sf)), "length_mean", "gc_mean")


SPECIES = """sc AS (SELECT {by}, species, count(*) AS k FROM p GROUP BY ALL), sr AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS ks, sum(k) OVER (PARTITION BY {by}) AS t, row_number() OVER (PARTITION BY {by} ORDER BY k DESC, species) AS rk FROM sc),
 sp AS (SELECT {by}, CASE WHEN ks = 1 THEN species WHEN k / t::DOUBLE >= 0.85 THEN printf('%s (%d/%d)', species, k::BIGINT, t::BIGINT) ELSE printf('multi-species (n=%d)', ks::BIGINT) END AS species FROM sr WHERE rk = 1)"""


@query(
    "g3_stratum_profile",
    f"""WITH {PANEL}, {SPECIES.format(by='stratum')}, tc AS (SELECT stratum, task_path, count(*) AS k FROM p GROUP BY 1,2), tr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k DESC, task_path) AS rk FROM tc),
 tk AS (SELECT stratum, string_agg(regexp_replace(task_path,'/[^/]*$',''), ', ' ORDER BY rk) AS tasks FROM tr WHERE rk <= 3 GROUP BY 1),
 b AS (SELECT stratum, count(*) AS n, min(length) AS length_min, max(length) AS length_max, 100.0::DOUBLE*count(*)/(SELECT count(*) FROM p) AS pct, quantile_cont(length,0.25) AS a1, median(length) AS a2, quantile_cont(length,0.75) AS a3, quantile_cont(gc,0.25) AS b1, median(gc) AS b2, quantile_cont(gc,0.75) AS b3 FROM p GROUP BY 1)
 SELECT stratum, n, length_min, length_max, round(pct,6)+0.0 AS panel_pct, round(a1,6)+0.0 AS length_q25, round(a2,6)+0.0 AS length_median, round(a3,6)+0.0 AS length_q75, round(b1,6)+0.0 AS gc_q25, round(b2,6)+0.0 AS gc_median, round(b3,6)+0.0 AS gc_q75, species, tasks
 FROM b JOIN sp USING (stratum) JOIN tk USING (stratum)""",
)
def g3(spark, sf):
    out = panel.stratum_profile(_panel(spark, sf))
    return rounded(out, "panel_pct", "length_q25", "length_median", "length_q75", "gc_q25", "gc_median", "gc_q75")


@query(
    "g4_dataset_profile",
    f"""WITH {PANEL}, {SPECIES.format(by='stratum, task_path')}
 SELECT stratum, task_path, count(*) AS n, round(median(length),6)+0.0 AS length_median, round(median(gc),6)+0.0 AS gc_median, any_value(sp.species) AS species FROM p JOIN sp USING (stratum, task_path) GROUP BY 1,2""",
)
def g4(spark, sf):
    return rounded(panel.dataset_profile(_panel(spark, sf), ORDER), "length_median", "gc_median")


@query(
    "g5_split_stats",
    f"""WITH {LAB}, x AS (SELECT *, CASE WHEN item % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM lab), lc AS (SELECT stratum, quality, count(*) AS k FROM x GROUP BY 1,2), m AS (SELECT stratum, 100.0::DOUBLE*min(k)/sum(k) AS mp FROM lc GROUP BY 1)
 SELECT stratum, count(*) FILTER (split='train') AS n_train, count(*) FILTER (split='test') AS n_test, min(length) AS length_min, max(length) AS length_max, round(any_value(mp),6)+0.0 AS minority_pct, round(median(length),6)+0.0 AS length_median FROM x JOIN m USING (stratum) GROUP BY 1""",
)
def g5(spark, sf):
    rows = fx_lab(spark, sf).withColumn("split", F.when(F.col("item") % 3 == 0, "test").otherwise("train")).withColumn("label", F.col("quality"))
    return rounded(panel.split_stats(rows, ["stratum"]), "minority_pct", "length_median")


@query("g6_file_stats", f"WITH {ITEMS} SELECT dataset, count(*) AS n_records, sum(length)::BIGINT AS total_bp, round(avg(length),6)+0.0 AS length_mean FROM i WHERE length > 0 GROUP BY 1")
def g6(spark, sf):
    return rounded(panel.file_stats(fx_items(spark, sf), ["dataset"]), "length_mean")


@query("g6_label_counts", f"WITH {ITEMS} SELECT dataset, stratum AS label, count(*) AS n FROM i WHERE length > 0 GROUP BY 1,2")
def g6_labels(spark, sf):
    return panel.label_counts(fx_items(spark, sf).withColumnRenamed("stratum", "label"), ["dataset"])


@query(
    "g7_nearest_rank_percentile",
    f"""WITH {ITEMS}, c AS (SELECT dataset, length, count(*) AS k FROM i GROUP BY 1,2), w AS (SELECT *, sum(k) OVER (PARTITION BY dataset ORDER BY length) AS c, sum(k) OVER (PARTITION BY dataset) AS t FROM c),
 q AS (SELECT unnest([0.0,0.25,0.5,0.75,0.95,1.0])::DOUBLE AS q) SELECT dataset, q, min(length) AS value FROM w JOIN q ON c >= q * t GROUP BY 1,2""",
)
def g7(spark, sf):
    return panel.nearest_rank_percentile(fx_items(spark, sf), ["dataset"], "length")


TASKS = """tk AS (SELECT stratum AS collection, stratum || '/' || dataset AS dataset, dataset AS task_group, CASE WHEN count(*) > 10 THEN 'binary' ELSE 'single_label' END AS task_type, count(*) AS n_records, min(length) AS len_min, quantile_disc(length,0.5) AS len_median, max(length) AS len_max FROM i GROUP BY 1,2,3)"""


@query(
    "g8_collection_summary",
    f"""WITH {ITEMS}, {TASKS}, m AS (SELECT collection, len_median, row_number() OVER (PARTITION BY collection ORDER BY len_median, dataset) AS rk, count(*) OVER (PARTITION BY collection) AS c FROM tk),
 ty AS (SELECT collection, task_type, count(*) AS k FROM tk GROUP BY 1,2), tt AS (SELECT collection, string_agg(task_type || ':' || k, ';' ORDER BY task_type) AS task_types FROM ty GROUP BY 1)
 SELECT collection, count(*) AS n_files, sum(n_records)::BIGINT AS n_records_total, min(len_min) AS len_min, max(len_max) AS len_max, count(DISTINCT dataset) AS n_datasets, count(DISTINCT task_group) AS n_groups, any_value(task_types) AS task_types,
 any_value(md) AS len_median_of_medians FROM tk JOIN tt USING (collection) JOIN (SELECT collection, len_median AS md FROM m WHERE rk = c // 2 + 1) USING (collection) GROUP BY 1""",
)
def g8(spark, sf):
    i = fx_items(spark, sf)
    keys = [F.col("stratum").alias("collection"), F.concat_ws("/", "stratum", "dataset").alias("dataset"), F.col("dataset").alias("task_group")]
    rows = i.select(*keys, "length")
    base = rows.groupBy("collection", "dataset", "task_group").agg(F.count(F.lit(1)).alias("n_records"), F.min("length").alias("len_min"), F.max("length").alias("len_max"))
    middle = panel.nearest_rank_percentile(rows, ["collection", "dataset"], "length", [0.5]).select("collection", "dataset", F.col("value").alias("len_median"))
    tasks = base.join(middle, ["collection", "dataset"]).withColumn("task_type", F.when(F.col("n_records") > 10, "binary").otherwise("single_label"))
    out = panel.collection_summary(tasks)
    shown = F.array_join(F.transform(F.map_entries("task_types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";")
    return out.withColumn("task_types", shown)


@query(
    "g9_group_counts",
    "SELECT 'p_brand' AS attribute, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2",
)
def g9(spark, sf):
    return panel.group_counts(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("g9_known_counts", "SELECT count(quality) AS n_quality, count(toxic) AS n_toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def g9_known(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return panel.known_counts(d, ["quality", "toxic"])


@query(
    "w4_top_labels",
    """WITH c AS (SELECT lang, source, count(*) AS k FROM documents GROUP BY 1,2), x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, source) AS rk FROM c)
 SELECT lang, string_agg(source || ':' || k, ';' ORDER BY rk) AS labels FROM x WHERE rk <= 6 GROUP BY 1""",
)
def w4(spark, sf):
    return panel.top_labels(table(spark, sf, "documents"), ["lang"], "source")


@query("w5_head_items", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 20")
def w5(spark, sf):
    return panel.head_items(table(spark, sf, "documents").select("doc_id", "lang", "source"), 20, "doc_id")


@query("w6_number_items", "SELECT doc_id, lang, printf('%s_%05d', lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id)) AS probe_id FROM documents")
def w6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return panel.number_items(d, "lang", [("n_chars", "asc"), ("doc_id", "asc")]).select("doc_id", "lang", "probe_id")


@query(
    "w7_ordered_by_list",
    """SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, lang, source) AS place FROM documents GROUP BY 1,2""",
)
def w7(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.withColumn("_p", panel.order_position("lang", ORDER).cast("int"))
    numbered = ordered_rank(placed, [], [("_p", "asc"), ("lang", "asc"), ("source", "asc")], "place").drop("_p")
    return panel.ordered_by_list(numbered, "lang", ORDER, "source")


@query("w8_union_tables", "SELECT * FROM (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part)")
def w8(spark, sf):
    parts = [table(spark, sf, t).select(F.col(f"{p}key").alias("id"), F.col(f"{t[0]}_name").alias("name")) for t, p in (("customer", "c_cust"), ("supplier", "s_supp"), ("part", "p_part"))]
    return panel.union_tables(*parts, order=["name", "id"])


@query("w10_distinct_first", "SELECT user_id, event_id, event_type, round(value,6)+0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM events) WHERE rk = 1")
def w10(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return rounded(panel.distinct_first(e, "user_id", "event_id"), "value")


@query(
    "w10_clean_lines",
    "SELECT event_id, trim(event_type) AS line FROM events WHERE event_id % 3 <> 0",
)
def w10_lines(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    line = F.when(k % 3 == 0, F.concat(F.lit("  # "), "event_type")).when(k % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit(" # note"))).otherwise(F.col("event_type"))
    return panel.clean_lines(e.select("event_id", line.alias("line")))


@query(
    "w11_group_lump",
    """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n >= 40 OR p_size IN (1, 2) THEN p_size::VARCHAR ELSE 'Other' END AS lumped FROM part JOIN c USING (p_size)""",
)
def w11(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return panel.group_lump(p, "size", 40, ["1", "2"]).select("p_partkey", "lumped")


@query(
    "w11_lump_order",
    """SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 100 OR p_type = 'SMALL'""",
)
def w11_order(spark, sf):
    return panel.lump_order(table(spark, sf, "part"), "p_type", 100, ["SMALL"])


# ---------------------------------------------------------------- sampling


@query("p1_sample_quota", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS rk FROM documents) WHERE rk <= 10")
def p1(spark, sf):
    return panel.sample_quota(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 10, 42)


BALANCED = """a AS (SELECT *, row_number() OVER (PARTITION BY {g}, {lab} ORDER BY md5('{s}|' || {k}), {k}) AS l FROM {src}), b AS (SELECT *, coalesce(l <= {per}, true) AS head FROM a),
 bal AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY head DESC, md5('{s}b|' || {k}), {k}) AS rk FROM b)"""


@query("p2_sample_balanced", f"WITH {BALANCED.format(g='source', lab='lang', s=42, k='doc_id', src='documents', per=3)} SELECT doc_id, source, lang FROM bal WHERE rk <= 15")
def p2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return panel.sample_balanced(d, ["source"], "lang", "doc_id", 3, 15, 42)


def fx_spec(spark, sf):
    """One spec row per source: quotas, crops and policies derived from its number."""
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    n = F.regexp_extract("dataset", r"(\d+)", 1).cast("int")
    return d.select(
        "dataset",
        F.concat(F.lit("st"), (n % 4).cast("string")).alias("stratum"),
        F.lit("text").alias("species_group"),
        F.lit("per_dataset").alias("stratum_species"),
        F.when(n % 2 == 0, F.concat(F.lit("sp_"), "dataset")).alias("species"),
        (n + 5).alias("target_n"),
        F.when(n % 3 == 0, F.lit(200)).alias("crop_to"),
        F.when(n % 5 == 0, "keep_label").otherwise("keep_all").alias("policy"),
        F.array(F.lit("en"), F.lit("fr")).alias("keep_labels"),
        F.when(n % 2 == 1, F.lit(4)).alias("per_label"),
        n.alias("position"),
    )


def fx_records(spark, sf):
    return fx_seq(spark, sf).select("dataset", "seq", F.col("stratum").alias("label"), F.col("item").alias("row_idx"))


BUILD = f"""{SEQ}, sp AS (SELECT DISTINCT dataset, regexp_extract(dataset,'(\\d+)',1)::INT AS n FROM s),
 j AS (SELECT s.item, s.stratum AS label, dataset, n, n + 5 AS target_n, 'st' || (n % 4) AS stratum, CASE WHEN n % 2 = 1 THEN 4 END AS per_label, dataset || '#' || item AS key,
  CASE WHEN n % 3 = 0 AND length(seq) > 200 THEN substr(seq, (length(seq)-200)//2+1, 200) ELSE seq END AS seq FROM s JOIN sp USING (dataset) WHERE n % 5 <> 0 OR s.stratum IN ('en','fr')),
 pool AS (SELECT * FROM j WHERE length(seq) BETWEEN 128 AND 1024), {BALANCED.format(g='dataset', lab='label', s=42, k='key', src='pool', per='per_label')},
 built AS (SELECT *, printf('%s_%05d', stratum, row_number() OVER (PARTITION BY stratum ORDER BY n, rk)) AS probe_id FROM bal WHERE rk <= target_n)"""


@query(
    "p3_build_panel",
    f"""WITH {BUILD} SELECT probe_id, seq AS sequence, length(seq)::INT AS length_bp, stratum AS functional_element, 'text' AS species_group, CASE WHEN n % 2 = 0 THEN 'sp_' || dataset ELSE stratum || '_label_' || label END AS species,
 round(length(regexp_replace(seq,'[^GC]','','g'))::DOUBLE/length(seq),6)+0.0 AS gc, dataset || '#row_' || item AS source, CASE WHEN n % 5 = 0 THEN 'keep_label' ELSE 'keep_all' END AS label_source FROM built""",
)
def p3(spark, sf):
    built = panel.build_panel(fx_records(spark, sf), fx_spec(spark, sf))
    return built.withColumn("gc", r("GC_content")).drop("GC_content", "dinuc_vec", "trinuc_vec")


@query(
    "g22_panel_manifest",
    f"""WITH {BUILD}, e AS (SELECT dataset, count(*) AS emitted_n FROM built GROUP BY 1), q AS (SELECT dataset, count(*) AS pool_size FROM s GROUP BY 1),
 sx AS (SELECT dataset, n FROM sp UNION ALL SELECT 'absent', 1)
 SELECT 'st' || (n % 4) AS stratum, dataset, n + 5 AS target_n, coalesce(pool_size,0) AS pool_size, coalesce(emitted_n,0) AS emitted_n, CASE WHEN pool_size IS NULL THEN 'MISSING' ELSE 'OK' END AS status, coalesce(emitted_n,0) >= 0.95 * (n+5) AS filled
 FROM sx LEFT JOIN q USING (dataset) LEFT JOIN e USING (dataset)""",
)
def g22(spark, sf):
    spec = fx_spec(spark, sf)
    gone = spec.filter("position = 1").withColumn("dataset", F.lit("absent"))
    records = fx_records(spark, sf)
    return panel.panel_manifest(records, spec.unionByName(gone), panel.build_panel(records, spec))


@query(
    "g22_manifest_totals",
    f"""WITH {BUILD}, e AS (SELECT dataset, count(*) AS k FROM built GROUP BY 1) SELECT 'st' || (n % 4) AS stratum, sum(n+5)::BIGINT AS requested, sum(coalesce(k,0))::BIGINT AS emitted FROM sp LEFT JOIN e USING (dataset) GROUP BY ROLLUP(1)""",
)
def g22_totals(spark, sf):
    records, spec = fx_records(spark, sf), fx_spec(spark, sf)
    return panel.manifest_totals(panel.panel_manifest(records, spec, panel.build_panel(records, spec)))


# ---------------------------------------------------------------- control tables


def _ordinals(spark, sf):
    """0-based numbers of the documents: one control row per document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"))
    return ordered_rank(d, [], [("item", "asc")], "_n").select((F.col("_n") - 1).alias("ordinal"))


LETTERS = """CASE WHEN u < (1-gc)/2 THEN 'A' WHEN u < (1-gc)/2 + gc/2 THEN 'C' WHEN u < (1-gc)/2 + gc THEN 'G' ELSE 'T' END"""


def letters_sql(kind: str) -> str:
    """Letters of ``rows(ordinal, len, gc)`` from the same md5 digests."""
    return f"""pos AS (SELECT ordinal, len, gc, unnest(range(0, len)) AS p FROM rows_), dg AS (SELECT *, ('0x' || substr(md5('42|{kind}|' || ordinal || '|' || (p // 8)), ((p % 8)*4+1)::INT, 4))::BIGINT / 65536.0::DOUBLE AS u FROM pos),
 txt AS (SELECT ordinal, string_agg({LETTERS}, '' ORDER BY p) AS seq FROM dg GROUP BY 1)"""


@query(
    "p4_random_sequences",
    f"""WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents), l AS (SELECT ordinal, n // 7 AS base, n % 7 AS extra FROM o),
 lv AS (SELECT ordinal, CASE WHEN ordinal < (base+1)*extra THEN ordinal // (base+1) ELSE extra + (ordinal - (base+1)*extra) // base END AS lev, CASE WHEN ordinal < (base+1)*extra THEN ordinal % (base+1) ELSE (ordinal - (base+1)*extra) % base END AS inside FROM l),
 rows_ AS (SELECT ordinal, [200,300,500,1000][(inside % 4)::INT+1] AS len, [0.2,0.3,0.4,0.5,0.6,0.7,0.8][lev::INT+1]::DOUBLE AS gc FROM lv), {letters_sql('random')}
 SELECT printf('ctrl_random_ACGT_%05d', ordinal+1) AS probe_id, seq AS sequence, len AS length_bp, printf('synthetic::gc=%.2f::len=%d', gc, len) AS source FROM rows_ JOIN txt USING (ordinal)""",
)
def p4(spark, sf):
    return control.random_sequences(_ordinals(spark, sf)).select("probe_id", "sequence", "length_bp", "source")


@query(
    "p6_motif_spike",
    f"""WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () // 20 AS per FROM documents), c AS (SELECT ordinal, ordinal // per AS cell FROM o WHERE per > 0 AND ordinal < per * 20),
 rows_ AS (SELECT ordinal, [200,300,500,1000][(cell % 4)::INT+1] AS len, ['TATAAAA','CACGTG','CCAAT','GGGCGG','CCCTC'][(cell // 4)::INT+1] AS motif, 0.5::DOUBLE AS gc FROM c), {letters_sql('motif')}
 SELECT printf('ctrl_motif_spiked_%05d', ordinal+1) AS probe_id, substr(seq, 1, (len - length(motif))//2) || motif || substr(seq, (len - length(motif))//2 + length(motif) + 1) AS sequence, len AS length_bp FROM rows_ JOIN txt USING (ordinal)""",
)
def p6(spark, sf):
    return control.motif_spike(_ordinals(spark, sf)).select("probe_id", "sequence", "length_bp")


def _shuffle_input(spark, sf):
    s = fx_seq(spark, sf).filter(F.length("seq") > 0)
    return s.select("item", "stratum", "seq")


@query(
    "p5_dinuc_shuffle_counts",
    f"""WITH {SEQ}, km AS (SELECT item, substr(seq, p, 2) AS kmer FROM (SELECT item, seq, unnest(range(1, length(seq))) AS p FROM s WHERE length(seq) > 0)) SELECT item, kmer, count(*) AS n FROM km GROUP BY 1,2""",
)
def p5(spark, sf):
    """2-letter counts of every shuffled text: equal to those of its source."""
    shuffled = control.shuffle_texts(_shuffle_input(spark, sf), "seq", "item", 42)
    return text.kmer_table(shuffled, ["item"], "shuffled", 2)


@query("p5_dinuc_shuffle")
def p5_rows(spark, sf):
    s = _shuffle_input(spark, sf)
    out = control.dinuc_shuffle(s, s.count(), 42)
    return out.select("probe_id", "sequence", "length_bp", r("GC_content").alias("gc"), "source")


@query(
    "p5_shuffle_quota",
    f"""WITH {SEQ}, f AS (SELECT item, stratum FROM s WHERE length(seq) > 0), g AS (SELECT stratum, count(*) AS pool FROM f GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY stratum) AS si, count(*) OVER () AS k FROM g),
 sh AS (SELECT stratum, pool, 400 // k + CASE WHEN si <= 400 % k THEN 1 ELSE 0 END AS share FROM n), d AS (SELECT stratum, pool, unnest(range(1, share+1)) AS draw FROM sh),
 dr AS (SELECT *, CASE WHEN draw <= pool THEN draw ELSE ('0x' || substr(md5('42again|' || stratum || '|' || draw),1,12))::BIGINT % pool + 1 END AS r FROM d),
 fr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || item), item) AS r FROM f) SELECT dr.stratum, draw, item FROM dr JOIN fr ON fr.stratum = dr.stratum AND fr.r = dr.r""",
)
def p5_quota(spark, sf):
    return control.shuffle_quota(_shuffle_input(spark, sf), 400, 42).select("stratum", "draw", "item")


def _control(spark, sf):
    s = _shuffle_input(spark, sf)
    n = table(spark, sf, "documents").count()
    return control.build_control_panel(s, 42, n, n, n)


@query("p7_build_control_panel")
def p7(spark, sf):
    return _control(spark, sf).groupBy("functional_element", "length_bp").agg(F.count(F.lit(1)).alias("n"), r(F.avg("GC_content")).alias("gc"))


@query("g23_control_manifest")
def g23(spark, sf):
    out = control.control_manifest(_control(spark, sf))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(
    "w9_except_keys",
    "SELECT 'extra' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)",
)
def w9(spark, sf):
    from respmosaic.operators.joins import except_keys, intersect_keys

    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    part = lambda df, name: df.select(F.lit(name).alias("side"), "doc_id")
    return part(except_keys(d, lab, "doc_id"), "extra").unionByName(part(intersect_keys(d, lab, "doc_id"), "both"))
