"""Integrity gates, joins, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respmosaic.catalog.base import ITEMS, LAB, SEQ, V, VN, fx_items, fx_lab, fx_seq, fx_v, fx_vn, query, r, rounded, table
from respmosaic.operators import integrity, joins, matrix, statistics
from respmosaic.session import ensure_checkpoint_dir
from respmosaic.sources import readers, sinks

BROKEN = """br AS (SELECT entity, item, value FROM v WHERE NOT (entity % 6 = 0 AND item % 5 = 0) AND entity % 7 <> 0
 UNION ALL SELECT entity, item, value FROM v WHERE entity % 6 = 1 AND entity % 7 <> 0 AND item = 3),
 bk AS (SELECT entity, CASE WHEN entity % 6 = 2 AND item = 0 THEN 999 ELSE item END AS item, CASE WHEN entity % 6 = 3 AND item = 3 THEN NULL ELSE value END AS value FROM br)"""


def fx_broken(spark, sf):
    """Scores with one defect per entity class: gaps, duplicates, foreign items, nulls."""
    v = fx_v(spark, sf).select("entity", "item", "value").filter("entity % 7 <> 0")
    e, i = F.col("entity"), F.col("item")
    rows = v.filter(~((e % 6 == 0) & (i % 5 == 0))).unionByName(v.filter((e % 6 == 1) & (i == 3)))
    rows = rows.withColumn("value", F.when(~((e % 6 == 3) & (i == 3)), F.col("value")))
    return rows.withColumn("item", F.when((e % 6 == 2) & (i == 0), F.lit(999).cast("long")).otherwise(i))


GATE = f"""c AS (SELECT e.entity, count(bk.item) AS n_rows, count(DISTINCT bk.item) AS n_distinct, count(DISTINCT CASE WHEN bk.item > 63 THEN bk.item END) AS n_extra, count(DISTINCT CASE WHEN bk.item <= 63 AND bk.value IS NOT NULL THEN bk.item END) AS n_finite
 FROM (SELECT DISTINCT entity FROM v) e LEFT JOIN bk USING (entity) GROUP BY 1), g AS (SELECT *, 64 - (n_distinct - n_extra) AS n_missing,
 CASE WHEN n_rows = 0 THEN 'missing' WHEN n_distinct < n_rows THEN 'duplicate items' WHEN n_rows <> 64 THEN 'row count' WHEN n_extra > 0 OR n_distinct - n_extra < 64 THEN 'item set' WHEN n_finite < 64 THEN 'non-finite values' ELSE '' END AS reason FROM c)"""


@query("i1_coverage_gate", f"WITH {V}, {BROKEN}, {GATE} SELECT entity, n_rows, n_distinct, n_extra, n_missing, n_finite, reason, reason = '' AS ok FROM g")
def i1(spark, sf):
    v = fx_v(spark, sf)
    gate = integrity.coverage_gate(fx_broken(spark, sf), v.select("item"), v.select("entity"))
    return gate.select("entity", "n_rows", "n_distinct", "n_extra", "n_missing", "n_finite", "reason", "ok")


@query("i2_keep_complete", f"WITH {V}, {BROKEN}, {GATE} SELECT bk.entity, bk.item, round(bk.value,6)+0.0 AS value FROM bk JOIN g USING (entity) WHERE reason = ''")
def i2(spark, sf):
    return rounded(integrity.keep_complete(fx_broken(spark, sf), fx_v(spark, sf).select("item")), "value")


@query(
    "i3_fallback_fill",
    f"""WITH {VN}, n AS (SELECT entity FROM vn GROUP BY 1 HAVING count(*) FILTER (value IS NULL) / count(*)::DOUBLE <= 0.045)
 SELECT vn.entity, vn.item, round(coalesce(vn.value, v.value + 1),6)+0.0 AS value FROM vn JOIN n USING (entity) JOIN v ON v.entity = vn.entity AND v.item = vn.item""",
)
def i3(spark, sf):
    a = fx_vn(spark, sf).select("entity", "item", "value")
    b = fx_v(spark, sf).select("entity", "item", (F.col("value") + 1).alias("value"))
    return rounded(integrity.fallback_fill(a, b, 0.045), "value")


@query(
    "i4_embedding_complete",
    """WITH e AS (SELECT label, CASE WHEN vec_id % 25 = 0 THEN NULL ELSE label END AS lab, vec_id % 17 <> 0 AS good, len(embedding) AS k FROM embeddings)
 SELECT label AS part, count(*) AS n_rows, count(*) FILTER (lab IS NULL) AS n_unlabelled, min(k)::INT AS dim_min, max(k)::INT AS dim_max, count(*) FILTER (good) AS n_finite, count(*) = 50 AND count(*) FILTER (lab IS NULL) = 0 AND count(*) FILTER (good) >= 0.95 * count(*) AS ok FROM e GROUP BY 1""",
)
def i4(spark, sf):
    e = table(spark, sf, "embeddings")
    bad = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 17 == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    rows = e.select(F.col("label").alias("part"), F.when(F.col("vec_id") % 25 != 0, F.col("label")).alias("label"), bad.alias("features"))
    return integrity.embedding_complete(rows, 50, by=["part"])


@query(
    "i5_constant_dim_check",
    "SELECT 63 AS dim_min, 64 AS dim_max, count(*) FILTER (vec_id % 5 <> 0) AS n_ok, false AS ok FROM embeddings",
)
def i5(spark, sf):
    e = table(spark, sf, "embeddings")
    odd = F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return integrity.constant_dim_check(e.select(odd.alias("features")))


@query(
    "i6_class_gate",
    f"""WITH {LAB}, x AS (SELECT dataset, quality AS label, CASE WHEN item % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM lab UNION ALL SELECT 'all', quality, CASE WHEN item % 3 = 0 THEN 'test' ELSE 'train' END FROM lab UNION ALL SELECT stratum, quality, CASE WHEN item % 3 = 0 THEN 'test' ELSE 'train' END FROM lab),
 c AS (SELECT dataset, label, count(*) FILTER (split='train') AS tr, count(*) FILTER (split='test') AS te FROM x GROUP BY 1,2),
 g AS (SELECT dataset, sum(tr)::BIGINT AS n_train, sum(te)::BIGINT AS n_test, count(*) FILTER (tr>0) AS classes_train, count(*) FILTER (te>0) AS classes_test, min(tr) FILTER (tr>0) AS smallest, count(*) FILTER ((tr>0) <> (te>0)) AS un FROM c GROUP BY 1),
 z AS (SELECT *, CASE WHEN n_train < 20 OR n_test < 5 THEN 'tiny' WHEN classes_train < 2 THEN 'train has one class' WHEN classes_test < 2 THEN 'test has one class' WHEN un > 0 THEN 'class sets differ' WHEN smallest < 5 THEN 'smallest class below folds' END AS reason FROM g)
 SELECT dataset, n_train, n_test, classes_train, classes_test, smallest, reason, CASE WHEN reason = 'tiny' THEN 'tiny' WHEN reason IS NOT NULL THEN 'class_gate' END AS error_type FROM z""",
)
def i6(spark, sf):
    lab = fx_lab(spark, sf).select("dataset", "stratum", F.col("quality").alias("label"), F.when(F.col("item") % 3 == 0, "test").otherwise("train").alias("split"))
    part = lambda c: lab.select(c.alias("dataset"), "label", "split")
    return integrity.class_gate(part(F.col("dataset")).unionByName(part(F.lit("all"))).unionByName(part(F.col("stratum"))), 5, ["dataset"])


# Result rows made from events: one stored result per (user, type), newest event as its time.
RESULTS = """rs AS (SELECT user_id AS entity, event_type AS task, max(event_id) AS last, max(ts) AS mtime FROM events GROUP BY 1,2),
 res AS (SELECT entity, task, last % 13 <> 0 AS readable, CASE last % 11 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '1.5' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE '0.' || (last % 97 + 1) END AS auc,
  CASE last % 11 WHEN 3 THEN 'tiny' WHEN 4 THEN 'class_gate' WHEN 5 THEN 'fit_fail' END AS skip_reason, CASE last % 11 WHEN 3 THEN 'tiny' WHEN 4 THEN 'class_gate' WHEN 5 THEN 'fit_fail' END AS error_type,
  CASE last % 9 WHEN 0 THEN 'old' WHEN 1 THEN NULL ELSE 'now' END AS fit_params, mtime FROM rs)"""


def fx_results(spark, sf):
    e = table(spark, sf, "events")
    rows = e.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("task")).agg(F.max("event_id").alias("last"), F.max("ts").alias("mtime"))
    k = F.col("last") % 11
    kind = F.when(k == 3, "tiny").when(k == 4, "class_gate").when(k == 5, "fit_fail")
    auc = F.when(k == 1, "abc").when(k == 2, "1.5").when(~k.isin(0, 3, 4, 5), F.concat(F.lit("0."), (F.col("last") % 97 + 1).cast("string")))
    params = F.when(F.col("last") % 9 == 0, "old").when(F.col("last") % 9 != 1, "now")
    return rows.select("entity", "task", (F.col("last") % 13 != 0).alias("readable"), auc.alias("auc"), kind.alias("skip_reason"), kind.alias("error_type"), params.alias("fit_params"), "mtime")


@query(
    "i7_stale_results",
    f"""WITH {RESULTS}, inp AS (SELECT user_id AS entity, event_type AS task, max(CASE WHEN value > 100 THEN ts + INTERVAL 1 DAY ELSE ts - INTERVAL 1 DAY END) AS newest FROM events GROUP BY 1,2)
 SELECT entity, task, CASE WHEN NOT readable THEN 'unreadable' WHEN auc IS NULL AND skip_reason IS NULL THEN 'no outcome' WHEN auc IS NOT NULL AND try_cast(auc AS DOUBLE) IS NULL THEN 'auc not numeric' WHEN try_cast(auc AS DOUBLE) > 1 THEN 'auc out of range'
 WHEN newest > mtime THEN 'input newer' WHEN fit_params <> 'now' THEN 'params changed' WHEN error_type IN ('load_fail','fit_fail') THEN 'retry error' END AS refit_reason FROM res LEFT JOIN inp USING (entity, task)""",
)
def i7(spark, sf):
    later = F.expr("CASE WHEN value > 100 THEN ts + INTERVAL 1 DAY ELSE ts - INTERVAL 1 DAY END")  # inputs of large values were touched after the result
    inputs = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("task"), later.alias("mtime"))
    return integrity.stale_results(fx_results(spark, sf), inputs, ["entity", "task"], "now").select("entity", "task", "refit_reason")


@query(
    "i8_pending_work",
    """SELECT p_partkey AS entity, t AS task, s AS split FROM part CROSS JOIN (SELECT unnest(['A','N','R']) AS t) CROSS JOIN (SELECT unnest(['F','O']) AS s)
 EXCEPT SELECT l_partkey, l_returnflag, l_linestatus FROM lineitem""",
)
def i8(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("task"), F.col("l_linestatus").alias("split"))
    entities = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"))
    return integrity.pending_work(entities, ["A", "N", "R"], ["F", "O"], done)


BUCKET = """CASE WHEN NOT readable THEN 'corrupt' WHEN auc IS NOT NULL AND coalesce(try_cast(auc AS DOUBLE) NOT BETWEEN 0 AND 1, true) THEN 'corrupt' WHEN auc IS NOT NULL THEN 'success'
 WHEN error_type IN ('tiny','class_gate') THEN 'deliberate' WHEN error_type IN ('load_fail','fit_fail') THEN 'pipeline_error' ELSE 'unknown' END"""


@query(
    "i9_outcome_buckets",
    f"""WITH {RESULTS}, b AS (SELECT entity || '/' || task AS key, {BUCKET} AS bucket FROM res), x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rk FROM b)
 SELECT bucket, count(*) AS n, string_agg(key, ',' ORDER BY key) FILTER (rk <= 10) AS examples FROM x GROUP BY 1""",
)
def i9(spark, sf):
    return integrity.outcome_buckets(fx_results(spark, sf).withColumn("key", F.concat_ws("/", F.col("entity").cast("string"), "task")), "key")


@query(
    "i10_rerun_stability",
    f"""WITH {VN}, j AS (SELECT vn.entity, vn.value AS a, CASE WHEN vn.entity % 3 = 0 THEN v.value ELSE v.value + 0.02 * ((v.item*7+v.entity)%5) END AS b FROM vn JOIN v ON v.entity = vn.entity AND v.item = vn.item),
 k AS (SELECT entity, count(*) AS n_items, count(abs(a-b)) AS n_finite, max(abs(a-b)) AS mx, avg(abs(a-b)) AS mn, corr(a,b) AS rr FROM j WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1)
 SELECT entity, n_items, n_finite, round(mx,6)+0.0 AS max_abs_diff, round(mn,6)+0.0 AS mean_abs_diff, round(rr,6)+0.0 AS pearson_r, rr >= 0.95 AND n_finite >= 0.8 * n_items AS passed FROM k""",
)
def i10(spark, sf):
    b = fx_v(spark, sf).select("entity", "item", F.when(F.col("entity") % 3 == 0, F.col("value")).otherwise(F.col("value") + 0.02 * ((F.col("item") * 7 + F.col("entity")) % 5)).alias("value"))
    out = integrity.rerun_stability(fx_vn(spark, sf), b, min_finite=0.8)
    return rounded(out, "max_abs_diff", "mean_abs_diff", "pearson_r")


@query(
    "t17_auc_matrix",
    f"""WITH {RESULTS}, ok AS (SELECT entity, task, CASE WHEN try_cast(auc AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(auc AS DOUBLE) END AS auc FROM res)
 SELECT e.entity, t.task, round(ok.auc,6)+0.0 AS auc FROM (SELECT DISTINCT entity FROM res) e CROSS JOIN (SELECT DISTINCT task FROM res) t LEFT JOIN ok ON ok.entity = e.entity AND ok.task = t.task""",
)
def t17(spark, sf):
    return rounded(statistics.auc_matrix(fx_results(spark, sf)), "auc")


# ---------------------------------------------------------------- joins


@query("j2_attach_item_attrs", f"WITH {V} SELECT entity, item, (item % 4)::BIGINT AS stratum, round(((item*7)%13)/13.0::DOUBLE,6)+0.0 AS gc, round(value,6)+0.0 AS value FROM v")
def j2(spark, sf):
    v = fx_v(spark, sf).select("entity", "item", "value")
    panel = v.select("item").distinct().select("item", (F.col("item") % 4).alias("stratum"), (((F.col("item") * 7) % 13) / F.lit(13.0)).alias("gc"))
    return rounded(joins.attach_item_attrs(v, panel, "stratum", "gc"), "gc", "value")


@query("j3_align_to_items", "SELECT d.doc_id AS item, l.quality::DOUBLE AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3(spark, sf):
    panel = table(spark, sf, "documents").select(F.col("doc_id").alias("item"))
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.col("quality").cast("double").alias("value"))
    return matrix.align_to_items(scores, panel)


@query(
    "j4_attach_entity_attrs",
    """SELECT l_orderkey, l_linenumber, s_suppkey AS entity, coalesce(n_name,'unknown') AS nation, coalesce(r_name,'unknown') AS region, round(log10(greatest(s_acctbal,0)+1),6)+0.0 AS log10_size
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def j4(spark, sf):
    s, n, rg = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    dim = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(rg, n.n_regionkey == rg.r_regionkey, "left")
    dim = dim.select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.greatest("s_acctbal", F.lit(0.0)).alias("size"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("entity"))
    return rounded(joins.attach_entity_attrs(lines, dim, ["nation", "region"], ["size"]), "log10_size")


@query(
    "j5_check_same_keys",
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'left' ELSE 'right' END AS missing_in FROM documents a FULL JOIN labels b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL",
)
def j5(spark, sf):
    return joins.key_differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "j8_apply_overrides",
    """WITH o AS (SELECT p_partkey, p_size * 2 AS p_size FROM part WHERE p_partkey % 4 = 0 AND p_size > 10)
 SELECT p.p_partkey, coalesce(o.p_size, p.p_size)::INT AS p_size, CASE WHEN o.p_size IS NOT NULL THEN 'override' ELSE 'inferred' END AS p_size_source FROM part p LEFT JOIN o USING (p_partkey)""",
)
def j8(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    overrides = p.filter("p_partkey % 4 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") * 2).alias("p_size"))
    return joins.apply_overrides(p, overrides, "p_partkey", ["p_size"], F.col("p_size").isNotNull())


# ---------------------------------------------------------------- sources and sinks


def scratch(spark) -> str:
    """A fresh folder on the shared checkpoint store."""
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("s1_read_fasta", f"WITH {SEQ} SELECT 'doc' || item || '|' || (item % 2) AS header, seq, length(seq)::INT AS length FROM s")
def s1(spark, sf):
    """Documents written as FASTA with wrapped lines, then read back."""
    path = scratch(spark)
    wrapped = F.regexp_replace("seq", "(.{70})", "$1\n")
    record = F.concat(F.lit(">doc"), F.col("item").cast("string"), F.lit("|"), (F.col("item") % 2).cast("string"), F.lit("\n"), wrapped)
    fx_seq(spark, sf).select(record.alias("value")).write.text(path)
    return readers.read_fasta(spark, path).select("header", "seq", F.length("seq").alias("length"))


@query("s1_fasta_stats", f"WITH {SEQ} SELECT (item % 2)::VARCHAR AS label, count(*) AS n, sum(length(seq))::BIGINT AS total_bp FROM s WHERE length(seq) > 0 GROUP BY 1")
def s1_stats(spark, sf):
    path = scratch(spark)
    record = F.concat(F.lit(">doc"), F.col("item").cast("string"), F.lit("|"), (F.col("item") % 2).cast("string"), F.lit("\r\n"), F.col("seq"), F.lit("\r"))
    fx_seq(spark, sf).select(record.alias("value")).write.option("compression", "gzip").text(path)
    return readers.fasta_lengths(readers.read_fasta(spark, path)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_bp"))


@query("s2_read_labelled_csv", f"WITH {LAB} SELECT seq, quality::VARCHAR AS label FROM lab WHERE length(seq) > 0")
def s2(spark, sf):
    path = scratch(spark) + ".tsv"
    rows = fx_lab(spark, sf).select(F.concat(F.lit(" "), "seq").alias("dna"), F.col("quality").alias("class"))
    # Cut off at its end, a field of blanks would be written as a broken empty value and read back as text.
    rows.write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_labelled_csv(spark, path, "dna", "class").select("seq", "label")


@query("s3_resolve_columns", "SELECT text AS sequence, lang AS label FROM documents")
def s3(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("Seq"), F.col("lang").alias("Target"))
    return readers.resolve_columns(d, {"sequence": ("sequence", "seq"), "label": ("label", "target")}, ignore_case=True)


@query("s4_read_task_split", f"WITH {LAB} SELECT seq AS sequence, quality AS label FROM lab WHERE length(seq) > 0")
def s4(spark, sf):
    path = scratch(spark)
    fx_lab(spark, sf).filter(F.length("seq") > 0).select(F.lower("seq").alias("Sequence"), F.col("quality").alias("Label")).write.option("header", True).csv(f"{path}/train.csv")
    return readers.read_task_split(spark, path, "train")


@query("s5_read_scores", f"WITH {VN} SELECT '00' || grp AS entity, entity AS item, round(avg(value),6)+0.0 AS value FROM vn GROUP BY 1,2")
def s5(spark, sf):
    path = scratch(spark)
    scores = fx_vn(spark, sf).groupBy(F.concat(F.lit("00"), F.col("grp").cast("string")).alias("entity"), F.col("entity").alias("item")).agg(F.avg("value").alias("value"))
    sinks.write_scores(scores, path)
    return rounded(readers.read_scores(spark, path), "value")


@query("s6_read_entity_json", "SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier")
def s6(spark, sf):
    """One document per nation, each holding a list of entities."""
    path = scratch(spark)
    s = table(spark, sf, "supplier")
    member = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    docs = s.groupBy("s_nationkey").agg(F.collect_list(member).alias("models")).select("models")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_entity_json(spark, path).select("id", "name", "nation")


@query(
    "s6_read_result_tree",
    f"""WITH {RESULTS} SELECT 'e/' || entity AS entity, 't/' || task AS task, readable, CASE WHEN readable THEN auc END AS auc, CASE WHEN readable THEN skip_reason END AS skip_reason, CASE WHEN readable THEN error_type END AS error_type FROM res""",
)
def s6_tree(spark, sf):
    """Results written as one JSON file per entity and task, unreadable ones as broken text, then read back with their ids from the path."""
    path = scratch(spark)
    rows = fx_results(spark, sf)
    body = F.when(F.col("readable"), F.to_json(F.struct(F.col("auc").alias("auc_test"), "skip_reason", "error_type"))).otherwise(F.lit('{"auc_test": '))
    files = rows.select(F.concat(F.lit("e__"), F.col("entity").cast("string")).alias("entity"), F.concat(F.lit("t__"), "task").alias("task"), body.alias("value"))
    sinks.write_text_tree(files, path, ["entity", "task"])
    return readers.read_results(spark, path, "part-*").select("entity", "task", "readable", "auc", "skip_reason", "error_type")


@query("s8_list_data_files", "SELECT DISTINCT 'c_mktsegment=' || c_mktsegment AS folder, 'csv' AS kind FROM customer UNION ALL SELECT DISTINCT 'old/c_mktsegment=' || c_mktsegment, 'csv.gz' FROM customer")
def s8(spark, sf):
    """Data files of a tree: plain and gzipped ones count, other kinds and skipped folders do not."""
    path = scratch(spark)
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition("c_mktsegment")
    c.write.partitionBy("c_mktsegment").csv(path)
    c.write.partitionBy("c_mktsegment").option("compression", "gzip").csv(f"{path}/old")
    c.write.partitionBy("c_mktsegment").json(f"{path}/notes")
    c.write.partitionBy("c_mktsegment").csv(f"{path}/Figures/new")
    listed = readers.list_data_files(spark, path)
    return listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", r"\.(csv(\.gz)?)$", 1).alias("kind")).distinct()


@query("s3_sequence_by_content", f"WITH {SEQ} SELECT item, seq AS sequence, stratum AS label FROM s WHERE length(seq) >= 30")
def s3_content(spark, sf):
    """No header names the sequence, so the first column whose first value looks like DNA is it."""
    d = fx_seq(spark, sf).filter(F.length("seq") >= 30).select("item", F.col("stratum").alias("Class"), F.col("seq").alias("field_7"))
    return readers.name_columns(d).select("item", "sequence", "label")


@query("s7_read_pairs_csv", "SELECT '0' AS anchor, c_custkey::VARCHAR AS partner, c_mktsegment AS label FROM customer")
def s7(spark, sf):
    path = scratch(spark)
    c = table(spark, sf, "customer").select(F.lit("0"), F.col("c_custkey").cast("string"), "c_mktsegment")
    c.write.csv(path)
    return readers.read_pairs_csv(spark, path)


@query("s9_pack_features", "SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS pos, round(unnest(embedding)::DOUBLE,6)+0.0 AS value FROM embeddings")
def s9(spark, sf):
    wide = readers.unpack_features(table(spark, sf, "embeddings"), 64, "embedding")
    packed = readers.pack_features(wide)
    return packed.select("vec_id", "label", F.posexplode("features").alias("pos", "value")).select("vec_id", "label", "pos", r(F.col("value").cast("double")).alias("value"))


@query("s10_load_panel", f"WITH {ITEMS} SELECT item, length, round(gc,6)+0.0 AS gc FROM i")
def s10(spark, sf):
    path = scratch(spark)
    sinks.write_table(fx_items(spark, sf).drop("seq"), path)
    return rounded(readers.Catalog(spark, {"main": path}).load_panel("main").select("item", "length", "gc"), "gc")


@query("s11_sinks_round_trip", "SELECT fmt, c_custkey, c_name, c_mktsegment FROM customer CROSS JOIN (SELECT unnest(['parquet','csv','json']) AS fmt)")
def s11(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch(spark)
        sinks.write_table(c, path, fmt)
        reader = spark.read if fmt == "parquet" else spark.read.schema(c.schema)
        back = reader.option("header", True).format(fmt).load(path).select(F.lit(fmt).alias("fmt"), *c.columns)
        out = back if out is None else out.unionByName(back)
    return out
