"""Scoring, learning and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from respmosaic.catalog.base import ITEMS, LAB, SEQ, VN, entity_labels, fit_sql, fx_items, fx_lab, fx_seq, fx_v, fx_vn, query, r, rounded, table
from respmosaic.functions import text
from respmosaic.operators import learning, matrix, scoring
from respmosaic.session import ensure_checkpoint_dir
from respmosaic.streaming import coverage, projection

ALPHA = 1.0


def _seqs(spark, sf):
    return fx_seq(spark, sf).select(F.col("dataset").alias("entity"), "seq")


def _panel(spark, sf):
    return fx_seq(spark, sf).filter(F.length("seq") > 0).select("item", "seq")


GRID3 = "l4 AS (SELECT unnest(['A','C','G','T']) AS c), grid AS (SELECT a.c || b.c || d.c AS w FROM l4 a CROSS JOIN l4 b CROSS JOIN l4 d)"
MARKOV = f"""{GRID3}, pw AS (SELECT item, dataset AS entity, substr(seq, p, 3) AS w FROM (SELECT item, dataset, seq, unnest(range(1, greatest(length(seq)-2,0)+1)) AS p FROM s)),
 cw AS (SELECT entity, w, count(*) AS n FROM pw GROUP BY 1,2), full_ AS (SELECT e.entity, substr(grid.w,1,2) AS ctx, substr(grid.w,3,1) AS next, coalesce(n,0) AS n FROM (SELECT DISTINCT dataset AS entity FROM s) e CROSS JOIN grid LEFT JOIN cw ON cw.entity = e.entity AND cw.w = grid.w),
 mk AS (SELECT *, ln((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY entity, ctx) + 4.0::DOUBLE)) AS logp FROM full_)"""


@query("l1_fit_markov", f'WITH {SEQ}, {MARKOV} SELECT entity, ctx, "next", n, round(logp,6)+0.0 AS logp FROM mk')
def l1(spark, sf):
    return rounded(scoring.fit_markov(_seqs(spark, sf), 2, ALPHA), "logp")


@query(
    "l2_score_ar",
    f"""WITH {SEQ}, {MARKOV}, iw AS (SELECT item, w, count(*) AS k FROM pw GROUP BY 1,2), sc AS (SELECT mk.entity, iw.item, sum(k * logp) AS sl FROM iw JOIN mk ON mk.ctx || mk."next" = iw.w GROUP BY 1,2),
 a AS (SELECT e.entity, s.item, length(s.seq) AS t, coalesce(sl, 0.0) AS sl FROM (SELECT DISTINCT dataset AS entity FROM s) e CROSS JOIN s LEFT JOIN sc ON sc.entity = e.entity AND sc.item = s.item WHERE length(s.seq) > 0)
 SELECT entity, item, t::INT AS token_length, t::INT AS base_length, greatest(t-1,1)::INT AS predictable_tokens, round(sl,4)+0.0 AS sum_log_p, round(sl/t,6)+0.0 AS ell_per_base, round(-sl/t/ln(2),6)+0.0 AS bpb, round(-sl/greatest(t-1,1),6)+0.0 AS ce_loss FROM a""",
)
def l2(spark, sf):
    model = scoring.fit_markov(_seqs(spark, sf), 2, ALPHA)
    out = scoring.score_ar(model, _panel(spark, sf), 2).withColumn("sum_log_p", r("sum_log_p", 4))
    return rounded(out, "ell_per_base", "bpb", "ce_loss")


@query(
    "l2_ar_positions",
    f"""WITH {SEQ}, {MARKOV}, x AS (SELECT item, dataset AS entity, p + 1 AS pos, substr(seq, p, 3) AS w FROM (SELECT item, dataset, seq, unnest(range(1, greatest(length(seq)-2,0)+1)) AS p FROM s))
 SELECT x.entity, x.item, x.pos, round(logp,6)+0.0 AS logp FROM x JOIN mk ON mk.entity = x.entity AND mk.ctx || mk."next" = x.w""",
)
def l2_positions(spark, sf):
    """Per-position values of every document under the model of its own source."""
    model = scoring.fit_markov(_seqs(spark, sf), 2, ALPHA)
    items = fx_seq(spark, sf).select("item", F.col("dataset").alias("_own"), "seq")
    rows = scoring.ar_positions(model, items.select("item", "seq"), 2, items.select("item", F.col("_own").alias("entity")))
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "logp")


MASKED = """ed AS (SELECT item, dataset AS entity, '^' || seq || '$' AS e FROM s WHERE length(seq) > 0), pt AS (SELECT item, entity, substr(e, p, 3) AS w FROM (SELECT item, entity, e, unnest(range(1, length(e)-1)) AS p FROM ed)),
 lm AS (SELECT unnest(['A','C','G','T']) AS c), gr AS (SELECT a.c || b.c || d.c AS w FROM (SELECT c FROM lm UNION ALL SELECT '^') a CROSS JOIN lm b CROSS JOIN (SELECT c FROM lm UNION ALL SELECT '$') d),
 ct AS (SELECT entity, w, count(*) AS n FROM pt GROUP BY 1,2), fl AS (SELECT e.entity, substr(gr.w,1,1) AS lft, substr(gr.w,2,1) AS mid, substr(gr.w,3,1) AS rgt, coalesce(n,0) AS n FROM (SELECT DISTINCT entity FROM ed) e CROSS JOIN gr LEFT JOIN ct ON ct.entity = e.entity AND ct.w = gr.w),
 mm AS (SELECT *, ln((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY entity, lft, rgt) + 4.0::DOUBLE)) AS logp FROM fl)"""


@query("l3_fit_masked", f"WITH {SEQ}, {MASKED} SELECT entity, lft, mid, rgt, n, round(logp,6)+0.0 AS logp FROM mm")
def l3_fit(spark, sf):
    return rounded(scoring.fit_masked(_seqs(spark, sf), ALPHA), "logp")


@query(
    "l3_score_pll",
    f"""WITH {SEQ}, {MASKED}, iw AS (SELECT item, w, count(*) AS k FROM pt GROUP BY 1,2), sc AS (SELECT mm.entity, iw.item, sum(k*logp) AS sl FROM iw JOIN mm ON mm.lft || mm.mid || mm.rgt = iw.w GROUP BY 1,2)
 SELECT sc.entity, sc.item, length(seq)::INT AS token_length, length(seq)::INT AS base_length, length(seq)::INT AS content_position_count, length(seq)::INT AS masked_position_count, 6 AS stride, least(length(seq),6)::INT AS n_passes,
 round(sl,4)+0.0 AS sum_log_p, round(sl/length(seq),6)+0.0 AS ell_per_base, round(-sl/length(seq)/ln(2),6)+0.0 AS bpb FROM sc JOIN s USING (item)""",
)
def l3(spark, sf):
    model = scoring.fit_masked(_seqs(spark, sf), ALPHA)
    out = scoring.score_pll(model, _panel(spark, sf), 6).withColumn("sum_log_p", r("sum_log_p", 4))
    return rounded(out, "ell_per_base", "bpb")


def gc_scorer():
    """A user scorer: log-odds of G/C per letter; refuses texts without letters."""
    import math

    def score(seq: str) -> dict:
        if not seq:
            raise ValueError("empty sequence")
        gc = (seq.count("G") + seq.count("C") + 1) / (len(seq) + 2)
        return {"sum_log_p": sum(math.log(gc / 2 if ch in "GC" else (1 - gc) / 2) for ch in seq), "base_length": len(seq)}

    return score


@query(
    "l4_score_panel",
    f"""WITH {SEQ}, g AS (SELECT item, stratum, length(seq) AS n, length(regexp_replace(seq,'[^GC]','','g')) AS k FROM s), z AS (SELECT *, (k+1)::DOUBLE/(n+2) AS gc FROM g)
 SELECT item, stratum, CASE WHEN n > 0 THEN round(k*ln(gc/2)+(n-k)*ln((1-gc)/2),4)+0.0 END AS sum_log_p, CASE WHEN n > 0 THEN n::BIGINT END AS base_length, CASE WHEN n > 0 THEN '' ELSE 'ValueError: empty sequence' END AS scoring_error FROM z""",
)
def l4(spark, sf):
    rows = fx_seq(spark, sf).select("item", "stratum", F.col("seq").alias("sequence"))
    scored = scoring.score_panel(rows, gc_scorer, "sum_log_p double, base_length long")
    return scored.withColumn("sum_log_p", r("sum_log_p", 4))


@query(
    "l5_mean_pool",
    """WITH x AS (SELECT label, vec_id, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT label, pos, round(avg(value),6)+0.0 AS value FROM x WHERE vec_id % 4 <> 0 GROUP BY 1,2""",
)
def l5(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("content", F.col("vec_id") % 4 != 0)
    tokens = e.select("label", F.col("embedding").cast("array<double>").alias("vec"), "content")
    pooled = scoring.mean_pool(tokens, ["label"], mask="content")
    return pooled.select("label", F.posexplode_outer("features").alias("pos", "value")).select("label", "pos", r("value").alias("value"))


@query(
    "l5_concat_layers",
    """WITH x AS (SELECT label, vec_id % 2 AS layer, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT label, (layer * 64 + pos)::INT AS pos, round(avg(value),6)+0.0 AS value FROM x GROUP BY 1,2""",
)
def l5_layers(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 2).alias("layer"), F.col("embedding").cast("array<double>").alias("vec"))
    both = scoring.concat_layers(scoring.mean_pool(e, ["label", "layer"]), ["label"], "layer")
    return both.select("label", F.posexplode_outer("features").alias("pos", "value")).select("label", "pos", r("value").alias("value"))


@query(
    "l6_embed_split",
    f"""WITH {SEQ}, km AS (SELECT item, substr(seq, p, 2) AS kmer FROM (SELECT item, seq, unnest(range(1, greatest(length(seq)-1,0)+1)) AS p FROM s)), c AS (SELECT item, kmer, count(*) AS n FROM km GROUP BY 1,2), t AS (SELECT item, sum(n) AS t FROM c GROUP BY 1),
 w AS (SELECT a || b AS kmer, row_number() OVER (ORDER BY a || b) - 1 AS pos FROM (SELECT unnest(['A','C','G','T']) AS a) CROSS JOIN (SELECT unnest(['A','C','G','T']) AS b))
 SELECT l.doc_id AS item, l.quality AS label, w.pos::INT AS pos, CASE WHEN length(s.seq) >= 100 THEN round(coalesce(c.n::DOUBLE/t.t,0),6)+0.0 END AS value FROM labels l JOIN s ON s.item = l.doc_id CROSS JOIN w LEFT JOIN c ON c.item = s.item AND c.kmer = w.kmer LEFT JOIN t ON t.item = s.item""",
)
def l6(spark, sf):
    lab = fx_lab(spark, sf)
    vector = F.when(F.length("seq") >= 100, text.dinuc_vec("seq"))
    out = scoring.embed_split(lab, vector, "item", "quality")
    return out.select("item", "label", F.posexplode_outer("features").alias("pos", "value")).select("item", "label", "pos", r("value").alias("value"))


def _labelled_vectors(spark, sf):
    lab = fx_lab(spark, sf)
    return lab.select(F.col("item").alias("row"), "quality", text.dinuc_vec("seq").alias("features"), F.col("quality").alias("label"))


@query("l7_linear_probe")
def l7(spark, sf):
    rows = _labelled_vectors(spark, sf)
    rec = learning.linear_probe(rows.filter("row % 3 <> 0"), rows.filter("row % 3 = 0"), (0.1, 1.0), 3, 1)
    keep = [(k, str(round(v, 6) if isinstance(v, float) else v)) for k, v in rec.items()]
    return spark.createDataFrame(keep, "field string, value string")


AUC_SQL = """(SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM
 (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM te))"""


@query(
    "l7_one_feature",
    f"""WITH {LAB}, d AS (SELECT item, CASE WHEN length > 0 THEN gc END AS x, quality AS y FROM lab), tr AS (SELECT * FROM d WHERE item % 3 <> 0 AND x IS NOT NULL), te AS (SELECT * FROM d WHERE item % 3 = 0 AND x IS NOT NULL)
 SELECT round(CASE WHEN (SELECT covar_pop(x, y) FROM tr) > 0 THEN a ELSE 1 - a END, 6) + 0.0 AS auc_test, (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test, (SELECT count(*) FROM d WHERE item % 3 <> 0) AS n_train_raw,
 (SELECT count(*) FROM d WHERE item % 3 <> 0 AND x IS NULL) AS n_train_dropped, (SELECT count(*) FROM d WHERE item % 3 = 0) AS n_test_raw, (SELECT count(*) FROM d WHERE item % 3 = 0 AND x IS NULL) AS n_test_dropped, 1::BIGINT AS embed_dim
 FROM (SELECT {AUC_SQL} AS a)""",
)
def l7_one(spark, sf):
    """With one feature the test AUC is that of the feature itself, or of its negative; empty sequences count as dropped rows."""
    lab = fx_lab(spark, sf)
    rows = lab.select(F.col("item").alias("row"), F.array(F.when(F.col("length") > 0, F.col("gc"))).alias("features"), F.col("quality").alias("label"))
    rec = learning.linear_probe(rows.filter("row % 3 <> 0"), rows.filter("row % 3 = 0"), (0.1, 1.0), 3, 1)
    names = ["auc_test", "n_train", "n_test", "n_train_raw", "n_train_dropped", "n_test_raw", "n_test_dropped", "embed_dim"]
    return rounded(spark.createDataFrame([tuple(rec[n] for n in names)], "auc_test double, " + ", ".join(f"{n} long" for n in names[1:])), "auc_test")


@query(
    "l8_class_features",
    f"""WITH {ITEMS}, d AS (SELECT dataset AS entity, avg(gc) AS y, regexp_extract(dataset, '([0-9]+)', 1)::INT % 4 AS cls FROM i GROUP BY 1),
 k AS (SELECT *, (ntile(3) OVER (ORDER BY md5('0|' || entity), entity) - 1)::INT AS fold FROM d), f AS (SELECT DISTINCT fold FROM k),
 m AS (SELECT f.fold, cls, count(*) AS n, avg(y) AS y FROM f JOIN k ON k.fold <> f.fold GROUP BY 1, 2), b AS (SELECT fold, sum(n / (n + 2.0) * y) / sum(n / (n + 2.0)) AS b FROM m GROUP BY 1)
 SELECT k.entity, k.fold, round(k.y, 6) + 0.0 AS y_true, round(greatest(0.0, least(1.0, b + coalesce(n * (m.y - b) / (n + 2.0), 0.0))), 6) + 0.0 AS y_pred FROM k JOIN b USING (fold) LEFT JOIN m ON m.fold = k.fold AND m.cls = k.cls""",
)
def l8_classes(spark, sf):
    """Mean G/C of each source from 64 features of which one marks its class: ridge has a closed form, and the Gram matrix is the smaller side."""
    targets = fx_items(spark, sf).groupBy(F.col("dataset").alias("entity")).agg(F.avg("gc").alias("y")).withColumn("task", F.lit("gc"))
    mark = F.regexp_extract("entity", r"(\d+)", 1).cast("int") % 4
    features = targets.select(F.lit("class").alias("feature_set"), "entity", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == mark).cast("double")).alias("features"))
    pred = learning.predict_metric(features, targets, splits=("kfold",), alphas=(2.0,), n_folds=3, inner=2)
    return rounded(pred.select("entity", "fold", "y_true", "y_pred"), "y_true", "y_pred")


@query("l8_predict_metric")
def l8(spark, sf):
    """Mean G/C of each source's documents predicted from its 2-letter profile."""
    items = fx_items(spark, sf).select("dataset", "gc", F.posexplode_outer(text.dinuc_vec("seq")).alias("pos", "x"))
    means = items.groupBy("dataset", "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_l"))
    features = rows.select(F.lit("profile").alias("feature_set"), F.col("dataset").alias("entity"), F.col("_l.x").alias("features"))
    targets = fx_items(spark, sf).groupBy(F.col("dataset").alias("entity")).agg(F.avg("gc").alias("y")).withColumn("task", F.lit("gc"))
    groups = targets.select("entity", (F.regexp_extract("entity", r"(\d+)", 1).cast("int") % 6).cast("string").alias("label"))
    pred = learning.predict_metric(features, targets, groups, alphas=(0.01, 1.0), n_folds=3, inner=2)
    return rounded(pred, "y_true", "y_pred")


@query(
    "l8_ridge_one_feature",
    f"""WITH {ITEMS}, d AS (SELECT item AS entity, length / 1000.0::DOUBLE AS x, gc AS y, (ntile(3) OVER (ORDER BY md5('0|' || item), item) - 1)::INT AS fold FROM i),
 f AS (SELECT DISTINCT fold FROM d), m AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my FROM f JOIN d ON d.fold <> f.fold GROUP BY 1),
 w AS (SELECT m.fold, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 2.0) AS w FROM m JOIN d ON d.fold <> m.fold GROUP BY 1)
 SELECT entity, fold, round(y, 6) + 0.0 AS y_true, round(greatest(0.0, least(1.0, my + w * (x - mx))), 6) + 0.0 AS y_pred FROM d JOIN w USING (fold)""",
)
def l8_one(spark, sf):
    """G/C of every document from its length alone: the closed form of ridge with one feature."""
    items = fx_items(spark, sf)
    features = items.select(F.lit("length").alias("feature_set"), F.col("item").alias("entity"), F.array(F.col("length") / 1000.0).alias("features"))
    targets = items.select(F.col("item").alias("entity"), F.lit("gc").alias("task"), F.col("gc").alias("y"))
    pred = learning.predict_metric(features, targets, splits=("kfold",), alphas=(2.0,), n_folds=3, inner=2)
    return rounded(pred.select("entity", "fold", "y_true", "y_pred"), "y_true", "y_pred")


@query("l9_loo_classify")
def l9(spark, sf):
    """Held-out separation of even and odd sources by their mean 2-letter profile."""
    items = fx_items(spark, sf).select("dataset", F.posexplode_outer(text.dinuc_vec("seq")).alias("pos", "x"))
    means = items.groupBy("dataset", "pos").agg(F.avg("x").alias("x"))
    rows = means.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_l"))
    rows = rows.select(F.col("dataset").alias("row"), F.col("_l.x").alias("features"), (F.regexp_extract("dataset", r"(\d+)", 1).cast("int") % 2).alias("label"))
    rec = learning.loo_classify(rows, (1.0,), "logistic")
    return spark.createDataFrame([(rec["n"], round(rec["auc"], 6), rec["best_C"])], "n long, auc double, best_c double")


@query("l9_every_row", f"WITH {ITEMS} SELECT count(*) AS n, least(count(*), 200) AS n_fitted, 1.0::DOUBLE AS auc FROM i")
def l9_every_row(spark, sf):
    """Long and short documents told apart by their length: every row gets a held-out score, the fitted ones and the others."""
    rows = fx_items(spark, sf).select(F.col("item").alias("row"), F.array(F.when(F.col("length") > 200, 1.0).otherwise(-1.0) + F.col("gc") / 100).alias("features"), (F.col("length") > 200).cast("int").alias("label"))
    rec = learning.loo_classify(rows, (1.0,), max_rows=200)
    return spark.createDataFrame([(rec["n"], rec["n_fitted"], round(rec["auc"], 6))], "n long, n_fitted long, auc double")


# ---------------------------------------------------------------- streaming


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "r1_stream_coverage",
    f"""WITH {VN}, c AS (SELECT entity, count(value) AS f FROM vn GROUP BY 1) SELECT 'e' || entity AS entity, CASE WHEN f = 64 THEN 'DONE' ELSE 'PARTIAL' END AS state, f AS n_finite FROM c""",
)
def r1(spark, sf):
    """Score files dropped in two waves, the second repeating part of the first."""
    base = _folder(spark)
    rows = fx_vn(spark, sf).select(F.concat(F.lit("e"), F.col("entity").cast("string")).alias("entity"), "item", "value")
    items = fx_v(spark, sf).select("item").distinct()
    rows.filter("item < 40").write.parquet(f"{base}/in", mode="append")
    coverage.run_stream_coverage(spark, f"{base}/in", f"{base}/store", f"{base}/cp", items).awaitTermination()
    rows.filter("item >= 30").write.parquet(f"{base}/in", mode="append")
    coverage.run_stream_coverage(spark, f"{base}/in", f"{base}/store", f"{base}/cp", items).awaitTermination()
    states = coverage.stream_coverage(spark, f"{base}/store", items)
    return states.select("entity", "state", "n_finite")


@query(
    "r2_stream_project",
    f"""WITH {VN}, old AS (SELECT * FROM vn WHERE entity % 10 <> 0), {fit_sql('old', 'vd')},
 n AS (SELECT entity, item, CASE WHEN value IS NOT NULL THEN greatest(value, threshold) END AS value FROM vn CROSS JOIN vd_t WHERE entity % 10 = 0), o AS (SELECT entity, avg(value) AS own FROM n GROUP BY 1)
 SELECT entity, item, round(value - own - col_mean,6)+0.0 AS value FROM n JOIN o USING (entity) JOIN vd_m USING (item)""",
)
def r2(spark, sf):
    base = _folder(spark)
    v = fx_vn(spark, sf).select("entity", "item", "value")
    matrix.save_fit(matrix.fit_matrix(v.filter("entity % 10 <> 0")), f"{base}/fit")
    fit = matrix.load_fit(spark, f"{base}/fit")  # read by every micro-batch, fitted once
    matrix.to_row_form(v.filter("entity % 10 = 0")).write.parquet(f"{base}/in")
    projection.run_stream_project(spark, f"{base}/in", fit.thresholds, fit.col_means, f"{base}/out", f"{base}/cp").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out"), "value")
