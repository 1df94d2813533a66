"""Aggregates, ranks, correlations, splits and permutation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from respmosaic.catalog.base import BIG, LAB, V, VN, dist_sql, entity_labels, fit_sql, fx_big, fx_lab, fx_v, fx_vn, query, r, rounded
from respmosaic.operators import distance, factor, matrix, permutation, splits, statistics
from respmosaic.plans.correlation import safe_pearson, spearman
from respmosaic.plans.ranking import average_rank

FIT = fit_sql("vn", "vd")
DIST = FIT + ", " + dist_sql("vd", "d")
PANEL = "panel AS (SELECT DISTINCT item, item % 4 AS stratum FROM v)"


def _panel(spark, sf):
    return fx_v(spark, sf).select("item").distinct().withColumn("stratum", F.col("item") % 4)


@query(
    "g10_stratum_value_stats",
    f"""WITH {VN}, {PANEL} SELECT stratum, count(DISTINCT item) AS n_items, count(value) AS n_cells, round(avg(value),6)+0.0 AS mean, round(stddev_pop(value),6)+0.0 AS std
 FROM vn JOIN panel USING (item) GROUP BY 1""",
)
def g10(spark, sf):
    return rounded(statistics.stratum_value_stats(fx_vn(spark, sf), _panel(spark, sf)), "mean", "std")


@query("g11_item_variance", f"WITH {VN} SELECT item, count(value) AS n, round(var_samp(value),6)+0.0 AS variance, round(avg(value),6)+0.0 AS mean FROM vn GROUP BY 1")
def g11(spark, sf):
    return rounded(statistics.item_variance(fx_vn(spark, sf)), "variance", "mean")


@query("g11_item_variance_big", f"WITH {BIG} SELECT item, count(value) AS n, round(var_pop(value),6)+0.0 AS variance, round(avg(value),6)+0.0 AS mean FROM big GROUP BY 1")
def g11_big(spark, sf):
    return rounded(statistics.item_variance(fx_big(spark, sf), ddof=0), "variance", "mean")


@query(
    "g12_item_variance_by_stratum",
    f"""WITH {VN}, {PANEL}, iv AS (SELECT item, var_samp(value) AS variance, avg(value) AS mean FROM vn GROUP BY 1)
 SELECT stratum, count(variance) AS n, round(avg(variance),6)+0.0 AS mean_variance, round(max(variance),6)+0.0 AS max_variance, round(avg(mean),6)+0.0 AS mean_of_means FROM iv JOIN panel USING (item) GROUP BY 1""",
)
def g12(spark, sf):
    out = statistics.item_variance_by_stratum(statistics.item_variance(fx_vn(spark, sf)), _panel(spark, sf))
    return rounded(out, "mean_variance", "max_variance", "mean_of_means")


@query(
    "g13_branch_scale",
    f"""WITH {V}, w AS (SELECT branch, value + 2 AS value FROM v), q AS (SELECT branch, median(value) AS median, quantile_cont(value,0.25) AS q25, quantile_cont(value,0.75) AS q75, min(value) AS min, max(value) AS max FROM w GROUP BY 1),
 z AS (SELECT *, median / (SELECT median FROM q ORDER BY branch LIMIT 1) AS ratio FROM q)
 SELECT branch, round(median,6)+0.0 AS median, round(q25,6)+0.0 AS q25, round(q75,6)+0.0 AS q75, round(min,6)+0.0 AS min, round(max,6)+0.0 AS max, round(ratio,6)+0.0 AS ratio, ratio BETWEEN 0.5 AND 2.0 AS passed FROM z""",
)
def g13(spark, sf):
    v = fx_v(spark, sf).withColumn("value", F.col("value") + 2)
    return rounded(statistics.branch_scale(v), "median", "q25", "q75", "min", "max", "ratio")


@query(
    "g14_row_stats",
    f"""WITH {VN}, {FIT}, e AS (SELECT entity, avg(value) AS m, stddev_pop(value) AS s FROM vd GROUP BY 1)
 SELECT grp, count(*) AS n, round(avg(m),6)+0.0 AS mean_of_means, round(stddev_pop(m),6)+0.0 AS std_of_means, round(avg(s),6)+0.0 AS mean_of_stds, round(stddev_pop(s),6)+0.0 AS std_of_stds
 FROM e JOIN (SELECT DISTINCT entity, grp FROM v) USING (entity) GROUP BY 1""",
)
def g14(spark, sf):
    vd = matrix.fit_matrix(fx_vn(spark, sf).select("entity", "item", "value")).values
    groups = entity_labels(fx_v(spark, sf), "grp").withColumnRenamed("label", "grp")
    return rounded(statistics.row_stats(vd, groups), "mean_of_means", "std_of_means", "mean_of_stds", "std_of_stds")


SHARE = """g AS (SELECT item, avg(value) AS g FROM {src} GROUP BY 1), c AS (SELECT grp, item, count(*) AS n, avg(value) AS c FROM {src} GROUP BY 1,2)
 SELECT round((SELECT sum(n*(c-g)*(c-g)) FROM c JOIN g USING (item)) / (SELECT sum((value-g)*(value-g)) FROM {src} JOIN g USING (item)),6)+0.0 AS share"""


@query("g16_between_group_share", f"WITH {V}, {SHARE.format(src='v')}")
def g16(spark, sf):
    v = fx_v(spark, sf)
    return rounded(permutation.between_group_share(v, entity_labels(v, "grp")), "share")


IMP = "imp AS (SELECT entity, item, grp, coalesce(value, avg(value) OVER (PARTITION BY item)) AS value FROM vn)"


@query("g17_multivariate_fst", f"WITH {VN}, {IMP}, {SHARE.format(src='imp')}")
def g17(spark, sf):
    v = fx_vn(spark, sf)
    return rounded(permutation.multivariate_fst(v, entity_labels(v, "grp")), "share")


PERMUTE = """lab AS (SELECT DISTINCT entity, grp AS label FROM v), base AS (SELECT label, row_number() OVER (ORDER BY entity) AS r FROM lab),
 dr AS (SELECT entity, p AS perm, row_number() OVER (PARTITION BY p ORDER BY md5('7|' || p || '|' || entity), entity) AS r FROM lab CROSS JOIN range(1, 30) t(p)),
 pl AS (SELECT perm, entity, label FROM dr JOIN base USING (r) UNION ALL SELECT 0, entity, label FROM lab),
 gp AS (SELECT item, avg(value) AS g FROM imp GROUP BY 1),
 ce AS (SELECT perm, label, item, count(*) AS n, avg(value) AS c FROM imp JOIN pl USING (entity) GROUP BY 1,2,3),
 sh AS (SELECT perm, sum(n*(c-g)*(c-g)) / (SELECT sum((value-g)*(value-g)) FROM imp JOIN gp USING (item)) AS share FROM ce JOIN gp USING (item) GROUP BY 1)"""


@query("g18_permutation_shares", f"WITH {VN}, {IMP}, {PERMUTE} SELECT perm, round(share,6)+0.0 AS share FROM sh")
def g18_shares(spark, sf):
    v = fx_vn(spark, sf)
    out = permutation.permutation_shares(v, entity_labels(v, "grp"), 29, 7)
    return rounded(out.withColumn("perm", F.col("perm").cast("long")), "share")


@query(
    "g18_fst_permutation",
    f"""WITH {VN}, {IMP}, {PERMUTE}, o AS (SELECT share AS observed FROM sh WHERE perm = 0), n AS (SELECT label, count(*) AS n FROM lab GROUP BY 1)
 SELECT round(any_value(observed),6)+0.0 AS observed, round(avg((share >= observed)::INT),6)+0.0 AS p_value, round(quantile_cont(share,0.025),6)+0.0 AS null_lo, round(quantile_cont(share,0.975),6)+0.0 AS null_hi, count(*) AS n_perm,
 (SELECT count(*) FROM n) AS n_groups, (SELECT min(n) FROM n) AS smallest, (SELECT max(n) FROM n) AS largest, (SELECT count(*) FROM n) < 2 AS degenerate FROM sh CROSS JOIN o WHERE perm > 0""",
)
def g18(spark, sf):
    v = fx_vn(spark, sf)
    out = permutation.fst_permutation(v, entity_labels(v, "grp"), 29, 7)
    return rounded(out, "observed", "p_value", "null_lo", "null_hi")


# A metric table: each source is an entity, each language a task, the value is in [0, 1].
AUC = """auc AS (SELECT dataset AS entity, stratum AS task, CASE WHEN dataset IN ('src0','src2','src4','src6','src8') THEN 'x' ELSE 'y' END AS branch, avg(gc) AS auc FROM i GROUP BY 1,2)"""


def fx_auc(spark, sf):
    from respmosaic.catalog.base import fx_items

    items = fx_items(spark, sf)
    branch = F.when(F.col("dataset").isin("src0", "src2", "src4", "src6", "src8"), "x").otherwise("y")
    return items.groupBy(F.col("dataset").alias("entity"), F.col("stratum").alias("task"), branch.alias("branch")).agg(F.avg("gc").alias("auc"))


from respmosaic.catalog.base import ITEMS  # noqa: E402


@query(
    "g19_auc_distribution",
    f"""WITH {ITEMS}, {AUC}, srs AS (SELECT entity, branch, task, auc FROM auc UNION ALL SELECT entity, branch, '__mean__', avg(auc) FROM auc GROUP BY 1,2),
 b AS (SELECT task, 'all' AS branch, auc FROM srs UNION ALL SELECT task, branch, auc FROM srs)
 SELECT task, branch, count(auc) AS n, round(avg(auc),6)+0.0 AS mean, round(stddev_pop(auc),6)+0.0 AS std, round(min(auc),6)+0.0 AS min, round(max(auc),6)+0.0 AS max, round(median(auc),6)+0.0 AS median FROM b GROUP BY 1,2""",
)
def g19(spark, sf):
    return rounded(statistics.auc_distribution(fx_auc(spark, sf)), "mean", "std", "min", "max", "median")


PRED = """pred AS (SELECT item AS entity, CASE WHEN t = 'q' THEN quality ELSE toxic END::DOUBLE AS y_true, CASE WHEN t = 'q' THEN gc ELSE 1 - gc END + seed * 0.01 * (length % 3) AS y_pred, t AS task, seed, stratum AS split
 FROM lab CROSS JOIN (SELECT unnest(['q','t']) AS t) CROSS JOIN (SELECT unnest([1,2]) AS seed))"""


def fx_pred(spark, sf):
    """Predictions shaped table: true labels with a GC-based score per task and seed."""
    lab = fx_lab(spark, sf)
    both = lab.withColumn("task", F.explode(F.array(F.lit("q"), F.lit("t")))).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    q = F.col("task") == "q"
    return both.select(
        F.col("item").alias("entity"),
        F.when(q, F.col("quality")).otherwise(F.col("toxic")).cast("double").alias("y_true"),
        (F.when(q, F.col("gc")).otherwise(1 - F.col("gc")) + F.col("seed") * 0.01 * (F.col("length") % 3)).alias("y_pred"),
        "task",
        "seed",
        F.col("stratum").alias("split"),
    )


def rank_sql(cols: str, value: str) -> str:
    part = f"PARTITION BY {cols} " if cols else ""
    both = f"{cols}, {value}" if cols else value
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER (PARTITION BY {both}) - 1)/2.0::DOUBLE)"


METRICS = f"""full_ AS (SELECT split, seed, entity, task, y_true, y_pred FROM pred UNION ALL SELECT split, seed, entity, '__mean_auc__', avg(y_true), avg(y_pred) FROM pred GROUP BY 1,2,3),
 rk AS (SELECT *, {rank_sql('split, seed, task', 'y_pred')} AS rp, {rank_sql('split, seed, task', 'y_true')} AS rt FROM full_),
 met AS (SELECT split, seed, task, count(*) AS n,
  CASE WHEN count(*) >= 3 AND stddev_pop(y_pred) > 0 AND stddev_pop(y_true) > 0 THEN corr(y_pred, y_true) END AS pearson,
  avg(abs(y_true-y_pred)) AS mae, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true-y_pred)*(y_true-y_pred))/(var_pop(y_true)*count(*)) END AS r2,
  CASE WHEN count(*) >= 3 AND stddev_pop(rp) > 0 AND stddev_pop(rt) > 0 THEN corr(rp, rt) END AS spearman FROM rk GROUP BY 1,2,3)"""


@query(
    "t13_regression_metrics",
    f"WITH {LAB}, {PRED}, {METRICS} SELECT split, seed, task, n, round(pearson,6)+0.0 AS pearson, round(mae,6)+0.0 AS mae, round(r2,6)+0.0 AS r2, round(spearman,6)+0.0 AS spearman FROM met",
)
def t13(spark, sf):
    return rounded(statistics.regression_metrics(fx_pred(spark, sf), ["split", "seed"]), "pearson", "mae", "r2", "spearman")


SUMMARY = """sm AS (SELECT split, task, avg(pearson) AS pearson_mean, stddev_samp(pearson) AS pearson_std, avg(spearman) AS spearman_mean, stddev_samp(spearman) AS spearman_std FROM met GROUP BY 1,2)"""


def _summary(spark, sf):
    metrics = statistics.regression_metrics(fx_pred(spark, sf), ["split", "seed"])
    return statistics.metric_summary(metrics, ["split", "task"], ["pearson", "spearman"])


@query(
    "g20_metric_summary",
    f"""WITH {LAB}, {PRED}, {METRICS}, {SUMMARY} SELECT split, task, round(pearson_mean,6)+0.0 AS pearson_mean, round(pearson_std,6)+0.0 AS pearson_std, round(spearman_mean,6)+0.0 AS spearman_mean, round(spearman_std,6)+0.0 AS spearman_std FROM sm""",
)
def g20(spark, sf):
    return rounded(_summary(spark, sf), "pearson_mean", "pearson_std", "spearman_mean", "spearman_std")


@query(
    "t15_metric_table",
    f"""WITH {LAB}, {PRED}, {METRICS}, {SUMMARY}, c AS (SELECT split, task, 'pearson' AS metric, printf('%.3f ± %.3f', round(pearson_mean,3)+0.0, pearson_std) AS cell FROM sm UNION ALL SELECT split, task, 'spearman', printf('%.3f ± %.3f', round(spearman_mean,3)+0.0, spearman_std) FROM sm)
 SELECT split, metric, max(cell) FILTER (task = 'q') AS q, max(cell) FILTER (task = 't') AS t, max(cell) FILTER (task = '__mean_auc__') AS __mean_auc__ FROM c GROUP BY 1,2""",
)
def t15(spark, sf):
    return statistics.metric_table(_summary(spark, sf), ["split"], ["q", "t", statistics.MEAN_TASK])


@query(
    "t14_average_predictions",
    f"""WITH {LAB}, {PRED}, a AS (SELECT entity, task, avg(y_true) AS y_true, avg(y_pred) AS y_pred FROM pred GROUP BY 1,2)
 SELECT task, count(*) AS n, round(corr(y_pred, y_true),6)+0.0 AS pearson FROM a GROUP BY 1""",
)
def t14(spark, sf):
    avg = statistics.average_predictions(fx_pred(spark, sf))
    return avg.groupBy("task").agg(F.count(F.lit(1)).alias("n"), r(safe_pearson("y_pred", "y_true")).alias("pearson"))


@query(
    "g21_baseline_rows",
    f"""WITH {VN}, {DIST}, lab AS (SELECT DISTINCT entity, grp, branch FROM v), o AS (SELECT entity_j AS entity, d FROM d WHERE entity_i = 0),
 k AS (SELECT o.*, branch FROM o JOIN lab USING (entity) WHERE entity NOT IN (3, 11, 250, 499))
 SELECT branch, count(*) AS n, round(avg(d),6)+0.0 AS d_mean, round(median(d),6)+0.0 AS d_median FROM k GROUP BY 1""",
)
def g21(spark, sf):
    from respmosaic.operators.joins import anti_members

    v = fx_vn(spark, sf)
    vd = matrix.fit_matrix(v.select("entity", "item", "value")).values
    listed = spark.createDataFrame([(0,), (3,), (11,), (250,), (499,)], "entity long")
    others = anti_members(matrix.distance_to_anchor(vd, 0), listed)
    others = others.join(entity_labels(v, "branch").withColumnRenamed("label", "branch"), "entity")
    return rounded(statistics.baseline_rows(others, ["d"], ["branch"]), "d_mean", "d_median")


COS = """{out} AS (SELECT b.entity, sum(a.value * b.value) / nullif(sqrt(sum(a.value * a.value) FILTER (b.value IS NOT NULL)) * sqrt(sum(b.value * b.value) FILTER (a.value IS NOT NULL)), 0) AS {out}
 FROM {src} a JOIN {src} b USING (item) WHERE a.entity = 0 GROUP BY 1)"""


@query(
    "g21_baseline_cosines",
    f"""WITH {VN}, {FIT}, lab AS (SELECT DISTINCT entity, branch FROM v), {COS.format(src='vn', out='cos_v')}, {COS.format(src='vd', out='cos_vd')},
 k AS (SELECT * FROM cos_v JOIN cos_vd USING (entity) JOIN lab USING (entity) WHERE entity NOT IN (0, 3, 11, 250, 499))
 SELECT branch, count(*) AS n, round(avg(cos_v),6)+0.0 AS cos_v_mean, round(median(cos_v),6)+0.0 AS cos_v_median, round(avg(cos_vd),6)+0.0 AS cos_vd_mean, round(median(cos_vd),6)+0.0 AS cos_vd_median FROM k GROUP BY 1""",
)
def g21_cosines(spark, sf):
    """Cosines to the anchor on raw and centred values, over the entities that are not listed."""
    from respmosaic.operators.joins import anti_members

    v = fx_vn(spark, sf)
    cells = v.select("entity", "item", "value")
    listed = spark.createDataFrame([(0,), (3,), (11,), (250,), (499,)], "entity long")
    raw = matrix.cosine_to_anchor(cells, 0).withColumnRenamed("cosine", "cos_v")
    centred = matrix.cosine_to_anchor(matrix.fit_matrix(cells).values, 0).withColumnRenamed("cosine", "cos_vd")
    others = anti_members(raw.join(centred, "entity"), listed).join(entity_labels(v, "branch").withColumnRenamed("label", "branch"), "entity")
    return rounded(statistics.baseline_rows(others, ["cos_v", "cos_vd"], ["branch"]), "cos_v_mean", "cos_v_median", "cos_vd_mean", "cos_vd_median")


@query(
    "j7_anti_members",
    f"WITH {V} SELECT DISTINCT entity, branch FROM v WHERE entity NOT IN (0, 3, 11, 250, 499) AND branch = 0",
)
def j7(spark, sf):
    from respmosaic.operators.joins import anti_members

    listed = spark.createDataFrame([(0,), (3,), (11,), (250,), (499,)], "entity long")
    return anti_members(fx_v(spark, sf).filter("branch = 0"), listed).select("entity", "branch").distinct()


@query(
    "w1_rank_items",
    f"""WITH {VN}, iv AS (SELECT item, CASE WHEN count(value) >= 2 THEN var_samp(value) END AS variance FROM vn GROUP BY 1)
 SELECT item, round(variance,6)+0.0 AS variance, row_number() OVER (ORDER BY variance DESC NULLS LAST, item) AS rank FROM iv""",
)
def w1(spark, sf):
    return rounded(statistics.rank_items(statistics.item_variance(fx_vn(spark, sf))).select("item", "variance", "rank"), "variance")


@query(
    "w1_rank_orders",
    """SELECT o_orderkey AS item, round(o_totalprice,6)+0.0 AS variance, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders""",
)
def w1_orders(spark, sf):
    from respmosaic.catalog.base import table

    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("variance"))
    return rounded(statistics.rank_items(orders), "variance")


@query(
    "w2_hardest_overlap",
    f"""WITH {V}, m AS (SELECT branch, item, avg(value) AS mean FROM v GROUP BY 1,2), z AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY mean, item) AS rk FROM m),
 ks AS (SELECT unnest([10,50,100]) AS k), h AS (SELECT k, item, bool_or(branch=0) AS a, bool_or(branch=1) AS b FROM z JOIN ks ON rk <= k GROUP BY 1,2)
 SELECT k, count(*) FILTER (a AND b) AS n_both, count(*) AS n_any, round(count(*) FILTER (a AND b)/count(*)::DOUBLE,6)+0.0 AS jaccard FROM h GROUP BY 1""",
)
def w2(spark, sf):
    v = fx_v(spark, sf)
    return rounded(statistics.hardest_overlap(v.filter("branch = 0"), v.filter("branch = 1")), "jaccard")


@query("w3_average_rank", f"WITH {LAB} SELECT item, length, {rank_sql('', 'length')} AS rank FROM lab")
def w3(spark, sf):
    return average_rank(fx_lab(spark, sf).select("item", "length"), "length").select("item", "length", "rank")


@query("w3_average_rank_lines", f"SELECT l_orderkey, l_linenumber, l_quantity, {rank_sql('', 'l_quantity')} AS rank FROM lineitem")
def w3_lines(spark, sf):
    from respmosaic.catalog.base import table

    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return average_rank(lines, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "rank")


@query(
    "t1_cross_branch_spearman",
    f"""WITH {V}, m AS (SELECT item, avg(value) FILTER (branch=0) AS a, avg(value) FILTER (branch=1) AS b FROM v GROUP BY 1),
 k AS (SELECT {rank_sql('', 'a')} AS ra, {rank_sql('', 'b')} AS rb FROM m) SELECT count(*) AS n, round(corr(ra, rb),6)+0.0 AS spearman FROM k""",
)
def t1(spark, sf):
    return rounded(statistics.cross_branch_spearman(fx_v(spark, sf), "branch", 0, 1), "spearman")


@query(
    "t2_safe_correlations",
    f"""WITH {LAB}, k AS (SELECT stratum, gc, quality, {rank_sql('stratum', 'gc')} AS ra, {rank_sql('stratum', 'quality')} AS rb FROM lab)
 SELECT stratum, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(gc) > 0 AND stddev_pop(quality) > 0 THEN round(corr(gc, quality),6)+0.0 END AS pearson,
 CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb),6)+0.0 END AS spearman FROM k GROUP BY 1""",
)
def t2(spark, sf):
    lab = fx_lab(spark, sf)
    p = lab.groupBy("stratum").agg(r(safe_pearson("gc", "quality")).alias("pearson"))
    return rounded(spearman(lab, "gc", "quality", ["stratum"]), "spearman").join(p, "stratum")


HALVES = """sd AS (SELECT unnest([1,2]) AS seed), hr AS (SELECT seed, item, stratum, row_number() OVER (PARTITION BY seed, stratum ORDER BY md5('half|' || seed || '|' || item), item) AS rk,
 count(*) OVER (PARTITION BY seed, stratum) // 2 AS h FROM panel CROSS JOIN sd), halves AS (SELECT seed, item, stratum, CASE WHEN rk <= h THEN 'a' ELSE 'b' END AS half FROM hr WHERE rk <= 2*h)"""


@query("t3_stratified_halves", f"WITH {V}, {PANEL}, {HALVES} SELECT * FROM halves")
def t3(spark, sf):
    return splits.stratified_halves(_panel(spark, sf), [1, 2])


@query(
    "t3_stratified_halves_documents",
    """WITH panel AS (SELECT doc_id AS item, lang AS stratum FROM documents), """ + HALVES + " SELECT * FROM halves",
)
def t3_docs(spark, sf):
    from respmosaic.catalog.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("stratum"))
    return splits.stratified_halves(docs, [1, 2])


@query(
    "t4_disjoint_halves",
    """WITH RECURSIVE sd AS (SELECT unnest([1,2,3]) AS seed), st AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY 1),
 o AS (SELECT seed, stratum, n, row_number() OVER (PARTITION BY seed ORDER BY md5('strata|' || seed || '|' || stratum), stratum) AS k FROM st CROSS JOIN sd),
 f AS (SELECT seed, 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, '' AS stratum, '' AS half FROM sd
  UNION ALL SELECT f.seed, o.k, CASE WHEN f.a <= f.b THEN f.a + o.n ELSE f.a END, CASE WHEN f.a <= f.b THEN f.b ELSE f.b + o.n END, o.stratum, CASE WHEN f.a <= f.b THEN 'a' ELSE 'b' END FROM f JOIN o ON o.seed = f.seed AND o.k = f.k + 1)
 SELECT f.seed, d.doc_id AS item, f.stratum, f.half FROM f JOIN documents d ON d.source = f.stratum""",
)
def t4(spark, sf):
    from respmosaic.catalog.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("stratum"))
    return splits.disjoint_halves(docs, [1, 2, 3])


SPLIT = f"""hv AS (SELECT seed, half, entity, item, value FROM vn JOIN halves USING (item)), {fit_sql('hv', 'vd', ('seed', 'half'))}, {dist_sql('vd', 'd', ('seed', 'half'))},
 pr AS (SELECT seed, entity_i, entity_j, max(d) FILTER (half='a') AS x, max(d) FILTER (half='b') AS y FROM d GROUP BY 1,2,3),
 sp AS (SELECT seed, count(*) AS n_pairs, corr(x,y) AS pearson, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)"""


@query("t5_split_half", f"WITH {VN}, {PANEL}, {HALVES}, {SPLIT} SELECT seed, n_pairs, round(pearson,6)+0.0 AS pearson, round(slope,6)+0.0 AS slope, round(intercept,6)+0.0 AS intercept FROM sp")
def t5(spark, sf):
    v = fx_vn(spark, sf).select("entity", "item", "value")
    return rounded(splits.split_half(v, splits.stratified_halves(_panel(spark, sf), [1, 2])), "pearson", "slope", "intercept")


@query(
    "t5_split_half_summary",
    f"WITH {VN}, {PANEL}, {HALVES}, {SPLIT} SELECT count(*) AS n_seeds, round(avg(pearson),6)+0.0 AS mean, round(stddev_pop(pearson),6)+0.0 AS std, round(min(pearson),6)+0.0 AS min, round(max(pearson),6)+0.0 AS max FROM sp",
)
def t5_summary(spark, sf):
    v = fx_vn(spark, sf).select("entity", "item", "value")
    per_seed = splits.split_half(v, splits.stratified_halves(_panel(spark, sf), [1, 2]))
    return rounded(splits.split_half_summary(per_seed), "mean", "std", "min", "max")


@query(
    "t5_split_half_big",
    f"""WITH {BIG}, panel AS (SELECT DISTINCT item, item % 4 AS stratum FROM big), {HALVES}, vn AS (SELECT * FROM big), {SPLIT}
 SELECT seed, n_pairs, round(pearson,6)+0.0 AS pearson, round(slope,6)+0.0 AS slope, round(intercept,6)+0.0 AS intercept FROM sp""",
)
def t5_big(spark, sf):
    v = fx_big(spark, sf)
    panel = v.select("item").distinct().withColumn("stratum", F.col("item") % 4)
    return rounded(splits.split_half(v, splits.stratified_halves(panel, [1, 2])), "pearson", "slope", "intercept")


@query(
    "t5_split_half_raw",
    f"""WITH {VN}, {PANEL}, {HALVES}, hv AS (SELECT seed, half, entity, item, value FROM vn JOIN halves USING (item)), {dist_sql('hv', 'd', ('seed', 'half'))},
 pr AS (SELECT seed, entity_i, entity_j, max(d) FILTER (half='a') AS x, max(d) FILTER (half='b') AS y FROM d GROUP BY 1,2,3)
 SELECT seed, count(*) AS n_pairs, round(corr(x,y),6)+0.0 AS pearson, round(regr_slope(y,x),6)+0.0 AS slope, round(regr_intercept(y,x),6)+0.0 AS intercept FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1""",
)
def t5_raw(spark, sf):
    """Halves compared on the values as they are, without clipping and centring."""
    v = fx_vn(spark, sf).select("entity", "item", "value")
    return rounded(splits.split_half(v, splits.stratified_halves(_panel(spark, sf), [1, 2]), pipeline=False), "pearson", "slope", "intercept")


SIDES = "pa AS (SELECT entity, item, value FROM vn), pb AS (SELECT entity, item, value + 0.01 * ((entity*7+item*5)%11) AS value FROM v)"


def _sides(spark, sf):
    a = fx_vn(spark, sf).select("entity", "item", "value")
    b = fx_v(spark, sf).select("entity", "item", (F.col("value") + 0.01 * ((F.col("entity") * 7 + F.col("item") * 5) % 11)).alias("value"))
    return a, b


@query(
    "j1_pair_scores",
    f"WITH {VN}, {SIDES} SELECT pa.entity, pa.item, round(pa.value,6)+0.0 AS value_a, round(pb.value,6)+0.0 AS value_b FROM pa JOIN pb USING (entity, item) WHERE pa.item % 4 < 3 AND pa.value IS NOT NULL",
)
def j1(spark, sf):
    a, b = _sides(spark, sf)
    return rounded(statistics.pair_scores(a, b, _panel(spark, sf).filter("stratum < 3")), "value_a", "value_b")


PAIRED = f"""pp AS (SELECT entity, item, pa.value AS a, pb.value AS b FROM pa JOIN pb USING (entity, item) WHERE pa.value IS NOT NULL),
 k AS (SELECT *, {rank_sql('entity', 'a')} AS ra, {rank_sql('entity', 'b')} AS rb FROM pp),
 pc AS (SELECT entity, count(*) AS n, corr(a,b) AS pearson, avg(a) AS mean_a, avg(b) AS mean_b, corr(ra,rb) AS spearman FROM k GROUP BY 1 HAVING count(*) >= 50)"""


@query(
    "t6_paired_correlation",
    f"WITH {VN}, {SIDES}, {PAIRED} SELECT entity, n, round(pearson,6)+0.0 AS pearson, round(mean_a,6)+0.0 AS mean_a, round(mean_b,6)+0.0 AS mean_b, round(spearman,6)+0.0 AS spearman FROM pc",
)
def t6(spark, sf):
    return rounded(statistics.paired_correlation(statistics.pair_scores(*_sides(spark, sf)), 50), "pearson", "mean_a", "mean_b", "spearman")


@query(
    "t6_correlation_summary",
    f"""WITH {VN}, {SIDES}, {PAIRED} SELECT count(pearson) AS n, round(avg(pearson),6)+0.0 AS mean, round(stddev_samp(pearson),6)+0.0 AS std, round(min(pearson),6)+0.0 AS min, round(max(pearson),6)+0.0 AS max,
 round(quantile_cont(pearson,0.05),6)+0.0 AS q05, round(median(pearson),6)+0.0 AS median, round(quantile_cont(pearson,0.95),6)+0.0 AS q95 FROM pc""",
)
def t6_summary(spark, sf):
    per_entity = statistics.paired_correlation(statistics.pair_scores(*_sides(spark, sf)), 50)
    return rounded(statistics.correlation_summary(per_entity), "mean", "std", "min", "max", "q05", "median", "q95")


@query(
    "t7_mantel_two_tables",
    f"""WITH {VN}, {SIDES}, sd AS (SELECT entity, item, value, 'a' AS side FROM pa WHERE (entity, item) IN (SELECT (entity, item) FROM pb) UNION ALL SELECT entity, item, value, 'b' FROM pb),
 {fit_sql('sd', 'vd', ('side',))}, {dist_sql('vd', 'd', ('side',))}, pr AS (SELECT entity_i, entity_j, max(d) FILTER (side='a') AS x, max(d) FILTER (side='b') AS y FROM d GROUP BY 1,2)
 SELECT count(*) AS n_pairs, round(corr(x,y),6)+0.0 AS pearson, round(regr_slope(y,x),6)+0.0 AS slope, round(regr_intercept(y,x),6)+0.0 AS intercept FROM pr""",
)
def t7(spark, sf):
    return rounded(statistics.mantel_two_tables(*_sides(spark, sf)), "pearson", "slope", "intercept")


@query(
    "t8_geometry_preserved",
    f"""WITH {VN}, {fit_sql('vn', 'b', ('branch',))}, {dist_sql('b', 'db', ('branch',))}, {fit_sql('vn', 'w')}, jw AS (SELECT w.*, l.branch FROM w JOIN (SELECT DISTINCT entity, branch FROM v) l USING (entity)), {dist_sql('jw', 'dj', ('branch',))},
 p AS (SELECT branch, entity_i, entity_j, db.d AS own, dj.d AS joint FROM db JOIN dj USING (branch, entity_i, entity_j)),
 k AS (SELECT *, {rank_sql('branch', 'own')} AS ra, {rank_sql('branch', 'joint')} AS rb FROM p)
 SELECT branch, count(*) AS n_pairs, round(corr(own,joint),6)+0.0 AS pearson, round(avg(joint)/avg(own),6)+0.0 AS mean_ratio, round(corr(ra,rb),6)+0.0 AS spearman, round(median(joint)/median(own),6)+0.0 AS median_ratio, corr(own,joint) > 0.9 AND corr(ra,rb) > 0.9 AS passed FROM k GROUP BY 1""",
)
def t8(spark, sf):
    v = fx_vn(spark, sf).select("entity", "item", "value", "branch")
    return rounded(statistics.geometry_preserved(v), "pearson", "mean_ratio", "spearman", "median_ratio")


@query(
    "t9_proportional_subset",
    """WITH d AS (SELECT doc_id AS item, source AS stratum, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS t FROM documents)
 SELECT item, stratum FROM d WHERE rk <= round_even(100.0::DOUBLE * n / t, 0)""",
)
def t9(spark, sf):
    from respmosaic.catalog.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("stratum"))
    return splits.proportional_subset(docs, 100, 5)


@query(
    "t9_subset_manifest",
    """WITH c AS (SELECT source AS stratum, count(*) AS full_count FROM documents GROUP BY 1), t AS (SELECT *, round_even(100.0::DOUBLE * full_count / (SELECT count(*) FROM documents), 0)::BIGINT AS subset_count FROM c)
 SELECT stratum, full_count, subset_count, round(full_count / (SELECT sum(full_count) FROM t)::DOUBLE, 4) AS fraction_full, round(subset_count / (SELECT sum(subset_count) FROM t)::DOUBLE, 4) AS fraction_subset FROM t""",
)
def t9_manifest(spark, sf):
    from respmosaic.catalog.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("stratum"))
    return splits.subset_manifest(docs, 100)


@query("t10_kfold", "SELECT doc_id AS item, (ntile(5) OVER (ORDER BY md5('11|' || doc_id), doc_id) - 1)::INT AS fold FROM documents")
def t10(spark, sf):
    from respmosaic.catalog.base import table

    return splits.kfold(table(spark, sf, "documents").select(F.col("doc_id").alias("item")), "item", 5, 11)


@query(
    "t11_group_kfold",
    """WITH RECURSIVE g AS (SELECT source AS grp, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, md5('3|' || grp), grp) AS k FROM g),
 f AS (SELECT 0::BIGINT AS k, [0::BIGINT,0::BIGINT,0::BIGINT] AS loads, '' AS grp, -1 AS fold
  UNION ALL SELECT o.k, list_transform(list_zip(f.loads, [1,2,3]), lambda z: CASE WHEN z[2] = list_position(f.loads, list_min(f.loads)) THEN z[1] + o.n ELSE z[1] END), o.grp, list_position(f.loads, list_min(f.loads)) - 1 FROM f JOIN o ON o.k = f.k + 1)
 SELECT d.doc_id AS item, f.grp AS dataset, f.fold::INT AS fold FROM f JOIN documents d ON d.source = f.grp""",
)
def t11(spark, sf):
    from respmosaic.catalog.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("dataset"))
    return splits.group_kfold(docs, "item", "dataset", 3, 3)


@query("t12_stratified_kfold", f"WITH {LAB} SELECT item, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('2|' || item), item) - 1) % 5)::INT AS fold FROM lab")
def t12(spark, sf):
    return splits.stratified_kfold(fx_lab(spark, sf), "item", "quality", 5, 2).select("item", "quality", "fold")


@query("t12_leave_one_out", f"WITH {LAB} SELECT item, item AS fold FROM lab")
def t12_loo(spark, sf):
    return splits.leave_one_out(fx_lab(spark, sf), "item")


AUC_SQL = """(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"""


@query(
    "t16_roc_auc",
    f"""WITH {LAB}, k AS (SELECT stratum, quality::DOUBLE AS y, {rank_sql('stratum', 'gc')} AS rk FROM lab)
 SELECT stratum, count(*) AS n, sum(y)::BIGINT AS n_pos, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round({AUC_SQL},6)+0.0 END AS auc FROM k GROUP BY 1""",
)
def t16(spark, sf):
    return rounded(statistics.roc_auc(fx_lab(spark, sf), "gc", "quality", ["stratum"]), "auc")


@query(
    "t16_item_separation",
    f"""WITH {V}, k AS (SELECT item, branch::DOUBLE AS y, {rank_sql('item', 'value')} AS rk FROM v), a AS (SELECT item, count(*) AS n, sum(y)::BIGINT AS n_pos, {AUC_SQL} AS auc FROM k GROUP BY 1)
 SELECT item, n, n_pos, round(auc,6)+0.0 AS auc, round(greatest(auc, 1-auc),6)+0.0 AS separation FROM a""",
)
def t16_item(spark, sf):
    out = statistics.separation(statistics.roc_auc(fx_v(spark, sf), "value", "branch", ["item"]))
    return rounded(out, "auc", "separation")


@query(
    "t16_ovr_weighted_auc",
    f"""WITH {V}, c AS (SELECT DISTINCT grp AS cls FROM v), m AS (SELECT entity, grp AS label, item % 10 AS cls, avg(value) AS score FROM v GROUP BY 1,2,3),
 k AS (SELECT cls, (label = cls)::INT::DOUBLE AS y, {rank_sql('cls', 'score')} AS rk FROM m), a AS (SELECT cls, sum(y) AS p, {AUC_SQL} AS auc FROM k GROUP BY 1) SELECT round(sum(auc*p)/sum(p),6)+0.0 AS auc FROM a""",
)
def t16_ovr(spark, sf):
    scores = fx_v(spark, sf).groupBy(F.col("entity").alias("row"), F.col("grp").alias("label"), (F.col("item") % 10).alias("class")).agg(F.avg("value").alias("score"))
    return rounded(statistics.ovr_weighted_auc(scores), "auc")


@query(
    "t18_auc_join",
    f"""WITH {ITEMS}, {AUC} SELECT entity, round(max(auc) FILTER (task='en'),6)+0.0 AS en, round(max(auc) FILTER (task='fr'),6)+0.0 AS fr, round(max(auc) FILTER (task='de'),6)+0.0 AS de, round(avg(auc) FILTER (task IN ('en','fr','de')),6)+0.0 AS mean_auc FROM auc GROUP BY 1""",
)
def t18(spark, sf):
    auc = fx_auc(spark, sf)
    return rounded(statistics.auc_join(auc.select("entity").distinct(), auc, ["en", "fr", "de"]), "en", "fr", "de", "mean_auc")
