"""Matrix, distance and factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from respmosaic.catalog.base import BIG, V, VN, cell_missing, dist_sql, entity_labels, fit_sql, fx_big, fx_v, fx_vn, query, r, rounded, table
from respmosaic.operators import distance, factor, matrix, pairs, statistics

FIT = fit_sql("vn", "vd")
DIST = FIT + ", " + dist_sql("vd", "d")


def _vd(spark, sf):
    return matrix.fit_matrix(fx_vn(spark, sf).select("entity", "item", "value")).values


def _d(spark, sf):
    return distance.pairwise_sq_distance(_vd(spark, sf))


@query("m1_response_matrix", f"WITH {VN} SELECT entity, item, round(value,6)+0.0 AS value FROM vn")
def m1(spark, sf):
    v = fx_v(spark, sf)
    grid, _ = matrix.response_matrix(v.filter(~cell_missing()), v.select("entity"), v.select("item"))
    return rounded(grid, "value")


@query(
    "m1_scored_missing_partial",
    f"""WITH {V}, p AS (SELECT * FROM v WHERE (entity*31+item*17)%23 <> 0 AND entity % 7 <> 0),
 c AS (SELECT e.entity, count(p.item) AS n FROM (SELECT DISTINCT entity FROM v) e LEFT JOIN p USING (entity) GROUP BY 1)
 SELECT CASE WHEN n = 0 THEN 'missing' WHEN n < (SELECT count(DISTINCT item) FROM v) THEN 'row count' ELSE '' END AS reason, count(*) AS n_entities FROM c GROUP BY 1""",
)
def m1_status(spark, sf):
    v = fx_v(spark, sf)
    _, status = matrix.response_matrix(v.filter(~cell_missing() & (F.col("entity") % 7 != 0)), v.select("entity"), v.select("item"))
    return status.groupBy("reason").agg(F.count(F.lit(1)).alias("n_entities"))


@query("m2_clip_lower", f"WITH {VN}, {FIT} SELECT entity, item, round(value,6)+0.0 AS value FROM vd_c")
def m2(spark, sf):
    clipped, _ = matrix.clip_lower(fx_vn(spark, sf).select("entity", "item", "value"))
    return rounded(clipped, "value")


@query("m2_clip_threshold_big", f"WITH {BIG} SELECT round(quantile_cont(value, 0.02),6)+0.0 AS threshold FROM big")
def m2_big(spark, sf):
    return rounded(matrix.clip_threshold(fx_big(spark, sf)), "threshold")


@query("m3_double_center", f"WITH {VN}, {fit_sql('vn', 'vd', clip=None)} SELECT entity, item, round(value,6)+0.0 AS value FROM vd")
def m3(spark, sf):
    return rounded(matrix.double_center(fx_vn(spark, sf).select("entity", "item", "value")).values, "value")


@query("m4_pairwise_sq_distance", f"WITH {VN}, {DIST} SELECT entity_i, entity_j, round(d,6)+0.0 AS d FROM d")
def m4(spark, sf):
    return rounded(_d(spark, sf), "d")


@query("m4_pairwise_sq_distance_big", f"WITH {BIG}, {fit_sql('big', 'vd')}, {dist_sql('vd', 'd')} SELECT entity_i, entity_j, round(d,6)+0.0 AS d FROM d")
def m4_big(spark, sf):
    return rounded(distance.pairwise_sq_distance(matrix.fit_matrix(fx_big(spark, sf)).values), "d")


@query(
    "m5_fit_matrix",
    f"""WITH {VN}, {FIT}
 SELECT 'threshold' AS kind, CAST(NULL AS BIGINT) AS key, round(threshold,6)+0.0 AS value FROM vd_t
 UNION ALL SELECT 'row_mean', entity, round(row_mean,6)+0.0 FROM vd_r
 UNION ALL SELECT 'col_mean', item, round(col_mean,6)+0.0 FROM vd_m
 UNION ALL SELECT 'grand_mean', NULL, round(avg(value),6)+0.0 FROM vd_c""",
)
def m5(spark, sf):
    fit = matrix.fit_matrix(fx_vn(spark, sf).select("entity", "item", "value"))
    part = lambda df, kind, key, c: df.select(F.lit(kind).alias("kind"), key.cast("long").alias("key"), r(c).alias("value"))
    none = F.lit(None)
    return (
        part(fit.thresholds, "threshold", none, "threshold")
        .unionByName(part(fit.row_means, "row_mean", F.col("entity"), "row_mean"))
        .unionByName(part(fit.col_means, "col_mean", F.col("item"), "col_mean"))
        .unionByName(part(fit.grand_mean, "grand_mean", none, "grand_mean"))
    )


@query(
    "m6_project",
    f"""WITH {VN}, old AS (SELECT * FROM vn WHERE entity % 10 <> 0), {fit_sql('old', 'vd')},
 n AS (SELECT entity, item, CASE WHEN value IS NOT NULL THEN greatest(value, threshold) END AS value FROM vn CROSS JOIN vd_t WHERE entity % 10 = 0),
 o AS (SELECT entity, avg(value) AS own FROM n GROUP BY 1)
 SELECT entity, item, round(value - own - col_mean,6)+0.0 AS value FROM n JOIN o USING (entity) JOIN vd_m USING (item)""",
)
def m6(spark, sf):
    v = fx_vn(spark, sf).select("entity", "item", "value")
    fit = matrix.fit_matrix(v.filter("entity % 10 <> 0"))
    return rounded(matrix.project(v.filter("entity % 10 = 0"), fit.thresholds, fit.col_means), "value")


@query(
    "m7_combined_matrix",
    f"""WITH {V}, {fit_sql('v', 'vd')}, f AS (SELECT DISTINCT entity, CASE WHEN grp = 0 THEN 'fam1' ELSE 'fam' || grp END AS family FROM v)
 SELECT family, count(DISTINCT entity) AS n_entities, round(sum(value*value),6)+0.0 AS ss FROM vd JOIN f USING (entity) GROUP BY 1""",
)
def m7(spark, sf):
    v = fx_v(spark, sf)
    dim = v.groupBy("entity").agg(F.first("branch").alias("branch"), F.concat(F.lit("fam"), F.first("grp").cast("string")).alias("family"))
    cells, folded = matrix.combined_matrix(v.select("entity", "item", "value"), dim, v.select("item").distinct(), {"fam0": "fam1"})
    vd = matrix.fit_matrix(cells).values.join(folded.select("entity", "family"), "entity")
    return vd.groupBy("family").agg(F.count_distinct("entity").alias("n_entities"), r(F.sum(F.col("value") * F.col("value"))).alias("ss"))


@query("m8_branch_matrices", f"WITH {VN}, {fit_sql('vn', 'vd', ('branch',))} SELECT branch, entity, item, round(value,6)+0.0 AS value FROM vd")
def m8(spark, sf):
    fit = matrix.branch_matrices(fx_vn(spark, sf).select("branch", "entity", "item", "value"))
    return rounded(fit.values.select("branch", "entity", "item", "value"), "value")


COSINE = """SELECT b.entity, sum(a.value*b.value)/nullif(sqrt(sum(a.value*a.value))*sqrt(sum(b.value*b.value)),0) AS cosine
 FROM {t} b JOIN {t} a ON a.item = b.item AND a.entity = {anchor} WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1"""


@query("m9_cosine_similarity", f"WITH {VN}, c AS ({COSINE.format(t='vn', anchor=0)}) SELECT entity, round(cosine,6)+0.0 AS cosine FROM c")
def m9(spark, sf):
    return rounded(matrix.cosine_to_anchor(fx_vn(spark, sf), 0), "cosine")


PARTNERS = [(3, "derived", 0), (11, "derived", 1), (250, "unrelated", 2), (499, "unrelated", 3)]
PARTNER_SQL = "p(entity, label, position) AS (VALUES " + ", ".join(f"({e}::BIGINT, '{lab}', {i})" for e, lab, i in PARTNERS) + ")"


@query(
    "m10_anchor_metrics",
    f"""WITH {VN}, {DIST}, {PARTNER_SQL}, c AS ({COSINE.format(t='vn', anchor=0)}), cd AS ({COSINE.format(t='vd', anchor=0)})
 SELECT p.entity, p.label, p.position, round(d.d,6)+0.0 AS d, round(c.cosine,6)+0.0 AS cos_v, round(cd.cosine,6)+0.0 AS cos_vd
 FROM p JOIN d ON d.entity_i = 0 AND d.entity_j = p.entity JOIN c ON c.entity = p.entity JOIN cd ON cd.entity = p.entity""",
)
def m10(spark, sf):
    partners = spark.createDataFrame(PARTNERS, "partner long, label string, position int")
    out = matrix.anchor_metrics(fx_vn(spark, sf).select("entity", "item", "value"), _vd(spark, sf), 0, partners)
    return rounded(out, "d", "cos_v", "cos_vd")


@query(
    "m11_anchor_difference",
    f"""WITH {V}, {PARTNER_SQL} SELECT 0::BIGINT AS anchor, p.entity AS partner, b.item, round(b.value - a.value,6)+0.0 AS diff
 FROM p JOIN v b ON b.entity = p.entity JOIN v a ON a.entity = 0 AND a.item = b.item""",
)
def m11(spark, sf):
    pairs = spark.createDataFrame([(0, e) for e, _, _ in PARTNERS], "anchor long, partner long")
    return rounded(matrix.anchor_difference(fx_v(spark, sf), pairs).select("anchor", "partner", "item", "diff"), "diff")


KNN = """sym AS (SELECT entity_i AS entity, entity_j AS other, d FROM {d} UNION ALL SELECT entity_j, entity_i, d FROM {d}),
 near AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, other) AS rank FROM sym)"""


@query("m12_nearest_neighbours", f"WITH {VN}, {DIST}, {KNN.format(d='d')} SELECT entity, other, rank, round(d,6)+0.0 AS d FROM near WHERE rank <= 5")
def m12_near(spark, sf):
    return rounded(distance.nearest_entities(_vd(spark, sf), 5).select("entity", "other", F.col("rank").cast("long").alias("rank"), "d"), "d")


def knn_share_sql(labels: str) -> str:
    return f"""ks AS (SELECT unnest([5,10]) AS k),
 o AS (SELECT k, entity, sum((a.label = b.label)::INT)/k::DOUBLE AS s FROM near JOIN {labels} a USING (entity) JOIN {labels} b ON b.entity = near.other CROSS JOIN ks WHERE rank <= k GROUP BY 1,2),
 n AS (SELECT label, count(*) AS n FROM {labels} GROUP BY 1),
 e AS (SELECT sum(n*(n-1))::DOUBLE/(sum(n)*(sum(n)-1)) AS expected FROM n),
 share AS (SELECT k, avg(s) AS observed, any_value(expected) AS expected FROM o CROSS JOIN e GROUP BY 1)"""


@query(
    "m12_knn_same_group",
    f"""WITH {VN}, {DIST}, {KNN.format(d='d')}, lab AS (SELECT DISTINCT entity, grp AS label FROM v), {knn_share_sql('lab')}
 SELECT k, round(observed,6)+0.0 AS observed, round(expected,6)+0.0 AS expected, round(observed-expected,6)+0.0 AS excess, abs(observed-expected) <= 0.10 AS passed FROM share""",
)
def m12(spark, sf):
    labels = entity_labels(fx_v(spark, sf), "grp")
    return rounded(distance.nearest_same_group(_vd(spark, sf), labels), "observed", "expected", "excess")


OUTLIERS = [3, 17, 42]


@query(
    "m13_structure_sensitivity",
    f"""WITH {VN}, {DIST}, dd AS (SELECT * FROM d WHERE entity_i NOT IN (3,17,42) AND entity_j NOT IN (3,17,42)), {KNN.format(d='dd')},
 lab AS (SELECT DISTINCT entity, branch AS label FROM v WHERE entity NOT IN (3,17,42)), {knn_share_sql('lab')}
 SELECT k, round(observed,6)+0.0 AS observed, round(expected,6)+0.0 AS expected, round(observed-expected,6)+0.0 AS excess, abs(observed-expected) <= 0.10 AS passed FROM share""",
)
def m13(spark, sf):
    labels = entity_labels(fx_v(spark, sf), "branch")
    tables = pairs.structure_sensitivity(_vd(spark, sf), labels, OUTLIERS, parts=["knn"], kept=["without_outliers"])
    return rounded(tables["without_outliers_knn"], "observed", "expected", "excess")


CASES = """c AS (SELECT CASE WHEN a.label = b.label THEN 'within_' || a.label ELSE 'between' END AS "case", d
 FROM d JOIN lab a ON a.entity = entity_i JOIN lab b ON b.entity = entity_j)"""


@query(
    "g15_intra_inter_distance",
    f"""WITH {VN}, {DIST}, lab AS (SELECT DISTINCT entity, branch AS label FROM v), {CASES},
 t AS (SELECT "case", count(d) AS n_pairs, avg(d) AS mean_d, median(d) AS median_d FROM c GROUP BY 1)
 SELECT "case", n_pairs, round(mean_d,6)+0.0 AS mean_d, round(median_d,6)+0.0 AS median_d, round((SELECT mean_d FROM t WHERE "case" = 'between')/mean_d,6)+0.0 AS mean_ratio FROM t""",
)
def g15(spark, sf):
    labels = entity_labels(fx_v(spark, sf), "branch")
    return rounded(pairs.group_distances(_vd(spark, sf), labels), "mean_d", "median_d", "mean_ratio")


def case_table_sql(cases: str, out: str) -> str:
    return f"""{out} AS (SELECT "case", count(d) AS n_pairs, avg(d) AS mean_d, median(d) AS median_d FROM {cases} GROUP BY 1)"""


@query(
    "m13_distances",
    f"""WITH {VN}, {DIST}, lab AS (SELECT DISTINCT entity, branch AS label FROM v), {CASES},
 c2 AS (SELECT CASE WHEN a.label = b.label THEN 'within_' || a.label ELSE 'between' END AS "case", d FROM d JOIN lab a ON a.entity = entity_i JOIN lab b ON b.entity = entity_j
 WHERE entity_i NOT IN (3,17,42) AND entity_j NOT IN (3,17,42)), {case_table_sql('c', 't1')}, {case_table_sql('c2', 't2')},
 u AS (SELECT 'all' AS rows_kept, t1.*, (SELECT mean_d FROM t1 WHERE "case" = 'between') AS b FROM t1 UNION ALL SELECT 'without_outliers', t2.*, (SELECT mean_d FROM t2 WHERE "case" = 'between') FROM t2)
 SELECT rows_kept, "case", n_pairs, round(mean_d,6)+0.0 AS mean_d, round(median_d,6)+0.0 AS median_d, round(b/mean_d,6)+0.0 AS mean_ratio FROM u""",
)
def m13_distances(spark, sf):
    tables = pairs.structure_sensitivity(_vd(spark, sf), entity_labels(fx_v(spark, sf), "branch"), OUTLIERS, parts=["distance"])
    named = [tables[f"{n}_distance"].withColumn("rows_kept", F.lit(n)) for n in ("all", "without_outliers")]
    return rounded(named[0].unionByName(named[1]), "mean_d", "median_d", "mean_ratio")


@query(
    "m13_all_neighbours",
    f"""WITH {VN}, {DIST}, {KNN.format(d='d')}, lab AS (SELECT DISTINCT entity, branch AS label FROM v), {knn_share_sql('lab')}
 SELECT k, round(observed,6)+0.0 AS observed, round(expected,6)+0.0 AS expected, round(observed-expected,6)+0.0 AS excess, abs(observed-expected) <= 0.10 AS passed FROM share""",
)
def m13_all(spark, sf):
    tables = pairs.structure_sensitivity(_vd(spark, sf), entity_labels(fx_v(spark, sf), "branch"), OUTLIERS, parts=["knn"], kept=["all"])
    return rounded(tables["all_knn"], "observed", "expected", "excess")


@query(
    "m14_winsor_limits",
    f"""WITH {VN}, {FIT}, q AS (SELECT quantile_cont(value,0.02) AS lo, quantile_cont(value,0.98) AS hi FROM vd)
 SELECT round(lo,6)+0.0 AS lo, round(hi,6)+0.0 AS hi, round(greatest(abs(lo),abs(hi)),6)+0.0 AS "limit" FROM q""",
)
def m14(spark, sf):
    return rounded(matrix.winsor_limits(_vd(spark, sf)), "lo", "hi", "limit")


@query(
    "m15_block_order",
    """WITH e AS (SELECT vec_id AS entity, vec_id % 2 AS branch, label AS grp FROM embeddings),
 s AS (SELECT *, count(*) OVER (PARTITION BY branch, grp) AS size FROM e)
 SELECT entity, branch, grp, row_number() OVER (ORDER BY branch, size DESC, grp, entity) - 1 AS position FROM s""",
)
def m15(spark, sf):
    dim = fx_v(spark, sf).select("entity", "branch", "grp").distinct()
    placed, _ = matrix.block_order(dim, "branch", "grp", "entity")
    return placed.select("entity", "branch", "grp", "position")


@query(
    "m15_block_offsets",
    """WITH s AS (SELECT vec_id % 2 AS branch, label AS grp, count(*) AS size FROM embeddings GROUP BY 1,2)
 SELECT branch, grp, size, (sum(size) OVER (ORDER BY branch, size DESC, grp))::BIGINT AS block_end,
 (sum(size) OVER (ORDER BY branch, size DESC, grp))::BIGINT - size AS block_start FROM s""",
)
def m15_offsets(spark, sf):
    dim = fx_v(spark, sf).select("entity", "branch", "grp").distinct()
    _, blocks = matrix.block_order(dim, "branch", "grp", "entity")
    return blocks


ELEMENTS = """e AS (SELECT doc_id AS item, CASE lang WHEN 'en' THEN 'polyA' WHEN 'de' THEN 'promoter' WHEN 'fr' THEN 'virus_species' ELSE source END AS element,
 CASE lang WHEN 'en' THEN 'Plant' WHEN 'de' THEN 'Human' WHEN 'fr' THEN 'Virus' ELSE 'Other' END AS category, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 WHEN 'fr' THEN 3 ELSE 4 END AS k FROM documents)"""


def _elements(spark, sf):
    element = F.when(F.col("lang") == "en", "polyA").when(F.col("lang") == "de", "promoter").when(F.col("lang") == "fr", "virus_species").otherwise(F.col("source"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item"), element.alias("element"))


@query("m15_item_order", f"WITH {ELEMENTS} SELECT item, element, category, row_number() OVER (ORDER BY k, element, item) - 1 AS position FROM e")
def m15_items(spark, sf):
    return matrix.item_order(_elements(spark, sf))[0]


@query("m15_category_offsets", f"WITH {ELEMENTS} SELECT category, sum(n) OVER (ORDER BY k)::BIGINT - n AS block_start, sum(n) OVER (ORDER BY k)::BIGINT AS block_end FROM (SELECT category, k, count(*) AS n FROM e GROUP BY 1, 2)")
def m15_categories(spark, sf):
    return matrix.item_order(_elements(spark, sf))[1]


DIMS = list(range(64))


@query("m16_matrix_to_wide", "SELECT vec_id AS entity, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE,6)+0.0 AS item_{i}" for i in DIMS) + " FROM embeddings")
def m16(spark, sf):
    wide = matrix.matrix_to_wide(fx_v(spark, sf), DIMS)
    return rounded(wide, *[f"item_{i}" for i in DIMS])


@query("m16_wide_to_long", f"WITH {VN} SELECT entity, item, round(value,6)+0.0 AS value FROM vn")
def m16_long(spark, sf):
    wide = matrix.matrix_to_wide(fx_vn(spark, sf), DIMS)
    return rounded(matrix.wide_to_long(wide, DIMS), "value")


@query("m17_truncated_svd_spectrum")
def m17(spark, sf):
    return rounded(factor.pca_entities(fx_v(spark, sf).select("entity", "item", "value"), 5).spectrum, "sigma", "explained")


@query("m17_svd_scores")
def m17_scores(spark, sf):
    scores = factor.pca_entities(fx_v(spark, sf).select("entity", "item", "value"), 5).scores
    return scores.select("entity", "pc", r(F.abs("score")).alias("abs_score"))


@query("m18_pca_scores")
def m18(spark, sf):
    return rounded(factor.pca_scores(fx_v(spark, sf).select("entity", "item", "value"), 4, zscore=True).spectrum, "sigma", "explained")


@query("m18_pc_group_auc")
def m18_auc(spark, sf):
    v = fx_v(spark, sf)
    scores = factor.pca_scores(v.select("entity", "item", "value"), 8).scores
    out = factor.pc_group_auc(scores, entity_labels(v, "branch"))
    return out.select("pc", "n", "n_pos", r("separation").alias("separation"))


def moments_sql(cells: str) -> str:
    """Sums of the singular values' second and fourth powers, from the cells alone."""
    return f"""gram AS (SELECT a.item AS i, b.item AS j, sum(a.value * b.value) AS s FROM {cells} a JOIN {cells} b ON a.entity = b.entity GROUP BY 1, 2)
 SELECT round((SELECT sum(value * value) FROM {cells}), 6) + 0.0 AS second, round((SELECT sum(s * s) FROM gram), 4) + 0.0 AS fourth"""


def _moments(spectrum):
    out = spectrum.agg(F.sum(F.col("sigma") ** 2).alias("second"), F.sum(F.col("sigma") ** 4).alias("fourth"))
    return out.select(r("second").alias("second"), r("fourth", 4).alias("fourth"))


@query("m17_spectrum_moments", f"WITH {V}, {fit_sql('v', 'x', clip=None)}, {moments_sql('x')}")
def m17_moments(spark, sf):
    """All singular values of the double-centred matrix, against sums over its cells."""
    v = fx_v(spark, sf).select("entity", "item", "value")
    return _moments(factor.pca_entities(v, 64).spectrum)


@query(
    "m18_spectrum_moments",
    f"""WITH {V}, m AS (SELECT item, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY 1), z AS (SELECT entity, item, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM v JOIN m USING (item)),
 {moments_sql('z')}""",
)
def m18_moments(spark, sf):
    """All singular values of the z-scored matrix, against sums over its cells."""
    return _moments(factor.pca_scores(fx_v(spark, sf).select("entity", "item", "value"), 64, zscore=True).spectrum)


@query("m17_scores_by_entity", f"WITH {V}, {fit_sql('v', 'x', clip=None)} SELECT entity, round(sum(value * value), 6) + 0.0 AS squares FROM x GROUP BY 1")
def m17_by_entity(spark, sf):
    """Squares of all scores of an entity, whatever their signs, against its cells."""
    scores = factor.pca_entities(fx_v(spark, sf).select("entity", "item", "value"), 64).scores
    return rounded(scores.groupBy("entity").agg(F.sum(F.col("score") ** 2).alias("squares")), "squares")


@query(
    "m18_cells_from_factors",
    f"""WITH {V}, m AS (SELECT item, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY 1)
 SELECT entity, item, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS value FROM v JOIN m USING (item)""",
)
def m18_cells(spark, sf):
    """All scores times all loadings give the z-scored matrix back."""
    f = factor.pca_scores(fx_v(spark, sf).select("entity", "item", "value"), 64, zscore=True)
    cells = f.scores.join(f.loadings, "pc").groupBy("entity", "item").agg(F.sum(F.col("score") * F.col("loading")).alias("value"))
    return rounded(cells, "value")


@query(
    "m19_procrustes_residual",
    f"""WITH {V}, m AS (SELECT item, avg(value) AS m FROM v GROUP BY 1), c AS (SELECT value - m AS a, 2 * (value - m) AS b FROM v JOIN m USING (item))
 SELECT round(sqrt(sum((b - a) * (b - a))) / sqrt(sum(b * b)), 6) + 0.0 AS residual FROM c""",
)
def m19(spark, sf):
    v = fx_v(spark, sf)
    a = v.select(F.col("entity").alias("key"), F.col("item").alias("dim"), F.col("value").alias("x"))
    b = v.groupBy(F.col("entity").alias("key"), (63 - F.col("item")).alias("dim")).agg((F.first("value") * 2).alias("x"))
    return spark.createDataFrame([(round(factor.procrustes_residual(a, b), 6),)], "residual double")


@query(
    "m20_gc_axis",
    f"""WITH {V}, l AS (SELECT grp AS pc, item, avg(value) AS loading, ((item*7)%13)/13.0::DOUBLE AS attr FROM v GROUP BY 1,2),
 r AS (SELECT pc, coalesce(corr(loading, attr),0) AS r FROM l GROUP BY 1), d AS (SELECT *, abs(r) > 0.2 AS dominated FROM r)
 SELECT pc, round(r,6)+0.0 AS r, dominated, coalesce((SELECT min(pc) FROM d WHERE NOT dominated), -1) AS first_free FROM d""",
)
def m20(spark, sf):
    loadings = fx_v(spark, sf).groupBy(F.col("grp").alias("pc"), "item").agg(F.avg("value").alias("loading"))
    attrs = fx_v(spark, sf).select("item").distinct().select("item", (((F.col("item") * 7) % 13) / F.lit(13.0)).alias("attr"))
    return rounded(statistics.gc_axis(loadings, attrs, 0.2), "r")


@query(
    "x3_impute_item_mean",
    f"WITH {VN} SELECT entity, item, round(coalesce(value, avg(value) OVER (PARTITION BY item)),6)+0.0 AS value FROM vn",
)
def x3(spark, sf):
    return rounded(matrix.impute_item_mean(fx_vn(spark, sf).select("entity", "item", "value")), "value")


@query(
    "s12_describe_matrix",
    f"""WITH {VN} SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT item) AS n_items, count(*) FILTER (value IS NULL) AS n_null, round(quantile_cont(value,0.02),6)+0.0 AS threshold FROM vn""",
)
def s12(spark, sf):
    v = fx_vn(spark, sf)
    return rounded(matrix.describe_matrix(v).withColumn("threshold", matrix.clip_threshold(v).scalar()), "threshold")


@query(
    "j6_entity_pairs",
    f"""WITH {VN} SELECT a.entity AS entity_i, b.entity AS entity_j, count(a.value-b.value) AS n_common
 FROM vn a JOIN vn b ON a.item = b.item AND a.entity < b.entity GROUP BY 1,2""",
)
def j6(spark, sf):
    return distance.entity_pairs(fx_vn(spark, sf).select("entity", "item", "value"))
