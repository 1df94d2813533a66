"""Matrix algebra on hand-made cases and invariances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from respmosaic.operators import distance, factor, matrix, permutation, statistics
from respmosaic.operators.integrity import coverage_gate, keep_complete


def dense(df, n, m):
    out = np.full((n, m), np.nan)
    for r in df.collect():
        if r["value"] is not None:
            out[r["entity"], r["item"]] = r["value"]
    return out


def pairs(df):
    return {(r["entity_i"], r["entity_j"]): r["d"] for r in df.collect()}


def brute(x):
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            out[(i, j)] = float(((x[i] - x[j])[both] ** 2).sum() * x.shape[1] / both.sum()) if both.any() else None
    return out


def test_ingest_maps_nan_and_infinities_to_null(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, float("-inf")), (1, 3, 2.0)], "e long, i long, v double")
    assert [r["value"] for r in matrix.ingest(df, "e", "i", "v").orderBy("item").collect()] == [None, None, 2.0]


def test_clip_keeps_nulls(long):
    clipped, thr = matrix.clip_lower(long([[-10, 1, 2, None], [3, 4, 5, 6]]), 0.25)
    assert thr.first()["threshold"] == pytest.approx(np.quantile([-10, 1, 2, 3, 4, 5, 6], 0.25))
    assert np.isnan(dense(clipped, 2, 4)[0, 3]) and dense(clipped, 2, 4)[0, 0] == 1.5


def test_double_center_means_vanish(long):
    x = np.random.default_rng(0).normal(size=(5, 7))
    got = dense(matrix.double_center(long(x.tolist())).values, 5, 7)
    want = x - x.mean(1, keepdims=True)
    assert np.allclose(got, want - want.mean(0))


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 3)])
def test_distance_matches_brute_force_in_any_blocking(long, blocks):
    x = np.random.default_rng(1).normal(size=(7, 9))
    x[0, :4] = np.nan
    x[3, 4:] = np.nan
    rows = [[None if np.isnan(c) else c for c in row] for row in x]
    got = pairs(distance.pairwise_sq_distance(long(rows), entity_block=blocks[0], item_block=blocks[1]))
    want = brute(x)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (None if want[k] is None else pytest.approx(want[k]))


def test_distance_ignores_entity_and_item_shifts(long):
    x = np.random.default_rng(2).normal(size=(4, 6))
    shifted = x + np.arange(4)[:, None] + np.arange(6)[None, :] * 3
    a = pairs(distance.pairwise_sq_distance(matrix.double_center(long(x.tolist())).values))
    b = pairs(distance.pairwise_sq_distance(matrix.double_center(long(shifted.tolist())).values.repartition(5)))
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_project_reproduces_a_fitted_row(long):
    x = np.random.default_rng(3).normal(size=(6, 8))
    v = long(x.tolist())
    fit = matrix.fit_matrix(v, 0.02)
    again = matrix.project(v.filter("entity = 2"), fit.thresholds, fit.col_means)
    assert np.allclose(dense(again, 6, 8)[2], dense(fit.values, 6, 8)[2])


FST_ONE = [[0, 0, 0, 0], [0, 0, 0, 0], [5, 5, 5, 5], [5, 5, 5, 5]]


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "entity long, label string")


def test_share_is_one_for_separated_groups_and_zero_for_constant(spark, long):
    lab = labels(spark, ["a", "a", "b", "b"])
    assert permutation.multivariate_fst(long(FST_ONE), lab).first()["share"] == pytest.approx(1.0)
    assert permutation.multivariate_fst(long([[1, 1]] * 4), lab).first()["share"] == 0.0
    holed = [[0, None, 0, 0]] + FST_ONE[1:]
    assert 0.0 <= permutation.multivariate_fst(long(holed), lab).first()["share"] <= 1.0


def test_permutations_keep_group_sizes_and_blocking_does_not_matter(spark, long, monkeypatch):
    rng = np.random.default_rng(4)
    v, lab = long(rng.normal(size=(9, 5)).tolist()), labels(spark, list("aaabbbbcc"))
    drawn = permutation.permuted_labels(lab, 6, 1).groupBy("perm", "label").count().collect()
    assert {(r["label"], r["count"]) for r in drawn} == {("a", 3), ("b", 4), ("c", 2)} and len(drawn) == 21
    a = {r["perm"]: r["share"] for r in permutation.permutation_shares(v, lab, 6, 1).collect()}
    monkeypatch.setattr(permutation, "GROUP_SUMS", 8)  # one item and two or three permutations at a time
    b = {r["perm"]: r["share"] for r in permutation.permutation_shares(v, lab, 6, 1, block=3).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert a[0] == pytest.approx(permutation.multivariate_fst(v, lab).first()["share"])


def test_svd_reconstructs_and_explains_everything(long):
    x = np.random.default_rng(6).normal(size=(4, 9))
    f = factor.truncated_svd(long(x.tolist()), 4)
    z, w = np.zeros((4, 4)), np.zeros((9, 4))
    for r in f.scores.collect():
        z[r["entity"], r["pc"]] = r["score"]
    for r in f.loadings.collect():
        w[r["item"], r["pc"]] = r["loading"]
    assert np.allclose(z @ w.T, x)
    spec = f.spectrum.orderBy("pc").toPandas()
    assert spec["explained"].sum() == pytest.approx(1.0)
    assert np.allclose(spec["sigma"], np.linalg.svd(x, compute_uv=False))


@pytest.mark.parametrize("shape, k", [((90, 40), 3), ((40, 90), 3), ((70, 70), 70)])
def test_svd_in_small_blocks(long, shape, k, monkeypatch):
    """Several blocks on both axes, a subspace narrower than the matrix, and a rank below the shape."""
    monkeypatch.setattr(factor, "SPARE", 6)
    monkeypatch.setattr(factor, "WHOLE", 0)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(shape[0], 30)) @ np.diag(0.5 ** np.arange(30)) @ rng.normal(size=(30, shape[1]))
    f = factor.truncated_svd(long(x.tolist()), k, block=16)
    sigma = np.linalg.svd(x, compute_uv=False)
    want = min(k, 30)
    assert np.allclose(f.spectrum.orderBy("pc").toPandas()["sigma"], sigma[:want], rtol=1e-7)
    scores = f.scores.toPandas().pivot(index="entity", columns="pc", values="score").to_numpy()
    loadings = f.loadings.toPandas().pivot(index="item", columns="pc", values="loading").to_numpy()
    assert np.allclose(loadings.T @ loadings, np.eye(want), atol=1e-7) and np.allclose(scores, x @ loadings, atol=1e-6)
    again = factor.truncated_svd(long(x.tolist()), k, block=16).scores.toPandas().pivot(index="entity", columns="pc", values="score").to_numpy()
    assert np.allclose(scores, again, atol=1e-6)


def test_svd_of_zeros(long):
    f = factor.truncated_svd(long(np.zeros((3, 4)).tolist()), 2)
    assert f.spectrum.count() == f.scores.count() == f.loadings.count() == 0


def test_procrustes_zero_under_rotation(spark):
    x = np.random.default_rng(7).normal(size=(6, 2))
    rot = np.array([[0.6, -0.8], [0.8, 0.6]])
    frame = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(2)], "key long, dim long, x double")
    assert factor.procrustes_residual(frame(x), frame(x @ rot + 3)) == pytest.approx(0.0, abs=1e-6)
    assert factor.procrustes_residual(frame(x), frame(np.ones((6, 2)))) == 0.0
    with pytest.raises(ValueError):
        factor.procrustes_residual(frame(x), frame(x).filter("dim = 0"))


def test_gc_axis_all_dominated_gives_minus_one(spark):
    load = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "pc int, item long, loading double")
    attrs = spark.createDataFrame([(i, float(2 * i)) for i in range(5)], "item long, attr double")
    assert statistics.gc_axis(load, attrs).first()["first_free"] == -1
    flat = attrs.withColumn("attr", F.lit(1.0))
    assert statistics.gc_axis(load, flat).first()["r"] == 0.0


def test_gate_reasons_in_order_and_keep_complete(spark):
    items = spark.createDataFrame([(i,) for i in range(3)], "item long")
    rows = [("dup", 0, 1.0), ("dup", 0, 1.0), ("dup", 1, 1.0), ("short", 0, 1.0), ("set", 0, 1.0), ("set", 1, 1.0), ("set", 9, 1.0)]
    rows += [("nan", i, float("nan") if i == 2 else 1.0) for i in range(3)] + [("ok", i, 1.0) for i in range(3)]
    scores = spark.createDataFrame(rows, "entity string, item long, value double")
    entities = spark.createDataFrame([(e,) for e in ("dup", "short", "set", "nan", "ok", "none")], "entity string")
    got = {r["entity"]: r["reason"] for r in coverage_gate(scores, items, entities).collect()}
    assert got == {"dup": "duplicate items", "short": "row count", "set": "item set", "nan": "non-finite values", "ok": "", "none": "missing"}
    assert {r["entity"] for r in keep_complete(scores, items).collect()} == {"ok"}
    with pytest.raises(ValueError):
        keep_complete(scores, items, strict=True)
    with pytest.raises(ValueError):
        keep_complete(scores, items, strict=True, allow_missing=True)
