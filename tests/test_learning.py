"""Linear fits against plain optimisation, ridge in both forms, and leave-one-out scores of every row."""

import numpy as np
import pytest

from respmosaic.operators import learning
from respmosaic.plans import newton


@pytest.mark.parametrize("kind, classes", [("logistic", 2), ("squared_hinge", 2), ("logistic", 3)])
def test_sums_against_differences(kind, classes):
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(size=(30, 4)), rng.integers(0, classes, 30), rng.random(30) + 0.5
    theta = rng.normal(size=(1 if classes == 2 else classes, 4))
    _, g, h = newton.losses(z, y, theta, kind, w)
    for i in range(theta.size):
        ends = []
        for e in (1e-5, -1e-5):
            t = theta.copy()
            t.flat[i] += e
            ends.append(newton.losses(z, y, t, kind, w))
        assert g[i] == pytest.approx((ends[0][0] - ends[1][0]) / 2e-5, rel=1e-5, abs=1e-5)
        if kind == "logistic":
            assert np.allclose(h[i], (ends[0][1] - ends[1][1]) / 2e-5, atol=1e-4)


def _descend(z, y, c, penal, steps=60_000):
    """Plain gradient descent on the same objective."""
    w = np.zeros(z.shape[1])
    rate = 1.0 / (1.0 + c * 0.25 * np.linalg.norm(z, 2) ** 2)
    for _ in range(steps):
        w -= rate * (penal * w + c * (1 / (1 + np.exp(-z @ w)) - y) @ z)
    return w


def test_shared_passes_reach_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * [1, 5, 0.1] + [0, 100, 0]
    y = (x[:, 0] + rng.normal(size=90) > 0).astype(int)
    rows = spark.createDataFrame([(a.tolist(), int(b), i % 3) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y int, fold int").repartition(4).cache()
    scalers = newton.fold_scalers(rows, 3, 3)
    fits = [(f, c) for c in (0.1, 2.0) for f in (0, 1, 2, -1)]
    fold = np.arange(90) % 3
    for (f, c), theta in zip(fits, newton.fit_all(rows, fits, scalers, 2)):
        use = fold != f
        mean, scale = x[use].mean(0), x[use].std(0)
        assert np.allclose(scalers[f][0], mean) and np.allclose(scalers[f][1], scale)
        z = np.column_stack([(x[use] - mean) / scale, np.ones(use.sum())])
        assert np.allclose(theta[0], _descend(z, y[use], c, 1.0), atol=1e-5)


def test_shared_passes_take_few_jobs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), int(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "row long, features array<double>, label int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("probe", "probe")
    data = df.selectExpr("features as x", "label as y", "cast(row % 5 as int) as fold").cache()
    scalers = newton.fold_scalers(data, 5, 4)
    before = len(tracker.getJobIdsForGroup("probe"))
    newton.fit_all(data, [(f, c) for c in (0.01, 0.1, 1.0, 10.0) for f in (0, 1, 2, 3, 4, -1)], scalers, 2)
    jobs = len(tracker.getJobIdsForGroup("probe")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 2 * 12  # 24 fits, about 6 passes of a map and a sum


def test_probe_of_three_classes_and_dropped_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float("nan")] * 2 if i % 20 == 0 else (rng.normal(size=2) + [3 * (i % 3 == 1), 3 * (i % 3 == 2)]).tolist(), "abc"[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "row long, features array<double>, label string")
    rec = learning.linear_probe(df.filter("row < 100"), df.filter("row >= 100"), (0.1, 1.0), 3, 0)
    assert rec["auc_test"] > 0.9 and rec["auc_cv_mean"] > 0.9 and rec["n_classes"] == 3 and rec["multiclass"] and rec["embed_dim"] == 2
    assert (rec["n_train_raw"], rec["n_train_dropped"], rec["n_test_raw"], rec["n_test_dropped"], rec["n_train"], rec["n_test"]) == (100, 5, 50, 3, 95, 47)


def test_ridge_from_products_equals_ridge_from_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 60))
    y = 0.5 + 0.05 * x[:, :3].sum(1) + 0.02 * rng.normal(size=40)
    features = spark.createDataFrame([(s, i, (x[i] * (1 + (s == "b"))).tolist()) for s in "ab" for i in range(40)], "feature_set string, entity long, features array<double>")
    targets = spark.createDataFrame([(i, t, float(y[i]) + (t == "u") * 0.1) for i in range(40) for t in "tu" if (i, t) != (3, "u")], "entity long, task string, y double")
    groups = spark.createDataFrame([(i, f"g{i % 9}") for i in range(40)], "entity long, label string")
    key = ["split", "seed", "feature_set", "task", "entity"]

    def run():
        return learning.predict_metric(features, targets, groups, seeds=(0, 1), alphas=(0.1, 10.0, 100.0)).toPandas().sort_values(key, ignore_index=True)

    monkeypatch.setattr(learning, "SLICE", 17)
    dual = run()
    monkeypatch.setattr(learning, "GRAM", 0)
    primal = run()
    assert len(dual) == 2 * 2 * 2 * 79 and (dual[key] == primal[key]).all().all()
    assert np.allclose(dual["y_pred"], primal["y_pred"], atol=1e-9) and (dual["alpha"] == primal["alpha"]).all()


def test_ridge_from_products_leaves_no_gradient():
    """On its own rows, the fit's residual is alpha times the dual weights: the gradient of the objective is zero."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(20, 500)), rng.normal(size=20)
    every = np.arange(20)
    pred = learning._kernel_ridge(x @ x.T, y, every, every, [3.0])[0]
    xc = x - x.mean(0)
    w = xc.T @ ((y - pred) / 3.0)
    assert np.allclose(xc @ w + y.mean(), pred) and np.allclose(xc.T @ (y - pred) - 3.0 * w, 0, atol=1e-9)


@pytest.mark.parametrize("kind", ["svc", "logistic"])
def test_every_row_has_a_held_out_score(spark, kind):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) + 4 * (i % 2)).tolist() if i else [None, 1.0, 2.0], i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "row long, features array<double>, label int")
    few, all_ = learning.loo_classify(df, (0.1, 1.0), kind, max_rows=40), learning.loo_classify(df, (1.0,), kind)
    assert (few["n"], few["n_fitted"], all_["n"], all_["n_fitted"]) == (159, 40, 159, 159) and few["auc"] > 0.99 and all_["auc"] > 0.99
    with pytest.raises(ValueError):
        learning.loo_classify(df.filter("label = 1"))


def test_left_out_scores_of_wide_rows():
    """More features than rows: the fit in the rows' own span is the fit over all features."""
    rng = np.random.default_rng(8)
    x, y, out = rng.normal(size=(9, 40)), np.arange(9) % 2, rng.normal(size=(2, 40))
    got = learning._held_out(x, y, out, 0.7, "logistic")
    z = newton.standardised(np.vstack([x, out]), x.mean(0), x.std(0))
    weight = np.where(y == 1, 9 / 8.0, 9 / 10.0)
    theta = newton.fit_here(z[:9], y, 0.7, "logistic", weight)
    assert np.allclose(got, z[9:] @ theta, atol=1e-6)
