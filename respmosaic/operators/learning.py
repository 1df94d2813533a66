"""Linear probes, ridge prediction and leave-one-out fits, on folds that are table columns.

Probes run all folds and strengths in shared Newton passes; ridge follows from sums over rows or from a Gram matrix of entities, whichever is
smaller. Feature tables are stored once before the fits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respmosaic.operators.integrity import class_gate, finite_report, finite_rows
from respmosaic.operators.splits import group_kfold, kfold, stratified_kfold
from respmosaic.operators.statistics import roc_auc
from respmosaic.plans import blocked, newton
from respmosaic.plans.ranking import hash_rank
from respmosaic.plans.stable import materialise

C_GRID = (0.01, 0.1, 1.0, 10.0)


def _coded(train: DataFrame, column: str = "label") -> dict:
    """Codes of the classes, in the order of the labels."""
    return {r[column]: i for i, r in enumerate(train.select(column).distinct().orderBy(column).collect())}


def _auc(scored: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, auc)`` of rows ``(*by, y, scores)``: of the second class's score, or one-vs-rest weighted by class size beyond two classes."""
    by = list(by)
    if classes == 2:
        return roc_auc(scored.select(*by, "y", F.col("scores")[0].alias("s")), "s", "y", by).select(*by, "auc")
    long = scored.select(*by, "y", F.posexplode("scores").alias("class", "s")).withColumn("hit", (F.col("y") == F.col("class")).cast("int"))
    each = roc_auc(long, "s", "hit", [*by, "class"])
    return each.groupBy(*by).agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n_pos")))).alias("auc"))


def _score(rows: DataFrame, models: list[tuple[int, int, np.ndarray]], scalers: list) -> DataFrame:
    """``(model, fold, y, scores)``: rows under every model ``(number, fold it left out or -1 for all rows, weights)``."""
    shared = rows.sparkSession.sparkContext.broadcast((models, scalers))

    def run(frames):
        known, scale = shared.value
        for pdf in frames:
            x, y, fold = np.stack(pdf["x"].to_list()).astype(float), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            for number, out, theta in known:
                use = fold == out if out >= 0 else np.ones(len(x), bool)
                if use.any():
                    s = newton.scores(newton.standardised(x[use], *scale[out]), theta)
                    yield pd.DataFrame({"model": number, "fold": out, "y": y[use], "scores": list(s)})

    return rows.mapInPandas(run, "model int, fold int, y int, scores array<double>")


def linear_probe(train: DataFrame, test: DataFrame, c_grid: Sequence[float] = C_GRID, n_cv: int = 5, seed: int = 0) -> dict:
    """L2 logistic probe: C by mean fold AUC (first on ties), refit, test AUC.

    ``train``/``test``: row, features array, label. The scaler is fitted inside each fold. The fits of all folds and strengths and the
    final ones run in shared Newton passes. Returns the result record with the rows left out as not finite, or a skip record when a gate fails.
    """
    train, test = materialise(train.select("row", "features", "label")), materialise(test.select("features", "label"))
    counts = {n: finite_report(t).first() for n, t in (("train", train), ("test", test))}
    drops = {f"n_{n}_{k}": r["n_raw" if k == "raw" else "n_dropped"] for n, r in counts.items() for k in ("raw", "dropped")}
    train, test = finite_rows(train), finite_rows(test)
    both = train.select(F.lit("train").alias("split"), "label").unionByName(test.select(F.lit("test").alias("split"), "label"))
    gate = class_gate(both, n_cv).first()
    if gate is None or gate["reason"] is not None:
        return {"skip_reason": "tiny" if gate is None else gate["reason"], "error_type": "tiny" if gate is None else gate["error_type"], **drops}
    codes = _coded(train)
    code = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])[F.col("label")]
    width = train.agg(F.max(F.size("features")).alias("d")).first()["d"]
    folds = stratified_kfold(train, "row", "label", n_cv, seed).select("row", "fold")
    data = materialise(train.join(folds, "row").select(F.col("features").cast("array<double>").alias("x"), code.alias("y"), "fold"))
    scalers = newton.fold_scalers(data, n_cv, width)
    fits = [(f, c) for c in c_grid for f in [*range(n_cv), -1]]
    weights = newton.fit_all(data, fits, scalers, len(codes))
    models = [(c_grid.index(c), f, w) for (f, c), w in zip(fits, weights)]
    cross = {}
    for r in _auc(_score(data, [m for m in models if m[1] >= 0], scalers), len(codes), ["model", "fold"]).collect():
        cross.setdefault(r["model"], []).append(0.0 if r["auc"] is None else r["auc"])
    best = max(range(len(c_grid)), key=lambda i: (round(float(np.mean(cross[i])), 12), -i))
    final = [m for m in models if m[0] == best and m[1] == -1]
    held = test.select(F.col("features").cast("array<double>").alias("x"), code.alias("y"), F.lit(-1).alias("fold"))
    return {
        "auc_test": _auc(_score(held, final, scalers), len(codes), ["model"]).first()["auc"],
        "auc_cv_mean": float(np.mean(cross[best])),
        "auc_cv_std": float(np.std(cross[best])),
        "best_C": float(c_grid[best]),
        "n_train": gate["n_train"],
        "n_test": gate["n_test"],
        "embed_dim": width,
        "n_classes": len(codes),
        "multiclass": len(codes) > 2,
        "classifier": "l2_logistic",
        "auc_average": "ovr_weighted" if len(codes) > 2 else "binary",
        **drops,
    }


#: Columns that name a cell of the design, and parts into which the sums of a cell are first merged.
CELL, PARTS = ["split", "seed", "feature_set", "task", "fold", "inner"], 64
#: Most entities of a Gram matrix, and features of one of its slices.
GRAM, SLICE = 2048, 1024


def _merge(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and centred scatter of the union of several sets of rows."""
    total = n.sum()
    if not total:
        return 0.0, mean.sum(0) * 0.0, scatter.sum(0) * 0.0
    middle = (n[:, None] * mean).sum(0) / total
    gap = mean - middle
    return float(total), middle, scatter.sum(0) + (n[:, None, None] * gap[:, :, None] * gap[:, None, :]).sum(0)


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = np.stack(pdf["mean"].to_list())
    return pdf["n"].to_numpy(float), mean, np.stack(pdf["scatter"].to_list()).reshape(len(pdf), mean.shape[1], mean.shape[1])


def _ridge(n: float, mean: np.ndarray, scatter: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the sums of ``(x, y)``; the intercept is not penalised."""
    d = len(mean) - 1
    w = np.linalg.lstsq(scatter[:d, :d] + alpha * np.eye(d), scatter[:d, d], rcond=None)[0]
    return w, float(mean[d] - w @ mean[:d])


def _r2(n: float, mean: np.ndarray, scatter: np.ndarray, w: np.ndarray, b: float) -> float:
    """R squared of a fitted line on the rows behind the sums."""
    d = len(mean) - 1
    v = np.append(-w, 1.0)
    miss = float(v @ mean) - b
    return 1.0 - (float(v @ scatter @ v) + n * miss * miss) / max(scatter[d, d], 1e-300)


def _grams(usable: DataFrame) -> dict:
    """``feature set -> (entities, Gram matrix)``, summed over slices of the features; features are taken about their means."""
    sets = [r["feature_set"] for r in usable.select("feature_set").distinct().orderBy("feature_set").collect()]
    numbered = usable.withColumn("_s", F.array_position(F.array(*[F.lit(s) for s in sets]), F.col("feature_set")) - 1)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / SLICE).cast("int")), lambda i: F.slice("x", i * SLICE + 1, F.lit(SLICE)))
    cut = numbered.select("_s", "entity", F.posexplode(cuts).alias("part", "v"))

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values("entity")["v"].to_list())
        v = v - v.mean(0)
        return pd.DataFrame({"b": [key[0]], "m": [(v @ v.T).tobytes()]})

    found = blocked.summed(cut.groupBy("_s", "part").applyInPandas(partial, "b long, m binary")).collect()  # at most GRAM x GRAM numbers a set
    names = {r["_s"]: sorted(r["e"]) for r in numbered.groupBy("_s").agg(F.collect_list("entity").alias("e")).collect()}
    return {sets[r["b"]]: (names[r["b"]], np.frombuffer(r["m"]).reshape(len(names[r["b"]]), -1)) for r in found}


def _kernel_ridge(k: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, alphas: Sequence[float]) -> list[np.ndarray]:
    """Predictions for the rows ``test`` at every alpha, from one eigendecomposition of the centred products of ``train``."""
    inside, across = k[np.ix_(train, train)], k[np.ix_(test, train)]
    mean, whole, middle = inside.mean(0), inside.mean(), y[train].mean()
    values, vectors = np.linalg.eigh(inside - mean[:, None] - mean[None] + whole)
    across = (across - across.mean(1, keepdims=True) - mean[None] + whole) @ vectors
    turned = vectors.T @ (y[train] - middle)
    small = 1e-12 * max(float(values[-1]), 1e-300)
    return [middle + across @ np.where(values + a > small, turned / np.maximum(values + a, small), 0.0) for a in alphas]


def _dual(usable: DataFrame, rows: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Ridge predictions from products between entities: memory follows their number squared, whatever the number of features."""
    shared = rows.sparkSession.sparkContext.broadcast(_grams(usable))
    alphas = [float(a) for a in alphas]
    columns = ["split", "seed", "feature_set", "fold", "entity", "task", "y_true", "y_pred", "alpha"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, gram = shared.value[pdf["feature_set"].iloc[0]]
        at = np.searchsorted(np.array(names), pdf["entity"].to_numpy())
        k, y, fold, inner = gram[np.ix_(at, at)], pdf["y"].to_numpy(float), pdf["fold"].to_numpy(), pdf["inner"].to_numpy()
        out = []
        for f in np.unique(fold):
            rest, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(rest):
                continue
            score = []
            for i in np.unique(inner[rest]):
                train, test = rest[inner[rest] != i], rest[inner[rest] == i]
                if len(train):
                    spread = max(float(((y[test] - y[test].mean()) ** 2).sum()), 1e-300)
                    score.append([1.0 - float(((y[test] - p) ** 2).sum()) / spread for p in _kernel_ridge(k, y, train, test, alphas)])
            best = int(np.argmax(np.round(np.mean(score or [[0.0] * len(alphas)], axis=0), 12)))
            part = pdf.iloc[held][["split", "seed", "feature_set", "fold", "entity", "task"]]
            out.append(part.assign(y_true=y[held], y_pred=np.clip(_kernel_ridge(k, y, rest, held, [alphas[best]])[0], 0.0, 1.0), alpha=alphas[best]))
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns[:6]) + ", y_true double, y_pred double, alpha double"
    return rows.groupBy("split", "seed", "feature_set", "task").applyInPandas(fit, schema)


def predict_metric(
    features: DataFrame,
    targets: DataFrame,
    groups: DataFrame | None = None,
    splits: Sequence[str] = ("kfold", "group_kfold"),
    seeds: Sequence[int] = (0,),
    alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0),
    n_folds: int = 5,
    inner: int = 3,
) -> DataFrame:
    """Out-of-fold ridge predictions per (split, seed, feature set, fold, task), clipped to [0, 1].

    ``features``: feature_set, entity, features; ``targets``: entity, task, y; ``groups``: entity, label. Ridge needs sums over
    rows only: one pass gives them for every (outer, inner) fold, and all fits of all alphas follow from these. With fewer entities than
    features (and at most ``GRAM``), the fits follow from the entities' products instead (:func:`_dual`). Alpha is
    the first with the best mean R squared over the inner folds. Rows without target or with a null feature are left out.
    """
    ids = features.select("entity").distinct()
    folds = None
    for split in splits:
        for seed in seeds:
            outer = kfold(ids, "entity", n_folds, seed) if split == "kfold" else group_kfold(ids.join(groups, "entity"), "entity", "label", n_folds, seed).select("entity", "fold")
            one = outer.join(kfold(ids, "entity", inner, seed + 1).withColumnRenamed("fold", "inner"), "entity").select(F.lit(split).alias("split"), F.lit(seed).alias("seed"), "entity", "fold", "inner")
            folds = one if folds is None else folds.unionByName(one)
    x = F.col("features").cast("array<double>")
    usable = features.select("feature_set", "entity", x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    usable = materialise(usable)
    wanted = targets.select("entity", "task", F.col("y").cast("double").alias("y")).where("y is not null").join(folds, "entity")
    shape = usable.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).agg(F.max("n").alias("n"), F.min("d").alias("d")).first()
    dual = shape["n"] is not None and shape["n"] < shape["d"] and shape["n"] <= GRAM
    rows = materialise((usable.drop("x") if dual else usable).join(wanted, "entity").select(*CELL, "entity", *([] if dual else ["x"]), "y"))
    if rows.isEmpty():
        raise ValueError("no feature set shares an entity with the targets")
    if dual:
        return _dual(usable, rows, alphas)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in CELL)

    def partial(frames):
        for pdf in frames:
            out = []
            for key, part in pdf.groupby(CELL, sort=False, dropna=False):
                z = np.column_stack([np.stack(part["x"].to_list()), part["y"].to_numpy()])
                gap = z - z.mean(0)
                out.append((*key, float(len(z)), z.mean(0), (gap.T @ gap).ravel()))
            yield pd.DataFrame(out, columns=[*CELL, "n", "mean", "scatter"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = _merge(*_unpack(pdf))
        return pd.DataFrame([(*pdf.iloc[0][CELL], n, mean, scatter.ravel())], columns=[*CELL, "n", "mean", "scatter"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        fold, part = pdf["fold"].to_numpy(), pdf["inner"].to_numpy()
        n, mean, scatter = _unpack(pdf)
        pick = lambda mask: _merge(n[mask], mean[mask], scatter[mask])
        for f in np.unique(fold):
            rest = fold != f
            if not rest.any():
                continue
            tests = [(pick(rest & (part != i)), pick(rest & (part == i))) for i in np.unique(part[rest])]
            score = [np.mean([_r2(*test, *_ridge(*train, a)) for train, test in tests if train[0] and test[0]] or [0.0]) for a in alphas]
            best = alphas[int(np.argmax(np.round(score, 12)))]
            w, b = _ridge(*pick(rest), best)
            out.append((*pdf.iloc[0][["split", "seed", "feature_set", "task"]], int(f), float(best), w, b))
        return pd.DataFrame(out, columns=["split", "seed", "feature_set", "task", "fold", "alpha", "w", "b"])

    sums = f"{kinds}, n double, mean array<double>, scatter array<double>"
    parts = rows.mapInPandas(partial, sums).withColumn("_part", F.spark_partition_id() % PARTS)
    cells = parts.groupBy(*CELL, "_part").applyInPandas(merged, sums).groupBy(*CELL).applyInPandas(merged, sums)
    keys = ["split", "seed", "feature_set", "task"]
    model = cells.groupBy(*keys).applyInPandas(fit, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "fold"]) + ", alpha double, w array<double>, b double")
    line = F.aggregate(F.zip_with("x", "w", lambda a, c: a * c), F.col("b"), lambda acc, v: acc + v)
    predicted = rows.join(model, [*keys, "fold"]).withColumn("y_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), line)))
    return predicted.select("split", "seed", "feature_set", "fold", "entity", "task", F.col("y").alias("y_true"), "y_pred", "alpha")


def _fitted(x: np.ndarray, y: np.ndarray, c: float, kind: str) -> Callable[[np.ndarray], np.ndarray]:
    """Scores of further rows under the fit of ``(x, y)``, scaled on ``x``; classes have equal mass. Wide rows are fitted in their own span."""
    mean, scale = newton.moments(len(x), x.sum(0), (x**2).sum(0))
    z, turn = newton.standardised(x, mean, scale), None
    if z.shape[1] > len(z):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        z, turn = u * s, vt.T
    weight = np.where(y == 1, len(y) / (2.0 * max(1, (y == 1).sum())), len(y) / (2.0 * max(1, (y == 0).sum())))
    theta = newton.fit_here(z, y, c, kind, weight)

    def score(out: np.ndarray) -> np.ndarray:
        o = newton.standardised(out, mean, scale)
        return (o if turn is None else o @ turn) @ theta

    return score


def loo_classify(rows: DataFrame, c_grid: Sequence[float] = (0.1, 1.0, 10.0), kind: str = "svc", max_rows: int = 500) -> dict:
    """Leave-one-out linear classifier (squared hinge, or ``logistic``) with scaling inside each fold; AUC of held-out scores over all rows.

    ``rows``: row, features, label 0/1; rows with a null or non-finite feature are left out. At most ``max_rows`` rows, those with the smallest md5 of
    their id, are fitted: each of them is scored by the fit of the others, and every further row, which no fit has seen, by the fit of all of them.
    Classes are weighted to equal mass. ``auc`` is None where it is not defined; ``n`` counts the scored rows, ``n_fitted`` the fitted ones.
    """
    spark = rows.sparkSession
    usable = finite_rows(rows).where("label in (0, 1)").select("row", F.col("features").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y"))
    data = materialise(hash_rank(materialise(usable), [], "loo", ["row"], "_r"))  # ranks read their rows twice
    known = data.filter(F.col("_r") <= max_rows).orderBy("_r").collect()  # at most max_rows rows
    if len({r["y"] for r in known}) < 2:
        raise ValueError("leave-one-out needs both classes")
    shared = spark.sparkContext.broadcast((np.array([r["x"] for r in known], float), np.array([r["y"] for r in known])))
    grid = [float(c) for c in c_grid]
    name = "squared_hinge" if kind == "svc" else "logistic"

    def left_out(frames):
        x, y = shared.value
        for pdf in frames:
            for i in pdf["id"]:
                rest = np.arange(len(x)) != i
                for j, c in enumerate(grid):
                    yield pd.DataFrame({"c": [j], "y": [int(y[i])], "score": _fitted(x[rest], y[rest], c, name)(x[i : i + 1])})

    def unseen(frames):
        fits = None  # once a task, not once a batch
        for pdf in frames:
            if len(pdf):
                fits = fits or [_fitted(*shared.value, c, name) for c in grid]
                other = np.stack(pdf["x"].to_list()).astype(float)
                for j, fit in enumerate(fits):
                    yield pd.DataFrame({"c": j, "y": pdf["y"].to_numpy(), "score": fit(other)})

    schema = "c int, y int, score double"
    inside = spark.range(0, len(known), 1, min(len(known), spark.sparkContext.defaultParallelism)).mapInPandas(left_out, schema)
    outside = data.filter(F.col("_r") > max_rows).select("x", "y").mapInPandas(unseen, schema)
    found = {r["c"]: r for r in roc_auc(materialise(inside.unionAll(outside)), "score", "y", ["c"]).collect()}
    best = max(range(len(grid)), key=lambda j: (-1.0 if found[j]["auc"] is None else found[j]["auc"], -j))
    return {"auc": found[best]["auc"], "best_C": grid[best], "n": found[best]["n"], "n_fitted": len(known)}
