"""Penalised linear classifiers: all fits of one table in shared passes, and small fits in numpy.

A fit minimises ``|w|^2 / 2 + C * sum of losses`` over standardised features. Two classes share one weight vector whose intercept is
penalised like a weight; more classes have one vector each and free intercepts. Classes are codes 0, 1, ...
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from respmosaic.plans import blocked

#: Numbers of the second derivatives that a task sums at once; passes at most; and the decrement that ends a fit.
SUMS, PASSES, DECREMENT = 8_000_000, 60, 1e-10


def losses(z: np.ndarray, y: np.ndarray, theta: np.ndarray, kind: str = "logistic", weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss, gradient and second derivatives at ``theta (vectors, features)``; ``z`` ends with a column of ones."""
    c = np.ones(len(z)) if weight is None else weight
    if len(theta) == 1:
        m = z @ theta[0]
        if kind == "squared_hinge":
            t = 2.0 * y - 1.0
            short = np.maximum(0.0, 1.0 - t * m)
            active = z[short > 0]
            return float(c @ short**2), -2.0 * (c * t * short) @ z, 2.0 * (active * c[short > 0, None]).T @ active
        p = 0.5 * (1.0 + np.tanh(0.5 * m))
        return float(c @ (np.logaddexp(0.0, m) - y * m)), (c * (p - y)) @ z, (z * (c * p * (1 - p))[:, None]).T @ z
    m = z @ theta.T
    top = m.max(axis=1, keepdims=True) if len(m) else m[:, :1]
    e = np.exp(m - top)
    p = e / e.sum(axis=1, keepdims=True)
    hit = np.eye(len(theta))[y.astype(int)]
    k, d = theta.shape
    second = np.zeros((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            s = c * p[:, a] * ((a == b) - p[:, b])
            second[a, :, b] = (z * s[:, None]).T @ z
            second[b, :, a] = second[a, :, b].T
    loss = float(c @ (np.log(e.sum(axis=1)) + top[:, 0] - (m * hit).sum(axis=1)))
    return loss, ((c[:, None] * (p - hit)).T @ z).ravel(), second.reshape(k * d, k * d)


@dataclass
class Fit:
    """One fit under way: ``theta`` is the best point so far, ``at`` the one to be looked at next."""

    c: float
    theta: np.ndarray
    at: np.ndarray
    value: float = np.inf
    done: bool = False

    def take(self, loss: float, gradient: np.ndarray, second: np.ndarray) -> None:
        """Moves on from the sums at ``at``: a Newton step where the value fell, half the way back where it rose."""
        penal = np.ones_like(self.at)
        if len(self.at) > 1:
            penal[:, -1] = 0.0
        value = 0.5 * float((penal * self.at**2).sum()) + self.c * loss
        if value > self.value + 1e-12 * abs(self.value):
            self.at = (self.theta + self.at) / 2
            self.done = bool(np.abs(self.at - self.theta).max() < 1e-14)
            return
        self.theta, self.value = self.at, value
        g = (penal * self.at).ravel() + self.c * gradient
        step = np.linalg.lstsq(np.diag(penal.ravel()) + self.c * second, g, rcond=1e-13)[0]
        if float(g @ step) <= DECREMENT * max(1.0, abs(value)):
            self.done = True
        self.at = self.theta - step.reshape(self.at.shape)


def fit_here(z: np.ndarray, y: np.ndarray, c: float, kind: str = "logistic", weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a two-class fit on rows at hand."""
    fit = Fit(c, np.zeros((1, z.shape[1])), np.zeros((1, z.shape[1])))
    for _ in range(PASSES):
        fit.take(*losses(z, y, fit.at, kind, weight))
        if fit.done:
            break
    return fit.theta[0]


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([(x - mean) / scale, np.ones(len(x))])


def moments(n: float, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation; a constant feature has the scale 1."""
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0.0))
    return mean, np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean)), spread, 1.0)


def _frames(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_list()).astype(float), pdf["y"].to_numpy(), pdf["fold"].to_numpy()


def fold_scalers(rows: DataFrame, folds: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and scale of the rows outside each fold, and last of all rows, from one pass of sums about the first row."""
    first = np.array(rows.select("x").first()["x"], float)

    def run(frames):
        total = np.zeros((folds, 2 * width + 1))
        for pdf in frames:
            x, _, fold = _frames(pdf)
            x = x - first
            for f in np.unique(fold):
                part = x[fold == f]
                total[f] += np.concatenate([[len(part)], part.sum(0), (part**2).sum(0)])
        yield pd.DataFrame({"b": range(folds), "m": [t.tobytes() for t in total]})

    sums = np.zeros((folds, 2 * width + 1))
    for r in blocked.summed(rows.mapInPandas(run, "b long, m binary")).collect():
        sums[r["b"]] = np.frombuffer(r["m"])
    parts = [sums.sum(0) - s for s in sums] + [sums.sum(0)]
    return [(mean + first, scale) for mean, scale in (moments(p[0], p[1 : width + 1], p[width + 1 :]) for p in parts)]


def fit_all(rows: DataFrame, fits: Sequence[tuple[int, float]], scalers: Sequence[tuple[np.ndarray, np.ndarray]], classes: int) -> list[np.ndarray]:
    """Weights of every fit ``(left-out fold or -1, C)`` over stored ``rows(x, y, fold)``.

    Each pass reads the rows once and adds up losses, gradients and second derivatives of all fits still under way (of as many at a time as
    ``SUMS`` allows); the driver takes the steps, whose size follows the features and not the rows.
    """
    width = len(scalers[0][0]) + 1
    vectors = 1 if classes == 2 else classes
    size = vectors * width
    state = [Fit(c, np.zeros((vectors, width)), np.zeros((vectors, width))) for _, c in fits]
    at_once = max(1, SUMS // (size * size))
    for _ in range(PASSES):
        left = [i for i, s in enumerate(state) if not s.done]
        if not left:
            break
        for part in (left[i : i + at_once] for i in range(0, len(left), at_once)):
            shared = rows.sparkSession.sparkContext.broadcast([(i, fits[i][0], state[i].at) for i in part])

            def run(frames, shared=shared):
                total = {}
                for pdf in frames:
                    x, y, fold = _frames(pdf)
                    scaled = {}
                    for i, out, theta in shared.value:
                        if out not in scaled:
                            use = fold != out
                            scaled[out] = standardised(x[use], *scalers[out]), y[use]
                        loss, gradient, second = losses(*scaled[out], theta)
                        total[i] = total.get(i, 0.0) + np.concatenate([[loss], gradient, second.ravel()])
                for i, t in total.items():
                    yield pd.DataFrame({"b": [i], "m": [t.tobytes()]})

            for r in blocked.summed(rows.mapInPandas(run, "b long, m binary")).collect():
                m = np.frombuffer(r["m"])
                state[r["b"]].take(float(m[0]), m[1 : size + 1], m[size + 1 :].reshape(size, size))
    return [s.theta for s in state]


def scores(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Scores of the classes: one column for two classes (of the second), else the probability of each."""
    m = z @ theta.T
    if len(theta) == 1:
        return m
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
