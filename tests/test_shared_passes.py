"""Distances with and without outliers come from the same passes over the pairs."""

import numpy as np
import pytest
from test_pairs import distances, frame, matrix

from respmosaic.operators import pairs


def test_row_sets_share_the_packed_matrix(spark, monkeypatch):
    x = matrix(np.random.default_rng(5), 40, 9, equal=4)
    packed = []
    monkeypatch.setattr(pairs, "packed_pairs", lambda *a, real=pairs.packed_pairs, **b: packed.append(1) or real(*a, **b))
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "entity long, label string")
    tables = pairs.structure_sensitivity(frame(spark, x), labels, [3, 17], parts=["distance"])
    assert len(packed) == 1
    for name, gone in (("all", ()), ("without_outliers", (3, 17))):
        want: dict = {}
        for (i, j), d in distances(x).items():
            if i not in gone and j not in gone:
                want.setdefault("between" if i % 2 != j % 2 else "within_" + "ab"[i % 2], []).append(d)
        got = {r["case"]: r for r in tables[f"{name}_distance"].collect()}
        assert {c: r["n_pairs"] for c, r in got.items()} == {c: len(d) for c, d in want.items()}
        for c, d in want.items():
            assert (got[c]["mean_d"], got[c]["median_d"], got[c]["mean_ratio"]) == pytest.approx((np.mean(d), np.median(d), np.mean(want["between"]) / np.mean(d)))


@pytest.mark.parametrize("missing", [0.0, 0.3])
@pytest.mark.parametrize("alone", [True, False])
def test_strips_give_every_pair_once_with_its_codes(monkeypatch, missing, alone):
    from types import SimpleNamespace

    from respmosaic.operators import distance

    monkeypatch.setattr(distance, "STRIP", (3, 4))
    x = matrix(np.random.default_rng(7), 50, 6, missing=missing, equal=5)
    block = lambda some: distance.Block(np.array(some), np.arange(6), x[some])
    sides = {0: block([*range(0, 14)]), 1: block([*range(14, 30)])}, {2: block([*range(30, 50)])}
    tiles = SimpleNamespace(gi=0, gj=0 if alone else 1, carried={}, whole_blocks=lambda: sides[:1] * 2 if alone else sides)
    got: dict = {}
    for i, j, gaps in distance.coded_gaps(tiles, lambda names, _: names % 3):
        got.setdefault((min(i, j), max(i, j)), []).extend(gaps)
    want: dict = {}
    for i, j in ((i, j) for i in range(30) for j in (range(i + 1, 30) if alone else range(30, 50))):
        n = (~np.isnan(x[i]) & ~np.isnan(x[j])).sum()
        if n:
            want.setdefault((min(i % 3, j % 3), max(i % 3, j % 3)), []).append(np.nansum((x[i] - x[j]) ** 2) / n)
    assert got.keys() == want.keys() and all(sorted(got[k]) == pytest.approx(sorted(want[k])) for k in want)
