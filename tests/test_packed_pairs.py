"""Packed block pairs: the matrix goes to few tasks, no statistic keeps a pair, and groups of blocks give the results of single ones."""

import numpy as np
import pytest
from test_pairs import distances, frame, matrix

from respmosaic.operators import distance, pairs


@pytest.fixture(scope="module")
def cells(spark):
    x = matrix(np.random.default_rng(4), 50, 9, equal=4)
    return x, frame(spark, x).localCheckpoint()


def test_a_matrix_is_shuffled_as_often_as_there_are_groups(cells):
    x, v = cells
    rows = distance.packed_pairs(v, [], 1, 100)
    assert rows.count() <= 50 * distance.GROUPS < x.size * 50
    assert {f.name for f in rows.schema} >= {"entities", "items", "m"}


@pytest.mark.parametrize("entity_block, item_block", [(2, 100), (7, 4), (1024, 2048)])
def test_nearest_over_groups_of_blocks(cells, entity_block, item_block):
    x, v = cells
    d = distances(x)
    got = {(r["entity"], r["rank"]): (r["other"], r["d"]) for r in distance.nearest_entities(v, 3, entity_block=entity_block, item_block=item_block).collect()}
    assert len(got) == 150
    for e in range(50):
        near = sorted(d[min(e, o), max(e, o)] for o in range(50) if o != e and (min(e, o), max(e, o)) in d)[:3]
        assert [got[e, r][1] for r in (1, 2, 3)] == pytest.approx(near)
        assert all(got[e, r][1] == pytest.approx(d[min(e, got[e, r][0]), max(e, got[e, r][0])]) for r in (1, 2, 3))


def test_halves_store_moments_only(cells, monkeypatch):
    x, v = cells
    kept = []
    monkeypatch.setattr(pairs, "materialise", lambda df, real=pairs.materialise: kept.append(real(df)) or kept[-1])
    both = v.selectExpr("'a' AS side", "*").unionByName(v.selectExpr("'b' AS side", "entity", "item", "value * 2 AS value"))
    got = pairs.compare_sides(both, "side", "a", "b").first()
    assert (got["n_pairs"], got["pearson"], got["slope"]) == pytest.approx((len(distances(x)), 1.0, 4.0))
    assert kept and not any("binary" in dict(df.dtypes).values() for df in kept)


def test_medians_in_several_passes(spark, cells, monkeypatch):
    x, v = cells
    monkeypatch.setattr(pairs, "FEW", 0)
    monkeypatch.setattr(pairs, "ENTITY_BLOCK", 5)
    monkeypatch.setattr(pairs, "pair_ranks", None)
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "entity long, label string")
    got = {r["case"]: r["median_d"] for r in pairs.group_distances(v, labels).collect()}
    want = {"between": [], "within_a": [], "within_b": []}
    for (i, j), d in distances(x).items():
        want["between" if i % 2 != j % 2 else "within_" + "ab"[i % 2]].append(d)
    assert got == pytest.approx({c: np.median(d) for c, d in want.items()})


def test_geometry_stores_no_distances_and_sends_few_bytes(cells, monkeypatch):
    x, v = cells
    kept = []
    monkeypatch.setattr(pairs, "materialise", lambda df, real=pairs.materialise: kept.append(real(df)) or kept[-1])
    both = v.selectExpr("'a' AS side", "1 AS branch", "*").unionByName(v.selectExpr("'b' AS side", "1 AS branch", "entity", "item", "value * 2 AS value"))
    got = pairs.compare_geometry(both, "side", "a", "b", ["branch"]).first()
    assert (got["n_pairs"], got["spearman"], got["mean_ratio"], got["median_ratio"]) == pytest.approx((len(distances(x)), 1.0, 4.0, 4.0))
    assert kept and not any({"x", "y"} <= set(df.columns) for df in kept)
    rng = np.random.default_rng(1)
    rising = np.sort(rng.integers(1 << 50, (1 << 50) + (1 << 30), 4000))
    assert (pairs._unpacked_ints(pairs._packed_ints(rising, rising=True), rising=True) == rising).all() and len(pairs._packed_ints(rising, rising=True)) < 4000 * 3.1
    for u in (rng.permutation(rising), np.zeros(3, np.int64), np.array([7]), np.array([0, (1 << 51) - 1])):
        assert (pairs._unpacked_ints(pairs._packed_ints(u)) == u).all()
