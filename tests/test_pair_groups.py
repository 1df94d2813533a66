"""Moments of all pairs from sums over groups of entities, against all pairs in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from respmosaic.operators import pair_groups, pairs
from test_pairs import distances, frame


def cells(seed, groups=5):
    """Two matrices of 60 entities; entities of one residue miss the same items, and one group misses all of the second."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(60, 9)) + 50
    b = np.hstack([a[:, :3] * 2, rng.normal(size=(60, 4))])
    e = np.arange(60)[:, None] % groups
    a[(e * 3 + np.arange(9)) % 4 == 0], b[(e + np.arange(7)) % 5 == 1] = np.nan, np.nan
    b[(e == 2)[:, 0]] = np.nan
    return a, b


def wanted(a, b):
    da, db = distances(a), distances(b)
    both = sorted(da.keys() & db.keys())
    x, y = np.array([da[k] for k in both]), np.array([db[k] for k in both])
    slope, intercept = np.polyfit(x, y, 1)
    return len(x), np.corrcoef(x, y)[0, 1], slope, intercept


@pytest.fixture
def no_pairs(monkeypatch):
    monkeypatch.setattr(pair_groups, "MANY", 2)
    monkeypatch.setattr(pair_groups, "CHUNK", 7)
    monkeypatch.setattr(pairs, "pair_blocks", None)


def test_two_sides_by_seed_without_a_pass_over_pairs(spark, no_pairs):
    sides = {s: cells(s) for s in (1, 2)}
    both = [frame(spark, m, side=name).withColumn("seed", F.lit(s)) for s, two in sides.items() for name, m in zip("ab", two)]
    rows = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    got = {r["seed"]: tuple(r)[1:] for r in pairs.compare_sides(rows, "side", "a", "b", ["seed"]).collect()}
    assert got.keys() == sides.keys()
    for s, two in sides.items():
        assert got[s] == pytest.approx(wanted(*two), rel=1e-9)


def test_complete_matrix_is_one_group(spark, no_pairs):
    a = np.random.default_rng(5).normal(size=(40, 6)) + 1e4
    b = a[:, :4] * 3 + np.random.default_rng(6).normal(size=(40, 4))
    rows = frame(spark, a, side="a").unionByName(frame(spark, b, side="b"))
    assert tuple(pairs.compare_sides(rows, "side", "a", "b").first()) == pytest.approx(wanted(a, b), rel=1e-8)


def test_groups_without_spread_or_with_many_patterns_take_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(pair_groups, "MANY", 2)
    same = np.ones((20, 3)) * 0.1
    rows = frame(spark, same, side="a").unionByName(frame(spark, same, side="b"))
    assert tuple(pairs.compare_sides(rows, "side", "a", "b").first()) == (190, None, None, None)
    a, b = cells(3)
    monkeypatch.setattr(pair_groups, "SUMS_BYTES", 1)
    rows = frame(spark, a, side="a").unionByName(frame(spark, b, side="b"))
    monkeypatch.setattr(pair_groups, "group_sums", None)
    assert tuple(pairs.compare_sides(rows, "side", "a", "b").first()) == pytest.approx(wanted(a, b))


def test_a_cell_that_comes_twice_is_an_error(spark, no_pairs):
    rows = frame(spark, np.random.default_rng(1).normal(size=(9, 3)), side="a")
    both = rows.unionByName(rows.withColumn("side", F.lit("b"))).unionByName(rows.limit(1))
    with pytest.raises(Exception, match="twice"):
        pairs.compare_sides(both, "side", "a", "b").collect()
