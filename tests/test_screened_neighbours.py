"""Neighbours by bounds in single precision: the same neighbours, ties and gaps as brute force, whatever the scale of the values."""

from types import SimpleNamespace

import numpy as np
import pytest

from respmosaic.operators import distance


def brute(x, names, k):
    found = {}
    for a in range(len(x)):
        gaps = x[a] - x
        n = (~np.isnan(gaps)).sum(1)
        ss = np.nansum(gaps * gaps, 1)
        found[names[a]] = sorted((ss[b] / n[b], names[b]) for b in range(len(x)) if b != a and n[b])[:k]
    return found


@pytest.mark.parametrize("seed", range(24))
def test_screened_neighbours_are_exact(seed):
    rng = np.random.default_rng(seed)
    k, m = int(rng.integers(1, 9)), int(rng.integers(1, 12))
    # Whole numbers tie; others lie far from zero or are very small or large.
    x = rng.integers(-2, 3, (60, m)).astype(float) if seed % 3 == 0 else rng.normal(1e6 * (seed % 2), 1, (60, m)) * 10.0 ** rng.integers(-8, 9)
    x[rng.random(x.shape) < (0 if seed % 4 == 0 else 0.3)] = np.nan
    names = np.sort(rng.permutation(1000)[:60])
    blocks = [distance.Block(names[at], np.arange(m), x[at]) for at in np.array_split(np.arange(60), 3)]
    first, rest = {0: blocks[0]}, {1: blocks[1], 2: blocks[2]}
    got: dict = {}
    for gi, gj, left, right in ((0, 0, first, first), (1, 1, rest, rest), (0, 1, first, rest)):
        tiles = SimpleNamespace(gi=gi, gj=gj, whole_blocks=lambda left=left, right=right: (left, right))
        for near in distance._screened(tiles, k):
            for e, o, ss, n in near.rows().itertuples(index=False):
                got.setdefault(e, []).append((ss / n, o))
    for e, want in brute(x, names, k).items():
        have = sorted(got.get(e, []))[:k]
        assert [o for _, o in have] == [o for _, o in want]
        assert [d for d, _ in have] == pytest.approx([d for d, _ in want], rel=1e-12)


def test_few_gaps_are_taken_in_double_precision(monkeypatch):
    x = np.random.default_rng(1).normal(size=(512, 16))
    blocks = {b: distance.Block(np.arange(b * 128, b * 128 + 128), np.arange(16), x[b * 128 : b * 128 + 128]) for b in range(4)}
    taken = []
    monkeypatch.setattr(distance.Screen, "exact", lambda self, other, i, j, real=distance.Screen.exact: taken.append(len(i)) or real(self, other, i, j))
    assert sum(len(n.rows()) for n in distance._screened(SimpleNamespace(gi=0, gj=0, whole_blocks=lambda: (blocks, blocks)), 3)) == 512 * 3
    assert sum(taken) < 512 * 511 / 2 / 5
