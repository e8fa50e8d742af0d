"""The branch and bound over packings against exhaustive search, and places of pieces against a plain walk."""

import numpy as np
import pytest

from windgrid.llm import packing


def fewest(items, capacity):
    """All ways to put items into sequences."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                bins[i] += items[k]
                go(k + 1, bins)
                bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def total(found, counts, capacity):
    used = np.zeros_like(counts)
    for f in found:
        assert sum(n * k for n, k in f.parts) <= capacity and f.times > 0
        for n, k in f.parts:
            used[n] += k * f.times
    assert (used == counts).all()
    return sum(f.times for f in found)


@pytest.mark.parametrize("seed", range(60))
def test_least_packings(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 21, rng.integers(0, 11)).tolist()
    counts = np.bincount(items, minlength=21)
    want = fewest(items, 20)
    found, proved = packing.packing_of(counts, 20, None, None, None)
    assert proved and total(found, counts, 20) == want
    found, proved = packing.packing_of(counts, 20)
    assert total(found, counts, 20) == want or not proved


def test_branching_beats_the_incumbent():
    """Largest first with the fullest sequences is not the least here; the branches are."""
    better = 0
    for seed in range(400):
        rng = np.random.default_rng(seed)
        counts = np.bincount(rng.integers(20, 50, 24), minlength=101)
        first = packing.best_fit_decreasing(counts, 100)
        got, _ = packing.branch(counts, 100, first)
        assert total(got, counts, 100) <= total(first, counts, 100)
        better += total(got, counts, 100) < total(first, counts, 100)
    assert better > 10


def test_dominated_fillings():
    left = np.zeros(21, dtype=np.int64)
    left[[12, 5, 4, 3, 2, 8]] = 1
    assert packing.dominated({12: 1, 5: 1}, 12, left, 3)  # the 8 fits in its place
    assert packing.dominated({12: 1, 5: 1, 3: 1}, 12, left, 0)  # the 8 for both
    assert not packing.dominated({12: 1, 8: 1}, 12, left, 0)
    found, whole = packing.fillings(left, 12, 20, None, None)
    assert whole and found == [((12, 1), (8, 1))]


def test_places():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 65, 500), minlength=65)
    found = packing.solve(counts, 64)
    slots = packing.Slots(packing.places(found))
    length = np.repeat(np.arange(65), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    shuffled = rng.permutation(len(length))
    sequence, offset = slots(length[shuffled], rank[shuffled])
    spans = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length[shuffled].tolist(), strict=True):
        spans.setdefault(s, []).append((o, n))
    assert len(spans) == sum(f.times for f in found)
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert all(len(x) == 0 for x in packing.Slots([])(np.array([], dtype=np.int64), np.array([], dtype=np.int64)))
