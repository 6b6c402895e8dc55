"""The lists of a walk are made once, without a second copy."""

import tracemalloc

import numpy as np

from quirelab.operators import nulls


def test_lists_are_not_copied():
    x = np.random.default_rng(2).integers(40, size=3_000_000).astype(np.int32)
    tracemalloc.start()
    number, places, bounds = nulls._repeated(x[:-1], x[1:], None, 1 << 14)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 11.5 * len(x)
    key = x[:-1].astype(np.int64) * 40 + x[1:]
    assert len(bounds) == 1601 and (number >= 0).all() and sorted(places.tolist()) == list(range(len(key)))
    for i in range(0, 1600, 99):
        own = places[bounds[i] : bounds[i + 1]]
        assert len(set(key[own])) == 1 and (number[own] == i).all() and len(own) == (key == key[own[0]]).sum()
