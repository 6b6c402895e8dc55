from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.operators import nulls
from tests.test_signature import make


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("n, size", [(8, 5), (50, 3), (200, 40), (1000, 900)])
def test_walk_over_places(order, n, size):
    x = np.random.default_rng(n).integers(size, size=n).astype(np.int32)
    after = defaultdict(set)
    for p in range(n - order):
        after[tuple(x[p : p + order])].add(x[p + order])
    walk = nulls._Walk(x, order, size, np.random.default_rng(1))
    got = np.concatenate([walk.words(k) for k in (0, 1, 3, n, 2 * n)])
    assert len(got) == 3 * n + 4 and got.max() < size
    runs = [tuple(got[i : i + order + 1]) for i in range(len(got) - order)]
    assert all(r[-1] in after[r[:-1]] for r in runs if r[:-1] in after)


def test_repeated_pairs_by_ranges():
    a, b = np.random.default_rng(2).integers(9, size=(2, 300)).astype(np.int32)
    number, places, bounds = nulls._repeated(a, b, None, 16)
    known = defaultdict(list)
    for p in range(300):
        known[a[p], b[p]].append(p)
    for at in known.values():
        c = number[at[0]]
        assert (number[at] == c).all() and (c == -1 if len(at) == 1 else places[bounds[c] : bounds[c + 1]].tolist() == at)


def test_hashed_runs_are_the_transitions(spark):
    lines = make(spark, [["a", "b", "a"], [], ["b", "a", "c"], ["a", "b"]])
    want = nulls.markov_transitions(lines).select("c").orderBy("c").collect()
    assert nulls.hashed_runs(lines).groupBy("state", "next").agg(F.count("*").alias("c")).select("c").orderBy("c").collect() == want
    walk = nulls.markov_chain(lines, replicates=2)
    assert walk.where(F.size("words") == 0).count() == 2 and walk.count() == 8


def test_models_one_after_another(spark, monkeypatch):
    lines = make(spark, [["a", "b", "a"], [], ["b", "a", "c"], ["a", "b"]])
    whole = nulls.all_models(lines).groupBy("model").agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))
    want = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in nulls.model_sizes(lines).collect()} == want and len(want) == 6
    assert nulls.model_sizes(lines.limit(0)).count() == 0
