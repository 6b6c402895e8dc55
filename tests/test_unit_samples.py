"""G6 from numbers: units of many samples of one vocabulary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.operators import units
from quirelab.operators.corpus import word_bag
from quirelab.operators.resample import bootstrap_draws
from tests.test_signature import make


@pytest.mark.parametrize("letters", ["ab", "abc", "aéz😀"])
def test_units_of_samples(letters):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(400)})
    stock = units.Stock(*units._texts(words), 60)
    for k in range(6):
        counts = [rng.randint(0, 1 + 3 * k) for _ in words]
        assert stock.units(np.array(counts)) == units.merges({w: c for w, c in zip(words, counts) if c}, 60)[0]
    assert stock.units(np.zeros(len(words), int)) == []


def test_samples_are_not_exchanged(spark, monkeypatch):
    """The stability is that of samples put together word by word; no table of samples by words is merged."""
    rng = random.Random(5)
    groups = [f"g{i % 6}" for i in range(60)]
    lines = make(spark, [["".join(rng.choice("abcd"[: 2 + i % 3]) for _ in range(rng.randint(1, 6))) for _ in range(8)] for i in range(60)], groups)
    times = bootstrap_draws(lines, 5, 42).groupBy("iter", "grp").agg(F.count("*").alias("m"))
    counts = times.join(word_bag(lines), "grp").where("word <> ''").groupBy("iter", "word").agg(F.sum("m").alias("c")).collect()
    every = {r["word"]: r["n"] for r in word_bag(lines).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).collect()}
    ref = set(units.merges(every, 30)[0])
    found = []
    for i in range(5):
        own = set(units.merges({r["word"]: r["c"] for r in counts if r["iter"] == i}, 30)[0])
        found.append(len(own & ref) / len(own | ref))
    inventory = units.unit_inventory
    monkeypatch.setattr(units, "unit_inventory", lambda types, by=(), *a: inventory(types, by, *a) if not by else pytest.fail("samples were exchanged"))
    got = units.bootstrap_stability(lines, 5, 30).first()
    assert got["iterations"] == 5
    assert (got["mean_jaccard"], got["sd"]) == pytest.approx((np.mean(found), np.std(found, ddof=1)))
