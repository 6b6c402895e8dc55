import random

import pytest

from quirelab.operators import units
from tests.test_signature import make


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéß𝄞"])
def test_units_of_many_types_are_the_same(letters):
    rng = random.Random(len(letters))
    types = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.randint(1, 9) for _ in range(300)}
    words = list(types)
    for vocabulary in (3, 40, 500):
        got = units.merges_of_many([words[:100], words[100:]], [[types[w] for w in words[:100]], [types[w] for w in words[100:]]], vocabulary)
        assert got == units.merges(types, vocabulary)[0]
    assert units.merges_of_many([], []) == []


def test_units_by_group(spark, monkeypatch):
    rng = random.Random(4)
    rows = [["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20)] for _ in range(30)]
    lines = make(spark, rows, [f"g{i % 3}" for i in range(30)])
    want = set()
    for g in range(3):
        own = [w for i, r in enumerate(rows) if i % 3 == g for w in r]
        want |= {(f"g{g}", k, u) for k, u in enumerate(units.merges({w: own.count(w) for w in own}, 60)[0])}
    assert {tuple(r) for r in units.group_inventories(lines, 60).select("grp", "rank", "unit").collect()} == want
    monkeypatch.setattr(units, "MANY", 5)
    assert {tuple(r) for r in units.group_inventories(lines, 60).select("grp", "rank", "unit").collect()} == want
