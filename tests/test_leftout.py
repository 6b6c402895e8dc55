import random

import numpy as np
import pytest

from quirelab.operators import coded, leftout, resample, signature
from quirelab.plans import experiments as plans
from tests.test_signature import make


def corpus(seed: int) -> coded.Numbers:
    rng = random.Random(seed)
    n_groups, n_lines, n_words = rng.choice([1, 2, 5, 15]), rng.choice([4, 40, 300]), rng.choice([1, 4, 40, 2000])
    numbers: dict[int, int] = {}
    groups = [numbers.setdefault(g, len(numbers)) for g in (rng.randrange(n_groups) for _ in range(n_lines))]
    sizes = [rng.choice([0, 1, 2, 5, 30]) * (g > 0 or seed % 3 > 0) for g in groups]
    words = [min(int(rng.paretovariate(0.6)) - 1, n_words - 1) for _ in range(sum(sizes))]
    for _ in range(6):  # passages that repeat
        a, b, k = rng.randrange(len(words) + 1), rng.randrange(len(words) + 1), rng.randrange(1, 90)
        k = min(k, len(words) - max(a, b))
        words[a : a + k] = words[b : b + k]
    return coded.Numbers(np.array(words, np.int32), np.array(sizes, np.int64), np.array(groups, np.int64), n_words)


@pytest.mark.parametrize("seed", range(12))
def test_is_the_signature_without_the_group(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(leftout, "CHANGES", 64)
        monkeypatch.setattr(leftout, "PLACES", 64)
    c = corpus(seed)
    apart, by, starts = leftout.Apart(c), np.argsort(c.groups, kind="stable"), np.cumsum(c.sizes) - c.sizes
    got: dict[str, list[np.ndarray]] = {}
    for name in leftout.PARTS:
        for f, v in leftout.part(apart, name).items():
            got.setdefault(f.split(":")[0], []).append(v)
    for g in range(apart.n_groups):
        rest = by[c.groups[by] != g]
        want = coded.signature(coded.Numbers(coded.gathered(c.words, starts[rest], c.sizes[rest]), c.sizes[rest], c.groups[rest], c.size), False)
        for f in {*want, *got}:
            values = [v[g] for v in got[f] if not np.isnan(v[g])]
            assert (np.mean(values) if values else None) == (want.get(f) if want.get(f) is None else pytest.approx(want[f], abs=1e-8)), (g, f)


def test_homogeneity_takes_no_copies(spark, monkeypatch):
    """The query has the plan's values and makes no copy of the corpus for a quire."""
    rng = random.Random(4)
    rows = [[f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(rng.choice([0, 1, 2, 4, 7]))] for _ in range(120)]
    lines = make(spark, rows, ["" if i < 4 else f"q{i // 9 % 7}" for i in range(120)])
    want = {(r["left_out"], r["field"]): r["value"] for r in signature.joint_signature(resample.without_each_group(lines), None, ["left_out"], False).collect() if r["value"] is not None}
    found = {}
    monkeypatch.setattr(plans, "lines_of", lambda spark, d: lines)
    monkeypatch.setattr(resample, "without_each_group", None)
    one = resample.homogeneity
    monkeypatch.setattr(resample, "homogeneity", lambda observed, apart: found.update(apart=apart.collect()) or one(observed, apart))
    assert plans.QUERIES["homogeneity"](spark, "").count() > 10
    got = {(r["left_out"], r["field"]): r["value"] for r in found["apart"]}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
