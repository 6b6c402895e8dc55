import random

import pytest

from quirelab.operators import resample, signature
from quirelab.plans import experiments as plans
from quirelab.plans.corpus import lines_of
from tests.test_signature import make


def test_count_fields(spark):
    """Totals minus a group's counts are the signature of the corpus without it."""
    rng = random.Random(8)
    rows = [[f"w{min(int(rng.paretovariate(0.8)), 90)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 7]))] for _ in range(90)]
    lines = make(spark, rows, ["" if i < 4 else f"q{i % 7}" if i < 80 else "hot" for i in range(90)])
    observed, apart = resample.count_fields(lines)
    whole = {r["field"]: r["value"] for r in signature.joint_signature(lines, None, (), False).collect()}
    assert observed.count() == 7
    assert all(whole[r["field"]] == pytest.approx(r["value"], abs=1e-9) for r in observed.collect())
    want = {(r["left_out"], r["field"]): r["value"] for r in signature.joint_signature(resample.without_each_group(lines), None, ["left_out"], False).collect()}
    got = apart.collect()
    assert len(got) == 7 * 9
    assert all(want[r["left_out"], r["field"]] == pytest.approx(r["value"], abs=1e-9) for r in got)


def test_one_quire_at_a_time(spark, data, monkeypatch):
    quires = {r["grp"] for r in lines_of(spark, data).select("grp").distinct().collect()}
    assert {r["extreme_group"] for r in plans.QUERIES["leave_one_quire_out"](spark, data).collect()} <= quires
    lines = make(spark, [["a", "b", f"w{i}"] for i in range(9)], list("XXXYYYZZZ"))
    monkeypatch.setattr(plans, "lines_of", lambda spark, d: lines)
    rows = plans.QUERIES["homogeneity"](spark, data).collect()
    assert len(rows) > 7 and {r["extreme_group"] for r in rows} <= {"X", "Y", "Z"}
