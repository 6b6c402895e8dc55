import random

from quirelab.operators import experiments, mechanisms
from quirelab.plans import experiments as plans
from tests.test_signature import make

FRACTAL = {"hurst_dfa", "multifractal_delta_h", "box_dimension"}


def test_fractal_fields_have_intervals_and_scores(spark, monkeypatch):
    rng = random.Random(5)
    rows = [[f"w{min(int(rng.paretovariate(1)), 60)}" for _ in range(rng.randint(4, 9))] for _ in range(400)]
    lines = make(spark, rows, [f"g{i // 40}" for i in range(400)])
    monkeypatch.setattr(plans, "lines_of", lambda spark, d: lines)
    _, _, intervals = plans._intervals(spark, "", 3)
    got = {r["field"]: r for r in intervals.collect()}
    for f in FRACTAL:
        assert got[f]["observed"] is not None and got[f]["lower"] <= got[f]["observed"] <= got[f]["upper"] and got[f]["sd"] > 0
    made = mechanisms.generate(spark, experiments.attachment_grid()[:2], rows, 600)
    with_three = experiments.score_grid(made, intervals).collect()
    less = experiments.score_grid(made, intervals, fractal=False).collect()
    assert [r["total"] - 3 for r in with_three] == [r["total"] for r in less]
    assert experiments.null_baseline(lines, intervals).first()["total"] == 3 + experiments.null_baseline(lines, intervals, fractal=False).first()["total"]
