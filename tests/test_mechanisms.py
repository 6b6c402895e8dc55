import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.operators import corpus, experiments, mechanisms
from quirelab.plans import experiments as plans
from quirelab.plans.corpus import lines_of
from tests.test_signature import make


@pytest.mark.parametrize("name", ["pa_grid", "fractal_grid"])
def test_grids_are_as_large_as_the_corpus(spark, data, name):
    n = corpus.words(lines_of(spark, data)).count()
    rows = plans.QUERIES[name](spark, data).collect()
    assert len(rows) == 6
    if name == "pa_grid":
        assert {r["lines"] for r in rows} == {n}
    else:
        assert all(abs(r["words"] - n) < 10 for r in rows)


def test_seed_is_the_whole_corpus(spark):
    """Words beyond the first 50 lines are cited too, and the counts of line types are those of the corpora."""
    lines = make(spark, [[f"w{i}", "x", "y"][: i % 4] for i in range(120)])
    configs = [experiments.attachment_grid()[0], experiments.self_citation_grid()[1], experiments.dictionary_grid()[0], *experiments.vocabulary_grid()[:1], *experiments.vocabulary_grid()[-1:]]
    seed, n = mechanisms.seed_table(lines)
    assert n == 180
    made = mechanisms.generate(spark, configs, seed, n).cache()
    every = {r["w"] for r in lines.select(F.explode("words").alias("w")).collect()}
    for i in range(3):
        rows = [r["words"] for r in made.where(f"config_id = {i}").orderBy("line_no").collect()]
        assert len(rows) == n and {w for x in rows for w in x} == every
        assert rows[:120] == [r["words"] for r in lines.orderBy("line_no").collect()]
    want = {r["config_id"]: r for r in experiments.line_type_statistics(made, ["config_id", "seed"]).collect()}
    got = experiments.grid_statistics(mechanisms.grid_type_counts(spark, configs, seed, n)).collect()
    assert len(got) == 5
    for r in got:
        w = want[r["config_id"]]
        assert (r["lines"], r["types"]) == (n, w["types"])
        assert (r["hapax_ratio"], r["zipf_slope"]) == pytest.approx((w["hapax_ratio"], w["zipf_slope"]))
    assert {r["words"] for r in got} == {r["n"] for r in made.groupBy("config_id").agg(F.sum(F.size("words")).alias("n")).collect()}


def test_changes_at_once():
    seed = mechanisms.Coded.of(mechanisms.pa.array([["a", "b", "c", "d", "e"], [], ["a"]], mechanisms.pa.list_(mechanisms.pa.string())))
    flat, k = mechanisms._strong_changes(seed, np.repeat([0, 1, 2], 400), 0.5, np.random.default_rng(3))
    assert k.tolist() == [5] * 400 + [1] * 800
    rows = flat[:2000].reshape(400, 5)
    changed = rows != np.arange(5)
    assert set(changed.sum(1)) == {2} and changed.any(0).all() and set(rows.ravel()) == set(range(5))
    assert set(flat[2000:2400]) == set(range(5)) and set(flat[2400:]) == set(range(1, 5))


def test_grids_are_scored(spark, data, monkeypatch):
    """Every sweep is scored on corpora of the corpus's size, against intervals of thirty iterations."""
    asked = []
    bounds = spark.createDataFrame([("hapax_ratio", 0.0, 1.0), ("length_mean", -2.0, -1.0)], "field string, lower double, upper double")
    lines = make(spark, [[f"w{i % 7}", f"v{i}", "x"] for i in range(60)])

    def intervals(spark, d, iterations=30, fractal=False):
        asked.append(iterations)
        return lines, None, bounds

    monkeypatch.setattr(plans, "_intervals", intervals)
    rows = plans.QUERIES["self_citation_grid"](spark, data).collect()
    assert len(rows) == 6 and all(r["lines"] == 180 and 1 <= r["matches"] < r["total"] for r in rows)
    assert [r["matches"] for r in rows] == sorted((r["matches"] for r in rows), reverse=True)
    assert len(plans.QUERIES["sweep_scores"](spark, data).collect()) == 6
    plans.QUERIES["interval_score"](spark, data)
    assert asked == [30, 30, 30]
