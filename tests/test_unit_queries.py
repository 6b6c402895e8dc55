import pytest

from quirelab.operators import units
from quirelab.plans import experiments, pipelines


@pytest.mark.parametrize("query", [experiments.QUERIES["bpe_bootstrap"], pipelines.QUERIES["unit_discovery"]])
def test_a_hundred_samples(spark, data, monkeypatch, query):
    asked, draws = [], units.bootstrap_draws
    monkeypatch.setattr(units, "bootstrap_draws", lambda lines, iterations, seed: asked.append(iterations) or draws(lines, iterations, seed))
    query(spark, data)
    assert asked == [100]
