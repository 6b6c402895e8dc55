import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.llm import consensus as cs
from quirelab.llm.consensus import consensus, fit_patterns, label_pattern

NAMES = ["A", "B", "C", "D"]


def cols():
    return {n: F.col(n.lower()) for n in NAMES}


def simulate(rng, n, rates):
    rows = []
    for j in range(n):
        truth = f"t{j}"
        rows.append((j, *((truth if rng.random() < r else f"e{j}{rng.randrange(2)}") if rng.random() < 0.9 else None for r in rates), "clash", 3))
    return rows


SCHEMA = "id long, a string, b string, c string, d string, pattern string, pick int"


def test_recovers_reliability_and_majority(spark):
    rng = random.Random(5)
    rates = (0.95, 0.6, 0.8, 0.7)
    rows = simulate(rng, 2000, rates)
    out, fit = consensus(spark.createDataFrame(rows, SCHEMA), "id", cols())
    assert fit.order() == ["A", "C", "D", "B"]
    assert np.abs(fit.reliability - np.array(rates)).max() < 0.12
    got = {r["item"]: r for r in out.collect()}
    right = 0
    for j, *labels in ((r[0], *r[1:5]) for r in rows):
        given = [x for x in labels if x is not None]
        if not given:
            assert got[j]["consensus"] is None
            continue
        top = max(given.count(x) for x in given)
        tied = {x for x in given if given.count(x) == top}
        want = next(labels["ABCD".index(a)] for a in fit.order() if labels["ABCD".index(a)] in tied)
        assert got[j]["consensus"] == want and got[j]["n_labels"] == len(given) and got[j]["n_classes"] == len(set(given))
        right += want == f"t{j}"
    assert right / len(rows) > 0.85


def test_pattern(spark):
    df = spark.createDataFrame([(1, "x", None, "x", "y", "", 0), (2, None, None, None, None, "", 0), (3, "q", "r", "q", "r", "", 0)], SCHEMA)
    assert [r[0] for r in df.orderBy("id").select(label_pattern(list(cols().values()))).collect()] == ["0,-,0,3", "-,-,-,-", "0,1,0,1"]


PATTERNS = {"0,0,0,3": 5, "0,1,0,1": 3, "0,0,-,3": 4, "0,1,2,2": 2, "-,-,2,2": 6, "-,1,-,-": 9}


def test_patterns_equal_items():
    """Counting patterns is the same as fitting item by item."""
    one = fit_patterns(PATTERNS, NAMES)
    many = fit_patterns({p: 2 * c for p, c in PATTERNS.items()}, NAMES)
    assert np.allclose(one.tilt, many.tilt) and one.agreement == pytest.approx(many.agreement)
    assert np.allclose(one.posterior(list(PATTERNS)).sum(1), 1)


def test_same_fit_in_spark(spark, monkeypatch):
    """Where patterns are summed up changes nothing."""
    table = spark.createDataFrame(list(PATTERNS.items()), "pattern string, count long").repartition(3)
    a, b = fit_patterns(PATTERNS, NAMES, rounds=4), fit_patterns(table, NAMES, rounds=4)
    assert np.allclose(a.tilt, b.tilt) and np.allclose(a.reliability, b.reliability) and a.agreement == pytest.approx(b.agreement)
    rows = spark.createDataFrame(simulate(random.Random(6), 60, (0.9, 0.6, 0.8, 0.7)), SCHEMA)
    small = sorted(map(tuple, consensus(rows, "id", cols(), rounds=3)[0].collect()))
    monkeypatch.setattr(cs, "ON_DRIVER", 3)
    large = sorted(map(tuple, consensus(rows, "id", cols(), rounds=3)[0].collect()))
    assert [r[:5] + r[6:] for r in small] == [r[:5] + r[6:] for r in large]
    assert [r[5] for r in small] == pytest.approx([r[5] for r in large])


def test_many_annotators(spark):
    """Twelve annotators, three of them good."""
    rng = random.Random(7)
    rows = []
    for j in range(60):
        rows.append((j, *(f"t{j}" if rng.random() < (0.95 if i < 3 else 0.5) else f"e{j}{rng.randrange(4)}" for i in range(12))))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"a{i} string" for i in range(12)))
    out, fit = consensus(df, "id", {f"a{i}": F.col(f"a{i}") for i in range(12)})
    assert set(fit.order()[:3]) == {"a0", "a1", "a2"}
    assert sum(r["likeliest"] == f"t{r['item']}" for r in out.collect()) >= 57


def test_classes_where_the_plurality_is_wrong(spark):
    """Two good annotators against three who give the same class to nearly everything, or take one class for another."""
    rng = random.Random(9)
    truth, votes = {}, []
    for j in range(600):
        c = rng.randrange(4)
        truth[j] = str(c)
        for name in "AB":
            votes.append((j, name, str(c if rng.random() < 0.93 else rng.randrange(4))))
        for name in "CD":
            votes.append((j, name, "0" if rng.random() < 0.95 else str(c)))
        votes.append((j, "E", {"1": "2", "2": "1"}.get(str(c), str(c))))
    votes += votes[:50] + [(None, "A", "1"), (3, None, "1"), (4, "F", None)]
    df = spark.createDataFrame(votes, "id long, who string, label string").repartition(3)
    out, fit = cs.class_consensus(df, "id", "who", "label")
    got = {r["item"]: r for r in out.collect()}
    assert len(got) == 600
    right = sum(got[j]["consensus"] == truth[j] for j in truth)
    plural = sum(got[j]["plurality"] == truth[j] for j in truth)
    assert right > 0.9 * 600 and right > plural + 60, (right, plural)
    assert fit.confusion[fit.annotators.index("E"), 1, 2] > 0.8
    assert fit.confusion[fit.annotators.index("A"), 3, 3] > 0.8
    empty, _ = cs.class_consensus(df.limit(0), "id", "who", "label")
    assert empty.count() == 0


def test_alpha(spark):
    votes = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (3, "b"), (4, "c"), (5, None), (None, "a")]
    r = cs.alpha(spark.createDataFrame(votes, "i long, l string"), "i", "l").first()
    # Worked by hand: 7 labels of 3 items; disagreement 2 of item 2; label totals a 3, b 4.
    assert r["items"] == 3 and r["labels"] == 7
    assert r["observed"] == pytest.approx(2 / 7) and r["expected"] == pytest.approx(24 / 42) and r["alpha"] == pytest.approx(0.5)
    none = cs.alpha(spark.createDataFrame([], "i long, l string"), "i", "l").first()
    assert none["items"] == 0 and none["alpha"] is None


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    out, fit = consensus(none, "id", cols())
    assert out.count() == 0 and np.isfinite(fit.tilt).all()
    single = spark.createDataFrame([(1, "x", None, None, None, "", 0), (1, "x", None, None, None, "", 0), (2, "w " * 100_000, "w " * 100_000, "z", "z", "", 0)], SCHEMA)
    out, _ = consensus(single, "id", cols())
    rows = {r["item"]: r for r in out.collect()}
    assert out.count() == 3 and rows[1]["consensus"] == "x" and rows[1]["agreement"] is None and rows[2]["agreement"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        consensus(none, "id", {})
