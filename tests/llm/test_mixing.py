import random

import pytest
from pyspark.sql import functions as F

from quirelab.llm import mixing as mx


def sizes(spark, n=4000):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 == 0 else "mid" if i % 3 == 1 else "tiny" if i % 30 == 2 else "other", rng.randint(0, 900)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = [(" BIG ", 0.5, 1), ("mid", 0.3, 2), ("Tiny", 0.15, 5), ("absent", 0.05, 3), (None, 0.1, 1)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame([(*r, "x") for r in rows], "source string, target_share double, max_repeats int, doc_id string")


def test_shares_and_caps(spark):
    s = sizes(spark)
    rates = mx.plan_rates(s, targets(spark))
    drawn = mx.draw(s, rates)
    rep = {r["source"]: r for r in mx.report(drawn, rates).collect()}
    assert set(rep) == {"big", "mid", "tiny", "absent"} and rep["absent"]["actual_share"] == 0
    there = 0.95
    for k, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15)):
        assert rep[k]["actual_share"] == pytest.approx(share / there, rel=0.02)
    most = {r["source"]: r["m"] for r in drawn.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert all(most[k] <= rep[k]["max_repeats"] for k in most)
    again = {r["doc_id"]: r["copies"] for r in mx.draw(s.repartition(5), rates).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in drawn.collect()}


def test_systematic(spark):
    """Copies are floor or ceil of the rate, and add up to the rate times the documents."""
    s = sizes(spark)
    rates = mx.plan_rates(s, targets(spark), total=700_000)
    drawn = mx.draw(s, rates)
    for r in rates.where("rate > 0").collect():
        own = drawn.where(F.col("source") == r["source"])
        n = s.where((F.col("source") == r["source"]) & (F.col("n_tokens") > 0)).count()
        total = own.agg(F.sum("copies")).first()[0]
        assert abs(total - n * r["rate"]) <= 1
        copies = {x["copies"] for x in own.select("copies").distinct().collect()}
        assert copies <= {int(r["rate"]), int(r["rate"]) + 1}
        assert r["rate"] <= r["max_repeats"]


def test_edges(spark):
    none, t = sizes(spark).limit(0), targets(spark)
    rates = mx.plan_rates(none, t)
    assert mx.draw(none, rates).count() == 0
    assert all(r["actual_share"] == 0 for r in mx.report(mx.draw(none, rates), rates).collect())
    zero = mx.plan_rates(sizes(spark), targets(spark, [("big", None, None), ("mid", 1.0, 0)]))
    assert mx.draw(sizes(spark), zero).count() == 0
    assert mx.plan_rates(none, t.limit(0)).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a note about a note", " NOTES", 0), (2, None, None, 0), (3, "", "x", 0), (None, "a", "x", 0), (4, "word " * 200_000, "x", 0)], "doc_id long, text string, source string, n_tokens int")
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in mx.token_counts(docs).collect()}
    assert got[1] == ("notes", 5) and got[2] == (None, 0) and got[3] == ("x", 0) and len(got) == 4
    assert 200_000 <= got[4][1] <= 200_001
