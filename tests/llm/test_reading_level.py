import numpy as np
from pyspark.sql import functions as F

from quirelab.llm import reading_level as rl
from quirelab.llm.trees import Boosted, isotonic

EASY = "The dog ran to the red box. A cat saw one map. My hat is on the bed. "
HARD = "Neither interdependent parameterisation necessitates heterogeneous stratification, notwithstanding that orthographic classification characterises whichever morphological interpretation concerning palaeographical reconstruction. "


def docs(spark, n=300):
    rows = []
    for i in range(n):
        level = i % 5 + 1
        text = EASY * (5 - level) * 2 + HARD * (level - 1) * 2
        rows.append((i, text + f"\nfol.io.words\n(see p. {i}) \"quoted\" ", ["en", "EN ", "en-GB"][i % 3], f"s{i % 4}", level, 0.5))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, true_level int, level double")


def labels(spark, n=300):
    rows = [(i, f"r{k}", min(5, max(1, i % 5 + 1 + (1 if (i + k) % 7 == 0 else 0)))) for i in range(0, n, 2) for k in range(3)]
    return spark.createDataFrame(rows + rows[:20] + [(5, "r1", None), (None, "r1", 2), (7, None, 3), (9, "r9", 44)], "doc_id long, rater string, reading_level int")


def test_trains_and_predicts(spark):
    d = docs(spark)
    model = rl.train(d, labels(spark))
    got = rl.reading_levels(d, model).join(d.select("doc_id", "true_level"), "doc_id").collect()
    assert len(got) == 300 and all((r["level"] >= 3.5) == (r["true_level"] >= 4) for r in got)
    assert {r[0] for r in model.report} == {"s0", "s2", "s3"} and all(r[4] > 0.9 for r in model.report)
    few = rl.train(d, labels(spark), max_train=60)
    assert sum(r[1] for r in few.report) < 110


def test_edges(spark):
    d = docs(spark, 10)
    odd = spark.createDataFrame([(900, None, "en", "s"), (901, "", "en", "s"), (902, "too few words", "en", "s"), (903, HARD, None, "s"), (904, HARD, "de", "s"), (905, ". . . " * 20, "en", None), (None, HARD, "en", "s"), (906, HARD * 6000, " English", None), (907, "> " + HARD, "en", "s")], "doc_id long, text string, lang string, source string")
    none = rl.train(odd.limit(0), labels(spark).limit(0))
    assert none.report == [] and rl.reading_levels(d, none).where("level >= 3.5").count() == 0
    model = rl.train(docs(spark), labels(spark))
    got = {r["doc_id"]: r["level"] for r in rl.reading_levels(odd, model).collect()}
    assert set(got) == {906} and got[906] > 3.5
    assert rl.reading_levels(odd.limit(0), model).count() == 0


def test_prose(spark):
    text = 'Part two\n\nThe dog ran. "daiin ol" It _sat_ down (see p. 3).\n> a quoted line here.\nol.chedy.daiin\n-- Then it slept.\nNo end mark\nHere it goes on and on and on.'
    got = spark.createDataFrame([(text,)], "t string").select(rl.running_prose(F.col("t"))).first()[0]
    for gone in ("Part two", "daiin", "sat", "see p", "quoted line", "chedy", "No end"):
        assert gone not in got
    for kept in ("The dog ran", "Then it slept", "Here it goes"):
        assert kept in got


def test_language(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "EN", " en ", "en-GB", "English", "en_US", "de", "fren", "", None)], "l string")
    assert [r[0] for r in df.select(rl.is_english(F.col("l"))).collect()] == [True] * 6 + [False] * 4


def test_combined(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "b", 4), (1, "c", 5), (2, "a", 1), (2, "a", 3)]
    got = {r["doc_id"]: (r["level"], r["raters"]) for r in rl.combined_labels(spark.createDataFrame(rows, "doc_id long, rater string, reading_level int")).collect()}
    assert got == {1: (4.0, 3), 2: (2.0, 1)}


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = np.where(x[:, 0] > 0.5, 2.0, 0.0) + x[:, 1]
    model = Boosted().fit(x[:2000], y[:2000], np.ones(2000))
    assert np.abs(model.predict(x[2000:]) - y[2000:]).mean() < 0.12
    assert model.predict(x[:0]).shape == (0,) and Boosted().predict(x).tolist() == [0.0] * 3000
    constant = Boosted().fit(np.ones((20, 2)), np.arange(20.0), np.ones(20))
    assert np.allclose(constant.predict(np.ones((3, 2))), 9.5)
    kx, ky = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]), np.ones(4))
    assert np.allclose(np.interp([1, 2, 3, 4], kx, ky), [1, 2.5, 2.5, 4])


def test_features_whatever_the_chunks(monkeypatch):
    from quirelab.llm import textvec

    texts = [EASY, "", HARD, EASY + HARD, "...", "one two three. four five six"]
    whole = rl.features(texts)
    monkeypatch.setattr(textvec, "CHUNK", 10)
    assert np.allclose(rl.features(texts), whole) and whole[1].sum() == 0
