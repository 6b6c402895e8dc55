import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelab.operators import coded, coding, corpus, experiments, mechanisms, nulls, resample, signature
from quirelab.session import cut, whole_executor
from tests.test_signature import make


def _lines(spark, rows=700, seed=3):
    rng = random.Random(seed)
    # Few words stand four times in a row: what is left of a straight profile is rounding, and the plans' is larger.
    words = [[f"w{int(40 * rng.random() ** 2 * rng.paretovariate(1.5))}" for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for _ in range(rows)]
    words[50:60] = words[10:20]
    return make(spark, words, ["" if i < 20 else f"q{(i // 30) % 17}" for i in range(rows)])


def test_replicates_have_the_joint_signature(spark):
    """All fields of the corpus and of its bootstrap samples, as by the plans over whole copies."""
    lines = _lines(spark)
    many = resample.resampled(lines, resample.bootstrap_draws(lines, 2))
    want = {(r["iter"], r["field"]): r["value"] for r in signature.joint_signature(many, None, ["iter"]).collect()}
    want |= {(-1, r["field"]): r["value"] for r in signature.joint_signature(lines).collect()}
    got = {(r["iter"], r["field"]): r["value"] for r in coded.signatures(spark, coded.store(cut(lines)), [-1, 0, 1], signature.FIELDS).collect()}
    assert set(got) == set(want) and sum(v is not None for v in got.values()) == 3 * 17
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)), k


@pytest.mark.parametrize("rows", [[], [[]], [["a"]], [["a", "a"]], [["a", "b"], [], ["a", "b", "a", "b"]], [["x"] * 60]])
def test_small_corpora(spark, rows):
    lines = make(spark, rows)
    want = {r["field"]: r["value"] for r in signature.joint_signature(lines).collect()}
    got = {r["field"]: r["value"] for r in coded.signatures(spark, coded.store(cut(lines)), [-1], signature.FIELDS).collect()}
    assert got == {f: None if v is None else pytest.approx(v, abs=1e-12) for f, v in want.items()}


@pytest.mark.parametrize("size", [2, 9, 60])
def test_costs(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 2, 3, 50, 700):
        x = rng.integers(size, size=n).astype(np.int32)
        for window in (7, 64):
            assert coded.lz77_cost(x, window, block=100) == sum(2 if k else 1 for _, _, k in coding.longest_matches(x.tolist(), window, 3, True))


def test_pairs_in_ranges(monkeypatch):
    """Pairs of a large vocabulary are counted in ranges of the first word."""
    x = np.random.default_rng(1).integers(0, 40, 3000).astype(np.int32) * np.int32(50_000)
    for size in (2_000_000, 50_000_000):
        key = np.unique(x[:-3].astype(np.int64) * size + x[3:], return_counts=True)[1]
        pairs = coded._Pairs(x, size)
        assert len(pairs.parts) > 1 and pairs.clogs([3])[0] == pytest.approx(float((key * np.log2(key)).sum()))


def test_null_model_is_scored_in_one_task(spark, monkeypatch):
    """The shuffled corpus is scored as by the plans, without them."""
    lines = _lines(spark, 500)
    whole = signature.joint_signature(nulls.word_shuffle(lines))
    bounds = cut(whole.select("field", (whole["value"] - 1e-9).alias("lower"), (whole["value"] + 1e-9).alias("upper")))
    monkeypatch.setattr(experiments, "joint_signature", None)
    row = experiments.null_baseline(lines, bounds).first()
    assert row["matches"] == row["total"] == 16


def test_grids_are_scored_where_they_are_made(spark):
    """Type counts and signatures of a grid's corpora from one run, as from the written corpora."""
    lines = _lines(spark, 300)
    configs = [experiments.attachment_grid()[2], experiments.self_citation_grid()[1], experiments.fractal_grid()[0], experiments.vocabulary_grid()[5]]
    seed, _ = mechanisms.seed_table(lines)
    rows = cut(mechanisms.scored_rows(spark, configs, coded.store(cut(lines)), 400, [42], signature.FIELDS))
    made = cut(mechanisms.generate(spark, configs, seed, 400))
    want = {(r["config_id"], r["field"]): r["value"] for r in signature.joint_signature(made, None, ["config_id"], False).collect()}
    got = {(r["config_id"], r["field"]): r["value"] for r in rows.where("field is not null").collect()}
    fractal = {"hurst_dfa", "multifractal_delta_h", "box_dimension"}
    assert set(got) == set(want) and all(got[i, f] is not None for i in range(3) for f in fractal)
    assert all(got[k] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)) for k, v in want.items() if k[1] not in fractal)
    ties = mechanisms.grid_type_counts(spark, configs, seed, 400)
    assert sorted(map(tuple, rows.where("field is null").drop("field", "value").collect())) == sorted(map(tuple, ties.collect()))


def test_triples(spark):
    """Parses without overlap, of random and of repeated texts, whatever the length."""
    rng = np.random.default_rng(4)
    for size in (2, 5, 40):
        x = rng.integers(size, size=900).astype(np.int32)
        assert coded.lz77_triples(x, [8, 64, 256]) == [sum(1 for _ in coding.longest_matches(x.tolist(), w, 3, False)) for w in (8, 64, 256)]
    for text in ("abcabdabe", "it was the best of times it was the worst", "abcdefghijklmnopqrstuvwxyz", "a", "ab"):
        ids = np.array([ord(c) for c in text], np.int32)
        for n in (0, 1, 5, 90, 777, 3001):
            for window in (8, 20, 64):
                x = np.resize(ids, n).astype(np.int32) if n else np.zeros(0, np.int32)
                assert coded.periodic_triples(ids, n, window) == sum(1 for _ in coding.longest_matches(x.tolist(), window, 3, False))
                x[-1:] = 7
                assert coded.periodic_triples(ids, n, window, last=7) == sum(1 for _ in coding.longest_matches(x.tolist(), window, 3, False))


def test_profiles_are_those_of_the_streams(spark):
    """Each corpus's ratios as by one parse after another, also for controls longer than a window."""
    lines = _lines(spark, 200).select(F.lit("observed").alias("name"), "line_no", "grp", "words")
    texts = spark.createDataFrame([("a", "it was the best of times it was the worst of times"), ("b", "aab")], "name string, t string")
    both = cut(lines.unionByName(coding.control_corpus(texts, "name", F.col("t"), 20_001)).unionByName(coding.control_corpus(texts.where("name = 'b'").withColumn("name", F.lit("small")), "name", F.col("t"), 90)))
    flat = corpus.words(both, ["name"])
    stream = flat.select("name", F.col("pos").alias("i"), F.col("word").alias("sym"))
    whole = both.where(F.size("words") > 0).select("name", F.col("line_no").alias("i"), F.array_join("words", "").alias("sym"))
    got = {r["name"]: r for r in coding.compression_profile(both, flat, ["name"]).collect()}
    assert set(got) == {"observed", "a", "b", "small"} and set(got["small"][1:]) == {0.0}
    for field, df in [*((f"lz77_w{w}", coding.lz77_ratio(stream, ["name"], w)) for w in (64, 256, 1024)), ("huffman", coding.huffman_ratio(stream, ["name"])), ("lz77_line", coding.lz77_ratio(whole, ["name"], 256))]:
        for name, value in df.where("name <> 'small'").collect():
            assert got[name][field] == pytest.approx(value, abs=1e-12), (name, field)


@pytest.mark.parametrize(("master", "cores", "want"), [("local[4]", "0", None), ("local-cluster[3,2,3000]", "0", 2), ("spark://x:7077", "4", 4), ("yarn", "0", None), ("yarn", "1", None)])
def test_large_tasks_have_an_executor_to_themselves(spark, master, cores, want):
    class Context:
        def getConf(self):
            return {"spark.executor.cores": cores}

    class Session:
        sparkContext = Context()

    Context.master = master
    got = whole_executor(Session())
    assert (got and got.taskResources["cpus"].amount) == want


def test_many_empty_lines_are_passed_over():
    """Citing goes on however many empty lines are drawn in all, as long as some have words."""
    rng = np.random.default_rng(0)
    seed = [[f"w{x}" for x in rng.integers(0, 4000, k).tolist()] for k in rng.integers(0, 12, 3000).tolist()]
    assert len(mechanisms.self_citation(seed, 30_000, experiments.self_citation_grid()[3], np.random.default_rng([42, 3]))) == 30_000
