import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelab.operators import corpus, experiments, mechanisms, nulls, resample, signature, units
from tests.test_signature import make

SEED = [["a", "b", "c"], ["b", "c", "d"], ["c", "d", "e"], ["d", "e", "a"], ["e", "a", "b"]]


def test_folds_golden(spark):
    lines = make(spark, [["w"]] * 20, ["A"] * 10 + ["B"] * 10)
    folds = resample.group_folds(lines, 2, 42)
    got = {r["fold"]: (r["quires"], r["n_rows"]) for r in resample.manifest(lines, folds).collect()}
    assert got == {0: (["B"], 10), 1: (["A"], 10)}
    assert resample.leakage(folds).count() == 0 and resample.coverage(lines, folds).first()["complete"]
    with pytest.raises(ValueError):
        resample.group_folds(make(spark, [["w"]], [""]))
    more = make(spark, [["w"]] * 7, ["A", "B", "C", "D", "E", "F", ""])
    for by_hash in (False, True):
        folds = resample.group_folds(more, 3, 42, by_hash)
        assert sorted(folds.groupBy("fold").count().select("count").toPandas()["count"]) == [2, 2, 2]
        c = resample.coverage(more, folds).first()
        assert (c["missing_groups"], c["covered_rows"], c["complete"]) == (1, 6, False)


def test_bootstrap_and_scores(spark):
    lines = make(spark, SEED * 4, list("AABBC") * 4)
    draws = resample.bootstrap_draws(lines, 6)
    assert draws.groupBy("iter").count().where("count <> 3").count() == 0
    again = resample.resampled(lines, draws)
    per = again.groupBy("iter").agg(F.count("*").alias("n"), F.max("line_no").alias("m")).collect()
    assert len(per) == 6 and all(r["m"] == r["n"] - 1 for r in per)
    observed = signature.joint_signature(lines, None, (), False)
    bounds = resample.tolerance(observed, signature.joint_signature(again, None, ["iter"], False))
    assert bounds.count() == len(signature.FIELDS)
    report = resample.match_report(resample.interval_scores(observed, bounds)).first()
    assert report["matches"] == report["total"] > 5
    unknown = resample.interval_scores(spark.createDataFrame([("x", 1.0), ("y", None), ("cross_agreement", 1.0)], "field string, value double"), bounds).collect()
    assert [(r["field"], r["within"]) for r in unknown] == [("x", False)]


def test_leave_one_out(spark):
    lines = make(spark, [["x"], ["y"], ["z"], ["w"]], ["Q1", "Q1", "Q2", "Q2"])
    apart = resample.without_each_group(lines)
    assert [(r["line_no"], r["words"]) for r in apart.where("left_out = 'Q1'").orderBy("line_no").collect()] == [(0, ["z"]), (1, ["w"])]
    rep = resample.homogeneity(spark.createDataFrame([("f", 1.0)], "field string, value double"), spark.createDataFrame([("a", "f", 2.0), ("b", "f", 0.5), ("c", "f", None)], "left_out string, field string, value double")).first()
    assert (rep["lowest"], rep["highest"], rep["max_change"], rep["extreme_group"], rep["rank"]) == (0.5, 2.0, 1.0, "a", 1)


def bag(df):
    return sorted(tuple(r["words"]) for r in df.collect())


def test_null_models(spark):
    lines = make(spark, [[f"w{i}", f"w{i % 3}"] + ["x"] * (i % 4) for i in range(50)], [f"g{i // 12}" for i in range(50)])
    base = {r["line_no"]: (r["grp"], r["words"]) for r in lines.collect()}
    for f in (nulls.chunk_shuffle, nulls.group_shuffle):
        got = f(lines)
        assert bag(got) == bag(lines) and {r["line_no"]: r["grp"] for r in got.collect()} == {k: v[0] for k, v in base.items()}
        assert bag(f(lines)) == bag(f(lines))
    within = {r["line_no"]: r["words"] for r in nulls.word_shuffle(lines).collect()}
    assert all(sorted(within[k]) == sorted(v[1]) for k, v in base.items()) and within != {k: v[1] for k, v in base.items()}
    moved = {r["line_no"]: r["words"] for r in nulls.group_shuffle(lines).collect()}
    for g in ("g0", "g1"):
        assert sorted(map(tuple, (moved[k] for k, v in base.items() if v[0] == g))) == sorted(tuple(v[1]) for v in base.values() if v[0] == g)
    same = {r["line_no"]: r["words"] for r in nulls.frequency_matched(lines).collect()}
    assert all(len(same[k]) == len(v[1]) for k, v in base.items())
    assert nulls.block_bootstrap(lines).count() == 50
    walk = {r["line_no"]: r["words"] for r in nulls.markov_chain(lines).collect()}
    assert all(len(walk[k]) == len(v[1]) for k, v in base.items())
    assert {w for x in walk.values() for w in x} <= {w for _, x in base.values() for w in x}
    table = {(tuple(r["state"]), r["next"]) for r in nulls.markov_transitions(lines).collect()}
    stream = [w for k in sorted(walk) for w in walk[k]]
    starts = {s for s, _ in table}
    fresh = sum((tuple(stream[i : i + 2]), stream[i + 2]) not in table for i in range(len(stream) - 2))
    assert fresh <= 3 * sum(tuple(stream[i : i + 2]) not in starts for i in range(len(stream) - 2))
    assert walk == {r["line_no"]: r["words"] for r in nulls.markov_chain(lines.repartition(5)).collect()}
    two = nulls.markov_chain(lines, replicates=2)
    assert {r["replicate"] for r in two.collect()} == {0, 1} and two.count() == 2 * len(base)
    assert nulls.all_models(lines).select("model").distinct().count() == 6
    none = lines.limit(0)
    assert nulls.word_shuffle(none).count() == nulls.group_shuffle(none).count() == nulls.block_bootstrap(none).count() == 0


@pytest.mark.parametrize("config", [mechanisms.SelfCitation(), mechanisms.SelfCitation(0.1, 0.5, 0.2, 0.2, "recency", 1.0), mechanisms.SelfCitation(source_weighting="uniform"), mechanisms.Dictionary(), mechanisms.PreferentialAttachment(0.5, 0.5), mechanisms.PureNovelty(), mechanisms.FixedVocabulary(20), mechanisms.TwoRegime()])
def test_mechanisms(config):
    import numpy as np

    run = lambda s: mechanisms.PROCESSES[type(config)](SEED, 300, config, np.random.default_rng(s))
    out = run(1)
    assert len(out) == 300 and out == run(1) and out != run(2)
    assert {w for line in out for w in line} <= set("abcde")
    if isinstance(config, mechanisms.SelfCitation) and config.grammar_strength == 1:
        assert sum(line[0] in "abcde" and line[-1] in "abcde" for line in out) == 300
    if isinstance(config, mechanisms.PureNovelty):
        assert all(len(line) == 3 for line in out)
    assert mechanisms.PROCESSES[type(config)]([], 5, config, np.random.default_rng(1)) == []


def test_mechanism_parameters():
    for bad in (lambda: mechanisms.SelfCitation(0.9), lambda: mechanisms.SelfCitation(source_weighting="x"), lambda: mechanisms.SelfCitation(grammar_strength=2), lambda: mechanisms.Dictionary(0.9), lambda: mechanisms.PreferentialAttachment(0), lambda: mechanisms.Fractal(1.0)):
        with pytest.raises(ValueError):
            bad()


def test_fractal_parts(spark):
    import numpy as np

    from quirelab.operators.series import hurst_dfa
    from tests.test_signature import numbers

    rng = np.random.default_rng(4)
    x = mechanisms.fractional_noise(4096, 0.7, rng)
    assert abs(x.mean()) < 1e-9 and x.std() == pytest.approx(1)
    assert 0.55 < hurst_dfa(numbers(spark, x)).first()["h"] < 0.85
    codes = mechanisms.rank_codes(x, 16)
    assert set(np.bincount(codes)) == {256}
    assert sum(map(len, mechanisms.cut_lines(list(range(1000)), 8, 3, rng))) == 1000
    n, v = 10, 4
    assert np.bincount(mechanisms.rank_codes(np.arange(n), v)).tolist() == [2, 3, 2, 3]
    ranked = corpus.rank_symbols(spark.range(n), ["id"], v).orderBy("id")
    assert [r["symbol"] for r in ranked.collect()] == mechanisms.rank_codes(np.arange(n), v).tolist()


def test_grids(spark):
    assert [len(g()) for g in (experiments.self_citation_grid, experiments.dictionary_grid, experiments.attachment_grid, experiments.fractal_grid, experiments.attachment_sweep, experiments.vocabulary_grid)] == [6, 10, 6, 6, 44, 12]
    made = mechanisms.generate(spark, experiments.vocabulary_grid()[:2], SEED, 40, (1, 2))
    assert made.groupBy("config_id", "seed").count().where("count = 40").count() == 4
    near = experiments.nearest_config(spark.createDataFrame([(0, 0.7, -0.9), (1, 0.1, -0.2), (2, None, None)], "config_id int, hapax_ratio double, zipf_slope double"), "hapax_ratio", "zipf_slope").first()
    assert near["config_id"] == 0
    with pytest.raises(ValueError):
        experiments.scatter_union({"a": None})


def naive_merges(types, vocabulary):
    parts, units = {w: list(w) for w in types}, sorted({c for w in types for c in w})
    while len(units) < vocabulary:
        pairs = {}
        for w, s in parts.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + types[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if "".join(best) not in units:
            units.append("".join(best))
        parts = {w: units_once(s, best) for w, s in parts.items()}
    return units


def units_once(s, pair):
    return units.merge_once(s, pair)


def test_units(spark):
    rng = random.Random(9)
    types = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(60)}
    assert units.merges(types, 25)[0] == naive_merges(types, 25)
    table = spark.createDataFrame(list(types.items()), "word string, c long")
    local = [r["unit"] for r in units.unit_inventory(table, (), 12).orderBy("rank").collect()]
    far = [r["unit"] for r in units.unit_inventory(table, (), 12, local=5).orderBy("rank").collect()]
    assert local == far and len(local) == 12
    made = units.merges(types, 25)[1]
    enc = {r["word"]: r["units"] for r in units.encode_words(table, made).collect()}
    assert all("".join(u) == w for w, u in enc.items())
    lines = make(spark, [list(types)] * 12, ["A", "B", "C"] * 4)
    r = units.bootstrap_stability(lines, 4, 30).first()
    assert r["mean_jaccard"] == 1 and r["sd"] == 0
    p = units.unit_presence(lines, 30).first()
    assert p["n_groups"] == 3 and p["in_all"] == p["in_50pct"] == 30 and p["groups_above_half"] == 3
    assert units.bootstrap_stability(make(spark, [list(types)]), 4, 30).count() == 0
    assert [units.gate(n) for n in (50, 10, 9)] == ["pass", "partial", "fail"] and units.unit_alignment()["status"] == "unavailable"


def test_replicates_are_counted_without_copies(spark, monkeypatch):
    from quirelab.plans import experiments as plans

    rng = random.Random(3)
    rows = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))] for _ in range(90)]
    lines = make(spark, rows, [f"g{i // 9}" for i in range(90)])
    draws = resample.bootstrap_draws(lines, 5)
    many = resample.resampled(lines, draws).select("iter", F.explode("words").alias("word")).groupBy("iter", "word").agg(F.count("*").alias("c"))
    want = {tuple(r) for r in many.groupBy("iter", "c").agg(F.count("*").alias("m")).collect()}
    own = Counter(Counter(w for r in rows for w in r).values())
    assert {tuple(r) for r in resample.resampled_ties(lines, draws, 5).collect()} == want | {(-1, c, m) for c, m in own.items()}

    monkeypatch.setattr(plans, "lines_of", lambda spark, d: lines)
    monkeypatch.setattr(plans, "table", lambda spark, d, name: None)
    monkeypatch.setattr(plans.corpus, "line_bag", lambda df: lines)
    monkeypatch.setattr(resample, "resampled", None)  # a copy of the corpus per iteration
    got = {r["field"]: r["observed"] for r in plans.QUERIES["tolerance_two_fields"](spark, "").collect()}
    assert abs(got["hapax_ratio"] - own[1] / sum(own.values())) < 1e-12 and got["zipf_slope"] < 0
