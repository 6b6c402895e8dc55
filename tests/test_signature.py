import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelab.operators import corpus, experiments, series, signature
from quirelab.operators.boxes import box_dimension, line_points, observed_dimension, stream_dimension

LINES = [["a", "b"], ["b", "c"], ["c", "a"], ["a", "b", "c"], ["b", "a"], ["c", "b"], ["a", "c"], ["b", "c", "a"]]
GROUPS = list("AABBAABB")


def make(spark, lines, groups=None):
    return spark.createDataFrame([(i, g, w) for i, (w, g) in enumerate(zip(lines, groups or ["A"] * len(lines)))], "line_no long, grp string, words array<string>")


def value(df):
    r = df.first()
    return None if r is None else r[0]


def mi(pairs):
    n, x, y, xy = len(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(pairs)
    return sum(c / n * math.log2(c * n / (x[a] * y[b])) for (a, b), c in xy.items())


def test_scalars(spark):
    lines = make(spark, LINES, GROUPS)
    flat = corpus.words(lines)
    w = [x for line in LINES for x in line]
    assert [r["word"] for r in flat.orderBy("pos").collect()] == w
    n, u, b = len(w), Counter(w), Counter(zip(w, w[1:]))
    want = sum(-(c / (n - 1)) * math.log2((c / (n - 1)) / (u[x] / n)) for (x, _), c in b.items())
    assert value(signature.conditional_entropy(flat)) == pytest.approx(want)
    ends = [(LINES[i][-1], LINES[i + 1][0]) for i in range(7)]
    assert value(signature.edge_mi(lines)) == pytest.approx(mi(ends))
    assert value(signature.group_stability(lines, flat)) == 1.0
    d2 = [mi(list(zip(w, w[d:]))) for d in range(2, 5)]
    assert value(signature.mi_plateau(flat, (), 2, 4)) == pytest.approx(sum(x for x in d2 if x > 0) / sum(x > 0 for x in d2))


def test_degenerate(spark):
    assert value(signature.conditional_entropy(corpus.words(make(spark, [["a", "a", "a"]])))) == 0
    r = signature.line_lengths(make(spark, [["a"], ["a", "b"], ["a", "b", "c"], []])).first()
    assert (r[0], r[1], r[2]) == (2, pytest.approx(2 / 3), pytest.approx(0))
    assert signature.line_lengths(make(spark, [["a"], ["b"]])).first()["length_skew"] == 0
    assert value(signature.hapax_ratio(corpus.words(make(spark, [["a", "b"]])))) == 1.0
    assert value(signature.hapax_ratio(corpus.words(make(spark, [["a", "a"]])))) == 0.0
    assert value(signature.zipf_slope(corpus.words(make(spark, [["a", "a"]])))) == 0.0
    assert value(signature.mi_plateau(corpus.words(make(spark, LINES)))) is None
    assert value(signature.edge_mi(make(spark, [["a"], [], ["b"]]))) is None
    assert signature.first_pair_agreement(make(spark, [["a", "a", "b"]])).first()["onset_coda_ratio"] is None
    empty = make(spark, [])
    got = {r["field"]: r["value"] for r in signature.joint_signature(empty).collect()}
    assert set(got) == set(signature.FIELDS) and all(v is None for v in got.values())


def test_joint_by_key(spark):
    one, two = make(spark, LINES, GROUPS), make(spark, LINES[::-1], GROUPS)
    both = one.withColumn("rep", F.lit(1)).unionByName(two.withColumn("rep", F.lit(2)))
    scores = spark.createDataFrame([(0.5,), (None,), (1.0,)], "similarity_score double")
    joint = {(r["rep"], r["field"]): r["value"] for r in signature.joint_signature(both, scores, ["rep"]).collect()}
    for k, lines in ((1, one), (2, two)):
        for r in signature.joint_signature(lines, scores).collect():
            assert joint[k, r["field"]] == (None if r["value"] is None else pytest.approx(r["value"]))
    assert joint[1, "cross_agreement"] == 0.75


def test_blocks_do_not_matter(spark):
    lines = make(spark, LINES * 10)
    small = corpus.prefix(lines, [], "line_no", F.size("words"), "s", block=3)
    assert [r["s"] for r in small.orderBy("line_no").collect()] == [sum(len(x) for x in (LINES * 10)[:i]) for i in range(80)]
    flat = corpus.words(lines)
    got = corpus.followers(flat, [], "pos", "word", [1, 4], block=5).orderBy("pos").collect()
    w = [x for line in LINES * 10 for x in line]
    assert [tuple(r["nexts"]) for r in got] == [(w[i + 1] if i + 1 < len(w) else None, w[i + 4] if i + 4 < len(w) else None) for i in range(len(w))]


def test_mismatch_golden(spark):
    rows = [(True, 1.0, ["ZL", "IT", "CD", "FG", "GC"]), (False, 0.8, ["ZL", "IT", "CD"]), (False, 0.6, ["FG", "GC"]), (True, 0.98, ["ZL", "IT", "CD", "FG", "GC"]), (False, 0.5, ["ZL"])]
    df = spark.createDataFrame(rows, "eva_agreement boolean, similarity_score double, sources_present array<string>")
    r = experiments.transcription_report(df).first()
    assert r["n"] == 5 and r["agreement_pct"] == pytest.approx(40)
    assert (r["mean"], r["median"], r["sd"], r["p10"], r["p90"], r["p99"]) == tuple(map(pytest.approx, (0.776, 0.8, 0.19975985582694036, 0.54, 0.992, 0.9992)))
    assert list(r["histogram"]) == [0, 0, 0, 0, 0, 2, 0, 0, 1, 2]
    assert r["presence"] == {"ZL": 80, "IT": 60, "CD": 60, "FG": 60, "GC": 60}
    assert experiments.transcription_report(df.limit(0)).count() == 0
    assert experiments.transcription_report(df.withColumn("similarity_score", F.lit(None).cast("double"))).first()["mean"] == 0


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")


def test_hurst_bands(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    noise = rng.standard_normal(5000)
    white, walk = numbers(spark, noise), numbers(spark, noise.cumsum())
    e = series.hurst_ensemble(white).first()
    assert 0.35 <= e["dfa"] <= 0.65 and 0.35 <= e["rs"] <= 0.65 and e["mean"] == pytest.approx((e["rs"] + e["dfa"]) / 2)
    assert 0.7 <= value(series.hurst_dfa(walk).select("h")) <= 1 and value(series.hurst_rs(walk).select("h")) > 0.4
    m = series.multifractal(numbers(spark, noise[:2000])).collect()
    assert len(m) == 21 and 0 <= series.multifractal_summary(numbers(spark, noise[:2000])).first()["delta_h"] < 1
    short = numbers(spark, noise[:10])
    assert series.hurst_dfa(short).count() == 0 and series.hurst_ensemble(short).first()["mean"] is None
    assert series.multifractal(numbers(spark, [1.0] * 1500)).count() == 0


def test_by_group(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(g, i, float(rng.standard_normal())) for g, n in (("a", 300), ("b", 400), ("c", 5)) for i in range(n)]
    got = {r["g"] for r in series.by_group(spark.createDataFrame(rows, "g string, i long, v double"), "g", 20, series.hurst_dfa).collect()}
    assert got == {"a", "b", "aggregate"}


def test_stream_boxes(spark):
    few = make(spark, LINES)
    assert stream_dimension(few, corpus.words(few)).count() == 0
    assert observed_dimension(few, corpus.words(few)).first()["status"] == "too few points"
    many = make(spark, [[f"w{(i * j) % 37}" for j in range(12)] for i in range(120)])
    assert stream_dimension(many, corpus.words(many)).first()["dimension"] > 0.5
    seen = observed_dimension(many, corpus.words(many)).first()
    assert seen["n_points"] == 1440 and seen["status"] == "ok"
    one = make(spark, [["a"] * 200])
    assert stream_dimension(one, corpus.words(one)).count() == 0


def test_boxes(spark):
    grid = spark.createDataFrame([(i / 29, j / 29) for i in range(30) for j in range(30)], "x double, y double")
    line = spark.createDataFrame([(i / 99, i / 99) for i in range(100)], "x double, y double")
    g, d = box_dimension(grid).first(), box_dimension(line).first()
    assert 1.7 <= g["dimension"] <= 2.3 and 0.7 <= d["dimension"] <= 1.3 and d["r2"] > 0.9
    assert box_dimension(line.limit(50)).count() == 0
    lines = make(spark, LINES)
    pts = line_points(lines, corpus.words(lines), scale="corpus").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(pts) == (0, 1, 0, 1)
    with pytest.raises(ValueError):
        line_points(lines, corpus.words(lines), scale="page")


def test_sparse_and_dense_orders(spark):
    """Line numbers do not depend on gaps between the ids, and sparse ids make no block of their own."""
    rng = random.Random(4)
    ids = sorted(rng.sample(range(1 << 62), 3000))
    df = spark.createDataFrame([(i, f"w{k}") for k, i in enumerate(ids)], "o long, w string").repartition(5)
    assert corpus.is_sparse(df, "o") and not corpus.is_sparse(spark.range(3000), "id") and not corpus.is_sparse(df.limit(0), "o")
    got = {r["o"]: r["line_no"] for r in corpus.number_lines(df, [], "o").collect()}
    assert got == {i: k for k, i in enumerate(ids)}
    same = {r["o"]: r["line_no"] for r in corpus.number_lines(df, [], "o", sparse=False).collect()}
    assert same == got and corpus.number_lines(df.limit(0), [], "o").count() == 0


def test_ties_in_time(spark):
    """Equal times come in the order of the tie column, however the rows are spread."""
    rows = [(10 * (i // 40), i, float((i * 7) % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "s long, id long, v double").withColumn("t", F.timestamp_seconds("s"))
    want = [r[2] for r in rows]
    for parts in (1, 3, 7):
        got = [r["v"] for r in corpus.time_series(df.repartition(parts), "t", "v", ties=["id"]).orderBy("i").collect()]
        assert got == want
    assert [r["v"] for r in corpus.time_series(df, "t", "v").orderBy("i").collect()][:40] == sorted(want[:40])
