import random

from pyspark.sql import functions as F

from quirelab.operators.diff import diff_copies, diff_mismatches, same_set, same_text

SCHEMA = "mm_id long, zl_text string, it_text string, sources_missing array<string>, u long, key string, side int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA).withColumn("updated_at", F.timestamp_seconds("u")).repartition(3)


def brute(a, b):
    def newest(rows):
        out = {}
        for r in rows:
            if r[0] is not None and (r[0] not in out or (r[4] or -1) > (out[r[0]][4] or -1)):
                out[r[0]] = r
        return out

    text = lambda s: " ".join((s or "").replace("\t", " ").replace("\n", " ").split(" ")).strip() if s else ""
    words = lambda s: " ".join(x for x in text(s).split(" ") if x)
    m, n = newest(a), newest(b)
    out = [(k, "only_main") for k in m.keys() - n.keys()] + [(k, "only_mirror") for k in n.keys() - m.keys()]
    for k in m.keys() & n.keys():
        if words(m[k][1]) != words(n[k][1]):
            out.append((k, "zl_text"))
        if words(m[k][2]) != words(n[k][2]):
            out.append((k, "it_text"))
        if set(m[k][3] or []) - {None} != set(n[k][3] or []) - {None}:
            out.append((k, "sources_missing"))
    return sorted(out)


def test_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a b", "a  b", "a\tb ", "a\nb", "ab", "b a"]
    sets = [None, [], ["X"], ["X", "Y"], ["Y", "X"], ["X", "X"], [None, "X"]]

    def rows(n):
        out = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(texts), rng.choice(sets), i) for i in range(n)]
        return out + out[:7]

    a, b = rows(80), rows(80)
    assert sorted(tuple(r) for r in diff_mismatches(table(spark, a), table(spark, b)).collect()) == brute(a, b)


def test_hot_key_and_batches(spark):
    a = [(5, str(i), "x", None, i) for i in range(3000)] + [(i, "t", "x", None, 0) for i in range(100, 3000)]
    b = [(5, "2999", "x", [], 1)] + [(i, "t" if i % 10 else "u", "x", None, 0) for i in range(100, 3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(tuple(r) for r in diff_mismatches(table(spark, a), table(spark, b)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, "zl_text") for i in range(100, 3000, 10)]


def test_empty_and_identical(spark):
    a = table(spark, [(1, "a", "b", ["X"], 1), (2, None, None, None, None)])
    none = a.limit(0)
    assert diff_mismatches(none, none).count() == 0
    assert diff_mismatches(a, a).count() == 0
    assert sorted(r["issue"] for r in diff_mismatches(a, none).collect()) == ["only_main"] * 2
    long = table(spark, [(1, "w " * 300_000, None, None, 1)])
    assert [r["issue"] for r in diff_mismatches(long, a.where("mm_id = 1")).collect()].count("zl_text") == 1


def test_normal_forms(spark):
    r = spark.createDataFrame([(" a \t b\r\n", ["b", None, "a", "b"])], "t string, s array<string>").select(same_text(F.col("t")), same_set(F.col("s"))).first()
    assert tuple(r) == ("a b", '["a","b"]')
    got = diff_copies(spark.createDataFrame([(1, "x", 1)], "k int, f string, v long").withColumn("v", F.timestamp_seconds("v")), spark.createDataFrame([(1, "y", 1)], "k int, f string, v long").withColumn("v", F.timestamp_seconds("v")), "k", "v", {"f": F.col("f")})
    assert [tuple(r) for r in got.collect()] == [(1, "f")]


def test_values_and_ties(spark):
    a = table(spark, [(1, "x", "same", ["A"], 5), (1, "a", "same", ["A"], 5), (2, None, "k", None, 1), (4, "only", "", None, 1)])
    b = table(spark, [(1, "y ", "same", ["B", "A"], 5), (2, " ", "l", [], 1), (3, "z", "", None, None)])
    got = sorted(tuple(r) for r in diff_mismatches(a, b, values=True).collect())
    # Of two rows with one version the one with the least fields holds, wherever it stands.
    assert got == [(1, "sources_missing", '["A"]', '["A","B"]'), (1, "zl_text", "a", "y"), (2, "it_text", "k", "l"), (3, "only_mirror", None, None), (4, "only_main", None, None)]
    assert got == sorted(tuple(r) for r in diff_mismatches(a.orderBy(F.desc("zl_text")), b, values=True).collect())
    assert diff_mismatches(a.limit(0), b.limit(0), values=True).columns == ["mm_id", "issue", "main_value", "mirror_value"]


def test_ranges(spark, monkeypatch):
    """Shared split points: ranges are of about equal size, and every row has one."""
    from quirelab.operators import diff

    monkeypatch.setattr(diff, "ROWS", 100)
    keys = spark.range(5000).select((F.col("id") * 7 - 900).alias("key"))
    points, hot, n = diff.split_points(keys, 8)
    assert n == 8 and points == sorted(points) and hot == []
    sizes = [r["count"] for r in keys.groupBy(diff.range_number("key", points).alias("p")).count().collect()]
    assert len(sizes) == 8 and min(sizes) > 400
    got = {r["key"]: r["p"] for r in keys.select("key", diff.range_number("key", points).alias("p")).collect()}
    assert all(got[k] == sum(p <= k for p in points) for k in got)
    assert diff.split_points(keys.limit(0), 8)[::2] == ([], 1)
