import random

from pyspark.sql import functions as F

from quirelab.operators.orphans import force_runs, key_number, key_runs, known_keys, orphan_keys, orphan_references, orphans_by_table
from quirelab.operators.skew import hot_keys, salted_join


def stamp(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.timestamp_seconds(c).cast("timestamp_ntz"))
    return df


def test_integer_runs(spark):
    keys = [1, 2, 3, 3, 7, 1023, 1024, 1025, -5, None]
    runs = key_runs(spark.createDataFrame([(k,) for k in keys], "k long"), F.col("k"))
    got = sorted((r.lo, r.hi) for x in runs.collect() for r in x["runs"])
    assert got == [(-5, -4), (1, 4), (7, 8), (1023, 1024), (1024, 1026)]


def test_integer_orphans_brute_force(spark):
    rng = random.Random(1)
    parents = [rng.randrange(3000) for _ in range(1500)]
    refs = [rng.randrange(-10, 3300) for _ in range(2000)] + [17] * 2000 + [None]
    got = orphan_keys(spark.createDataFrame([(r, "x", 0) for r in refs], "k long, block string, _k int"), F.col("k"), spark.createDataFrame([(p,) for p in parents], "p long"), F.col("p"))
    assert got.columns == ["k", "block", "_k"]
    assert sorted(r["k"] for r in got.collect()) == sorted(r for r in refs if r is not None and r not in set(parents))
    empty = spark.createDataFrame([], "p long")
    assert orphan_keys(spark.createDataFrame([(1,)], "k long"), F.col("k"), empty, F.col("p")).count() == 1
    assert orphan_keys(empty, F.col("p"), empty, F.col("p")).count() == 0


def test_in_force(spark):
    rng = random.Random(2)
    keys = ["a", "b", "c"]
    rows = []
    for _ in range(60):
        lo = rng.randrange(0, 400) * 86400
        rows.append((rng.choice(keys), lo, None if rng.random() < 0.1 else lo + rng.randrange(-1, 60) * 86400, "extra"))
    rows += rows[:10] + [(None, 0, None, "x"), ("d", None, None, "x")]
    parents = stamp(spark.createDataFrame(rows, "key string, a long, z long, runs string"), "a", "z")
    refs = [(rng.choice([*keys, "d", "nowhere", None]), rng.randrange(-10, 500) * 86400, str(i)) for i in range(300)] + [("a", None, "n")]
    refs += refs[:5]
    table = stamp(spark.createDataFrame(refs, "key string, at long, record_key string"), "at")
    got = {r["record_key"]: r["reason"] for r in orphan_references(table, force_runs(parents, F.col("key"), F.col("a"), F.col("z"))).collect()}
    want = {}
    for k, t, i in refs:
        if k is None or t is None:
            continue
        own = [(a, z) for key, a, z, _ in rows if key == k]
        if any(a is not None and a <= t and (z is None or t < z) for a, z in own):
            continue
        want[i] = "missing" if not own else "deleted" if any(z is not None and z <= t for _, z in own) else "late"
    assert got == want


def test_tables_empty(spark, data):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet").limit(0)
    assert orphans_by_table(read("line_records"), read("page_records"), read("folio_records")).count() == 0


def test_hot_keys_and_salting(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), "id")
    hot = hot_keys(left, F.col("k"), 0.05)
    assert list(hot) == ["hot"] and abs(hot["hot"] - 1 / 3) < 0.02
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        assert sorted(map(str, salted_join(left, right, "k", F.col("id"), how).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert hot_keys(left.limit(0), F.col("k")) == {}


def test_clock_times(spark):
    from quirelab.functions.times import clock_micros, clock_month

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql("select timestamp_ntz'2021-03-28 02:30:00.000001' as a, timestamp_ntz'1969-12-31 23:59:59.5' as b, cast(null as timestamp_ntz) as c")
        r = df.select(*(clock_micros(F.col(x)) for x in "abc"), *(clock_month(F.col(x)) for x in "abc")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(r) == (1616898600000001, -500000, None, "2021-03", "1969-12", None)


def test_text_keys_as_numbers(spark):
    keys = ["f68v", "f69v", "f70v", "f68r", "f068v", "f0068v", "f", "", "12", "a1b2", "a1b02", "é7", "x" + "9" * 30 + "y", "-:f", "1:0:f68v", "a\n5", "f68v "]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    got = {r[0]: (r[1], r[2]) for r in df.select("key", *key_number(F.col("key"))).collect()}
    assert len(set(got[k] for k in keys)) == len(keys) and got[None][1] is None
    assert got["f68v"][0] == got["f70v"][0] != got["f68r"][0] and got["f70v"][1] == 70
    rng = random.Random(5)
    name = lambda: rng.choice(["f", "g0", ""]) + rng.choice(["", "0"]) + str(rng.randrange(300)) + rng.choice(["r", "v", "", "v2"])
    parents = [name() for _ in range(900)]
    refs = [name() for _ in range(1500)] + ["f7v"] * 1500
    table = spark.createDataFrame([(k, str(i)) for i, k in enumerate(refs)], "key string, id string")
    out = known_keys(table, spark.createDataFrame([(k,) for k in [*parents, None]], "key string"))
    assert out.columns == ["key", "id", "known"]
    assert sorted((r["id"], r["known"]) for r in out.collect()) == sorted((str(i), k in set(parents)) for i, k in enumerate(refs))
    # Keys that are numbered through are few runs.
    through = spark.createDataFrame([(f"f{i}{s}",) for i in range(1, 900) for s in "rv"], "key string")
    g, n = key_number(F.col("key"))
    assert sum(len(r["runs"]) for r in key_runs(through, n, group=g).collect()) == 2


def test_very_many_periods(spark):
    """The run at or before a time is found by halving, whatever the number of runs."""
    rows = [("k", i * 10, i * 10 + 5) for i in range(5000)]
    parents = stamp(spark.createDataFrame(rows, "key string, a long, z long"), "a", "z")
    refs = stamp(spark.createDataFrame([("k", t, str(t)) for t in range(-3, 50_020, 7)], "key string, at long, record_key string"), "at")
    got = {int(r["record_key"]): r["reason"] for r in orphan_references(refs, force_runs(parents, F.col("key"), F.col("a"), F.col("z"))).collect()}
    assert got == {t: "late" if t < 0 else "deleted" for t in range(-3, 50_020, 7) if t < 0 or t % 10 >= 5 or t >= 50_000}
