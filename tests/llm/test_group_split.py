import random

import pytest
from pyspark.sql import functions as F

from quirelab.llm import group_split as gs


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in parent}


def comps(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return {r["vertex"]: r["component"] for r in gs.components(df).collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges = [(a, b) for a, b in edges if a != b]
    got = comps(spark, edges + edges[:9] + [(5, 5), (None, 3)])
    assert got == brute(edges)
    path = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(40)]
    assert set(comps(spark, path, "string").values()) == {"v000"}
    star = [(0, i) for i in range(1, 60)]
    assert set(comps(spark, star).values()) == {0}
    assert comps(spark, []) == {}


def test_star_edges(spark):
    links = spark.createDataFrame([("f1", "B"), ("f1", "A"), ("f1", "A"), ("f2", "C"), (None, "A"), ("f3", None), ("", "C"), ("", "D")], "folio string, q string")
    assert sorted(tuple(r) for r in gs.star_edges(links, "folio", "q").collect()) == [("A", "B"), ("C", "D")]
    assert gs.star_edges(links.limit(0), "folio", "q").count() == 0


def test_split(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 20)) for i in range(500)] + [(900, None), (901, -4)]
    df = spark.createDataFrame(rows, "component long, weight long").withColumn("total", F.lit("clash")).withColumn("start", F.lit(1))
    out = gs.split_groups(df.drop("total", "start"), {"train": 0.8, "validation": 0.1, "test": 0.1})
    sums = {r["part"]: r["w"] for r in out.groupBy("part").agg(F.sum("weight").alias("w")).collect()}
    total = sum(w for _, w in rows if w and w > 0)
    assert out.count() == len(rows) and set(sums) == {"train", "validation", "test"}
    assert abs(sums["train"] / total - 0.8) < 0.02 and abs(sums["test"] / total - 0.1) < 0.02
    assert {r["component"]: r["part"] for r in out.collect()} == {r["component"]: r["part"] for r in gs.split_groups(df.drop("total", "start").repartition(7), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert gs.split_groups(df.drop("total", "start").limit(0), {"a": 1}).count() == 0
    starts = sorted((r["start"], r["weight"]) for r in gs.running_start(spark.createDataFrame(rows[:50], "component long, weight long"), "weight", F.col("component")).collect())
    at = 0
    for s, w in starts:
        assert s == at
        at += w


def test_every_record_has_a_part(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["A", "B", "C", "D", "E", None]) if i % 3 else f"q{i % 50}") for i in range(900)]
    records = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, vertex string, part string")
    groups = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "C")], "vertex string, component string")
    parts = {"train": 0.6, "test": 0.4}
    placed = gs.split_records(records, groups, parts)
    got = {r["record_id"]: r for r in placed.collect()}
    assert len(got) == 900 and placed.count() == 900
    by = {}
    for r in got.values():
        by.setdefault(r["component"], set()).add(r["part"])
    assert all(len(p) == 1 for p in by.values())
    assert {got[i]["component"] for i, v in rows if v in ("A", "B")} == {"A"} and all(got[i]["component"] == f"record {i}" for i, v in rows if v is None)
    report = {r["part"]: r for r in gs.split_report(placed, parts).collect()}
    assert sum(r["records"] for r in report.values()) == 900 and abs(report["train"]["share"] - 0.6) < 0.1
    assert gs.split_records(records.limit(0), groups, parts).count() == 0


def test_torn(spark):
    listed = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 1, "C"), (1, 2, "X"), (1, 3, "X"), (2, 0, "A"), (2, 0, "B"), (2, None, "X"), (2, 1, None)], "split_id long, fold int, member string")
    groups = spark.createDataFrame([("A", "A"), ("B", "A"), ("Z", "A")], "vertex string, component string")
    assert sorted(tuple(r) for r in gs.torn_groups(listed, groups).collect()) == [(1, "A"), (1, "B"), (1, "X")]
    assert gs.torn_groups(listed.limit(0), groups.limit(0)).count() == 0


def test_gives_up(spark):
    with pytest.raises(RuntimeError):
        gs.components(spark.createDataFrame([(1, 2)], "a long, b long"), most_rounds=0)
