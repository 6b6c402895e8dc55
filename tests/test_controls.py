from pyspark.sql import functions as F

from quirelab.operators import coding
from quirelab.plans import corpus as plans


def test_controls_are_as_long_as_the_corpus(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(coding, "compression_profile", lambda lines, flat, by: seen.append(flat) or lines)
    plans.QUERIES["compression_profile"](spark, data)
    n = {r["name"]: r["n"] for r in seen[0].groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert len(n) == 4 and len(set(n.values())) == 1 and n["observed"] != 20_000


def test_control_lines(spark):
    texts = spark.createDataFrame([("a", "ab c"), ("none", " ")], "name string, t string")
    rows = coding.control_corpus(texts, "name", F.col("t"), 10).orderBy("line_no").collect()
    assert [(r["name"], r["line_no"], "".join(r["words"])) for r in rows] == [("a", 0, "abcabcab"), ("a", 1, "ca")]
    assert coding.control_corpus(texts, "name", F.col("t"), 0).count() == 0
