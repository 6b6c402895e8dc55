import random

from pyspark.sql import functions as F

from quirelab.functions.grammar import line_words, parse_values, reading_words
from quirelab.operators.packed import packed_in_tables, place_packed, split_packed


def values(spark, text, remarks=False):
    return spark.createDataFrame([(text,)], "t string").select(parse_values("t", remarks)).first()[0]


def test_grammar(spark):
    assert values(spark, "ol.daiin,*ch") == ["ol", "daiin", "*ch"]
    assert values(spark, '"a, b" c') == ["a, b", "c"]
    assert values(spark, '"a""b"') == ['a"b']
    assert values(spark, "“x; y”·«z» ‘q’ 'r s'") == ["x; y", "z", "q", "r s"]
    assert values(spark, '""') == []
    assert values(spark, '"open ended') == ["open", "ended"]
    assert values(spark, '"" "x"') == [" ", "x"]  # scanned from the left
    assert values(spark, "12 3") == []
    assert values(spark, "") == [] and values(spark, None) == []
    assert values(spark, "a<b.c>d{e}f", True) == ["a", "d", "f"]
    assert values(spark, "a<b.c>d{e}f") == ["a", "b", "c", "d", "e", "f"]
    assert values(spark, "a <unclosed b", True) == ["a", "unclosed", "b"]
    assert values(spark, "Öl été") == ["Öl", "été"]


def test_long_text(spark):
    text = ".".join(["daiin"] * 200_000)
    assert len(values(spark, text)) == 200_000
    assert values(spark, '"' + "a" * 500_000 + '"') == ["a" * 500_000]
    assert len(values(spark, '"' + '""' * 100_000 + 'a"')[0]) == 100_001


def test_words_of_a_line(spark):
    df = spark.createDataFrame([(["a.b", "c"], "z"), (None, "x.<r>y"), ([], "x"), ([""], "x"), ([None, "q"], None), (None, None)], "tokens array<string>, raw_text string")
    assert [r[0] for r in df.select(line_words()).collect()] == [["a", "b", "c"], ["x", "y"], ["x"], [], ["q"], []]


def test_reading(spark):
    df = spark.createDataFrame([("Ab.{x}c* <!y>d",), (None,), ("=-",)], "t string")
    assert [r[0] for r in df.select(reading_words("t")).collect()] == [["ab", "c*", "d"], [], []]


def test_split(spark):
    df = spark.createDataFrame([(1, ["a.b", None, '"c d"', 'e"'], 5), (2, ["x"], 5), (3, None, 5), (4, [], 5), (1, ["a.b", None, '"c d"', 'e"'], 5)], "id long, a array<string>, pos int").dropDuplicates(["id"])
    got = [tuple(r) for r in split_packed(df, "id", "a").orderBy("record_id", "pos").collect()]
    assert got == [(1, 0, 0, "a", False), (1, 1, 0, "b", False), (1, 2, 2, "c d", False), (1, 3, 3, "e", True), (2, 0, 0, "x", False)]
    assert split_packed(df, "id", "a", True).select("record_id").distinct().count() == 1
    assert split_packed(df.limit(0), "id", "a").count() == 0


def test_tables(spark):
    lines = spark.createDataFrame([(1, ["a.b"]), (1, ["a.b"]), (2, ["a", "b"]), (None, ["a.b"])], "line_id long, tokens array<string>")
    marks = spark.createDataFrame([(7, ["ZL,IT"], 1), (7, ["ZL", "IT"], 2), (8, ["ZL,IT"], 3), (8, ["ZL,IT"], 3), (9, None, 1)], "mm_id long, sources_present array<string>, u long").withColumn("updated_at", F.timestamp_seconds("u"))
    got = sorted(tuple(r) for r in packed_in_tables(lines, marks).collect())
    assert got == [("line_records", 1, 0, "a"), ("line_records", 1, 1, "b"), ("mismatch_main", 8, 0, "ZL"), ("mismatch_main", 8, 1, "IT")]
    assert packed_in_tables(lines.limit(0), marks.limit(0)).count() == 0


def places(spark, text, brackets=False):
    df = spark.createDataFrame([(1, [text])], "id long, a array<string>")
    return [(r["offset"], r["term"], r["malformed"]) for r in place_packed(df, "id", "a", brackets).orderBy("pos").collect()]


def test_places(spark):
    assert places(spark, "ZL; IT/«GC, 2nd» x") == [(0, "ZL", False), (4, "IT", False), (7, "GC, 2nd", False), (17, "x", False)]
    assert places(spark, 'a "b') == [(0, "a", True), (3, "b", True)]
    assert places(spark, "a b” c") == [(0, "a", True), (2, "b", True), (5, "c", True)]
    assert places(spark, "a\n\n, b") == [(0, "a", False), (5, "b", False)]
    assert places(spark, "") == [] and places(spark, None) == [] and places(spark, ", ;") == []


def test_brackets(spark):
    assert places(spark, "x [a, b] (c) d", True) == [(0, "x", False), (2, "a, b", False), (9, "c", False), (13, "d", False)]
    assert places(spark, "x [a, b] (c)", False) == [(0, "x", False), (3, "a", False), (6, "b", False), (10, "c", False)]
    assert places(spark, "[] [ ] {z} <w [v", True) == [(7, "z", False), (12, "w", False), (15, "v", False)]
    assert places(spark, '"[q]" [“r”]', True) == [(0, "[q]", False), (6, "“r”", False)]


def test_malformed_against_brute_force(spark):
    """A quote is malformed exactly if it is no part of a value, read from the left."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ,;'\"“”«»") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "id long, a array<string>")
    got = {}
    for r in place_packed(df, "id", "a").collect():
        got.setdefault(r["record_id"], []).append((r["offset"], r["term"], r["malformed"]))

    pairs = ['""', "''", "“”", "„“", "„”", "‘’", "‚‘", "‚’", "«»", "»«", "‹›", "``"]

    def read(t):
        out, bad, i = [], False, 0
        while i < len(t):
            for o, c in pairs:
                if t[i] != o:
                    continue
                j = i + 1
                while j < len(t) and (t[j] != c or t[j + 1 : j + 2] == c):
                    j += 2 if t[j] == c else 1
                if j < len(t) and j > i + 1:
                    out.append((i, t[i + 1 : j].replace(c + c, c)))
                    i = j
                    break
            else:
                if t[i].isalpha() or t[i] == "*":
                    j = i
                    while j < len(t) and (t[j].isalpha() or t[j] == "*"):
                        j += 1
                    out.append((i, t[i:j]))
                    i = j - 1
                elif any(t[i] in p for p in pairs):
                    bad = True
            i += 1
        return [(a, b, bad) for a, b in out]

    for i, t in enumerate(texts):
        assert got.get(i, []) == read(t), t
