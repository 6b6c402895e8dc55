import pytest
from pyspark.sql import functions as F

from quirelab.functions.keys import normalize_quire, plain_key
from quirelab.sources import audit, readers


def test_quires(spark):
    cases = {"qA": "A", "qB": "B", "Q": "Q", "A": "A", "": "", "q": "q", "qQ": "Q", " qC\t": "C", " D": "D"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "q string").select("q", normalize_quire(F.col("q")).alias("n"), plain_key(F.col("q")).alias("k"))
    got = {r["q"]: r["n"] for r in df.collect()}
    assert got == cases | {None: ""}
    assert {r["q"]: r["k"] for r in df.collect()}[" qC\t"] == "qc"


def test_parsing(spark):
    raw = spark.createDataFrame([("f1r", 1, "ol daiin", "ol  daiin", "qA", "ZL"), ("f2", None, None, None, None, None)], "page_id string, line_number int, text string, text_clean string, quire string, source string")
    a, b = readers.parse_lines(raw).collect()
    assert (a["folio"], a["quire"], a["tokens"], a["transcription_source"]) == ("f1", "A", ["ol", "daiin"], "unknown")
    assert (b["folio"], b["tokens"], b["line_number"]) == ("f2", [], 0)
    assert readers.parse_lines(raw.drop("text_clean")).first()["tokens"] == ["ol", "daiin"]
    t = spark.createDataFrame([(["a.b,c", "d"],), ([],), (None,), ([None],)], "tokens array<string>")
    assert [r[0] for r in t.select(readers.dotted_words("tokens")).collect()] == [["a", "b", "c", "d"], [], [], []]
    assert [r[0] for r in t.select(readers.dotted_words("tokens", True)).collect()] == [["a", "b", "c"], [], [], []]


def test_metadata_and_join(spark):
    folios = spark.createDataFrame([("f1", "qA", "herbal"), ("f1", "qA", "herbal")], "folio_id string, quire_id string, section_value string")
    pages = spark.createDataFrame([("f1r", "f1", "qA", "herbal", "P")], "page_id string, folio_id string, quire_id string, section_value string, illustration_type string")
    assert readers.parse_metadata(None, folios).count() == 1
    meta = readers.parse_metadata(pages, folios)
    lines = spark.createDataFrame([("f1r", None, ""), ("f9r", "f9", "B"), (None, "x", "y")], "page string, folio string, quire string")
    got = {r["page"]: r for r in readers.join_records(lines, meta).collect()}
    assert (got["f1r"]["folio"], got["f1r"]["quire"], got["f1r"]["section"]) == ("f1", "", "herbal")
    assert got["f9r"]["page_id"] is None and len(got) == 3
    assert readers.distinct_pages(readers.join_records(lines, meta)).count() == 3
    with pytest.raises(ValueError):
        readers.parse_metadata(None, None)


def test_coordinates(spark):
    rows = [{"token_id": 1, "page": "f1r", "line": "3", "x": 1, "y": 2.5, "width": "4", "height": 5}, {"token_id": 2, "line": "three"}, {}, 7]
    got = readers.parse_coordinates(spark, rows).collect()
    assert [(r["token_id"], r["line"], r["y"]) for r in got] == [("1", 3, 2.5), ("", 0, 0.0)]
    assert readers.parse_coordinates(spark, None).count() == 0


def test_hashes(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert audit.table_hash(a) == audit.table_hash(a.select("b", "a").orderBy("b"))
    assert audit.table_hash(a) != audit.table_hash(a.union(a.limit(1)))
    assert audit.payload_hash({"b": 1, "a": 2}) == audit.payload_hash({"a": 2, "b": 1})
    bad = audit.source_status("gone", lambda: spark.read.parquet(str(tmp_path / "none")))
    assert bad["status"] == "failed" and bad["error"]
    row, df = audit.first_that_loads("x", [("none", lambda: spark.read.parquet(str(tmp_path / "none"))), ("here", lambda: a)])
    assert row["status"] == "loaded" and row["repo_id"] == "here" and df.count() == 2
    assert audit.first_that_loads("x", [])[0]["status"] == "unavailable"
    audit.write_manifest(audit.status_table(spark, [bad, row]), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_sinks(spark, tmp_path):
    sig = spark.createDataFrame([("a", 1.23456789), ("b", None)], "field string, value double")
    path = str(tmp_path / "sig")
    got = {r["field"]: r["value"] for r in readers.load_signature(spark, path, lambda: sig).collect()}
    assert got == {"a": 1.234568, "b": None} and readers.load_signature(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    bounds = spark.createDataFrame([("a", 1.0, 1.1, 0.1, 0.8, 1.2), ("b", None, None, None, None, None)], "field string, observed double, bootstrap_mean double, sd double, lower double, upper double")
    readers.save_intervals(bounds, str(tmp_path / "i"))
    assert sorted(map(tuple, readers.load_intervals(spark, str(tmp_path / "i")).collect())) == sorted(map(tuple, bounds.collect()))
    readers.save_table(sig, str(tmp_path / "j"))
    assert readers.read_first(spark, str(tmp_path / "p"), str(tmp_path / "j"), "field string, value double").count() == 2
    readers.save_folds(sig.withColumn("fold", F.lit(1)), str(tmp_path / "f"))
    assert (tmp_path / "f" / "fold=1").is_dir()


def test_stream(spark, data, tmp_path):
    from quirelab.operators.corpus import line_corpus, words
    from quirelab.operators.signature import word_counts
    from quirelab.streaming.word_stream import stream_counts, windowed_counts

    table = spark.read.parquet(f"{data}/line_records.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = stream_counts(stream, "4000 days").writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, word_counts(words(line_corpus(table))).collect()))
    assert sorted(map(tuple, spark.table("wc").collect())) == want
    w = windowed_counts(stream).writeStream.outputMode("update").format("memory").queryName("ww").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("ww").count() > 0
