"""Queries of loading, fallbacks, manifests and saved results, with their SQL."""

from __future__ import annotations

import json
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import boxes, coding, corpus, resample, units
from quirelab.plans.corpus import lines_of
from quirelab.plans.sqltext import FLAT, QUIRE, registry
from quirelab.session import cut, scratch_path, table
from quirelab.sources import audit, readers

QUERIES, ORACLE, query = registry()


@query("select 'customer' as name, 'loaded' as status, 'fallback' as source_type, count(*) as row_count, null as error from customer union all select 'none', 'unavailable', 'fallback', 0, 'a: gone; b: gone'")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A3: the first of several places that loads, and a source that no place has."""

    def gone() -> DataFrame:
        raise OSError("gone")

    one, _ = audit.first_that_loads("customer", [("nowhere", gone), (d, lambda: table(spark, d, "customer"))])
    none, _ = audit.first_that_loads("none", [("a", gone), ("b", gone)])
    return audit.status_table(spark, [one, none]).select("name", "status", "source_type", "row_count", "error")


@query("select count(*) as regions, true as absent_is_null from region")
def fetched_status(spark: SparkSession, d: str) -> DataFrame:
    """A4: a small JSON document from an address, and an address that has none. The document lives on the driver alone."""
    place = Path(mkdtemp(prefix="quirelab-")) / "status.json"
    place.write_text(json.dumps({"regions": table(spark, d, "region").count()}))
    got, absent = audit.fetch_json(place.as_uri()), audit.fetch_json((place.parent / "absent.json").as_uri())
    return spark.createDataFrame([(got["regions"], absent is None)], "regions long, absent_is_null boolean")


_AUDITED = ["region", "nation", "page_records", "split_manifest"]


@query(" union all ".join(f"select '{t}' as name, 'loaded' as status, count(*) as row_count, true as dated from {t}" for t in _AUDITED))
def audit_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A5: statuses written as a manifest and read again."""
    path = scratch_path(spark, "manifest")
    audit.write_manifest(audit.run_audit(spark, {t: f"{d}/{t}.parquet" for t in _AUDITED}, hashed=False), path)
    return spark.read.json(path).select("name", "status", "row_count", F.col("generated_at").isNotNull().alias("dated"))


@query("select 'parquet' as found, section, count(*) as n from page_records group by section union all select 'json', section, count(*) from page_records group by section union all select 'absent', null, 0")
def joined_records_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Parquet if it is there, else JSON, else nothing."""
    pages = table(spark, d, "page_records").select("page_id", "section")
    path = scratch_path(spark, "pages")
    readers.save_table(pages, path)
    kept = {"parquet": readers.read_first(spark, f"{d}/page_records.parquet", path), "json": readers.read_first(spark, f"{path}-no-parquet", path, "page_id string, section string")}
    try:
        readers.read_first(spark, f"{path}-no-parquet", f"{path}-no-json")
        absent = []
    except FileNotFoundError:
        absent = [("absent", None, 0)]
    parts = [df.groupBy("section").agg(F.count("*").alias("n")).select(F.lit(k).alias("found"), "section", "n") for k, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(spark.createDataFrame(absent, "found string, section string, n long"))


@query("""select 'similarity_score' as field, avg(similarity_score) as observed, avg(similarity_score) as bootstrap_mean, stddev_pop(similarity_score) as sd, avg(similarity_score) - 2 * stddev_pop(similarity_score) as lower, avg(similarity_score) + 2 * stddev_pop(similarity_score) as upper from mismatch_main
union all select 'template_transition', null, null, null, null, null""", "observed bootstrap_mean sd lower upper")
def saved_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals saved and read again, bounds that are missing included."""
    scores = table(spark, d, "mismatch_main").where("similarity_score is not null")
    observed = scores.select(F.lit("similarity_score").alias("field"), F.col("similarity_score").alias("value")).groupBy("field").agg(F.avg("value").alias("value"))
    observed = observed.unionByName(spark.createDataFrame([("template_transition", None)], "field string, value double"))
    path = scratch_path(spark, "intervals")
    readers.save_intervals(resample.tolerance(observed, scores.select(F.lit("similarity_score").alias("field"), F.col("similarity_score").alias("value"))), path)
    return readers.load_intervals(spark, path)


@query("select line_id, any_value(coalesce(tokens, [])) as tokens from line_records where line_id is not null group by line_id")
def stream_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each line as they stand."""
    return table(spark, d, "line_records").where("line_id is not null").dropDuplicates(["line_id"]).select("line_id", readers.stream_words("tokens").alias("tokens"))


@query(f"select page_id, folio, {QUIRE.format('quire')} as quire, section, illustration_type from page_records")
def metadata_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """B7 from page records."""
    pages = table(spark, d, "page_records").select("page_id", F.col("folio").alias("folio_id"), F.col("quire").alias("quire_id"), F.col("section").alias("section_value"), "illustration_type")
    return readers.parse_metadata(pages, None)


@query(f"with {FLAT}, v as (select word, row_number() over (order by encode(word)) - 1 as id, count(*) over () as t from (select distinct word from flat)), n as (select count(*) as m from flat) select pos, pos / greatest(1, m - 1) as x, id / greatest(1, t - 1) as y from flat join v using (word), n")
def corpus_points(spark: SparkSession, d: str) -> DataFrame:
    """F11 at the scale of the corpus."""
    lines = lines_of(spark, d)
    flat = cut(corpus.words(lines))
    return boxes.line_points(lines, flat, (), "corpus", keep=["pos"])


_BOXES = """b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, count(*) as n from p),
u as (select (x - lx) / (hx - lx) as x, (y - ly) / (hy - ly) as y, n from p, b),
s as (select pow(10, log10(0.5e0) + t * (log10(0.04e0) - log10(0.5e0)) / 29) as scale from range(0, 30) r(t)),
c0 as (select distinct scale, n, least(floor(x * ceil(1 / scale)), ceil(1 / scale) - 1) as i, least(floor(y * ceil(1 / scale)), ceil(1 / scale) - 1) as j from u, s where ceil(1 / scale) between 2 and 1024),
c as (select scale, n, count(*) as boxes from c0 group by all having count(*) > 1),
g as (select count(*) filter (boxes < 0.9 * n and boxes > 4) as k from c),
r as (select regr_slope(ln(boxes), ln(1 / scale)) as dimension, regr_r2(ln(boxes), ln(1 / scale)) as r2, count(*) as scales from c, g where case when k >= 4 then boxes < 0.9 * n and boxes > 4 else boxes < 0.95 * n end)"""
_VOC = "v as (select word, row_number() over (order by encode(word)) - 1 as id, count(*) over () as t from (select distinct word from flat))"


@query(f"with {FLAT}, {_VOC}, m as (select count(*) as m from flat), p as (select pos / greatest(1, m - 1) as x, id / greatest(1, t - 1) as y from flat join v using (word), m), {_BOXES} select * from r", "dimension r2")
def stream_box_dimension(spark: SparkSession, d: str) -> DataFrame:
    """F12 at a given spacing."""
    lines = lines_of(spark, d)
    return boxes.stream_dimension(lines, cut(corpus.words(lines)), spacing=0.02)


@query(f"with {FLAT}, {_VOC}, m as (select line_no, count(*) as m from flat group by 1), p as (select idx / greatest(1, m - 1) as x, id / greatest(1, t - 1) as y from flat join v using (word) join m using (line_no)), {_BOXES} select (select count(*) from p) as n_points, dimension, r2, scales, 'ok' as status from r", "dimension r2")
def observed_box_dimension(spark: SparkSession, d: str) -> DataFrame:
    """F13 at a given spacing."""
    lines = lines_of(spark, d)
    return boxes.observed_dimension(lines, cut(corpus.words(lines)), spacing=0.02)


@query(f"with {FLAT} select distinct word, word as joined from flat where word <> ''")
def encoded_words(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word cut into units and put together again."""
    words = cut(corpus.word_bag(corpus.line_bag(table(spark, d, "line_records"))).where("word <> ''"))
    counts = words.groupBy("word").agg(F.count("*").alias("c"))
    return units.encode_words(words, units.merge_list(counts)).select("word", F.array_join("units", "").alias("joined"))


@query(f"with {FLAT}, u as (select word, count(*) as c from flat group by 1), n as (select sum(c) as n from u) select count(*) as types, 1e0 as kraft, -sum(c / n * log2(c / n)) as entropy, true as within_a_bit from u, n", "kraft entropy")
def huffman_bounds(spark: SparkSession, d: str) -> DataFrame:
    """E5: the code of all words is complete (Kraft's sum is 1), and its mean length within a bit of the entropy."""
    codes = coding.huffman_codes(corpus.word_bag(corpus.line_bag(table(spark, d, "line_records"))).select(F.col("word").alias("sym")))
    size = F.length("code")
    sums = codes.agg(F.count("*").alias("types"), F.sum(F.pow(F.lit(2.0), -size)).alias("kraft"), F.sum("c").alias("n"), F.sum(F.col("c") * size).alias("bits"), F.sum(F.expr("c * log2(c)")).alias("u"))
    entropy = F.log2(F.col("n").cast("double")) - F.col("u") / F.col("n")
    mean = F.col("bits") / F.col("n")
    return sums.select("types", "kraft", entropy.alias("entropy"), ((mean >= entropy - 1e-9) & (mean < entropy + 1)).alias("within_a_bit"))
