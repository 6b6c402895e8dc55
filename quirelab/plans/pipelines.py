"""Whole pipelines: representation, splits, fractal analysis, unit discovery. Each returns a small summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import boxes, corpus, experiments, resample, series, signature, units
from quirelab.plans.corpus import lines_of
from quirelab.plans.sqltext import FLAT, LINES, QUIRE, registry
from quirelab.session import cut, scratch_path, table
from quirelab.sources import readers

QUERIES, ORACLE, query = registry()


def run_representation(raw_lines: DataFrame, pages: DataFrame | None, folios: DataFrame | None, mismatches: DataFrame, out: str) -> DataFrame:
    """Parse lines and metadata, join them, compare transcriptions; writes both results below ``out``.

    Returns ``n_lines, n_pages, n_joined, n_with_page, n_compared``.
    """
    spark = raw_lines.sparkSession
    lines, meta = readers.parse_lines(raw_lines), readers.parse_metadata(pages, folios)
    readers.save_table(readers.join_records(lines, meta.distinct()), f"{out}/joined")
    readers.save_table(experiments.transcription_report(mismatches), f"{out}/comparison")
    joined = spark.read.json(f"{out}/joined").agg(F.count("*").alias("n_joined"), F.count("page_id").alias("n_with_page"))
    compared = spark.read.json(f"{out}/comparison").agg(F.max("n").alias("n_compared"))
    sizes = lines.agg(F.count("*").alias("n_lines")).crossJoin(meta.agg(F.count("*").alias("n_pages")))
    return sizes.crossJoin(joined).crossJoin(compared)  # single rows


def run_splits(lines: DataFrame, out: str, n_folds: int = 5, seed: int = 42, by_hash: bool = False) -> DataFrame:
    """H3: folds of the groups, written as one folder per fold, checked: ``n_folds, leaked_groups, missing_groups, complete``."""
    folds = cut(resample.group_folds(lines, n_folds, seed, by_hash))
    readers.save_folds(resample.fold_rows(lines, folds).select("line_no", "grp", "fold"), out)
    leaked = resample.leakage(folds).agg(F.count("*").alias("leaked_groups"))
    made = folds.agg(F.countDistinct("fold").alias("n_folds"))
    return made.crossJoin(leaked).crossJoin(resample.coverage(lines, folds).select("missing_groups", "complete"))  # single rows


def run_fractal_analysis(lines: DataFrame) -> DataFrame:
    """``rs, dfa, delta_h, delta_alpha, dimension`` of the word stream by alphabetical ids; undefined ones are null."""
    flat = cut(corpus.words(lines))
    ids = cut(corpus.encoded(flat, first=False))
    hurst = series.hurst_ensemble(ids).select("rs", "dfa")
    spectrum = series.multifractal_summary(ids).select("delta_h", "delta_alpha")
    box = boxes.box_dimension(boxes.line_points(lines, flat)).select("dimension")
    return hurst.join(spectrum, F.lit(True), "left").join(box, F.lit(True), "left")  # single rows


@query("""select (select count(*) from line_records) as n_lines, (select count(*) from page_records) as n_pages, count(*) as n_joined, count(page_id) as n_with_page, (select count(*) from mismatch_main) as n_compared
from (select p.page_id from line_records l left join (select distinct page_id, folio, """ + QUIRE.format("quire") + """ as quire, section, illustration_type from page_records) p on coalesce(l.page, '') = p.page_id)""")
def representation_pipeline(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "line_records").select(F.col("page").alias("page_id"), "line_number", F.col("raw_text").alias("text"), "quire", F.col("transcription_source").alias("source"))
    pages = table(spark, d, "page_records").select("page_id", F.col("folio").alias("folio_id"), F.col("quire").alias("quire_id"), F.col("section").alias("section_value"), "illustration_type")
    return run_representation(raw, pages, None, table(spark, d, "mismatch_main"), scratch_path(spark, "representation"))


@query(f"with {LINES} select 5::bigint as n_folds, 0::bigint as leaked_groups, (select count(distinct grp) from lines where grp = '') as missing_groups, (select count(*) from lines where grp = '') = 0 as complete")
def splits_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return run_splits(cut(lines_of(spark, d)), scratch_path(spark, "folds"), by_hash=True)  # any number of groups


@query()
def fractal_analysis(spark: SparkSession, d: str) -> DataFrame:
    return run_fractal_analysis(cut(lines_of(spark, d)))


@query()
def unit_discovery(spark: SparkSession, d: str) -> DataFrame:
    """G8."""
    return units.unit_discovery(cut(lines_of(spark, d)))


@query(f"with {FLAT}, top as (select word from flat group by 1 order by count(*) desc, word limit 50) select word, count(distinct grp) as groups from flat where word in (select word from top) group by 1")
def words_in_groups(spark: SparkSession, d: str) -> DataFrame:
    """C4: in how many groups each of the 50 most frequent words occurs."""
    flat = corpus.words(lines_of(spark, d))
    top = flat.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(50).select("word")
    return flat.join(top, "word", "left_semi").groupBy("word").agg(F.countDistinct("grp").alias("groups"))


@query(f"with {LINES} select line_no, grp, words from lines where grp <> 'Z'")
def without_group(spark: SparkSession, d: str) -> DataFrame:
    """All lines but those of one group."""
    return lines_of(spark, d).where("grp <> 'Z'")


@query("select l_orderkey::varchar || ':' || l_linenumber::varchar as token_id, l_suppkey::varchar as page, l_linenumber::int as line, l_quantity as x, l_discount as y, l_tax as width, 0::double as height from lineitem")
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of text fields cast to coordinates."""
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, d, "lineitem").select(F.concat_ws(":", text("l_orderkey"), text("l_linenumber")).alias("token_id"), text("l_suppkey").alias("page"), text("l_linenumber").alias("line"), text("l_quantity").alias("x"), text("l_discount").alias("y"), text("l_tax").alias("width"), F.lit(None).cast("string").alias("height"))
    return readers.parse_coordinates(spark, rows)


@query(f"with {FLAT}, u as (select word, count(*) as c from flat group by 1) select 'hapax_ratio' as field, round(avg((c = 1)::int), 6) as value from u union all select 'template_transition', null")
def saved_signature(spark: SparkSession, d: str) -> DataFrame:
    """A signature saved with six decimals and read again."""
    h = signature.hapax_ratio(corpus.words(lines_of(spark, d))).select(F.lit("hapax_ratio").alias("field"), F.col("hapax_ratio").alias("value"))
    both = h.unionByName(spark.createDataFrame([("template_transition", None)], "field string, value double"))
    return readers.load_signature(spark, scratch_path(spark, "signature"), lambda: both)
