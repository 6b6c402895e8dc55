"""Queries of the llm subpackage, by problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions.grammar import line_words, parse_values, reading_words
from quirelab.functions.keys import plain_key, quire_key
from quirelab.llm import consensus as cs
from quirelab.llm import group_split as gs
from quirelab.llm import leakage, mixing
from quirelab.llm import reading_level as rl
from quirelab.llm import shared_spans as sp
from quirelab.llm import term_counts as tc
from quirelab.llm.oracle import ORACLE
from quirelab.session import cut, table

__all__ = ["ORACLE", "QUERIES"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """``record_id, words``, one row per line; deliveries of a line have one content."""
    rows = table(spark, d, "line_records").where("line_id is not null").select(F.col("line_id").alias("record_id"), line_words().alias("words"))
    return rows.dropDuplicates(["record_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one change to empty counts: its lines are all added records."""
    store = tc.TermCounts(spark).apply(tc.images(None, _lines(spark, d)))
    return store.marked().where("mark is not null").select("term", "mark")


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every term after two loads; lines of the second that were there before are changes."""
    rows = table(spark, d, "line_records").where("line_id is not null")
    words = lambda df: df.select(F.col("line_id").alias("record_id"), line_words().alias("words")).dropDuplicates(["record_id"])
    first, second = rows.where("loaded_at < timestamp'2023-01-01'"), rows.where("loaded_at is null or loaded_at >= timestamp'2023-01-01'")
    store = tc.TermCounts(spark).apply(tc.images(None, words(first)))
    known = words(first).join(words(second).select("record_id"), "record_id", "left_semi")
    before, after = tc.changed(known, words(second))
    return store.apply(tc.images(before, after)).marked().select("term", "occurrences", "records", "mark")


def p1_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Counts after corrections: lines as raw_text has them first, then by their tokens.

    Lines without a number come late, and lines without a page are deleted; so the change holds
    added, changed and deleted records, and counts go up and down.
    """
    rows = table(spark, d, "line_records").where("line_id is not null")
    first = rows.where("line_number is not null").select(F.col("line_id").alias("record_id"), parse_values("raw_text", True).alias("words")).dropDuplicates(["record_id"])
    now = rows.where("page is not null").select(F.col("line_id").alias("record_id"), line_words().alias("words")).dropDuplicates(["record_id"])
    before, after = tc.changed(first, now)
    return tc.TermCounts(spark).apply(tc.images(None, first)).apply(tc.images(before, after)).marked().select("term", "occurrences", "records", "mark")


def _shared(spark: SparkSession, d: str) -> tuple[DataFrame, sp.SharedWindows]:
    rows = table(spark, d, "line_records").where("line_id is not null").select(F.col("line_id").alias("record_id"), line_words().alias("words"))
    return rows, sp.shared_windows(rows, 8)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = sp.shared_pairs(_shared(spark, d)[1])
    return pairs.select(F.col("record_a").alias("line_id_a"), F.col("record_b").alias("line_id_b"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each line stands elsewhere."""
    return sp.shared_shares(*_shared(spark, d)).withColumnRenamed("record_id", "line_id")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The maximal stretches of each line that stand elsewhere, by first word and number of words."""
    return sp.shared_intervals(*_shared(spark, d)).withColumnRenamed("record_id", "line_id")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each line with its class of exact copies."""
    return sp.shared_classes(*_shared(spark, d)).withColumnRenamed("record_id", "line_id")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Classes of lines with a stretch in common; with p2_classes this says what p2_found says."""
    return sp.shared_links(_shared(spark, d)[1])


READERS = ("zl", "it", "cd", "gc")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"{r}_text" for r in READERS]
    newest = table(spark, d, "mismatch_main").where("mm_id is not null").groupBy("mm_id").agg(F.max_by(F.struct(*cols), "updated_at").alias("r")).select("mm_id", "r.*")
    joined = [F.array_join(reading_words(c), " ").alias(c) for c in cols]
    return newest.select("mm_id", *joined)


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, cs.Fit]:
    labels = {r.upper(): F.when(F.col(f"{r}_text") != "", F.col(f"{r}_text")) for r in READERS}
    return cs.consensus(_readings(spark, d), "mm_id", labels)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _consensus(spark, d)
    return out.where("n_labels >= 2 and n_classes >= 2").select(F.col("item").alias("mm_id"), "consensus")


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Consensus and agreement of every record, whether disputed or not."""
    out, _ = _consensus(spark, d)
    return out.select(F.col("item").alias("mm_id"), "n_labels", "n_classes", "consensus", "agreement")


def p6_posterior(spark: SparkSession, d: str) -> DataFrame:
    """What the model finds most probable for every record, and its probability of the consensus."""
    out, _ = _consensus(spark, d)
    return out.where("n_labels > 0").select(F.col("item").alias("mm_id"), "consensus", F.round("posterior", 6).alias("posterior"), "likeliest")


def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Tilt and reliability of each source, with the agreement over the whole table."""
    _, fit = _consensus(spark, d)
    rows = [(a, float(t), float(r), fit.agreement) for a, t, r in zip(fit.annotators, fit.tilt, fit.reliability)]
    return spark.createDataFrame(rows, "source string, tilt double, reliability double, agreement double")


def p6_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the sources beyond chance, over the whole table."""
    readings = _readings(spark, d)
    votes = readings.select("mm_id", F.explode(F.array(*(F.col(f"{r}_text") for r in READERS))).alias("reading")).where("reading <> ''")
    return cs.alpha(votes, "mm_id", "reading")


def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of the raters' reading levels, which share one set of labels."""
    votes = table(spark, d, "level_labels").where("reading_level between 1 and 5")
    out, _ = cs.class_consensus(votes, "doc_id", "rater", "reading_level")
    return out.withColumnRenamed("item", "doc_id").withColumn("posterior", F.round("posterior", 6))


def _quire_groups(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "line_records").select("folio", quire_key(F.col("quire")).alias("q"))
    return gs.components(gs.star_edges(links, "folio", "q"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "split_manifest").select(F.col("manifest_id").alias("split_id"), "fold", F.explode("quires").alias("q")).select("split_id", "fold", quire_key(F.col("q")).alias("member"))
    torn = gs.torn_groups(listed.distinct(), _quire_groups(spark, d))
    return torn.select(F.col("split_id").alias("manifest_id"), F.col("member").alias("quire"))


PARTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _split(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "line_records").where("line_id is not null").groupBy("line_id").agg(F.max(quire_key(F.col("quire"))).alias("vertex"))
    return gs.split_records(lines.withColumnRenamed("line_id", "record_id"), _quire_groups(spark, d), PARTS)


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    """Each line with its quire, its group and its part of 80 : 10 : 10; lines without a quire are held by nothing."""
    return _split(spark, d).withColumnsRenamed({"record_id": "line_id", "vertex": "quire"})


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many groups and lines each part got."""
    return gs.split_report(_split(spark, d), PARTS)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), 13)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found_pairs(_leaks(spark, d))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim and re-parameterised passages, with the number of windows."""
    return _leaks(spark, d)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(mixing.token_counts(table(spark, d, "documents")))  # three numbers a document; encoded once
    rates = mixing.plan_rates(sizes, table(spark, d, "mix_targets"))
    return mixing.draw(sizes, rates), rates


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, with the copies of each."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share reached by each source of mix_targets."""
    return mixing.report(*_mix(spark, d))


def _mix_letters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("doc_id is not null")
    sizes = docs.select("doc_id", plain_key(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    rates = mixing.plan_rates(sizes, table(spark, d, "mix_targets"))
    return mixing.draw(sizes, rates), rates


def p9_mixture_letters(spark: SparkSession, d: str) -> DataFrame:
    """The same draw with sizes in characters, which SQL can follow."""
    return _mix_letters(spark, d)[0].select("doc_id", "source", "copies")


def p9_shares_letters(spark: SparkSession, d: str) -> DataFrame:
    """Share in characters reached by each source."""
    return mixing.report(*_mix_letters(spark, d)).select("source", "size", "documents", "drawn_tokens", F.round("actual_share", 9).alias("actual_share"))


def _levels(spark: SparkSession, d: str) -> tuple[DataFrame, rl.LevelModel]:
    documents = table(spark, d, "documents")
    model = rl.train(documents, table(spark, d, "level_labels"))
    return rl.reading_levels(documents, model), model


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    levels, model = _levels(spark, d)
    return levels.where(F.col("level") >= model.threshold).select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The estimated level of every English document."""
    return _levels(spark, d)[0].withColumn("level", F.round("level", 4))


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    """How predictions for held-out sources agree with their labels."""
    _, model = _levels(spark, d)
    return spark.createDataFrame(model.report, "source string, documents long, mean_error double, bias double, same_side double")


QUERIES = {f.__name__: f for f in (p1_found, p1_incremental, p1_corrected, p2_found, p2_shares, p2_intervals, p2_classes, p2_links, p6_found, p6_agreement, p6_posterior, p6_reliability, p6_alpha, p6_levels, p7_found, p7_split, p7_shares, p8_found, p8_passages, p9_mixture, p9_shares, p9_mixture_letters, p9_shares_letters, p10_found, p10_levels, p10_validation)}
