"""Experiment drivers: grids of mechanisms scored against tolerance intervals, and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.operators import coded, nulls
from quirelab.operators import mechanisms as me
from quirelab.operators.resample import interval_scores, match_report
from quirelab.operators.signature import FIELDS, bin_of, joint_signature, zipf_from_counts, zipf_from_ties
from quirelab.session import cut


# The parameter grids of the published sweeps.


def self_citation_grid() -> list[me.SelfCitation]:
    """3 copy rates by 2 grammars; the rest is split 6 : 3 : 1."""
    return [me.SelfCitation(c, (1 - c) * 0.6, (1 - c) * 0.3, (1 - c) * 0.1, "frequency", g) for c, g in product((0.7, 0.85, 0.95), (0.0, 1.0))]


def dictionary_grid() -> list[me.Dictionary]:
    """Reference by mutation rate by distance, without negative literals."""
    rows = product((0.4, 0.6, 0.8), (0.1, 0.3), (250, 1000))
    return [me.Dictionary(r, m, round(1 - r - m, 6), d) for r, m, d in rows if round(1 - r - m, 6) >= 0]


def attachment_grid() -> list[me.PreferentialAttachment]:
    """X3."""
    return [me.PreferentialAttachment(p, m) for p, m in ((0.05, 0.3), (0.1, 0.3), (0.1, 0.5), (0.2, 0.3), (0.2, 0.5), (0.3, 0.5))]


def attachment_sweep() -> list[me.PreferentialAttachment]:
    """11 novelty rates by 4 strengths."""
    return [me.PreferentialAttachment(p, m) for p, m in product((0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.99), (0.1, 0.3, 0.5, 0.7))]


def fractal_grid() -> list[me.Fractal]:
    """X4."""
    return [me.Fractal(h, 8.28, 3.2, r) for h, r in ((0.55, 0.03), (0.61, 0.03), (0.65, 0.03), (0.61, 0.05), (0.61, 0.1), (0.7, 0.05))]


def vocabulary_grid() -> list:
    """The three alternatives, 12 configurations."""
    return [
        *(me.PureNovelty(m) for m in (0.1, 0.3, 0.5, 0.7)),
        *(me.FixedVocabulary(v) for v in (100, 500, 2000, 5000)),
        *(me.TwoRegime(c) for c in (0.3, 0.5, 0.7, 0.9)),
    ]


def score_grid(corpora: DataFrame, intervals: DataFrame, by: Sequence[str] = ("config_id", "seed"), fractal: bool = True) -> DataFrame:
    """Signatures of all corpora of a grid in one plan, scored: ``[*by,] matches, total, match_fraction``, best first."""
    return score_fields(joint_signature(corpora, None, by, fractal), intervals, by)


def score_fields(fields: DataFrame, intervals: DataFrame, by: Sequence[str] = ("config_id", "seed")) -> DataFrame:
    """The same from their signatures ``[*by,] field, value``."""
    return match_report(interval_scores(fields, intervals, by), by).orderBy(F.desc("matches"), *by)


def null_baseline(lines: DataFrame, intervals: DataFrame, seed: int = 42, fractal: bool = True) -> DataFrame:
    """The within-line permutation, scored."""
    made = coded.store(cut(nulls.word_shuffle(lines, seed).select("line_no", "grp", "words")))
    return match_report(interval_scores(coded.signatures(lines.sparkSession, made, [-1], FIELDS, fractal).drop("iter"), intervals))


def type_counts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D2 over whole lines as types: ``[*by,] words, c``."""
    return lines.groupBy(*by, "words").agg(F.count("*").alias("c"))


def line_type_statistics(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D3: ``[*by,] types, hapax_ratio, zipf_slope`` over whole lines; the slope is null under ten types."""
    counts = type_counts(lines, by)
    head = counts.groupBy(*by).agg(F.count("*").alias("types"), F.avg((F.col("c") == 1).cast("double")).alias("hapax_ratio"))
    slope = zipf_from_counts(counts, by)
    out = head.join(slope, list(by)) if by else head.crossJoin(slope)  # one row each
    return out.withColumn("zipf_slope", F.when(F.col("types") >= 10, F.col("zipf_slope")))


def grid_statistics(ties: DataFrame, by: Sequence[str] = ("config_id", "seed")) -> DataFrame:
    """D3 of the corpora of a grid from ``[*by,] lines, words, c, m``: ``m`` line types occur ``c`` times."""
    head = ties.groupBy(*by).agg(F.max("lines").alias("lines"), F.max("words").alias("words"), F.sum("m").alias("types"), (F.sum(F.when(F.col("c") == 1, F.col("m")).otherwise(0)) / F.sum("m")).alias("hapax_ratio"))
    return head.join(zipf_from_ties(ties, by), list(by)).withColumn("zipf_slope", F.when(F.col("types") >= 10, F.col("zipf_slope")))


def hapax_lengths(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lengths of line types that occur once against the others: means, population deviations, difference."""
    t = type_counts(lines, by).withColumn("k", F.coalesce(F.size("words"), F.lit(0)))
    once = lambda c: F.when(F.col("c") == 1, F.col(c))
    more = lambda c: F.when(F.col("c") > 1, F.col(c))
    out = t.groupBy(*by).agg(F.avg(once("k")).alias("hapax_mean"), F.stddev_pop(once("k")).alias("hapax_sd"), F.avg(more("k")).alias("other_mean"), F.stddev_pop(more("k")).alias("other_sd"))
    return out.withColumn("difference", F.col("hapax_mean") - F.col("other_mean"))


def novelty_survival(lines: DataFrame, by: Sequence[str] = (), after: int = 1000) -> DataFrame:
    """Line types first seen after line ``after``: number, share that stays single, mean and median frequency."""
    t = lines.groupBy(*by, "words").agg(F.min("line_no").alias("first"), F.count("*").alias("c")).where(F.col("first") > after)
    return t.groupBy(*by).agg(F.count("*").alias("novel"), F.avg((F.col("c") == 1).cast("double")).alias("novel_hapax"), F.avg("c").alias("mean_frequency"), F.expr("percentile(c, 0.5)").alias("median_frequency"))


def seed_summary(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and population deviation over seeds, without nulls."""
    return rows.groupBy(*keys).agg(*(x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_sd"))))


def nearest_config(rows: DataFrame, x: str, y: str, at: tuple[float, float] = (0.701, -0.901)) -> DataFrame:
    """The configuration nearest to a point: ``config_id, distance``; ties to the lower id."""
    d = F.sqrt(F.pow(F.col(x) - at[0], 2) + F.pow(F.col(y) - at[1], 2))
    return rows.select("config_id", d.alias("distance")).where("distance is not null").groupBy().agg(F.min_by("config_id", F.struct("distance", "config_id")).alias("config_id"), F.min("distance").alias("distance")).where("config_id is not null")


def scatter_union(parts: dict[str, DataFrame | None]) -> DataFrame:
    """``series, config_id, hapax_ratio, zipf_slope`` of several result tables; missing ones are skipped."""
    have = [df.select(F.lit(n).alias("series"), "config_id", "hapax_ratio", "zipf_slope") for n, df in parts.items() if df is not None]
    if not have:
        raise ValueError("no results to unite")
    return reduce(DataFrame.unionByName, have)


def transcription_report(rows: DataFrame, sources: Sequence[str] = ("ZL", "IT", "CD", "FG", "GC")) -> DataFrame:
    """One row: ``n, agreement_pct, mean, median, sd, min, max, p10, p50, p90, p99, histogram, presence``.

    ``histogram``: counts in ten bins of [0, 1]; ``presence``: per source the percentage of rows
    that list it, a source listed twice counting twice. Missing agreement is disagreement. Without
    scores the statistics are 0; without rows there is no row.
    """
    binned = rows.withColumn("_bin", F.when(F.col("similarity_score").between(0, 1), bin_of("similarity_score")))
    s, share = "similarity_score", lambda x: F.coalesce(x, F.lit(0.0))
    zero = lambda e, name: F.coalesce(e.cast("double"), F.lit(0.0)).alias(name)
    p = F.expr("percentile(similarity_score, array(0.1, 0.5, 0.9, 0.99))")
    listed = lambda x: F.filter("sources_present", lambda v: v == x)
    here = [F.sum(F.coalesce(F.size(listed(x)), F.lit(0))) * 100.0 / F.count("*") for x in sources]
    out = binned.groupBy().agg(
        F.count("*").alias("n"), share(F.avg(F.coalesce(F.col("eva_agreement"), F.lit(False)).cast("double")) * 100).alias("agreement_pct"),
        zero(F.avg(s), "mean"), zero(F.median(s), "median"), zero(F.stddev_pop(s), "sd"), zero(F.min(s), "min"), zero(F.max(s), "max"), p.alias("_p"),
        F.array(*(F.count_if(F.col("_bin") == i) for i in range(10))).alias("histogram"),
        F.map_from_arrays(F.array(*map(F.lit, sources)), F.array(*here)).alias("presence"),
    )
    named = [F.coalesce(F.col("_p")[i], F.lit(0.0)).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p99"))]
    return out.where("n > 0").select("n", "agreement_pct", "mean", "median", "sd", "min", "max", *named, "histogram", "presence")


def value_counts(df: DataFrame, column: Column, name: str = "value") -> DataFrame:
    """``value, n``, null included."""
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys on more than one row: ``key, n``."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")


def coverage_sample(left: DataFrame, right: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """Keys of one side that the other lacks: ``n_left, n_missing, sample`` (a few of them, in order)."""
    a, b = left.select(key).where(f"{key} is not null").distinct(), right.select(key).where(f"{key} is not null").distinct()
    marked = a.join(b.withColumn("_in", F.lit(True)), key, "left")
    gone = marked.where("_in is null").select(key).orderBy(key).limit(sample).agg(F.collect_list(key).alias("sample"))
    sums = marked.agg(F.count("*").alias("n_left"), F.count_if(F.col("_in").isNull()).alias("n_missing"))
    return sums.crossJoin(gone)  # one row each
