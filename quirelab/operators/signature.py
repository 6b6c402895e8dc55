"""The joint signature S1 to S15 of a corpus, each as an aggregate plan.

Every function takes a corpus (see :mod:`quirelab.operators.corpus`) or its word stream and
returns one row per value of ``by``. A statistic that is not defined is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.operators import boxes, coding, series
from quirelab.operators.corpus import encoded, followers, words
from quirelab.session import cut

#: Fields of the signature, in order.
FIELDS = [
    "conditional_entropy", "length_mean", "length_variance", "length_skew", "mi_plateau", "onset", "coda", "onset_coda_ratio", "edge_mi",
    "zipf_slope", "hapax_ratio", "lz77_ratio", "group_stability", "cross_agreement", "positional_divergence", "template_transition",
    "hurst_dfa", "multifractal_delta_h", "box_dimension",
]
#: Ranks of a tie counted in one task.
CHUNK = 1_000_000


def _clog() -> Column:
    """The sum of c log c over a table of counts ``c``."""
    return F.expr("sum(c * log2(c))")


def _one(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by) if by else df.groupBy()


def word_counts(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[*by,] word, c``."""
    return flat.groupBy(*by, "word").agg(F.count("*").alias("c"))


def conditional_entropy(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entropy of a word given the one before, over the whole stream; null under two words.

    The sum over bigrams splits into sums over bigram counts and over word counts, so neither
    table is joined to the other; the last word starts no bigram and is corrected for.
    """
    single = flat.groupBy(*by, "word").agg(F.count("*").alias("c"), F.max("pos").alias("p"))
    one = _one(single, by).agg(F.sum("c").alias("n"), _clog().alias("u"), F.max_by("c", "p").alias("last"))
    pairs = followers(flat, by, "pos", "word", [1]).select(*by, "word", F.col("nexts")[0].alias("y")).where("y is not null")
    two = _one(pairs.groupBy(*by, "word", "y").agg(F.count("*").alias("c")), by).agg(_clog().alias("b"))
    m = F.col("n") - 1
    h = -(F.col("b") - F.col("u") + F.log2("last") - m * F.log2(m.cast("double")) + m * F.log2(F.col("n").cast("double"))) / m
    joined = one.join(two, list(by), "left") if by else one.crossJoin(two)  # one row each
    return joined.select(*by, F.when(F.col("n") >= 2, h).alias("conditional_entropy"))


def line_lengths(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population variance and skew of the lengths of lines with words."""
    k = lines.select(*by, F.size("words").alias("k")).where("k > 0")
    return _one(k, by).agg(F.avg("k").alias("length_mean"), F.var_pop("k").alias("length_variance"), F.when(F.count("k") > 0, F.coalesce(F.skewness("k"), F.lit(0.0))).alias("length_skew"))


def mi_plateau(flat: DataFrame, by: Sequence[str] = (), nearest: int = 10, farthest: int = 50) -> DataFrame:
    """S3: mean over distances of the positive mutual informations of words that far apart.

    MI = log n + (sum of c log c over pairs, minus the same over either side) / n. Only the pairs
    are counted per distance. A side's counts are the word counts less what stands in the last (or
    first) d places, so its sum is that of the word counts, corrected for at most ``farthest``
    words. Words go by their 64-bit hashes. Null if the stream is not longer than ``farthest``, or
    no distance has any.
    """
    ds = list(range(nearest, farthest + 1))
    keys = [*by, "d"]
    coded = flat.select(*by, "pos", F.xxhash64("word").alias("x"))
    ahead = followers(coded, by, "pos", "x", ds)
    pairs = ahead.select(*by, "x", F.posexplode("nexts").alias("d", "y")).where("y is not null").withColumn("d", F.col("d") + nearest)
    joint = pairs.groupBy(*keys, "x", "y").agg(F.count("*").alias("c")).groupBy(*keys).agg(_clog().alias("xy"), F.sum("c").alias("m"))
    single = coded.groupBy(*by, "x").agg(F.count("*").alias("c"))
    whole = _one(single, by).agg(F.sum("c").alias("n"), _clog().alias("u"))
    with_whole = lambda df: df.join(whole, list(by)) if by else df.crossJoin(F.broadcast(whole))  # noqa: E731  # one row
    placed = with_whole(coded)
    # At most 2 x farthest words: the ends of the stream, with how often each occurs in all.
    ends = placed.where(f"pos < {farthest} or pos >= n - {farthest}").join(single, [*by, "x"])
    near = ends.select(*by, "x", "pos", "n", "c", F.explode(F.array(*map(F.lit, ds))).alias("d"))

    def side(cut_off: str, name: str) -> DataFrame:
        gone = near.where(cut_off).groupBy(*keys, "x").agg(F.count("*").alias("t"), F.first("c").alias("c"))
        rest = F.expr("sum(if(c > t, (c - t) * log2(c - t), 0.0) - c * log2(c))")
        return gone.groupBy(*keys).agg(rest.alias(name))

    mi = with_whole(joint).join(side("pos >= n - d", "sx"), keys).join(side("pos < d", "sy"), keys)
    bits = F.log2(F.col("m").cast("double")) + (F.col("xy") - 2 * F.col("u") - F.col("sx") - F.col("sy")) / F.col("m")
    mi = mi.withColumn("mi", bits)
    # Sums that cancel leave rounding, not information.
    positive = F.when(F.col("mi") > 1e-9, F.col("mi"))
    return _one(mi, by).agg(F.when(F.max("n") >= farthest + 1, F.avg(positive)).alias("mi_plateau"))


def first_pair_agreement(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of lines with two words or more whose first two, or last two, words are equal, and their ratio."""
    w = lines.where(F.size("words") >= 2)
    same = lambda a, b: F.avg((F.element_at("words", a) == F.element_at("words", b)).cast("double"))
    return _one(w, by).agg(same(1, 2).alias("onset"), same(-1, -2).alias("coda")).withColumn("onset_coda_ratio", F.try_divide("onset", F.nullif("coda", F.lit(0.0))))


def edge_mi(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information of a line's last word and the next line's first; both must have words. Null if not positive."""
    ends = lines.select(*by, "line_no", F.try_element_at("words", F.lit(-1)).alias("x"), F.get("words", F.lit(0)).alias("first"))
    pairs = followers(ends, by, "line_no", "first", [1]).select(*by, "x", F.col("nexts")[0].alias("y")).where("x is not null and y is not null")
    joint = pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("c"))
    total = _one(joint, by).agg(_clog().alias("xy"), F.sum("c").alias("n"))
    side = lambda c: _one(joint.groupBy(*by, c).agg(F.sum("c").alias("c")), by).agg(_clog().alias(f"s{c}"))
    put = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(b)
    mi = F.log2(F.col("n").cast("double")) + (F.col("xy") - F.col("sx") - F.col("sy")) / F.col("n")
    return put(put(total, side("x")), side("y")).select(*by, F.when(mi > 1e-12, mi).alias("edge_mi"))


def zipf_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """S6 from ``[*by,] c``: slope of ln count on ln rank, ties at successive ranks; 0 for one type.

    Types with equal counts are kept as one row, ranked over these rows (few, at most about the
    root of twice the corpus), and their ranks are rolled out in pieces over the tasks.
    """
    return zipf_from_ties(counts.groupBy(*by, "c").agg(F.count("*").alias("m")), by)


def zipf_from_ties(ties: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from ``[*by,] c, m``: ``m`` types occur ``c`` times."""
    start = F.sum("m").over(Window.partitionBy(*by).orderBy(F.desc("c"))) - F.col("m")
    pieces = ties.withColumn("a", start).withColumn("k", F.explode(F.expr(f"sequence(0L, cast((m - 1) div {CHUNK} as bigint))")))
    ranks = pieces.select(*by, "c", F.explode(F.expr(f"sequence(a + k * {CHUNK} + 1, a + least(m, (k + 1) * {CHUNK}))")).alias("r"))
    return _one(ranks, by).agg(F.when(F.count("*") > 0, F.coalesce(F.expr("regr_slope(ln(c), ln(r))"), F.lit(0.0))).alias("zipf_slope"))


def zipf_slope(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """S6 over words."""
    return zipf_from_counts(word_counts(flat, by), by)


def hapax_ratio(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of distinct words that occur once."""
    return _one(word_counts(flat, by), by).agg(F.avg((F.col("c") == 1).cast("double")).alias("hapax_ratio"))


def group_stability(lines: DataFrame, flat: DataFrame, by: Sequence[str] = (), top: int = 100) -> DataFrame:
    """Over the ``top`` most frequent words, the mean share of groups that have the word.

    Ties go to the word seen first when lines are read group by group, groups in order of their
    first line. Groups without words count as groups.
    """
    firsts = lines.groupBy(*by, "grp").agg(F.min("line_no").alias("g"))
    n_groups = _one(firsts, by).agg(F.count("*").alias("n"))
    per = flat.groupBy(*by, "word", "grp").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    ranked = per.join(firsts, [*by, "grp"]).groupBy(*by, "word").agg(F.sum("c").alias("c"), F.count("*").alias("k"), F.min(F.struct("g", "p")).alias("f"))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("c"), "f"))).where(F.col("r") <= top)
    joined = best.join(n_groups, list(by)) if by else best.crossJoin(F.broadcast(n_groups))  # one row
    return _one(joined, by).agg(F.avg(F.col("k") / F.col("n")).alias("group_stability"))


def cross_agreement(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the similarity scores that are there."""
    return _one(scores, by).agg(F.avg("similarity_score").alias("cross_agreement"))


def bin_of(x: str, bins: int = 10) -> Column:
    """The bin of a value in [0, 1]: edges i * (1 / bins) as doubles, the last bin closed."""
    step = 1.0 / bins
    out = F.lit(bins - 1)
    for i in range(bins - 1, 0, -1):
        out = F.when(F.col(x) < F.lit(i * step), F.lit(i - 1)).otherwise(out)
    return out


def positional_divergence(lines: DataFrame, flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean entropy over ten bins of where in the corpus a word's lines lie.

    Only words that occur twice and fall in more than one bin count.
    """
    n = _one(lines, by).agg(F.count("*").alias("n"))
    joined = flat.join(n, list(by)) if by else flat.crossJoin(F.broadcast(n))  # one row
    binned = joined.withColumn("x", F.col("line_no") / F.greatest(F.lit(1), F.col("n") - 1)).withColumn("b", bin_of("x"))
    per = binned.groupBy(*by, "word", "b").agg(F.count("*").alias("c")).groupBy(*by, "word").agg(F.sum("c").alias("t"), F.count("*").alias("k"), _clog().alias("s"))
    return _one(per.where("t >= 2 and k > 1"), by).agg(F.expr("avg(log2(t) - s / t)").alias("positional_divergence"))


def fractal_fields(lines: DataFrame, flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """S13 to S15 of ids by first appearance; null under 1000 words (S15: under 100 points)."""
    sizes = _one(flat, by).agg(F.count("*").alias("_n"))
    ids = cut(encoded(flat, by))
    dfa = series.hurst_dfa(ids, by).select(*by, F.col("h").alias("hurst_dfa"))
    mf = series.multifractal_summary(ids, by).select(*by, F.col("delta_h").alias("multifractal_delta_h"))
    box = boxes.box_dimension(boxes.line_points(lines, flat, by, least_words=2), by).select(*by, F.col("dimension").alias("box_dimension"))
    put = lambda a, b: a.join(b, list(by), "left") if by else a.join(b, F.lit(True), "left")
    out = reduce(put, [sizes, dfa, mf, box])
    return out.select(*by, *(F.when(F.col("_n") >= 1000, F.col(c)).alias(c) for c in ("hurst_dfa", "multifractal_delta_h", "box_dimension")))


def joint_signature(lines: DataFrame, scores: DataFrame | None = None, by: Sequence[str] = (), fractal: bool = True) -> DataFrame:
    """All fields as ``[*by,] field, value``, one row each; undefined values are null.

    The word stream is written once, since a dozen aggregations read it.
    """
    flat = cut(words(lines, by))
    parts = [
        conditional_entropy(flat, by), line_lengths(lines, by), mi_plateau(flat, by), first_pair_agreement(lines, by), edge_mi(lines, by), zipf_slope(flat, by),
        hapax_ratio(flat, by), coding.lz77_signature(flat, by), group_stability(lines, flat, by), positional_divergence(lines, flat, by),
    ]
    if scores is not None:
        parts.append(cross_agreement(scores, [c for c in by if c in scores.columns]))
    if fractal:
        parts.append(fractal_fields(lines, flat, by))
    long = []
    for p in parts:
        fields = [c for c in p.columns if c in FIELDS]
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))).alias("r")
        long.append(p.select(*[c for c in by if c in p.columns], pairs).select(*[c for c in by if c in p.columns], "r.field", "r.value"))
    full = reduce(lambda a, b: a.unionByName(b), [x for x in long if all(c in x.columns for c in by)])
    keys = lines.select(*by).distinct() if by else lines.sparkSession.range(1).select()
    wanted = keys.select(*by, F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    out = wanted.join(full, [*by, "field"], "left")
    for x in long:
        if not all(c in x.columns for c in by):  # the same score for every replicate
            out = out.join(F.broadcast(x.withColumnRenamed("value", "_v")), "field", "left").withColumn("value", F.coalesce("value", "_v")).drop("_v")
    return out.select(*by, "field", "value")
