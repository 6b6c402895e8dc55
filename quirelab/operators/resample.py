"""Group folds, bootstrap draws, tolerance intervals and leave-one-out, as joins on draw tables."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.operators.corpus import number_lines, prefix, word_bag
from quirelab.session import cut

#: Group labels that can be shuffled on the driver; more need ``by_hash``.
ON_DRIVER = 100_000
#: Fields that are not scored.
NOT_SCORED = ["group_stability", "cross_agreement", "template_transition"]


def draw(n: Column, *parts: Column | int | str) -> Column:
    """A repeatable draw from 0 .. n - 1: the first 8 hex digits of an MD5 over the parts, modulo n."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def order_hash(*parts: Column | int | str) -> Column:
    """A repeatable number of 60 bits from the parts, to put rows in a random order."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: Block width that cuts the range of order_hash into 65,536 pieces.
HASH_BLOCK = 1 << 44


def group_folds(lines: DataFrame, n_folds: int = 5, seed: int = 42, by_hash: bool = False) -> DataFrame:
    """H1: ``grp, fold`` for every group but the empty one.

    Groups in order of first appearance are shuffled, and every n-th goes to the same fold.
    ``by_hash``: order by the MD5 of seed and label, for any number of groups, instead of a
    seeded shuffle of the labels on the driver. Without groups, or with more than ON_DRIVER and no
    ``by_hash``, this raises ValueError: the rule never changes by itself.
    """
    groups = lines.where("grp is not null and grp <> ''").groupBy("grp").agg(F.min("line_no").alias("o"))
    n = groups.count()
    if not n:
        raise ValueError("no groups to split")
    if not by_hash and n > ON_DRIVER:
        raise ValueError(f"{n} groups are too many for a shuffle on the driver; set by_hash")
    if by_hash:
        ranked = prefix(groups.withColumn("h", order_hash(seed, F.col("grp"))), [], "h", F.lit(1), "r", HASH_BLOCK)
        return ranked.select("grp", F.pmod("r", F.lit(n_folds)).cast("int").alias("fold"))
    labels = [r["grp"] for r in groups.orderBy("o").collect()]
    random.Random(seed).shuffle(labels)
    return lines.sparkSession.createDataFrame([(g, i % n_folds) for i, g in enumerate(labels)], "grp string, fold int")


def fold_rows(lines: DataFrame, folds: DataFrame) -> DataFrame:
    """Lines with their fold; lines without a group are in none and are left out."""
    return lines.join(folds, "grp")


def manifest(lines: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold, quires, n_rows``, the quires of a fold in order of their name."""
    sizes = lines.groupBy("grp").agg(F.count("*").alias("n"))
    return folds.join(sizes, "grp", "left").groupBy("fold").agg(F.array_sort(F.collect_list("grp")).alias("quires"), F.sum(F.coalesce("n", F.lit(0))).alias("n_rows"))


def leakage(folds: DataFrame) -> DataFrame:
    """H2: groups that stand in more than one fold: ``grp, n_folds``; none if the folds are sound."""
    return folds.groupBy("grp").agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


def coverage(lines: DataFrame, folds: DataFrame) -> DataFrame:
    """H2: one row ``missing_groups, unknown_groups, n_rows, covered_rows, complete``.

    ``missing_groups``: groups with lines but no fold (the empty group included);
    ``unknown_groups``: folds' groups without lines.
    """
    have, want = lines.select("grp").distinct(), folds.select("grp").distinct()
    missing = have.join(want, "grp", "left_anti").agg(F.count("*").alias("missing_groups"))
    unknown = want.join(have, "grp", "left_anti").agg(F.count("*").alias("unknown_groups"))
    rows = lines.join(want.withColumn("in", F.lit(1)), "grp", "left").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("in"), F.lit(0)).alias("covered_rows"))
    out = missing.crossJoin(unknown).crossJoin(rows)  # three single rows
    return out.withColumn("complete", F.expr("missing_groups = 0 and unknown_groups = 0 and n_rows = covered_rows"))


def numbered_groups(lines: DataFrame) -> DataFrame:
    """``grp, g``: groups numbered from 0 in order of their first line."""
    firsts = lines.groupBy("grp").agg(F.min("line_no").alias("o"))
    return prefix(firsts, [], "o", F.lit(1), "g").select("grp", F.col("g").cast("long").alias("g"))


def bootstrap_draws(lines: DataFrame, iterations: int = 30, seed: int = 42) -> DataFrame:
    """``iter, draw_no, grp``: in each iteration as many groups as there are, with replacement."""
    groups = numbered_groups(lines)
    n = groups.count()
    slots = lines.sparkSession.range(iterations * n).select((F.col("id") / n).cast("int").alias("iter"), (F.col("id") % n).alias("draw_no")) if n else lines.sparkSession.createDataFrame([], "iter int, draw_no long")
    picked = slots.withColumn("g", draw(F.lit(n), seed, F.col("iter"), F.col("draw_no")))
    return picked.join(groups, "g").select("iter", "draw_no", "grp")


def resampled(lines: DataFrame, draws: DataFrame) -> DataFrame:
    """H4: the corpus of each iteration: lines of the drawn groups in order of the draws. All replicates are one table, keyed by ``iter``."""
    rows = draws.join(lines, "grp").select("iter", (F.col("draw_no") * (1 << 34) + F.col("line_no")).alias("o"), "grp", "words")
    return number_lines(rows, ["iter"], "o").select("iter", "line_no", "grp", "words")


def resampled_ties(lines: DataFrame, draws: DataFrame, iterations: int) -> DataFrame:
    """Word counts of every iteration without its copy of the corpus: ``iter, c, m``: ``m`` word types occur ``c`` times.

    A group's words count as often as it was drawn, so one aggregation by word sums all iterations
    beside each other. The corpus itself is iteration -1.
    """
    drawn = draws.groupBy("grp").agg(F.array(*(F.count_if(F.col("iter") == i).cast("int") for i in range(iterations))).alias("_t"))
    placed = lines.where(F.size("words") > 0).select("grp", "words").join(drawn, "grp", "left").select("_t", F.explode("words").alias("word"))
    sums = placed.groupBy("word").agg(F.count("*").alias("_c"), *(F.coalesce(F.sum(F.col("_t")[i]), F.lit(0)).alias(f"_{i}") for i in range(iterations)))
    counts = sums.select(F.posexplode(F.array("_c", *(f"_{i}" for i in range(iterations)))).alias("i", "c")).where("c > 0")
    return counts.groupBy((F.col("i") - 1).alias("iter"), "c").agg(F.count("*").alias("m"))


def tolerance(observed: DataFrame, replicates: DataFrame, width: float = 2.0) -> DataFrame:
    """``field, observed, bootstrap_mean, sd, lower, upper`` from ``field, value`` and ``iter, field, value``.

    Population deviation over the replicates with a value; bounds are null where the observed
    value or all replicates are.
    """
    spread = replicates.where("value is not null").groupBy("field").agg(F.avg("value").alias("bootstrap_mean"), F.stddev_pop("value").alias("sd"))
    out = observed.select("field", F.col("value").alias("observed")).join(spread, "field", "left")
    return out.withColumn("lower", F.col("observed") - width * F.col("sd")).withColumn("upper", F.col("observed") + width * F.col("sd"))


def interval_scores(signatures: DataFrame, intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D9 field by field: ``[*by,] field, value, lower, upper, within``.

    Null values and the fields of NOT_SCORED are left out; missing bounds count as not within.
    """
    rows = signatures.where(F.col("value").isNotNull() & ~F.col("field").isin(NOT_SCORED)).join(intervals.select("field", "lower", "upper"), "field", "left")
    return rows.select(*by, "field", "value", "lower", "upper", F.coalesce(F.col("value").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("within"))


def match_report(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D9 in total: ``[*by,] matches, total, match_fraction``."""
    out = scores.groupBy(*by).agg(F.count_if("within").alias("matches"), F.count("*").alias("total"))
    return out.withColumn("match_fraction", F.coalesce(F.try_divide("matches", "total"), F.lit(0.0)))


def without_each_group(lines: DataFrame) -> DataFrame:
    """The corpus without each of its groups in turn, keyed by ``left_out``, groups one after another.

    One copy of the corpus per group but one; meant for few groups (sections, sources, folds). For
    fields that follow from counts, :func:`count_fields` takes any number of groups without copies.
    """
    groups = numbered_groups(lines)
    # Every line once for every other group: the replicates themselves, each of which is evaluated.
    n = groups.count()
    if not n:
        return lines.select(F.col("grp").alias("left_out"), "line_no", "grp", "words")
    spread = lines.join(groups, "grp").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where("_other <> g")
    rows = spread.join(groups.select(F.col("g").alias("_other"), F.col("grp").alias("left_out")), "_other")
    ordered = rows.select("left_out", (F.col("g") * (1 << 34) + F.col("line_no")).alias("o"), "grp", "words")
    return number_lines(ordered, ["left_out"], "o").select("left_out", "line_no", "grp", "words")


def count_fields(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X9 for the fields that follow from counts, over any number of groups: observed ``field, value``, and ``left_out, field, value``.

    Fields: length_mean, length_variance, length_skew, onset, coda, onset_coda_ratio, hapax_ratio.
    What is left without a group is the total minus the group's own count. Of a word only the
    groups with all its occurrences, or all but one, change the single words: at most two groups.
    """
    k = F.size("words").cast("long")
    full = lambda x: F.coalesce(F.sum(F.when(k > 0, x)), F.lit(0)).cast("long")
    pair = lambda x: F.coalesce(F.sum(F.when(k >= 2, x.cast("long"))), F.lit(0))
    same = lambda a, b: F.try_element_at("words", F.lit(a)) == F.try_element_at("words", F.lit(b))
    sums = lines.groupBy("grp").agg(full(F.lit(1)).alias("n"), full(k).alias("s1"), full(k * k).alias("s2"), full(k * k * k).alias("s3"), pair(F.lit(1)).alias("n2"), pair(same(1, 2)).alias("on"), pair(same(-1, -2)).alias("co"))
    counts = word_bag(lines).groupBy("grp", "word").agg(F.count("*").alias("c"))
    per = counts.groupBy("word").agg(F.sum("c").alias("t"), F.max("c").alias("m"), F.max_by("grp", F.struct("c", "grp")).alias("top"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    change = lambda g, types, single: F.struct(F.col(g).alias("grp"), F.lit(types).cast("long").alias("types"), F.lit(single).cast("long").alias("single"))
    hit = F.when(F.expr("m = t and t = 1"), F.array(change("top", 1, 1))).when(F.expr("m = t"), F.array(change("top", 1, 0))).when(F.expr("t = 2"), F.array(change("lo", 0, -1), change("hi", 0, -1))).when(F.expr("t - m = 1"), F.array(change("top", 0, -1)))
    gone = per.select(F.explode(hit).alias("h")).groupBy(F.col("h.grp").alias("grp")).agg(F.sum("h.types").alias("types"), F.sum("h.single").alias("single"))
    own = cut(sums.join(gone, "grp", "left").na.fill(0, ["types", "single"]))
    names = [c for c in own.columns if c != "grp"]
    words = per.agg(F.count("*").alias("types"), F.count_if(F.col("t") == 1).alias("single"))
    total = cut(own.groupBy().agg(*(F.sum(c).alias(c) for c in names if c not in ("types", "single"))).crossJoin(words))  # one row each

    def fields(df: DataFrame, by: Sequence[str]) -> DataFrame:
        mean, square, cube = (F.try_divide(F.col(f"s{i}").cast("double"), F.col("n")) for i in (1, 2, 3))
        # Without the mean's square the variance is an integer over n squared: exact zero for equal lengths.
        variance = F.try_divide((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double"), F.col("n").cast("double") * F.col("n"))
        skew = F.when(F.col("n") > 0, F.coalesce(F.try_divide(cube - 3 * mean * square + 2 * mean * mean * mean, F.nullif(F.pow(variance, F.lit(1.5)), F.lit(0.0))), F.lit(0.0)))
        onset, coda = F.try_divide("on", "n2"), F.try_divide("co", "n2")
        values = {"length_mean": mean, "length_variance": variance, "length_skew": skew, "onset": onset, "coda": coda, "onset_coda_ratio": F.try_divide(onset, F.nullif(coda, F.lit(0.0))), "hapax_ratio": F.try_divide("single", "types")}
        return df.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.cast("double").alias("value")) for f, v in values.items()))).alias("r")).select(*by, "r.*")

    both = own.crossJoin(F.broadcast(total.select(*(F.col(c).alias(f"_{c}") for c in names))))  # one row
    rest = both.select(F.col("grp").alias("left_out"), *((F.col(f"_{c}") - F.col(c)).alias(c) for c in names))
    return fields(total, []), fields(rest, ["left_out"])


def homogeneity(observed: DataFrame, left_out: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """``field, observed, lowest, highest, max_change, max_change_sd, extreme_group, rank`` over the groups left out.

    ``rank`` 1 is the most stable field, by change in deviations of the intervals, or by the bare
    change without intervals. Fields without values have no row.
    """
    rows = left_out.where("value is not null").join(observed.where("value is not null").select("field", F.col("value").alias("observed")), "field")
    change = F.abs(F.col("value") - F.col("observed"))
    out = rows.groupBy("field").agg(F.first("observed").alias("observed"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.max(change).alias("max_change"), F.max_by("left_out", F.struct(change, "left_out")).alias("extreme_group"))
    if intervals is not None:
        out = out.join(intervals.select("field", "sd"), "field", "left").withColumn("max_change_sd", F.try_divide("max_change", F.nullif("sd", F.lit(0.0)))).drop("sd")
    else:
        out = out.withColumn("max_change_sd", F.lit(None).cast("double"))
    rank = F.row_number().over(Window.orderBy(F.coalesce("max_change_sd", "max_change"), "field"))  # one row per field
    return out.select("field", "observed", "lowest", "highest", "max_change", "max_change_sd", "extreme_group", rank.alias("rank"))
