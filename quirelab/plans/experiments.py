"""Queries of resampling, null models, mechanisms, units and experiments, with SQL where it can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions.grammar import line_words
from quirelab.operators import coded, corpus, experiments, leftout, mechanisms, nulls, resample, signature, units
from quirelab.plans.corpus import lines_of
from quirelab.plans.sqltext import FLAT, LINES, registry
from quirelab.session import cut, table

QUERIES, ORACLE, query = registry()


def _draw(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5({_text(*parts)}), 1, 8))::bigint % {n})"


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5({_text(*parts)}), 1, 15))::bigint"


def _text(*parts: str) -> str:
    return " || ':' || ".join(f"({p})::varchar" for p in parts)


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    """The corpus grouped by who transcribed it, a few groups; null and spelling aside."""
    rows = table(spark, d, "line_records").where("line_id is not null").dropDuplicates(["line_id"])
    named = rows.select("line_id", F.coalesce("transcription_source", F.lit("none")).alias("grp"), line_words().alias("words"))
    return corpus.number_lines(named, [], "line_id").select("line_no", "grp", "words")


_SRC = LINES.replace("lines as", "l0 as") + ", lines as (select row_number() over (order by line_id) - 1 as line_no, g as grp, words from (select line_id, any_value(coalesce(transcription_source, 'none')) as g from line_records group by line_id) join (select line_no as m, words, line_id as i from (select row_number() over (order by line_id) - 1 as line_no, line_id from (select distinct line_id from line_records)) join l0 using (line_no)) on i = line_id)"

# --- folds -------------------------------------------------------------------------------------

_FOLDS = f"folds as (select grp, ((row_number() over (order by {_hash('42', 'grp')}) - 1) % 5)::int as fold from (select distinct grp from lines where grp <> ''))"


@query(f"with {LINES}, {_FOLDS} select * from folds")
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    return resample.group_folds(lines_of(spark, d), by_hash=True)


@query(f"with {LINES}, {_FOLDS}, s as (select grp, count(*) as n from lines group by 1) select fold, list(grp order by encode(grp)) as quires, sum(n)::bigint as n_rows from folds join s using (grp) group by 1")
def fold_manifest(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return resample.manifest(lines, resample.group_folds(lines, by_hash=True))


@query("select grp, count(distinct fold) as n_folds from (select distinct manifest_id || ':' || trim(unnest(quires)) as grp, fold from split_manifest) where grp is not null group by 1 having count(distinct fold) > 1")
def fold_leakage(spark: SparkSession, d: str) -> DataFrame:
    """H2 on the stored manifests, labels as they are spelled but for blanks."""
    listed = table(spark, d, "split_manifest").select("manifest_id", "fold", F.explode("quires").alias("q")).select(F.concat_ws(":", "manifest_id", F.trim("q")).alias("grp"), "fold", "q").where("q is not null")
    return resample.leakage(listed)


@query(f"with {LINES}, {_FOLDS} select (select count(*) from (select distinct grp from lines where grp not in (select grp from folds))) as missing_groups, 0::bigint as unknown_groups, (select count(*) from lines) as n_rows, (select count(*) from lines where grp in (select grp from folds)) as covered_rows, (select count(*) from lines where grp not in (select grp from folds)) = 0 as complete")
def fold_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return resample.coverage(lines, resample.group_folds(lines, by_hash=True))


@query(f"with {LINES}, {_FOLDS} select fold, count(*) as lines, sum(len(words))::bigint as words from lines join folds using (grp) group by 1")
def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return resample.fold_rows(lines, resample.group_folds(lines, by_hash=True)).groupBy("fold").agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))


# --- bootstrap, intervals, leave-one-out --------------------------------------------------------

_DRAWS = f"g as (select grp, row_number() over (order by min(line_no)) - 1 as g from lines group by grp), n as (select count(*) as n from g), draws as (select i::int as iter, j as draw_no, grp from range(0, 30) a(i), range(0, (select n from n)) b(j), n, g where g.g = {_draw('n', '42', 'i', 'j')})"


@query(f"with {LINES}, {_DRAWS} select * from draws")
def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    return resample.bootstrap_draws(lines_of(spark, d))


_HAPAX_ITER = "u as (select iter, word, count(*) as c from (select iter, unnest(words) as word from draws join lines using (grp)) group by all), h as (select iter, avg((c = 1)::int) as v from u group by 1)"


@query(f"""with {FLAT}, {_DRAWS}, {_HAPAX_ITER}, z as (select iter, ln(c) as y, ln(row_number() over (partition by iter order by c desc)) as x from u), s as (select iter, regr_slope(y, x) as v from z group by 1),
o as (select word, count(*) as c from flat group by 1), oz as (select ln(c) as y, ln(row_number() over (order by c desc)) as x from o),
b as (select 'hapax_ratio' as field, (select avg((c = 1)::int) from o) as observed, avg(v) as bootstrap_mean, stddev_pop(v) as sd from h union all select 'zipf_slope', (select regr_slope(y, x) from oz), avg(v), stddev_pop(v) from s)
select field, observed, bootstrap_mean, sd, observed - 2 * sd as lower, observed + 2 * sd as upper from b""", "observed bootstrap_mean sd lower upper")
def tolerance_two_fields(spark: SparkSession, d: str) -> DataFrame:
    """H5 for the two fields whose replicates SQL computes in time; 30 iterations."""
    bag = corpus.line_bag(table(spark, d, "line_records"))
    ties = cut(resample.resampled_ties(bag, resample.bootstrap_draws(lines_of(spark, d)), 30))
    hapax = ties.groupBy("iter").agg((F.sum(F.when(F.col("c") == 1, F.col("m")).otherwise(0)) / F.sum("m")).alias("hapax_ratio"))
    both = hapax.join(signature.zipf_from_ties(ties, ["iter"]), "iter")
    long = both.select("iter", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("hapax_ratio", "zipf_slope")))).alias("r")).select("iter", "r.*")
    return resample.tolerance(long.where("iter < 0").drop("iter"), long.where("iter >= 0"))


def _intervals(spark: SparkSession, d: str, iterations: int = 30, fractal: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = cut(lines_of(spark, d).select("line_no", "grp", "words"))
    rows = cut(coded.signatures(spark, coded.store(lines), [-1, *range(iterations)], signature.FIELDS, fractal))
    observed = rows.where("iter < 0").drop("iter")
    return lines, observed, cut(resample.tolerance(observed, rows.where("iter >= 0")))


@query()
def tolerance_intervals(spark: SparkSession, d: str) -> DataFrame:
    """H5 with all fields, 30 iterations beside each other."""
    return _intervals(spark, d)[2]


@query()
def interval_score(spark: SparkSession, d: str) -> DataFrame:
    """The within-line null model against the intervals."""
    lines, _, intervals = _intervals(spark, d)
    return experiments.null_baseline(lines, intervals)


@query(f"""with {_SRC}, u as (select o.grp as left_out, word, count(*) as c from (select distinct grp from lines) o, (select grp, unnest(words) as word from lines) w where w.grp <> o.grp group by all),
v as (select left_out, avg((c = 1)::int) as value from u group by 1), o as (select avg((c = 1)::int) as observed from (select word, count(*) as c from (select unnest(words) as word from lines) group by 1))
select 'hapax_ratio' as field, any_value(observed) as observed, min(value) as lowest, max(value) as highest, max(abs(value - observed)) as max_change, cast(null as double) as max_change_sd, arg_max(left_out, abs(value - observed)) as extreme_group, 1::int as "rank" from v, o""", "observed lowest highest max_change")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """X9, D7 for one field: how the hapax ratio moves without each transcription source."""
    hapax = (df.where("field = 'hapax_ratio'") for df in resample.count_fields(_by_source(spark, d)))
    return resample.homogeneity(*hapax)


_WITHOUT = f"""with {LINES},
c as (select grp, word, count(*) as c from (select grp, unnest(words) as word from lines) group by all), t as (select word, sum(c) as t from c group by 1),
x as (select grp, count(*) filter (c = t) as types, count(*) filter (t = 1) as ones, count(*) filter (t - c = 1) as fresh from c join t using (word) group by 1),
own as (select grp, count(*) filter (k > 0) as n, sum(k) as s1, sum(k * k) as s2, sum(k * k * k) as s3, count(*) filter (k >= 2) as n2, count(*) filter (k >= 2 and words[1] = words[2]) as o, count(*) filter (k >= 2 and words[-1] = words[-2]) as z from (select *, len(words) as k from lines) group by 1),
a as (select {", ".join(f"sum({x})::bigint as {x}" for x in ("n", "s1", "s2", "s3", "n2", "o", "z"))}, (select count(*) from t) as types, (select count(*) from t where t = 1) as single from own),
r as (select grp as left_out, {", ".join(f"(a.{x} - own.{x})::bigint as {x}" for x in ("n", "s1", "s2", "s3", "n2", "o", "z"))}, a.types - coalesce(x.types, 0) as types, single - coalesce(ones, 0) + coalesce(fresh, 0) as single from own left join x using (grp), a
  union all by name select cast(null as varchar) as left_out, * from a),
m as (select *, s1 / n as mean, (n * s2 - s1 * s1) / n / n as var from r),
f as (select left_out, unnest(['length_mean', 'length_variance', 'length_skew', 'onset', 'coda', 'onset_coda_ratio', 'hapax_ratio']) as field,
  unnest([mean, var, (s3 / n - 3 * mean * (s2 / n) + 2 * pow(mean, 3)) / pow(var, 1.5), o / n2, z / n2, (o / n2) / nullif(z / n2, 0), single / types]) as value from m),
d as (select l.field, l.left_out, l.value, q.value as observed, abs(l.value - q.value) as change from f l join f q on l.field = q.field and q.left_out is null where l.left_out is not null and l.value is not null and q.value is not null),
g as (select field, any_value(observed) as observed, min(value) as lowest, max(value) as highest, max(change) as max_change, arg_max(left_out, (round(change, 12), left_out)) as extreme_group from d group by 1)
select *, cast(null as double) as max_change_sd, row_number() over (order by max_change, field)::int as "rank" from g"""


@query(_WITHOUT, "observed lowest highest max_change")
def leave_one_quire_out(spark: SparkSession, d: str) -> DataFrame:
    """X9 for every quire, with the fields that follow from counts."""
    return resample.homogeneity(*resample.count_fields(lines_of(spark, d)))


@query()
def homogeneity(spark: SparkSession, d: str) -> DataFrame:
    """X9 for every quire, with all fields but the fractal ones, from what each quire changes."""
    lines = cut(lines_of(spark, d).select("line_no", F.coalesce("grp", F.lit("")).alias("grp"), "words"))
    path = coded.store(lines)
    observed = cut(coded.signatures(spark, path, [-1], signature.FIELDS, False).drop("iter"))
    apart = leftout.signatures(spark, path).join(resample.numbered_groups(lines).withColumnRenamed("grp", "left_out"), "g")
    return resample.homogeneity(observed, cut(apart.select("left_out", "field", "value")))


# --- null models -------------------------------------------------------------------------------


@query(f"with {LINES} select line_no, grp, list_transform(list_sort(list_transform(range(1, len(words) + 1), lambda i: {{'h': md5('42:' || line_no || ':' || (i - 1)), 'w': words[i]}})), lambda p: p.w) as words from lines")
def null_word_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return nulls.word_shuffle(lines_of(spark, d))


def _permuted(within: str) -> str:
    return f"a as (select line_no, grp, {within} as w, row_number() over (partition by {within} order by line_no) as k from lines), b as (select {within} as w, words, row_number() over (partition by {within} order by {_hash('42', 'line_no')}) as k from lines) select line_no, grp, words from a join b using (w, k)"


@query(f"with {LINES}, {_permuted('line_no // 20')}")
def null_line_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return nulls.chunk_shuffle(lines_of(spark, d))


@query(f"with {LINES}, {_permuted('grp')}")
def null_group_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return nulls.group_shuffle(lines_of(spark, d))


@query(f"with {LINES}, p as (select len(words) as k, words, row_number() over (partition by len(words) order by line_no) - 1 as i from lines), s as (select line_no, grp, len(words) as k, {_draw('count(*) over (partition by len(words))', '42', 'line_no')} as i from lines) select line_no, grp, words from s join p using (k, i)")
def null_freq_matched(spark: SparkSession, d: str) -> DataFrame:
    return nulls.frequency_matched(lines_of(spark, d))


_BLOCKS = f"n as (select count(*) as n from lines), s as (select line_no, grp, n, {_draw('((n + 19) // 20)', '42', 'line_no // 20')} * 20 + line_no % 20 as s from lines, n), t as (select line_no, grp, case when s < n then s else {_draw('n', '42', chr(39) + 'fill' + chr(39), 'line_no')} end as s from s)"


@query(f"with {LINES}, {_BLOCKS} select t.line_no, t.grp, l.words from t join lines l on l.line_no = t.s")
def null_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return nulls.block_bootstrap(lines_of(spark, d))


@query(f"with {FLAT}, t as (select [word, lead(word) over (order by pos)] as state, lead(word, 2) over (order by pos) as next from flat) select state, next, count(*) as c from t where next is not null group by all")
def markov_transitions(spark: SparkSession, d: str) -> DataFrame:
    return nulls.markov_transitions(lines_of(spark, d))


@query(f"with {LINES} select line_no, grp, len(words) as n_words from lines")
def markov_null(spark: SparkSession, d: str) -> DataFrame:
    """The shape of a walk; its words are random."""
    walk = nulls.markov_chain(cut(lines_of(spark, d)))
    return walk.select("line_no", "grp", F.size("words").cast("long").alias("n_words"))


@query(f"with {FLAT} select count(*) as words, 0::bigint as against_the_table from flat")
def markov_walk(spark: SparkSession, d: str) -> DataFrame:
    """Wherever the corpus has a run of words, a walk goes on from it as the table does."""
    lines = cut(lines_of(spark, d))
    made = cut(nulls.markov_chain(lines).select("line_no", "grp", "words"))
    runs = nulls.hashed_runs(made).select("state", "next", F.lit(1).alias("m"), F.lit(0).alias("k")).unionByName(nulls.hashed_runs(lines).select("state", "next", F.lit(0).alias("m"), F.lit(1).alias("k")))
    # One exchange by state: both aggregations then stay where the rows are.
    per = runs.repartition("state").groupBy("state", "next").agg(F.sum("m").alias("m"), F.max("k").alias("k")).groupBy("state").agg(F.sum("m").alias("m"), F.sum(F.when(F.col("k") == 0, F.col("m")).otherwise(0)).alias("off"), F.max("k").alias("k"))
    return per.agg((F.sum("m") + 2).alias("words"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("off"))), F.lit(0)).alias("against_the_table"))  # two words come before the first run


@query(f"with {LINES}, {_BLOCKS} select m as model, count(*) as lines, sum(len(words))::bigint as words from lines, (select unnest(['word_shuffle', 'chunk_shuffle', 'group_shuffle', 'markov_chain', 'frequency_matched']) as m) group by 1 union all select 'block_bootstrap', count(*), sum(len(l.words))::bigint from t join lines l on l.line_no = t.s")
def null_models(spark: SparkSession, d: str) -> DataFrame:
    """Lines and words of every model; their content is compared model by model."""
    return nulls.model_sizes(cut(lines_of(spark, d)))


# --- line types --------------------------------------------------------------------------------

_TYPES = "t as (select words, count(*) as c, min(line_no) as f from lines group by 1)"


@query(f"with {LINES}, {_TYPES}, r as (select c, ln(c) as y, ln(row_number() over (order by c desc)) as x from t) select count(*) as types, avg((c = 1)::int) as hapax_ratio, regr_slope(y, x) as zipf_slope from r", "hapax_ratio zipf_slope")
def line_type_hapax(spark: SparkSession, d: str) -> DataFrame:
    return experiments.line_type_statistics(corpus.line_bag(table(spark, d, "line_records")))


@query(f"with {LINES}, {_TYPES} select avg(len(words)) filter (c = 1) as hapax_mean, stddev_pop(len(words)) filter (c = 1) as hapax_sd, avg(len(words)) filter (c > 1) as other_mean, stddev_pop(len(words)) filter (c > 1) as other_sd, avg(len(words)) filter (c = 1) - avg(len(words)) filter (c > 1) as difference from t", "hapax_mean hapax_sd other_mean other_sd difference")
def hapax_length_contrast(spark: SparkSession, d: str) -> DataFrame:
    return experiments.hapax_lengths(corpus.line_bag(table(spark, d, "line_records")))


@query(f"with {LINES}, {_TYPES} select count(*) as novel, avg((c = 1)::int) as novel_hapax, avg(c) as mean_frequency, median(c) as median_frequency from t where f > 1000", "novel_hapax mean_frequency")
def novelty_survival(spark: SparkSession, d: str) -> DataFrame:
    return experiments.novelty_survival(lines_of(spark, d))


# --- scores of configurations that SQL can follow: each quire, and each bootstrap sample -----------

_PER_QUIRE = """u as (select grp, word, count(*) as c from (select grp, unnest(words) as word from lines) group by all),
z as (select grp, c, ln(c) as y, ln(row_number() over (partition by grp order by c desc)) as x from u),
q as (select grp as config_id, avg((c = 1)::int) as hapax_ratio, coalesce(regr_slope(y, x), 0) as zipf_slope from z group by 1)"""


def _per_quire(spark: SparkSession, d: str) -> DataFrame:
    flat = corpus.word_bag(corpus.line_bag(table(spark, d, "line_records"))).select("grp", "word")
    return signature.hapax_ratio(flat, ["grp"]).join(signature.zipf_slope(flat, ["grp"]), "grp").withColumnRenamed("grp", "config_id")


@query(f"with {LINES}, {_PER_QUIRE} select arg_min(config_id, (x, config_id)) as config_id, min(x) as distance from (select config_id, sqrt(pow(hapax_ratio - 0.701, 2) + pow(zipf_slope + 0.901, 2)) as x from q)", "distance")
def nearest_quire(spark: SparkSession, d: str) -> DataFrame:
    """D10 with the quires as configurations."""
    return experiments.nearest_config(_per_quire(spark, d), "hapax_ratio", "zipf_slope")


@query(f"with {LINES}, {_PER_QUIRE} select 'quires' as series, config_id, hapax_ratio, zipf_slope from q union all select 'again', config_id, hapax_ratio, zipf_slope from q", "hapax_ratio zipf_slope")
def scatter_quires(spark: SparkSession, d: str) -> DataFrame:
    """X8 with the quires as configurations; one series is missing."""
    rows = _per_quire(spark, d)
    return experiments.scatter_union({"quires": rows, "absent": None, "again": rows})


@query(f"with {LINES}, {_DRAWS}, {_HAPAX_ITER} select iter % 5 as config, avg(v) as hapax_ratio_mean, stddev_pop(v) as hapax_ratio_sd from h group by 1", "hapax_ratio_mean hapax_ratio_sd")
def seed_summary_draws(spark: SparkSession, d: str) -> DataFrame:
    """D6 with bootstrap samples as seeds, six to a configuration."""
    lines = lines_of(spark, d)
    many = corpus.word_bag(resample.resampled(lines, resample.bootstrap_draws(lines)), ["iter"])
    rows = signature.hapax_ratio(many, ["iter"]).withColumn("config", F.col("iter") % 5)
    return experiments.seed_summary(rows, ["config"], ["hapax_ratio"])


@query(f"""with {LINES}, {_PER_QUIRE}, {_DRAWS}, {_HAPAX_ITER.replace('u as', 'ui as').replace('from u group', 'from ui group')},
o as (select avg((c = 1)::int) as v from (select word, sum(c) as c from u group by 1)), i as (select (select v from o) - 2 * stddev_pop(v) as lo, (select v from o) + 2 * stddev_pop(v) as hi from h)
select config_id, (hapax_ratio between lo and hi)::int::bigint as matches, 2::bigint as total, (hapax_ratio between lo and hi)::int / 2 as match_fraction from q, i""", "match_fraction")
def quire_scores(spark: SparkSession, d: str) -> DataFrame:
    """The quires' fields against bootstrap intervals; zipf_slope has none and counts as no match."""
    lines = cut(lines_of(spark, d))
    long = lambda df, by: df.select(*by, F.lit("hapax_ratio").alias("field"), F.col("hapax_ratio").alias("value"))
    many = signature.hapax_ratio(corpus.word_bag(resample.resampled(lines, resample.bootstrap_draws(lines)), ["iter"]), ["iter"])
    intervals = resample.tolerance(long(signature.hapax_ratio(corpus.word_bag(lines)), []), long(many, ["iter"]))
    quires = _per_quire(spark, d)
    fields = quires.select("config_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("hapax_ratio", "zipf_slope")))).alias("r")).select("config_id", "r.*")
    return resample.match_report(resample.interval_scores(fields, intervals, ["config_id"]), ["config_id"])


# --- mechanisms --------------------------------------------------------------------------------


def _n_lines(configs: list, n_words: int) -> int:
    """As many lines as the corpus has words, as in the published sweeps; fractal lines have that many words in all."""
    return max(1, round(n_words / configs[0].length_mean)) if isinstance(configs[0], mechanisms.Fractal) else n_words


def _grid(spark: SparkSession, d: str, configs: list, seeds=(42,)) -> DataFrame:
    """Line types of a grid grown from all lines to the corpus's size."""
    lines = cut(lines_of(spark, d).select("line_no", "grp", "words"))
    n_words = lines.agg(F.sum(F.greatest(F.size("words"), F.lit(0)))).first()[0] or 0
    ties = cut(mechanisms.grid_type_counts(spark, configs, coded.store(lines), _n_lines(configs, n_words), seeds, True))
    return experiments.grid_statistics(ties).join(mechanisms.config_table(spark, configs), "config_id")


def _scores(spark: SparkSession, d: str, configs: list, seeds=(42,)) -> tuple[DataFrame, DataFrame]:
    """Type counts of a grid, and the scores of its corpora's signatures; each corpus is made once and not written."""
    lines, _, intervals = _intervals(spark, d)
    n_words = lines.agg(F.sum(F.greatest(F.size("words"), F.lit(0)))).first()[0] or 0
    made = cut(mechanisms.scored_rows(spark, configs, coded.store(lines if lines.inputFiles() else cut(lines)), _n_lines(configs, n_words), seeds, signature.FIELDS))
    fields = made.where("field is not null").select("config_id", "seed", "field", "value")
    return made.where("field is null").drop("field", "value"), experiments.score_fields(fields, intervals)


def _scored(spark: SparkSession, d: str, configs: list, seeds=(42,)) -> DataFrame:
    """Line types of a grid, and D9: the signature of each of its corpora against the intervals; most matches first."""
    ties, scores = _scores(spark, d, configs, seeds)
    rows = experiments.grid_statistics(ties).join(scores, ["config_id", "seed"]).join(mechanisms.config_table(spark, configs), "config_id")
    return rows.orderBy(F.desc("matches"), "config_id", "seed")


@query()
def self_citation_grid(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return _scored(spark, d, experiments.self_citation_grid())


@query()
def dictionary_grid(spark: SparkSession, d: str) -> DataFrame:
    """X2."""
    return _scored(spark, d, experiments.dictionary_grid())


@query()
def pa_grid(spark: SparkSession, d: str) -> DataFrame:
    """X3 without its scores, which are in sweep_scores."""
    return _grid(spark, d, experiments.attachment_grid())


@query()
def fractal_grid(spark: SparkSession, d: str) -> DataFrame:
    """X4."""
    return _scored(spark, d, experiments.fractal_grid())


@query()
def vocab_dynamics_grid(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    return _scored(spark, d, experiments.vocabulary_grid())


@query()
def pa_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """44 configurations by five seeds, summed up over the seeds."""
    rows = _scored(spark, d, experiments.attachment_sweep(), (42, 101, 202, 303, 404))
    return experiments.seed_summary(rows, ["config_id", "parameters"], ["hapax_ratio", "zipf_slope", "matches"])


@query()
def best_config(spark: SparkSession, d: str) -> DataFrame:
    """D10 over the vocabulary grid."""
    return experiments.nearest_config(_grid(spark, d, experiments.vocabulary_grid()), "hapax_ratio", "zipf_slope")


@query()
def scatter(spark: SparkSession, d: str) -> DataFrame:
    """Hapax and Zipf of several grids in one table; one is missing."""
    return experiments.scatter_union({"attachment": _grid(spark, d, experiments.attachment_grid()), "fractal": _grid(spark, d, experiments.fractal_grid()), "absent": None})


@query()
def sweep_scores(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of a grid scored against the intervals."""
    return _scores(spark, d, experiments.attachment_grid())[1]


# --- units -------------------------------------------------------------------------------------


@query()
def bpe_vocab(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2."""
    return units.unit_inventory(units.word_types(corpus.line_bag(table(spark, d, "line_records"))))


@query()
def bpe_jaccard_by_group(spark: SparkSession, d: str) -> DataFrame:
    return units.group_coverage(corpus.line_bag(table(spark, d, "line_records")))


@query()
def bpe_presence(spark: SparkSession, d: str) -> DataFrame:
    return units.unit_presence(corpus.line_bag(table(spark, d, "line_records")))


@query()
def bpe_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """G6."""
    return units.bootstrap_stability(cut(lines_of(spark, d).select("line_no", "grp", "words")))
