"""Queries of the corpus statistics, with their SQL: sources, joins, signature, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.functions.keys import normalize_quire, plain_key
from quirelab.operators import boxes, coding, corpus, experiments, series, signature
from quirelab.plans.sqltext import EVENTS, FLAT, QUIRE, profile, registry, scale_table, scales
from quirelab.session import cut, table
from quirelab.sources import audit, readers

QUERIES, ORACLE, query = registry()


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.line_corpus(table(spark, d, "line_records"))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return corpus.words(lines_of(spark, d))


def _bag(spark: SparkSession, d: str) -> DataFrame:
    """Lines for statistics that do not look at order."""
    return corpus.line_bag(table(spark, d, "line_records"))


# --- sources, parsing, joins -------------------------------------------------------------------

_TABLES = ["customer", "documents", "embeddings", "eval_items", "events", "folio_records", "level_labels", "line_records", "lineitem", "mismatch_main", "mismatch_mirror", "mix_targets", "nation", "orders", "page_records", "part", "quire_records", "region", "split_manifest", "supplier"]


@query(" union all ".join(f"select '{t}' as name, 'loaded' as status, count(*) as row_count from {t}" for t in _TABLES))
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    """A6 of every table; source_hashes has the hashes too."""
    return audit.run_audit(spark, {t: f"{d}/{t}.parquet" for t in _TABLES}, hashed=False).select("name", "status", "row_count")


@query()
def source_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A6 of every table, with its hash."""
    return audit.run_audit(spark, {t: f"{d}/{t}.parquet" for t in _TABLES}).select("name", "status", "row_count", "sha256")


@query(f"select distinct quire, {QUIRE.format('quire')} as normalized from line_records")
def quire_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_records").select("quire", normalize_quire(F.col("quire")).alias("normalized")).distinct()


@query(r"select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s]+'), lambda w: w <> '') as words from documents")
def tokenise_white(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.white_words(F.col("text")).alias("words"))


@query("""select line_id, list_filter(regexp_split_to_array(coalesce(trim(t[1], ' 	 '), ''), '[.,]'), lambda w: w <> '') as first_words,
  list_filter(flatten(list_transform(coalesce(t, []), lambda x: regexp_split_to_array(coalesce(trim(x, ' 	 '), ''), '[.,]'))), lambda w: w <> '') as all_words
from (select line_id, any_value(tokens) as t from line_records group by line_id)""")
def tokenise_dotted(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "line_records").dropDuplicates(["line_id"])
    return lines.select("line_id", readers.dotted_words("tokens", True).alias("first_words"), readers.dotted_words("tokens").alias("all_words"))


@query(rf"""select line_id, coalesce(page, '') as page, regexp_replace(coalesce(page, ''), '[rv]$', '') as folio, {QUIRE.format('quire')} as quire, coalesce(line_number, 0) as line_number,
  list_filter(regexp_split_to_array(coalesce(raw_text, ''), '[\s]+'), lambda w: w <> '') as tokens, coalesce(raw_text, '') as raw_text, 'unknown' as transcription_source
from (select line_id, any_value(page) as page, any_value(quire) as quire, any_value(line_number) as line_number, any_value(raw_text) as raw_text from line_records group by line_id)""")
def parse_raw_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "line_records").dropDuplicates(["line_id"]).select("line_id", F.col("page").alias("page_id"), "line_number", F.col("raw_text").alias("text"), "quire", F.col("transcription_source").alias("source"))
    return readers.parse_lines(raw, "line_id")


@query(f"""select folio_id as page_id, folio_id as folio, {QUIRE.format('quire_id')} as quire, section_value as section, cast(null as varchar) as illustration_type
from (select folio_id, quire_id, section_value, row_number() over (partition by folio_id order by quire_id desc nulls last, section_value desc nulls last) as r from folio_records) where r = 1""")
def metadata_from_folios(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_metadata(None, table(spark, d, "folio_records").select("folio_id", "quire_id", "section_value"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "line_records").select("line_id", "page", "folio", "quire", "loaded_at")
    pages = table(spark, d, "page_records").select("page_id", "folio", "quire", "section", "illustration_type").distinct()
    return readers.join_records(lines, pages)


_JOIN = """select line_id, page, coalesce(l.folio, p.folio) as folio, coalesce(l.quire, p.quire) as quire, loaded_at, page_id, section, illustration_type
from line_records l left join (select distinct page_id, folio, quire, section, illustration_type from page_records) p on l.page is not distinct from p.page_id"""


@query(_JOIN)
def lines_pages_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d)


@query(f"select distinct page_id, folio, quire, section, illustration_type from ({_JOIN})")
def distinct_pages(spark: SparkSession, d: str) -> DataFrame:
    return readers.distinct_pages(_joined(spark, d))


@query("""with a as (select distinct nullif(lower(trim(page)), '') as k from line_records), b as (select distinct nullif(lower(trim(page_id)), '') as k from page_records),
m as (select k from a where k is not null and k not in (select k from b where k is not null))
select (select count(*) from a where k is not null) as n_left, (select count(*) from m) as n_missing, (select list(k order by k) from (select k from m order by k limit 10)) as sample""")
def coverage_anti_join(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "line_records").select(plain_key(F.col("page")).alias("k"))
    return experiments.coverage_sample(left, table(spark, d, "page_records").select(plain_key(F.col("page_id")).alias("k")), "k")


@query("select line_id as key, count(*) as n from line_records where line_id is not null group by 1 having count(*) > 1")
def duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    return experiments.duplicate_keys(table(spark, d, "line_records"), F.col("line_id"))


@query(f"select {QUIRE.format('quire')} as value, count(*) as n from line_records group by 1")
def quire_counts(spark: SparkSession, d: str) -> DataFrame:
    return experiments.value_counts(table(spark, d, "line_records"), normalize_quire(F.col("quire")))


@query("select count(*) as n, count(*) filter (eva_agreement) as agreed, count(*) filter (similarity_score = 1) as equal_score, bool_and(coalesce(eva_agreement = (similarity_score = 1), true)) as consistent from mismatch_main")
def agreement_check(spark: SparkSession, d: str) -> DataFrame:
    one = F.col("similarity_score") == 1
    return table(spark, d, "mismatch_main").agg(F.count("*").alias("n"), F.count_if("eva_agreement").alias("agreed"), F.count_if(one).alias("equal_score"), F.bool_and(F.coalesce(F.col("eva_agreement") == one, F.lit(True))).alias("consistent"))


@query(f"with {FLAT} select word, count(*) as c from flat group by 1")
def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    return signature.word_counts(corpus.word_bag(_bag(spark, d)))


@query(f"with {FLAT} select line_no, len(words) as n_words, sum(len(words)) over (order by line_no)::bigint as \"end\" from lines")
def line_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return readers.boundaries(lines_of(spark, d))


@query(f"with {FLAT} select grp, count(distinct line_no) as lines, count(*) as words, count(distinct word) as types from flat group by 1")
def group_word_lists(spark: SparkSession, d: str) -> DataFrame:
    """What each group's word list holds, without making the lists."""
    return _flat(spark, d).groupBy("grp").agg(F.countDistinct("line_no").alias("lines"), F.count("*").alias("words"), F.countDistinct("word").alias("types"))


@query(f"with {FLAT} select a.word as x, b.word as y, count(*) as c from flat a join flat b on b.pos = a.pos + 3 group by 1, 2")
def shifted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words three apart."""
    ahead = corpus.followers(_flat(spark, d), [], "pos", "word", [3])
    return ahead.select(F.col("word").alias("x"), F.col("nexts")[0].alias("y")).where("y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))


@query(f"with {FLAT}, v as (select word, min(pos) as p from flat group by 1) select word, row_number() over (order by p) - 1 as id from v")
def first_appearance_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_ids(_flat(spark, d))


@query(f"with {FLAT}, v as (select distinct word from flat) select word, row_number() over (order by encode(word)) - 1 as id from v")
def sorted_vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_ids(_flat(spark, d), first=False)


@query(f"with {FLAT}, v as (select word, row_number() over (order by encode(word)) - 1 as id, count(*) over () as t from (select distinct word from flat)), n as (select line_no, count(*) as m from flat group by 1) select f.line_no, f.idx, idx / greatest(1, m - 1) as x, id / greatest(1, t - 1) as y from flat f join v using (word) join n using (line_no)")
def line_points(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    flat = corpus.words(lines)
    return boxes.line_points(lines, flat, keep=("line_no", "idx")).withColumn("idx", F.col("idx").cast("long"))


# --- signature ---------------------------------------------------------------------------------

_U = "u as (select word, count(*) as c from flat group by 1)"
_S = {
    "conditional_entropy": f"{_U}, b as (select word, y, count(*) as c from (select word, lead(word) over (order by pos) as y from flat) where y is not null group by 1, 2) select sum(-(b.c / (n - 1)) * log2((b.c / (n - 1)) / (u.c / n))) as conditional_entropy from b join u using (word), (select count(*) as n from flat)",
    "mi_plateau": "i as (select pos, dense_rank() over (order by word) as w from flat), p as (select d, a.w as x, b.w as y, count(*) as c from i a, range(10, 51) r(d), i b where b.pos = a.pos + d group by all), mx as (select d, x, sum(c) as c from p group by all), my as (select d, y, sum(c) as c from p group by all), n as (select d, sum(c) as n from p group by 1), m as (select p.d, sum(p.c / n * log2(p.c * n / (mx.c * my.c))) as mi from p join mx on p.d = mx.d and p.x = mx.x join my on p.d = my.d and p.y = my.y join n on n.d = p.d group by 1) select avg(mi) as mi_plateau from m where mi > 0",
    "zipf_slope": f"{_U}, r as (select ln(c) as y, ln(row_number() over (order by c desc)) as x from u) select regr_slope(y, x) as zipf_slope from r",
    "hapax_ratio": f"{_U} select avg((c = 1)::int) as hapax_ratio from u",
    "group_stability": "f as (select grp, min(line_no) as g from lines group by 1), k as (select word, count(*) as c, count(distinct flat.grp) as k, min((g, pos)) as o from flat join f using (grp) group by 1 order by c desc, o limit 100) select avg(k / (select count(*) from f)) as group_stability from k",
    "positional_divergence": "x as (select word, line_no / m as x from flat, (select greatest(1, count(*) - 1) as m from lines)), b as (select word, len(list_filter([0.1e0, 0.2e0, 3*0.1e0, 0.4e0, 0.5e0, 6*0.1e0, 7*0.1e0, 0.8e0, 0.9e0], lambda e: e <= x)) as b, count(*) as c from x group by all), t as (select word, sum(c) as t, count(*) as k from b group by 1 having sum(c) >= 2 and count(*) > 1) select avg(h) as positional_divergence from (select b.word, -sum(c / t * log2(c / t)) as h from b join t using (word) group by 1)",
    "line_lengths": "k as (select len(words) as k from lines where len(words) > 0), m as (select avg(k) as m, var_pop(k) as v from k) select any_value(m) as length_mean, any_value(v) as length_variance, avg(pow((k - m) / sqrt(v), 3)) as length_skew from k, m",
    "first_pairs": "w as (select words from lines where len(words) >= 2) select onset, coda, onset / nullif(coda, 0) as onset_coda_ratio from (select avg((words[1] = words[2])::int) as onset, avg((words[-1] = words[-2])::int) as coda from w)",
    "edge_mi": "e as (select words[-1] as x, lead(words) over (order by line_no)[1] as y from lines), p as (select x, y, count(*) as c from e where x is not null and y is not null group by all), mx as (select x, sum(c) as c from p group by 1), my as (select y, sum(c) as c from p group by 1), n as (select sum(c) as n from p) select sum(p.c / n * log2(p.c * n / (mx.c * my.c))) as edge_mi from p join mx using (x) join my using (y), n",
}


def _one(name: str) -> str:
    return f"with {FLAT}, {_S[name]}"


@query(_one("hapax_ratio"), "hapax_ratio")
def hapax_ratio(spark: SparkSession, d: str) -> DataFrame:
    return signature.hapax_ratio(corpus.word_bag(_bag(spark, d)))


@query(_one("line_lengths"), "length_mean length_variance length_skew")
def token_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return signature.line_lengths(_bag(spark, d))


@query(_one("zipf_slope"), "zipf_slope")
def zipf_slope(spark: SparkSession, d: str) -> DataFrame:
    return signature.zipf_slope(corpus.word_bag(_bag(spark, d)))


@query(_one("conditional_entropy"), "conditional_entropy")
def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    return signature.conditional_entropy(cut(_flat(spark, d)))  # read twice


@query(_one("edge_mi"), "edge_mi")
def edge_mi(spark: SparkSession, d: str) -> DataFrame:
    return signature.edge_mi(lines_of(spark, d))


@query(_one("first_pairs"), "onset coda onset_coda_ratio")
def d1_agreement(spark: SparkSession, d: str) -> DataFrame:
    return signature.first_pair_agreement(_bag(spark, d))


@query(_one("mi_plateau"), "mi_plateau")
def mi_plateau(spark: SparkSession, d: str) -> DataFrame:
    return signature.mi_plateau(cut(_flat(spark, d)))


@query(_one("group_stability"), "group_stability")
def quire_stability(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return signature.group_stability(lines, corpus.words(lines))


@query(_one("positional_divergence"), "positional_divergence")
def positional_divergence(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return signature.positional_divergence(lines, corpus.words(lines))


@query("select avg(similarity_score) as cross_agreement from mismatch_main", "cross_agreement")
def score_mean(spark: SparkSession, d: str) -> DataFrame:
    return signature.cross_agreement(table(spark, d, "mismatch_main"))


_PER = {
    "conditional_entropy": ["conditional_entropy"], "line_lengths": ["length_mean", "length_variance", "length_skew"], "mi_plateau": ["mi_plateau"], "first_pairs": ["onset", "coda", "onset_coda_ratio"],
    "edge_mi": ["edge_mi"], "zipf_slope": ["zipf_slope"], "hapax_ratio": ["hapax_ratio"], "group_stability": ["group_stability"], "positional_divergence": ["positional_divergence"],
}
_LEFT_OUT = ["lz77_ratio", "hurst_dfa", "multifractal_delta_h", "box_dimension"]
_LONG = " union all ".join(f"select '{f}' as field, (select {f} from (with {FLAT}, {_S[k]})) as value" for k, fs in _PER.items() for f in fs)


@query(_LONG + " union all select 'cross_agreement', avg(similarity_score) from mismatch_main union all select 'template_transition', null", "value")
def joint_signature_long(spark: SparkSession, d: str) -> DataFrame:
    """The fields that SQL can say; joint_signature_rest has the others."""
    return signature.joint_signature(lines_of(spark, d), table(spark, d, "mismatch_main"), fractal=False).where(~F.col("field").isin(_LEFT_OUT))


@query()
def joint_signature_rest(spark: SparkSession, d: str) -> DataFrame:
    lines = cut(lines_of(spark, d))
    flat = cut(corpus.words(lines))
    parts = [coding.lz77_signature(flat), signature.fractal_fields(lines, flat)]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # single rows


@query(r"""with r as (select *, case when similarity_score between 0 and 1 then len(list_filter([0.1e0, 0.2e0, 3*0.1e0, 0.4e0, 0.5e0, 6*0.1e0, 7*0.1e0, 0.8e0, 0.9e0], lambda e: e <= similarity_score)) end as b from mismatch_main)
select count(*) as n, avg(coalesce(eva_agreement, false)::int) * 100 as agreement_pct, avg(similarity_score) as mean, median(similarity_score) as median, stddev_pop(similarity_score) as sd, min(similarity_score) as min, max(similarity_score) as max,
quantile_cont(similarity_score, 0.1) as p10, quantile_cont(similarity_score, 0.5) as p50, quantile_cont(similarity_score, 0.9) as p90, quantile_cont(similarity_score, 0.99) as p99,
""" + "[" + ", ".join(f"count(*) filter (b = {i})" for i in range(10)) + "] as histogram, " + ", ".join(f"sum(coalesce(len(list_filter(sources_present, lambda v: v = '{s}')), 0)) * 100.0 / count(*) as pct_{s.lower()}" for s in ("ZL", "IT", "CD", "FG", "GC")) + " from r", "agreement_pct mean median sd min max p10 p50 p90 p99 pct_zl pct_it pct_cd pct_fg pct_gc")
def transcription_report(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.transcription_report(table(spark, d, "mismatch_main"))
    return out.select("*", *(F.col("presence")[s].alias(f"pct_{s.lower()}") for s in ("ZL", "IT", "CD", "FG", "GC"))).drop("presence")


@query("select b, count(*) as c from (select len(list_filter([0.1e0, 0.2e0, 3*0.1e0, 0.4e0, 0.5e0, 6*0.1e0, 7*0.1e0, 0.8e0, 0.9e0], lambda e: e <= similarity_score))::int as b from mismatch_main where similarity_score between 0 and 1) group by 1")
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "mismatch_main").where("similarity_score between 0 and 1")
    return scores.groupBy(signature.bin_of("similarity_score").alias("b")).agg(F.count("*").alias("c"))


# --- series ------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return corpus.time_series(table(spark, d, "events"), "ts", "value", by, ties=["event_id"])


_MAXK = "least((select max(n) from prof) // 4, 1000)"
_DFA = f"""k as ({scale_table(4, _MAXK, 30)}),
w as (select k, i // k as win, regr_syy(z, i % k) - pow(regr_sxy(z, i % k), 2) / regr_sxx(z, i % k) as ss from prof, k where i // k < n // k and n // k >= 4 group by all),
f as (select k, avg(sqrt(greatest(ss, 0) / k)) as f from w where ss > 0 group by 1 having count(*) >= 4)
select count(*) as scales, greatest(0, least(1, regr_slope(ln(f), ln(k)))) as h from f"""
_RS = f"""k as ({scale_table(8, _MAXK, 30)}), q as (select k, greatest(1, k // 2) as step from k),
e as (select k, v, z, (n - k) // step as last, unnest(range(greatest(0, ceil((i - k + 1) / step)::bigint), i // step + 1)) as win from prof, q where (n - k) // step + 1 >= 4),
w as (select k, win, max(z) - min(z) as r, stddev_pop(v) as s from e where win <= last group by all having stddev_pop(v) > 0),
f as (select k, avg(r / s) as f from w group by 1 having count(*) >= 4)
select count(*) as scales, greatest(0, least(1, regr_slope(ln(f), ln(k)))) as h from f"""


@query(f"with {EVENTS}, {profile()}, {_DFA}", "h")
def hurst_dfa(spark: SparkSession, d: str) -> DataFrame:
    return series.hurst_dfa(_events(spark, d))


@query(f"with {EVENTS}, {profile()}, {_RS}", "h")
def hurst_rs(spark: SparkSession, d: str) -> DataFrame:
    return series.hurst_rs(_events(spark, d))


@query(f"with a as (with {EVENTS}, {profile()}, {_RS}), b as (with {EVENTS}, {profile()}, {_DFA}) select a.h as rs, b.h as dfa, (a.h + b.h) / 2 as mean, abs(a.h - b.h) / 2 as std from a, b", "rs dfa mean std")
def hurst_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return series.hurst_ensemble(_events(spark, d))


_BY_TYPE = """e as (select event_type as g, ts, value::double as v, row_number() over (partition by event_type order by ts, event_id) - 1 as j, count(*) over (partition by event_type) as m from events where ts is not null and value is not null),
s as (select g, j as i, v from e where m >= {least} union all select 'aggregate', row_number() over (order by g, j) - 1, v from e where m >= {least})"""


@query(f"""with {_BY_TYPE.format(least=20)}, {profile('g')},
k as (select g, n, unnest({scales(4, 'least(n // 4, 1000)', 30)}) as k from (select g, max(n) as n from prof group by 1)),
w as (select p.g, k, i // k as win, regr_syy(z, i % k) - pow(regr_sxy(z, i % k), 2) / regr_sxx(z, i % k) as ss from prof p join k on p.g = k.g where i // k < p.n // k and p.n // k >= 4 group by all),
f as (select g, k, avg(sqrt(greatest(ss, 0) / k)) as f from w where ss > 0 group by all having count(*) >= 4)
select g as event_type, count(*) as scales, greatest(0, least(1, regr_slope(ln(f), ln(k)))) as h from f group by 1 having count(*) >= 5""", "h")
def hurst_by_group(spark: SparkSession, d: str) -> DataFrame:
    return series.by_group(_events(spark, d, "event_type"), "event_type", 20, series.hurst_dfa)


_MF = """
w as (select {g}k, i // k as win, sqrt(greatest(regr_syy(z, i % k) - pow(regr_sxy(z, i % k), 2) / regr_sxx(z, i % k), 0) / k) as rms from prof {join} where i // k < prof.n // k and prof.n // k >= 2 group by {g}k, i // k),
f as (select {g}k, q, case when q = 0 then exp(avg(ln(rms))) else pow(avg(pow(rms, q)), 1 / q) end as f from w, (select -5 + t * 0.5e0 as q from range(0, 21) r(t)) where rms > 0 group by {g}k, q having count(*) >= 2),
h as (select {g}q, regr_slope(ln(f), ln(k)) as hq, regr_r2(ln(f), ln(k)) as r2, count(*) as c from f group by all having count(*) >= 4),
y as (select *, q * hq - 1 as tau, coalesce((lead(hq) over o - lag(hq) over o) / (lead(q) over o - lag(q) over o), (lead(hq) over o - hq) / (lead(q) over o - q), (hq - lag(hq) over o) / (q - lag(q) over o)) as s from h window o as ({part} order by q))
select {g}q, hq, tau, r2, hq + q * s as alpha, q * (hq + q * s) - tau as f_alpha from y"""


@query(f"with {EVENTS}, {profile()}, k as ({scale_table(16, '(select max(n) from prof) // 4', 20)}), " + _MF.format(g="", join=", k", part=""), "hq tau r2 alpha f_alpha")
def mfdfa_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return series.multifractal(_events(spark, d))


@query(f"with {_BY_TYPE.format(least=1000)}, {profile('g')}, k as (select g, unnest({scales(16, 'n // 4', 20)}) as k from (select g, max(n) as n from prof group by 1)), " + _MF.format(g="g, ", join="join k using (g)", part="partition by g").replace("select g, q, hq, tau, r2, hq + q * s as alpha, q * (hq + q * s) - tau as f_alpha from y", "select g as event_type, max(hq) - min(hq) as delta_h, max(hq + q * s) - min(hq + q * s) as delta_alpha, avg(r2) as mean_r2, min(r2) as min_r2 from y group by 1"), "delta_h delta_alpha mean_r2 min_r2")
def mfdfa_by_group(spark: SparkSession, d: str) -> DataFrame:
    return series.by_group(_events(spark, d, "event_type"), "event_type", 1000, series.multifractal_summary)


def _ids(order: str) -> str:
    """The word stream as a series s(i, v) of ids in some order of the words."""
    return f"ids as (select word, row_number() over (order by {order}) - 1 as id from flat group by word), s as (select pos as i, id::double as v from flat join ids using (word))"


_KMF = f"k as ({scale_table(16, '(select max(n) from prof) // 4', 20)})"
_MF_SUMMARY = _MF.format(g="", join=", k", part="").replace("select q, hq, tau, r2, hq + q * s as alpha, q * (hq + q * s) - tau as f_alpha from y", "select max(hq) - min(hq) as delta_h, max(hq + q * s) - min(hq + q * s) as delta_alpha from y")


@query(f"with {FLAT}, {_ids('min(pos)')}, {profile()}, {_KMF}, {_MF_SUMMARY}", "delta_h delta_alpha")
def signature_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """S14 of the corpus: ids by first appearance; joint_signature_rest has S13 and S15 beside it."""
    return series.multifractal_summary(cut(corpus.encoded(cut(_flat(spark, d))))).select("delta_h", "delta_alpha")


@query(f"with r as (with {FLAT}, {_ids('encode(word)')}, {profile()}, {_RS}), b as (with {FLAT}, {_ids('encode(word)')}, {profile()}, {_KMF}, {_MF_SUMMARY}) select r.h as rs, delta_h, delta_alpha from r, b", "rs delta_h delta_alpha")
def fractal_series(spark: SparkSession, d: str) -> DataFrame:
    """F14 by alphabetical ids, but for DFA, whose windows of four equal words are rounding alone, and the sampled box dimension."""
    ids = cut(corpus.encoded(cut(_flat(spark, d)), first=False))
    return series.hurst_rs(ids).select(F.col("h").alias("rs")).crossJoin(series.multifractal_summary(ids).select("delta_h", "delta_alpha"))  # single rows


@query("""with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, count(*) as n from p),
u as (select (x - lx) / (hx - lx) as x, (y - ly) / (hy - ly) as y, n from p, b),
s as (select pow(10, log10(0.5e0) + t * (log10(0.04e0) - log10(0.5e0)) / 29) as scale from range(0, 30) r(t)),
c as (select scale, n, count(distinct (least(floor(x * ceil(1 / scale)), ceil(1 / scale) - 1), least(floor(y * ceil(1 / scale)), ceil(1 / scale) - 1))) as boxes from u, s where ceil(1 / scale) between 2 and 1024 group by all having count(distinct (least(floor(x * ceil(1 / scale)), ceil(1 / scale) - 1), least(floor(y * ceil(1 / scale)), ceil(1 / scale) - 1))) > 1),
g as (select count(*) filter (boxes < 0.9 * n and boxes > 4) as k from c)
select regr_slope(ln(boxes), ln(1 / scale)) as dimension, regr_r2(ln(boxes), ln(1 / scale)) as r2, count(*) as scales from c, g where case when k >= 4 then boxes < 0.9 * n and boxes > 4 else boxes < 0.95 * n end""", "dimension r2")
def box_dimension(spark: SparkSession, d: str) -> DataFrame:
    """At a given spacing; with the sampled one see joint_signature_rest."""
    points = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return boxes.box_dimension(points, spacing=0.02)


@query("""with r as (select event_id, row_number() over (order by value, event_id) - 1 as r, count(*) over () as n from events where value is not null)
select event_id, (select max(i) from range(0, 50) t(i) where i * n // 50 <= r)::int as symbol from r""")
def rank_quantile_encode(spark: SparkSession, d: str) -> DataFrame:
    """M9 on a table: the rank of each value decides one of 50 symbols."""
    events = table(spark, d, "events").where("value is not null").select("event_id", "value")
    return corpus.rank_symbols(events, ["value", "event_id"], 50).select("event_id", "symbol")


# --- coding ------------------------------------------------------------------------------------


@query()
def lz77_ratio(spark: SparkSession, d: str) -> DataFrame:
    """E3 of every group's words."""
    flat = _flat(spark, d)
    return coding.lz77_ratio(flat.select("grp", F.col("pos").alias("i"), F.col("word").alias("sym")), ["grp"])


@query(f"with {FLAT}, t as (select grp, word, idx, pos, row_number() over (partition by grp order by pos) - 1 as i from flat) select grp, i, word as sym from t")
def lz77_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every group's words encoded and decoded again."""
    stream = _flat(spark, d).select("grp", F.col("pos").alias("i"), F.col("word").alias("sym"))
    return coding.lz77_decode(coding.lz77_encode(stream, ["grp"]), ["grp"])


@query()
def huffman_ratio(spark: SparkSession, d: str) -> DataFrame:
    return coding.huffman_ratio(corpus.word_bag(_bag(spark, d)).select("grp", F.col("word").alias("sym")), ["grp"])


@query()
def huffman_codes(spark: SparkSession, d: str) -> DataFrame:
    return coding.huffman_codes(corpus.word_bag(_bag(spark, d)).select(F.col("word").alias("sym")))


# The texts of the control corpora.
CONTROLS = {
    "latin_sample": "Gallia est omnis divisa in partes tres quarum unam incolunt Belgae aliam Aquitani tertiam qui ipsorum lingua Celtae nostra Galli appellantur Hi omnes lingua institutis legibus inter se differunt",
    "english_sample": "It was the best of times it was the worst of times it was the age of wisdom it was the age of foolishness it was the epoch of belief it was the epoch of incredulity",
    "germanic_sample": "der die das ein eine einer eines dem den die der des und oder aber wenn weil dass obwohl trotzdem dennoch",
}


@query()
def compression_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus, and three controls of as many characters as it has words."""
    n_words = corpus.word_bag(_bag(spark, d)).count()
    observed = lines_of(spark, d).select(F.lit("observed").alias("name"), "line_no", "grp", "words")
    controls = coding.control_corpus(spark.createDataFrame(list(CONTROLS.items()), "name string, t string"), "name", F.col("t"), n_words)
    lines = observed.unionByName(controls)
    return coding.compression_profile(lines, corpus.words(lines, ["name"]), ["name"])
