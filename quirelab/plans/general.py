"""Queries p3, p4 and p5, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators.diff import diff_mismatches
from quirelab.operators.orphans import orphan_keys, orphans_by_table
from quirelab.operators.packed import packed_in_tables, place_packed, split_packed
from quirelab.plans.sqltext import VALUE, values_of
from quirelab.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = packed_in_tables(table(spark, d, "line_records"), table(spark, d, "mismatch_main"))
    return out.select("table_name", "record_id", "pos", "term")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every line's tokens, packed or not, with the element it came from."""
    lines = table(spark, d, "line_records").select("line_id", "tokens").dropDuplicates(["line_id"])
    return split_packed(lines, "line_id", "tokens").select("record_id", "pos", "element", "term", "malformed")


def p3_places(spark: SparkSession, d: str) -> DataFrame:
    """Every value of sources_present of every newest mismatch row, with the character it starts at."""
    newest = table(spark, d, "mismatch_main").where("mm_id is not null").groupBy("mm_id").agg(F.max_by("sources_present", "updated_at").alias("sources_present"))
    return place_packed(newest, "mm_id", "sources_present")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_table(*(table(spark, d, t) for t in ("line_records", "page_records", "folio_records")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return p4_found(spark, d).groupBy("table_name", "ref_month", "reason").agg(F.count("*").alias("orphans"))


def p4_integer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Order keys of line items that have no order outside status P."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return orphan_keys(items, F.col("l_orderkey"), orders, F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return diff_mismatches(table(spark, d, "mismatch_main"), table(spark, d, "mismatch_mirror"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of records per kind of difference."""
    return p5_found(spark, d).groupBy("issue").agg(F.count("*").alias("records"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every difference with what either copy has, as it is compared; sets as JSON."""
    return diff_mismatches(table(spark, d, "mismatch_main"), table(spark, d, "mismatch_mirror"), values=True)


QUERIES = {f.__name__: f for f in (p3_found, p3_values, p3_places, p4_found, p4_report, p4_integer_keys, p5_found, p5_report, p5_values)}

_STRAY = """'["“”„''‘’‚«»‹›`]'"""
_TOTAL = VALUE[:-1] + "|(?s).'"
_P3_PART = """
select '{table}' as table_name, id as record_id, cast(p - 1 as integer) as pos, vals[p] as term from (
  select id, flatten(parsed) as vals, unnest(range(1, len(flatten(parsed)) + 1)) as p from (
    select id, list_transform(a, lambda e: {values}) as parsed from ({source}))
  where len(list_filter(parsed, lambda x: len(x) >= 2)) > 0)"""
_LINES_ONCE = "select line_id as id, any_value(tokens) as a from line_records group by line_id"
_NEWEST = "select mm_id as id, arg_max(sources_present, updated_at) as a from mismatch_main group by mm_id"
_KEY = "nullif(lower(trim({0})), '')"
_P4_PART = """
select '{table}' as table_name, record_key, strftime(ts, '%Y-%m') as ref_month,
  case when not bool_or(p.k is not null) then 'missing' when bool_or(coalesce(p.deleted_at <= ts, false)) then 'deleted' else 'late' end as reason
from ({refs}) r left join (select distinct {pk} as k, added_at, deleted_at from {parent}) p on p.k = r.k
where r.k is not null
group by record_key, ts
having not bool_or(coalesce(p.added_at <= ts and (p.deleted_at is null or ts < p.deleted_at), false))"""
_P4 = (
    _P4_PART.format(table="line_records", refs=f"select distinct cast(line_id as varchar) as record_key, {_KEY.format('page')} as k, recorded_at as ts from line_records", pk=_KEY.format("page_id"), parent="page_records")
    + " union all "
    + _P4_PART.format(
        table="page_records",
        refs=f"select record_key, arg_min(k, ts) as k, min(ts) as ts from (select {_KEY.format('page_id')} as record_key, {_KEY.format('folio')} as k, added_at as ts from page_records) where record_key is not null group by record_key",
        pk=_KEY.format("folio_id"),
        parent="folio_records",
    )
)
_TEXT = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\r\n]+', ' ', 'g'))"
_P5_JOIN = f"""
with m as (select mm_id, arg_max(struct_pack(z := {_TEXT.format("zl_text")}, i := {_TEXT.format("it_text")}, s := list_sort(list_distinct(coalesce(sources_missing, [])))), updated_at) as r from mismatch_main group by mm_id),
n as (select mm_id, arg_max(struct_pack(z := {_TEXT.format("zl_text")}, i := {_TEXT.format("it_text")}, s := list_sort(list_distinct(coalesce(sources_missing, [])))), updated_at) as r from mismatch_mirror group by mm_id),
j as (select coalesce(m.mm_id, n.mm_id) as mm_id, m.r as a, n.r as b, m.mm_id is null as no_a, n.mm_id is null as no_b from m full join n on m.mm_id = n.mm_id)"""
_P5 = f"""
{_P5_JOIN}
select mm_id, 'only_main' as issue from j where no_b
union all select mm_id, 'only_mirror' from j where no_a
union all select mm_id, 'zl_text' from j where not no_a and not no_b and a.z <> b.z
union all select mm_id, 'it_text' from j where not no_a and not no_b and a.i <> b.i
union all select mm_id, 'sources_missing' from j where not no_a and not no_b and a.s <> b.s"""

ORACLE = {
    "p3_found": _P3_PART.format(table="line_records", values=values_of("e"), source=_LINES_ONCE) + " union all " + _P3_PART.format(table="mismatch_main", values=values_of("e"), source=_NEWEST),
    "p3_values": f"""
select id as record_id, cast(row_number() over (partition by id order by el, j) - 1 as integer) as pos, cast(el as integer) as element, term, malformed from (
  select id, el, regexp_matches(regexp_replace(e, {VALUE}, ' ', 'g'), {_STRAY}) as malformed, unnest(range(1, len(vals) + 1)) as j, unnest(vals) as term from (
    select id, el, e, {values_of("e")} as vals from (select id, unnest(a) as e, unnest(range(0, len(a))) as el from ({_LINES_ONCE}))))""",
    "p3_places": f"""
select id as record_id, cast(row_number() over (partition by id order by el, off) - 1 as integer) as pos, cast(el as integer) as element, cast(off as integer) as "offset", ({values_of("m")})[1] as term, malformed from (
  select id, el, malformed, unnest(ms) as m, unnest(offs) as off from (
    select id, el, ms, list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)) as offs,
      regexp_matches(regexp_replace(e, {VALUE}, ' ', 'g'), {_STRAY}) as malformed
    from (select id, el, e, regexp_extract_all(e, {_TOTAL}) as ms from (select id, unnest(a) as e, unnest(range(0, len(a))) as el from ({_NEWEST})))))
where len({values_of("m")}) > 0""",
    "p4_found": _P4,
    "p4_report": f"select table_name, ref_month, reason, count(*) as orphans from ({_P4}) group by all",
    "p4_integer_keys": "select l_orderkey, count(*) as lines from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by 1",
    "p5_found": _P5,
    "p5_values": f"""
{_P5_JOIN}
select mm_id, 'only_main' as issue, null as main_value, null as mirror_value from j where no_b
union all select mm_id, 'only_mirror', null, null from j where no_a
union all select mm_id, 'zl_text', a.z, b.z from j where not no_a and not no_b and a.z <> b.z
union all select mm_id, 'it_text', a.i, b.i from j where not no_a and not no_b and a.i <> b.i
union all select mm_id, 'sources_missing', to_json(a.s)::varchar, to_json(b.s)::varchar from j where not no_a and not no_b and a.s <> b.s""",
    "p5_report": f"select issue, count(*) as records from ({_P5}) group by 1",
}
