"""SQL for the queries of this subpackage, where it can say them on whole tables in time."""

from __future__ import annotations

from quirelab.plans.sqltext import values_of

_REMARKS_OUT = r"regexp_replace({0}, '<[^>]*>|\{{[^}}]*\}}', ' ', 'g')"
LINES = f"""
select line_id, any_value(case when len(tokens) > 0 then flatten(list_transform(tokens, lambda e: {values_of("e")})) else {values_of(_REMARKS_OUT.format("raw_text"))} end) as words
from line_records group by line_id"""
_COUNTS = f"""
with lines as ({LINES}),
occ as (select line_id, unnest(words) as term from lines),
c as (select term, count(*) as occurrences, count(distinct line_id) as records from occ group by term),
m as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.05 * (select count(*) from lines) then 'common' end as mark from c)"""
_QUIRE = "nullif(case when length(trim({0})) > 1 and lower(left(trim({0}), 1)) = 'q' then substr(trim({0}), 2) else trim({0}) end, '')"
_ITEM_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
_READING = r"nullif(array_to_string(regexp_extract_all(lower(regexp_replace(coalesce(r.{0}, ''), '<[^>]*>|\{{[^}}]*\}}', ' ', 'g')), '[\p{{L}}*]+'), ' '), '')"
_READERS = ["zl", "it", "cd", "gc"]
_VOTES = f"""
n as (select mm_id, arg_max(struct_pack(zl_text, it_text, cd_text, gc_text), updated_at) as r from mismatch_main group by mm_id),
l as (select mm_id, s, t from (select mm_id, {", ".join(_READING.format(x + "_text") + f" as {x}" for x in _READERS)} from n) unpivot (t for s in (zl, it, cd, gc))),
rel as (select a.s, avg((a.t = b.t)::int) as q from l a join l b on a.mm_id = b.mm_id and a.s <> b.s group by 1),
v as (select mm_id, t, count(*) as c, max(q) as q from l join rel using (s) group by all)"""
_GROUPS = f"""
links as (select distinct folio, {_QUIRE.format("quire")} as q from line_records where folio is not null),
e as (select distinct a.q as x, b.q as y from links a join links b on a.folio = b.folio where a.q is not null and b.q is not null),
reach(x, y) as (select x, y from e union select r.x, e.y from reach r join e on r.y = e.x),
grp as (select x as q, min(y) as g from reach group by x)"""
_SPLIT = _GROUPS + f""",
one as (select line_id, max({_QUIRE.format("quire")}) as quire from line_records where line_id is not null group by line_id),
named as (select line_id, quire, coalesce(g, quire, 'record ' || line_id) as component from one left join grp on grp.q = quire),
w as (select component, count(*) as weight from named group by component),
o as (select component, weight, sum(weight) over (order by ('0x' || substr(md5('7:' || component), 1, 15))::bigint, component) as upto, sum(weight) over () as total from w),
p as (select component, case when (2 * upto - weight)::double / (2 * total) < 0.8 then 'train' when (2 * upto - weight)::double / (2 * total) < 0.9 then 'validation' else 'test' end as part from o),
placed as (select line_id, quire, component, part from named join p using (component))"""
_MIX = """
s as (select doc_id, nullif(lower(trim(source)), '') as source, coalesce(length(text), 0) as n from documents where doc_id is not null),
t as (select nullif(lower(trim(source)), '') as source, target_share, max_repeats from mix_targets),
h as (select source, sum(n) as size from s group by 1),
w as (select t.source, target_share, max_repeats, coalesce(size, 0) as size, min(case when size > 0 then size * max_repeats / target_share end) over () as whole from t left join h using (source)),
r as (select source, size, least(max_repeats::double, coalesce(target_share * whole / nullif(size, 0), 0)) as rate from w),
o as (select doc_id, source, n, rate, row_number() over (partition by source order by least(length(bin(n)) - 1, 31), ('0x' || substr(md5('11:' || doc_id), 1, 15))::bigint, doc_id) as k, (('0x' || substr(md5('12:' || source), 1, 15))::bigint % 1073741824) / 1073741824 as u from s join r using (source) where n > 0 and rate > 0),
d as (select doc_id, source, n, (floor(k * rate + u) - floor((k - 1) * rate + u))::bigint as copies from o)"""

ORACLE = {
    # Ties go to the source that agrees most often with the others, which is here also the order of the fit.
    "p6_found": f"""
with {_VOTES},
d as (select mm_id from v group by 1 having sum(c) >= 2 and count(*) >= 2)
select mm_id, arg_max(t, (c, q)) as consensus from v where mm_id in (select mm_id from d) group by 1""",
    "p6_agreement": f"""
with {_VOTES},
g as (select mm_id, sum(c) as n_labels, count(*) as n_classes, arg_max(t, (c, q)) as consensus, sum(c * (c - 1)) as same from v group by 1)
select n.mm_id, n_labels::int as n_labels, n_classes::int as n_classes, consensus, case when n_labels > 1 then same::double / (n_labels * (n_labels - 1)) end as agreement
from n left join g using (mm_id)""",
    "p6_alpha": f"""
with {_VOTES},
u as (select mm_id, sum(c) as m, sum(c * c) as sq from v group by 1 having sum(c) > 1),
o as (select count(*) as items, sum(m)::bigint as labels, sum((m * m - sq)::double / (m - 1)) / sum(m) as observed from u),
e as (select t, sum(c) as n from v where mm_id in (select mm_id from u) group by 1),
x as (select (sum(n) * sum(n) - sum(n * n))::double / (sum(n) * (sum(n) - 1)) as expected from e)
select items, labels, observed, expected, 1 - observed / expected as alpha from o, x""",
    "p1_found": f"{_COUNTS} select term, mark from m where mark is not null",
    "p1_incremental": f"{_COUNTS} select term, occurrences, records, mark from m",
    "p1_corrected": _COUNTS.replace("occ as", "kept as (select * from lines where line_id in (select line_id from line_records where page is not null)), occ as").replace("as term from lines", "as term from kept").replace("from lines)", "from kept)") + " select term, occurrences, records, mark from m",
    "p2_found": f"""
with lines as ({LINES}),
w as (select distinct line_id, words[p:p + 7] as g from (select line_id, words, unnest(range(1, len(words) - 6)) as p from lines where len(words) >= 8))
select distinct a.line_id as line_id_a, b.line_id as line_id_b from w a join w b on a.g = b.g and a.line_id < b.line_id""",
    "p2_shares": f"""
with lines as ({LINES}),
w as (select line_id, p, words[p:p + 7] as g from (select line_id, words, unnest(range(1, len(words) - 6)) as p from lines where len(words) >= 8)),
s as (select g from w group by g having min(line_id) <> max(line_id)),
k as (select distinct line_id, unnest(range(p, p + 8)) as q from w where g in (select g from s)),
n as (select line_id, count(*) as c from k group by line_id)
select line_id, len(words)::bigint as n_words, coalesce(c, 0)::bigint as shared_words, case when len(words) > 0 then coalesce(c, 0)::double / len(words) end as share
from lines left join n using (line_id)""",
    "p2_intervals": f"""
with lines as ({LINES}),
copies as (select line_id, len(words) as n, count(*) over (partition by words) as c from lines where len(words) >= 8),
w as (select line_id, p, words[p:p + 7] as g from (select line_id, words, unnest(range(1, len(words) - 6)) as p from lines where len(words) >= 8)),
s as (select g from w group by g having min(line_id) <> max(line_id)),
r as (select line_id, p, p - row_number() over (partition by line_id order by p) as run from w where g in (select g from s) and line_id in (select line_id from copies where c = 1))
select line_id, min(p) - 1 as start, count(*) + 7 as n_words from r group by line_id, run
union all select line_id, 0, n from copies where c > 1""",
    "p2_classes": f"""
with lines as ({LINES})
select line_id, case when len(words) >= 8 then min(line_id) over (partition by words) else line_id end as class_id,
  case when len(words) >= 8 then count(*) over (partition by words) else 1 end as copies from lines""",
    "p2_links": f"""
with lines as ({LINES}),
k as (select min(line_id) as line_id, words from lines where len(words) >= 8 group by words),
w as (select distinct line_id, words[p:p + 7] as g from (select line_id, words, unnest(range(1, len(words) - 6)) as p from k))
select distinct a.line_id as class_a, b.line_id as class_b from w a join w b on a.g = b.g and a.line_id < b.line_id""",
    "p7_found": f"""
with recursive {_GROUPS},
listed as (select distinct manifest_id, fold, {_QUIRE.format("q0")} as q from (select manifest_id, fold, unnest(quires) as q0 from split_manifest)),
l as (select manifest_id, fold, listed.q, coalesce(g, listed.q) as g from listed left join grp on grp.q = listed.q where listed.q is not null),
t as (select manifest_id, g from l group by manifest_id, g having count(distinct fold) > 1)
select distinct l.manifest_id, l.q as quire from l join t on t.manifest_id = l.manifest_id and t.g = l.g""",
    "p7_split": f"with recursive {_SPLIT} select line_id, quire, component, part from placed",
    "p7_shares": f"""
with recursive {_SPLIT}
select part, case part when 'train' then 0.8e0 else 0.1e0 end as wanted, count(distinct component) as groups, count(*) as records, count(*)::double / sum(count(*)) over () as share from placed group by part""",
    "p9_mixture_letters": f"with {_MIX} select doc_id, source, copies from d where copies > 0",
    "p9_shares_letters": f"""
with {_MIX}, g as (select source, count(*) as documents, sum(n * copies)::bigint as drawn_tokens from d where copies > 0 group by 1)
select source, size::bigint as size, coalesce(documents, 0) as documents, coalesce(drawn_tokens, 0) as drawn_tokens, round(coalesce(drawn_tokens, 0) / sum(drawn_tokens) over (), 9) as actual_share from r left join g using (source)""",
    # On these tables no passage is re-parameterised, so any that were reported would differ from this.
    "p8_passages": f"""
with i as (select item_id, ws[p:p + 12] as g from (select item_id, ws, unnest(range(1, len(ws) - 11)) as p from (select item_id, {_ITEM_WORDS} as ws from eval_items) where len(ws) >= 13)),
d as (select doc_id, p, ws[p:p + 12] as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from (select doc_id, {_ITEM_WORDS} as ws from documents) where len(ws) >= 13))
select item_id, doc_id, 'verbatim' as kind, count(distinct p) as windows from i join d on i.g = d.g group by all""",
    "p8_found": f"""
with i as (select item_id, ws[p:p + 12] as g from (select item_id, ws, unnest(range(1, len(ws) - 11)) as p from (select item_id, {_ITEM_WORDS} as ws from eval_items) where len(ws) >= 13)),
d as (select doc_id, ws[p:p + 12] as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from (select doc_id, {_ITEM_WORDS} as ws from documents) where len(ws) >= 13))
select distinct item_id, doc_id from i join d on i.g = d.g""",
}
