"""Pieces of SQL shared by the oracles."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

VALUE = r"""'"(?:[^"]|"")+"|''(?:[^'']|'''')+''|“(?:[^”]|””)+”|«(?:[^»]|»»)+»|[\p{L}*]+'"""
UNQUOTE = """case when regexp_matches(v, '^["“«'']') then replace(v[2:-2], v[-1:] || v[-1:], v[-1:]) else v end"""


def values_of(e: str) -> str:
    """The values of a text."""
    return f"list_transform(coalesce(regexp_extract_all({e}, {VALUE}), []), lambda v: {UNQUOTE})"


QUIRE = "case when length(trim(coalesce({0}, ''))) > 1 and lower(left(trim(coalesce({0}, '')), 1)) = 'q' then substr(trim(coalesce({0}, '')), 2) else trim(coalesce({0}, '')) end"
#: lines(line_no, grp, words) and flat(line_no, grp, idx, word, pos).
LINES = f"""
lines as (select row_number() over (order by line_id) - 1 as line_no, grp, words from (
  select line_id, any_value({QUIRE.format("quire")}) as grp,
    any_value(case when len(tokens) > 0 then flatten(list_transform(tokens, lambda e: {values_of("e")}))
      else {values_of("regexp_replace(raw_text, '<[^>]*>|[{][^}]*[}]', ' ', 'g')")} end) as words
  from line_records where line_id is not null group by line_id))"""
FLAT = LINES + """,
flat as (select line_no, grp, idx, word, row_number() over (order by line_no, idx) - 1 as pos from (
  select line_no, grp, unnest(range(0, len(words))) as idx, unnest(words) as word from lines))"""
EVENTS = "s as (select row_number() over (order by ts, event_id) - 1 as i, value::double as v from events where ts is not null and value is not null)"


def profile(by: str = "") -> str:
    """prof(by.., i, v, z, n) of s(by.., i, v)."""
    part = f"partition by {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""prof as (select {keys}i, v, n, sum(v - mu) over ({part} order by i) as z from (
  select {keys}i, v, count(*) over ({part}) as n, avg(v) over ({part}) as mu from s))"""


def _power(low: int, high: str, count: int) -> str:
    step = f"(log10({high}) - log10({low})) / {count - 1}"
    return f"cast(floor(pow(10, case when t = {count - 1} then log10({high}) else log10({low}) + t * ({step}) end)) as bigint)"


def scales(low: int, high: str, count: int) -> str:
    """A list of whole log-spaced numbers; ``high`` is an expression of columns."""
    return f"list_filter(list_distinct(list_transform(range(0, {count}), lambda t: {_power(low, high, count)})), lambda k: k >= {low} and k <= {high})"


def scale_table(low: int, high: str, count: int) -> str:
    """The same as a table (k); ``high`` may be a subquery."""
    return f"select distinct k from (select {_power(low, 'hi', count)} as k, hi from range(0, {count}) r(t), (select {high} as hi)) where k >= {low} and k <= hi"


def registry():
    """``QUERIES, ORACLE`` and a decorator ``query(sql, doubles)`` that fills them.

    ``doubles`` names columns that are sums of floating point numbers: engines add in different
    orders, so both sides round them to six decimals.
    """
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None, doubles: str = ""):
        names = doubles.split()

        def put(f):
            @wraps(f)
            def run(spark, d):
                df = f(spark, d)
                return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in names}) if names else df

            queries[f.__name__] = run
            if sql:
                oracle[f.__name__] = f"select * replace ({', '.join(f'round({c}, 6) + 0e0 as {c}' for c in names)}) from ({sql})" if names else sql
            return run

        return put

    return queries, oracle, query
