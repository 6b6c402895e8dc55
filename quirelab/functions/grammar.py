"""A small parsing expression grammar, compiled to one possessive regular expression.

PEG rules are ordered choices whose parts never give back what they took; a regular expression
of atomic groups and possessive loops has the same meaning, so the grammar runs inside Spark's
``regexp_extract_all`` on the JVM. A choice that fails (an opening quote without its partner)
backtracks to its start, and the next alternative is tried there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote styles, opening and closing.
QUOTE_PAIRS = ['""', "''", "“”", "„“", "„”", "‘’", "‚‘", "‚’", "«»", "»«", "‹›", "``"]
# Brackets of editorial remarks.
REMARK_PAIRS = ["<>", "{}"]


def choice(*rules: str) -> str:
    """Ordered choice: the first alternative that matches is kept."""
    return "(?>" + "|".join(rules) + ")"


def some(rule: str) -> str:
    """One or more, never giving back."""
    return f"(?:{rule})++"


def quoted(pair: str) -> str:
    """What stands between a pair of quotes; a doubled closing quote inside stands for one."""
    opening, closing = ("\\" + c if c in "`" else c for c in pair)
    return opening + some(choice(f"[^{closing}]++", closing * 2)) + closing


def bracketed(pair: str) -> str:
    """A remark in brackets."""
    return ("\\" + pair[0]) + f"[^{pair[1]}]*+" + ("\\" + pair[1])


BARE = "[\\p{L}*]++"
STRAY = "[" + "".join(sorted({c for p in QUOTE_PAIRS for c in p})) + "]"
_QUOTED = [quoted(p) for p in QUOTE_PAIRS]
#: Values of a field: quoted, else bare; a quote that opens nothing comes out as a stray character.
FIELD = choice(*_QUOTED, BARE, STRAY)
#: Values where brackets hold a value too, for fields written that way.
BRACKET_PAIRS = ["[]", "()", "{}", "<>"]
BRACKETED = choice(*_QUOTED, *(bracketed(p) for p in BRACKET_PAIRS), BARE, STRAY)
#: What stands between values.
GAP = "(?s)."
#: The same for running lines, where a remark is tried first.
LINE = choice(*(bracketed(p) for p in REMARK_PAIRS), *_QUOTED, BARE, STRAY)
#: Only bare words, as readings are compared.
_OPENERS = "".join(sorted({p[0] for p in QUOTE_PAIRS}))


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, grammar: str) -> str:
    return f"regexp_extract_all({text}, {_lit(grammar)}, 0)"


def _clean(v: str) -> str:
    """A match to its value: quotes off, doubled quotes single."""
    inner = f"substring({v}, 2, char_length({v}) - 2)"
    last = f"right({v}, 1)"
    return (
        f"case when char_length({v}) > 2 and locate(left({v}, 1), {_lit(_OPENERS)}) > 0 "
        f"then replace({inner}, concat({last}, {last}), {last}) else {v} end"
    )


def _parse_sql(text: str, remarks: bool) -> str:
    """SQL for the values of one text; null gives an empty array."""
    found = _matches(text, LINE if remarks else FIELD)
    dropped = f"v not rlike {_lit('^' + STRAY + '$')}" + (" and left(v, 1) not in ('<', '{')" if remarks else "")
    return f"coalesce(transform(filter({found}, v -> {dropped}), v -> {_clean('v')}), cast(array() as array<string>))"


def parse_values(text: str, remarks: bool = False) -> Column:
    """The values of one string column, as an array in order.

    ``remarks``: skip what stands in ``<...>`` or ``{...}``. Null gives an empty array.
    """
    return F.expr(_parse_sql(text, remarks))


def parse_elements(array: str) -> Column:
    """For each element of an array column, the array of its values; null gives an empty array.

    An element whose only content is separators, or null, has no values.
    """
    return F.expr(f"coalesce(transform({array}, e -> {_parse_sql('e', False)}), cast(array() as array<array<string>>))")


def placed_elements(array: str, brackets: bool = False) -> Column:
    """For each element, its values with where they stand: ``offset, term, malformed``.

    The grammar takes every character, as a value or as a gap, so the lengths of what came before
    add up to the offset (in characters, from 0; quotes and brackets are part of the place, not of
    the term). ``brackets``: what stands in brackets is one value, its blanks trimmed, and nothing
    if that is empty. ``malformed``: a quote in the element opens or closes nothing.
    """
    grammar = choice(BRACKETED if brackets else FIELD, GAP)
    stray = _lit("^" + STRAY + "$")
    inner = "trim(substring(v, 2, char_length(v) - 2))"
    term = f"case when char_length(v) > 1 and left(v, 1) in ('[', '(', '{{', '<') then {inner} else {_clean('v')} end" if brackets else _clean("v")
    is_value = f"(v rlike {_lit('^' + BARE)} or char_length(v) > 1)"
    placed = (
        f"aggregate({_matches('e', grammar)}, named_struct('at', 0, 'out', cast(array() as array<struct<offset:int,term:string>>)), "
        f"(s, v) -> named_struct('at', int(s.at + char_length(v)), 'out', if({is_value} and {term} <> '', concat(s.out, array(named_struct('offset', s.at, 'term', {term}))), s.out)), s -> s.out)"
    )
    bad = f"coalesce(exists({_matches('e', grammar)}, v -> v rlike {stray}), false)"
    return F.expr(f"coalesce(transform({array}, e -> named_struct('found', coalesce({placed}, array()), 'malformed', {bad})), array())")


def malformed_elements(array: str) -> Column:
    """For each element, whether a quote in it opens nothing or closes nothing."""
    stray = _lit("^" + STRAY + "$")
    return F.expr(f"transform({array}, e -> coalesce(exists({_matches('e', FIELD)}, v -> v rlike {stray}), false))")


def line_words(tokens: str = "tokens", raw_text: str = "raw_text") -> Column:
    """The words of a line: the values of its tokens, or of raw_text where tokens is null or empty."""
    return F.expr(
        f"case when coalesce(size({tokens}), 0) > 0 "
        f"then flatten(transform({tokens}, e -> {_parse_sql('e', False)})) else {_parse_sql(raw_text, True)} end"
    )


def reading_words(text: str) -> Column:
    """The words of a reading: remarks left out, runs of letters and ``*``, lower-cased."""
    grammar = choice(*(bracketed(p) for p in REMARK_PAIRS), BARE)
    return F.expr(
        f"coalesce(transform(filter({_matches(text, grammar)}, v -> left(v, 1) not in ('<', '{{')), v -> lower(v)), "
        "cast(array() as array<string>))"
    )
