"""Spelling of keys: pages, folios, quires, sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """All white space off both ends (Spark's own trim takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_key(c: Column) -> Column:
    """A page, folio or source key as it is compared: trimmed, lower-cased; empty is null."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def normalize_quire(c: Column) -> Column:
    """A quire label trimmed and without one leading q or Q if more is there; null gives ''."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when((F.length(t) > 1) & (F.lower(F.substring(t, 1, 1)) == "q"), t.substr(F.lit(2), F.length(t))).otherwise(t)


def quire_key(c: Column) -> Column:
    """A quire as it is compared; null where there is none."""
    q = normalize_quire(c)
    return F.when(q != "", q)
