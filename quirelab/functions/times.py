"""Times as they stand on the clock, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_micros(c: Column) -> Column:
    """Microseconds since 1970 on the timestamp's own clock; no zone and no summer time comes in."""
    part = lambda n, x: F.lit(n) * x.cast("long")
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return part(86_400_000_000, F.unix_date(c.cast("date"))) + part(3_600_000_000, F.hour(c)) + part(60_000_000, F.minute(c)) + seconds


def clock_month(c: Column) -> Column:
    """The month as ``yyyy-MM``."""
    return F.when(c.isNotNull(), F.format_string("%04d-%02d", F.year(c), F.month(c)))
