"""Several values packed in one field: one value per row, with its position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.functions.grammar import malformed_elements, parse_elements, placed_elements


def split_packed(df: DataFrame, id_col: str, array_col: str, only_packed: bool = False) -> DataFrame:
    """Split the elements of an array column into single values.

    Returns ``record_id, pos, element, term, malformed``: ``pos`` counts all values of the array
    from 0, ``element`` is the array element the value came from, ``malformed`` says that a quote
    in that element has no partner (its characters then only separate). ``only_packed`` keeps
    records in which at least one element holds two or more values.

    Null or empty arrays and elements without values give no rows; repeated input rows give
    repeated rows, so pass one row per record. Runs row by row, without a shuffle.
    """
    rows = df.select(F.col(id_col).alias("record_id"), F.col(array_col).alias("_a"))
    if only_packed:
        # A cheap test first: two values need something besides letters and stars in one element.
        rows = rows.where(F.exists("_a", lambda e: e.rlike(r"[^\p{L}*]")))
    # Generate is a barrier: what it yields is computed once, not once per use below.
    rows = rows.select("record_id", F.explode(F.array(F.struct(parse_elements("_a").alias("v"), malformed_elements("_a").alias("bad")))).alias("p"))
    if only_packed:
        rows = rows.where(F.exists("p.v", lambda v: F.size(v) >= 2))
    flat = F.flatten(
        F.transform("p.v", lambda v, i: F.transform(v, lambda t: F.struct(i.alias("element"), t.alias("term"), F.get("p.bad", i).alias("malformed"))))
    )
    return rows.select("record_id", F.posexplode(flat).alias("pos", "t")).select("record_id", "pos", "t.element", "t.term", "t.malformed")


def place_packed(df: DataFrame, id_col: str, array_col: str, brackets: bool = False) -> DataFrame:
    """The same with where each value stands: ``record_id, pos, element, offset, term, malformed``.

    ``offset``: the character of the element at which the value starts, its quote or bracket
    included. ``brackets``: what stands in ``[]``, ``()``, ``{}`` or ``<>`` is one value as well.
    """
    rows = df.select(F.col(id_col).alias("record_id"), F.col(array_col).alias("_a"))
    rows = rows.select("record_id", F.explode(F.array(placed_elements("_a", brackets))).alias("p"))
    flat = F.flatten(F.transform("p", lambda e, i: F.transform(e["found"], lambda v: F.struct(i.alias("element"), v["offset"].alias("offset"), v["term"].alias("term"), e["malformed"].alias("malformed")))))
    return rows.select("record_id", F.posexplode(flat).alias("pos", "t")).select("record_id", "pos", "t.*")


def packed_in_tables(lines: DataFrame, mismatches: DataFrame) -> DataFrame:
    """All values of the packed arrays of line_records.tokens and mismatch_main.sources_present.

    Returns ``table_name, record_id, pos, term``. A line delivered twice counts once; of a
    mismatch record the newest row holds. Records with a null key are left out.
    """
    # Deliveries of one line have one content, so dropping unpacked rows first only makes the shuffle smaller.
    packed = lines.select("line_id", "tokens").where("line_id is not null").where(F.exists("tokens", lambda e: e.rlike(r"[^\p{L}*]")))
    once = packed.dropDuplicates(["line_id"])
    newest = mismatches.where("mm_id is not null").groupBy("mm_id").agg(F.max_by("sources_present", "updated_at").alias("sources_present"))
    parts = [
        split_packed(once, "line_id", "tokens", True).select(F.lit("line_records").alias("table_name"), "record_id", "pos", "term"),
        split_packed(newest, "mm_id", "sources_present", True).select(F.lit("mismatch_main").alias("table_name"), "record_id", "pos", "term"),
    ]
    return parts[0].unionByName(parts[1])
