"""Differences between two copies of a dataset, by a range-partitioned streaming merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.functions.times import clock_micros
from quirelab.operators.skew import SKETCH

#: Rows in a range, about, as far as there are partitions for it.
ROWS = 50_000


def same_text(c: Column) -> Column:
    """A text as it is compared: runs of blanks, tabs and line breaks are one blank, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\n]+", " "))


def same_set(c: Column) -> Column:
    """An array as it is compared: a set without nulls, written in order; null is empty."""
    kept = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))
    return F.to_json(kept)


def _merge(fields: list[str], names: tuple[str, str], values: bool):
    """A merger of rows sorted by (key, side, newest first): two pointers over either side's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            if not rows.num_rows:
                continue
            # The newest row of each key and side is its first; the last key may go on in the next batch.
            key, side = rows["key"].combine_chunks().to_numpy(), rows["side"].combine_chunks().to_numpy()
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (side[1:] != side[:-1])
            at = np.flatnonzero(first)
            last = key[at] == key[-1]
            carry = rows.take(pa.array(at[last]))
            yield from out(rows, at[~last], key, side)
        if carry is not None and carry.num_rows:
            key, side = carry["key"].combine_chunks().to_numpy(), carry["side"].combine_chunks().to_numpy()
            yield from out(carry, np.arange(len(key)), key, side)

    def out(rows: pa.Table, at: np.ndarray, key: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = at[side[at] == 0], at[side[at] == 1]
        # Where each pointer stands when the other's key is reached.
        step = np.searchsorted(key[right], key[left])
        met = (step < len(right)) & (key[right[np.minimum(step, max(len(right) - 1, 0))]] == key[left]) if len(right) else np.zeros(len(left), bool)
        lone = np.ones(len(right), bool)
        lone[step[met]] = False
        gone = pa.nulls(int((~met).sum() + lone.sum()), pa.string())
        mine, theirs = [gone], [gone]
        keys, issues = [key[left[~met]], key[right[lone]]], [np.full((~met).sum(), names[0], object), np.full(lone.sum(), names[1], object)]
        a, b = pa.array(left[met]), pa.array(right[step[met]])
        for f in fields:
            differs = pc.fill_null(pc.not_equal(rows[f].take(a), rows[f].take(b)), False).to_numpy()
            keys.append(key[left[met]][differs])
            issues.append(np.full(differs.sum(), f, object))
            if values:
                mask = pa.array(differs)
                for out_of, at_rows in ((mine, a), (theirs, b)):
                    out_of += rows[f].take(at_rows.filter(mask)).chunks
        cols = [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(issues), pa.string())]
        if values:
            cols += [pa.concat_arrays(c) for c in (mine, theirs)]
        yield pa.RecordBatch.from_arrays(cols, ["key", "issue", "left_value", "right_value"][: len(cols)])

    return run


def split_points(keys: DataFrame, parts: int, share: float = 0.01) -> tuple[list[int], list[int], int]:
    """Split points of a column ``key`` into ranges of about equal numbers of rows, keys with at least ``share`` of the rows, and the number of ranges.

    One pass over the keys alone, with sketches of fixed size; at most ``parts`` - 1 points and
    1 / share keys come back. They steer where rows go, never what comes out.
    """
    k, parts = int(1 / share), max(1, min(parts, 4096))
    at = ", ".join(str(i / parts) for i in range(1, parts)) or "0.5"
    row = keys.where("key is not null").agg(F.expr(f"approx_percentile(key, array({at}), 20000)").alias("q"), F.expr(f"approx_top_k(key, {k}, {max(SKETCH, 4 * k)})").alias("top"), F.count("*").alias("n")).first()
    wanted = max(1, min(parts, row["n"] // ROWS + 1))
    points = sorted(set((row["q"] or [])[:: max(1, parts // wanted)]))
    return points, [r["item"] for r in row["top"] or [] if r["count"] >= share * row["n"]], len(points) + 1


def range_number(key: str, points: list[int]) -> Column:
    """Which of the ranges between sorted split points a key is in, by binary search."""
    if not points:
        return F.lit(0)
    at = f"array({', '.join(f'{p}L' for p in points)})"
    middle = "(s.a + s.b) div 2"
    step = f"if(s.a >= s.b, s, if({at}[int({middle})] <= {key}, named_struct('a', int({middle} + 1), 'b', s.b), named_struct('a', s.a, 'b', int({middle}))))"
    return F.expr(f"aggregate(sequence(1, {len(points).bit_length()}), named_struct('a', 0, 'b', {len(points)}), (s, i) -> {step}, s -> s.a)")


def diff_copies(left: DataFrame, right: DataFrame, key: str, version: str, fields: dict[str, Column], names: tuple[str, str] = ("only_left", "only_right"), values: bool = False) -> DataFrame:
    """Rows missing on either side and fields that differ: ``key, issue``, and with ``values`` ``left_value, right_value``.

    Both copies are cut at the same split points, taken from their keys alone, exchanged once,
    sorted by key within ranges and merged in one streaming pass, a batch at a time. Of several
    rows of a key the one with the newest ``version`` holds (a null version is older than any), of
    several of these the one with the least fields, compared in their order. ``issue`` is one of
    ``names``, or the field's name; the values are as they were compared, and null for a missing
    row. ``fields`` maps a name to the column that is compared, as text without nulls. ``key`` is
    an integer column; null keys are left out. Keys with very many rows on a side are brought
    down to one row each before the exchange.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        micros = clock_micros(F.col(version))
        return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lit(n).alias("side"), F.coalesce(micros, F.lit(-(2**62))).alias("version"), *(c.alias(f) for f, c in fields.items()))

    keys = left.select(F.col(key).cast("long").alias("key")).unionByName(right.select(F.col(key).cast("long").alias("key")))
    points, hot, n = split_points(keys, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = side(left, 0).unionByName(side(right, 1))
    if hot:
        is_hot = F.col("key").isin(hot)
        newest = both.where(is_hot).groupBy("key", "side").agg(F.min(F.struct((-F.col("version")).alias("v"), *fields)).alias("r"))
        both = both.where(~is_hot).unionByName(newest.select("key", "side", (-F.col("r.v")).alias("version"), *(f"r.{f}" for f in fields)))
    ranged = both.repartitionById(n, range_number("key", points)).sortWithinPartitions("key", "side", F.desc("version"), *fields)
    schema = "key long, issue string" + (", left_value string, right_value string" if values else "")
    return ranged.drop("version").mapInArrow(_merge(list(fields), names, values), schema)


def diff_mismatches(main: DataFrame, mirror: DataFrame, values: bool = False) -> DataFrame:
    """mismatch_main against mismatch_mirror: ``mm_id, issue``, and with ``values`` ``main_value, mirror_value``."""
    fields = {"zl_text": same_text(F.col("zl_text")), "it_text": same_text(F.col("it_text")), "sources_missing": same_set(F.col("sources_missing"))}
    found = diff_copies(main, mirror, "mm_id", "updated_at", fields, ("only_main", "only_mirror"), values)
    return found.withColumnsRenamed({"key": "mm_id", "left_value": "main_value", "right_value": "mirror_value"})
