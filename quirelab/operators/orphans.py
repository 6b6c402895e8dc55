"""References to records that do not exist, or not at the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.functions.keys import plain_key
from quirelab.functions.times import clock_micros, clock_month
from quirelab.operators.skew import hot_keys, salted_join

#: End of a period that has none, as microseconds; later than any timestamp.
OPEN = 2**62


def _islands(rows: DataFrame, *group: str) -> DataFrame:
    """Merge the half-open integer ranges [lo, hi) of each group into contiguous runs."""
    order = Window.partitionBy(*group).orderBy("lo")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = rows.withColumn("_new", (F.coalesce(F.max("hi").over(before), F.lit(-(2**62))) < F.col("lo")).cast("int"))
    run = new.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*group, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def key_runs(parents: DataFrame, key: Column, block: int = 1 << 10, group: Column | None = None) -> DataFrame:
    """Compress integer parent keys into contiguous runs: ``block, runs`` with runs [(lo, hi)].

    Keys are cut into blocks of ``block`` numbers, so no sort is global and a block holds at most
    block / 2 runs. Null keys are left out; repeated keys count once. ``group``: numbers of one
    group only form runs; ``block`` then names group and block.
    """
    keys = parents.select(_block(key.cast("long"), group, block).alias("block"), key.cast("long").alias("lo")).where("lo is not null").distinct()
    return _islands(keys.select("block", "lo", (F.col("lo") + 1).alias("hi")), "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def _block(n: Column, group: Column | None, block: int) -> Column:
    number = F.floor(n / block) if block & (block - 1) else F.shiftright(n, block.bit_length() - 1)
    return number if group is None else F.concat_ws(":", group, number.cast("string"))


def key_number(key: Column) -> tuple[Column, Column]:
    """A text key as ``(group, number)``, no two keys alike: its last run of digits, and the text around it.

    Keys like f68v, f69v then are the successive numbers 68, 69 of one group, and compress into
    runs. The group tells how long the number is written if that is with leading zeros; a key
    without digits is number 0 of a group of its own.
    """
    pattern = r"^(?s)(.*?)([0-9]{1,18})([^0-9]*)$"
    digits = F.regexp_extract(key, pattern, 2)
    before, after = F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 3)
    width = F.when(digits.startswith("0"), F.length(digits)).otherwise(F.lit(0))
    some = F.concat_ws(":", F.length(before), width, F.concat(before, after))
    return F.when(digits != "", some).otherwise(F.concat(F.lit("-:"), key)), F.when(digits != "", digits.cast("long")).when(key.isNotNull(), 0)


def _at_or_before(runs: str, at: str) -> str:
    """SQL: the last run that starts at or before a point, or null, by binary search in the sorted runs."""
    middle = "(s.a + s.b) div 2"
    step = f"if(s.a >= s.b, s, if({runs}[int({middle})].lo <= {at}, named_struct('a', int({middle} + 1), 'b', s.b), named_struct('a', s.a, 'b', int({middle}))))"
    many = f"aggregate(sequence(1, int(ceil(log2(size({runs}) + 1)))), named_struct('a', 0, 'b', size({runs})), (s, i) -> {step}, s -> s.a)"
    return f"case when coalesce(size({runs}), 0) > 0 then get({runs}, {many} - 1) end"


def _beyond(runs: str, at: str) -> str:
    """SQL: whether no run holds a point, as of the run that starts at or before it."""
    return f"coalesce(({_at_or_before(runs, at)}).hi <= {at}, true)"


def orphan_keys(refs: DataFrame, ref_key: Column, parents: DataFrame, parent_key: Column, block: int = 1 << 10) -> DataFrame:
    """Rows of ``refs`` whose integer key is no parent key, with all their columns.

    Each reference is matched as of its key to the run that starts at or before it, and is an
    orphan beyond that run's end. Null references are none and do not come out.
    """
    cols = [F.col(f"`{c}`") for c in refs.columns]
    keyed = refs.select(F.struct(*cols).alias("_row"), ref_key.cast("long").alias("_k")).where("_k is not null")
    keyed = keyed.withColumn("block", _block(F.col("_k"), None, block))
    joined = salted_join(keyed, key_runs(parents, parent_key, block), "block", F.col("_k"), "left")
    return joined.where(_beyond("runs", "_k")).select("_row.*")


def known_keys(refs: DataFrame, parent_keys: DataFrame, block: int = 1 << 10) -> DataFrame:
    """Add ``known`` to ``refs`` (with a text column ``key``): whether the key is one of ``parent_keys`` (a column ``key``).

    Text keys are read as numbers (:func:`key_number`), parent keys compressed into runs, and each
    reference matched as of its number. The runs are few where keys are numbered through, and are
    broadcast by Spark as long as they are small; beyond that AQE cuts blocks with many references.
    """
    group, number = key_number(F.col("key"))
    runs = key_runs(parent_keys.where("key is not null"), number, block, group)
    numbered = refs.withColumn("_k", number).withColumn("block", _block(F.col("_k"), group, block))
    joined = numbered.join(runs, "block", "left")
    return joined.withColumn("known", ~F.expr(_beyond("runs", "_k"))).drop("_k", "block", "runs")


def force_runs(parents: DataFrame, key: Column, added: Column, deleted: Column) -> DataFrame:
    """When each key is in force: ``key, runs, first_deleted``, times as integer microseconds.

    The instants a key is in force are the sorted integers here; rows that touch or overlap merge
    into one run [lo, hi). Runs are merged within a month first and over months then, so a key
    with very many rows is not sorted in one piece. ``first_deleted``: the earliest end of any row.
    A row without added time is never in force but shows that the key exists.
    """
    rows = parents.select(key.alias("key"), clock_micros(added).alias("lo"), clock_micros(deleted).alias("end"))
    rows = rows.where("key is not null").withColumn("month", F.expr("floor(lo / 2592000000000)"))
    longest = rows.groupBy("key", "month", "lo").agg(F.max(F.coalesce("end", F.lit(OPEN))).alias("hi"), F.min("end").alias("end"))
    ends = longest.groupBy("key").agg(F.min("end").alias("first_deleted"))
    held = longest.where("hi > lo").select("key", "month", "lo", "hi")
    runs = _islands(_islands(held, "key", "month").select("key", "lo", "hi"), "key")
    listed = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    return ends.join(listed, "key", "left")


def orphan_references(refs: DataFrame, parents: DataFrame, hot: dict | None = None) -> DataFrame:
    """References that find no row in force at their time.

    ``refs``: ``key, at, record_key``; ``parents``: what :func:`force_runs` gives. Returns
    ``record_key, ref_month, reason``: ``missing`` if the key is beyond the runs of parent keys,
    ``deleted`` if a row of it ended at or before that time, else ``late``. References without key
    or time are none. Repeated references come out once; hot keys are salted.
    """
    refs = refs.where("key is not null and at is not null").select("key", "record_key", clock_micros(F.col("at")).alias("t"), clock_month(F.col("at")).alias("ref_month"))
    hot = hot_keys(refs, F.col("key")) if hot is None else hot
    told = known_keys(refs, parents.select("key"))
    joined = salted_join(told, parents, "key", F.col("record_key"), "left", hot)
    gone = joined.where(f"not known or {_beyond('runs', 't')}")
    reason = F.expr("case when not known then 'missing' when first_deleted <= t then 'deleted' else 'late' end")
    return gone.select("record_key", "ref_month", reason.alias("reason")).distinct()


def orphans_by_table(lines: DataFrame, pages: DataFrame, folios: DataFrame) -> DataFrame:
    """Lines whose page, and pages whose folio, is not in force at the time.

    Returns ``table_name, record_key, ref_month, reason``. A page counts once, by its key, at its
    earliest added time and with the folio of the first row that names one; deliveries of a line count once.
    """
    line_refs = lines.where("line_id is not null").select(plain_key(F.col("page")).alias("key"), F.col("recorded_at").alias("at"), F.col("line_id").cast("string").alias("record_key"))
    page_keys = pages.select(plain_key(F.col("page_id")).alias("record_key"), plain_key(F.col("folio")).alias("key"), F.col("added_at").alias("at")).where("record_key is not null and at is not null")
    page_refs = page_keys.groupBy("record_key").agg(F.min("at").alias("at"), F.min_by("key", F.when(F.col("key").isNotNull(), F.col("at"))).alias("key"))
    in_pages = force_runs(pages, plain_key(F.col("page_id")), F.col("added_at"), F.col("deleted_at"))
    in_folios = force_runs(folios, plain_key(F.col("folio_id")), F.col("added_at"), F.col("deleted_at"))
    found = [("line_records", orphan_references(line_refs, in_pages)), ("page_records", orphan_references(page_refs, in_folios))]
    a, b = (df.select(F.lit(name).alias("table_name"), "record_key", "ref_month", "reason") for name, df in found)
    return a.unionByName(b)
