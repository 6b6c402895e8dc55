"""Long exact spans shared between records, through FM-indexes over shards.

Each distinct sequence of words is cut into segments: maximal stretches of windows (``length``
words each) with the same minimizer, the least-hashed run of ``SEED`` words in the window. Equal
windows have equal minimizers, so every repeat of a window reaches the same shard, and a shard is
searched with its own segments only: work and traffic follow the number of words. A shard builds
a compressed FM-index and streams its segments through it. Where the matching statistics reach
``length`` and the suffix range holds several places, the window is reported under its suffix
range, and the records of one range are partners. Overlapping windows make up the maximal
intervals of a record (:func:`shared_intervals`).

Exact copies are collapsed first and joined back by class. A seed that would fill a shard alone
(boilerplate) is cut further: its windows are routed one by one, and of each only the first and
the last place go to the index, picked with map-side aggregation, so a phrase in a third of all
records gathers in no task; its other places are joined to what the index found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelab.llm.fmindex import FMIndex
from quirelab.llm.textvec import Members, window_hashes
from quirelab.session import cut

#: Words of a minimizer.
SEED = 4
#: Words in an FM-index; a task with more builds several, each for whole keys.
SHARD = 1 << 20
#: One in so many records is looked at to find seeds that would fill a shard; this steers routing only.
LOOK = 64
#: At most so many seeds are cut further (8 bytes each, sent to the tasks): beyond 2^38 words, a seed
#: is cut only if it has more than this part of them, and shards grow beyond SHARD accordingly.
MOST_CUT = 1 << 20


def _flat(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = batch_column
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy().view(np.uint64), lengths


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SHARD words; a longer sequence is a piece of its own."""
    ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + SHARD, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _windows(values: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies in one sequence, and its minimizer."""
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(of[: len(values) - length + 1] == of[length - 1 :])
    seeds = window_hashes(values, min(SEED, length))
    n = len(values) - length + 1
    least = seeds[:n].copy()
    for k in range(1, length - min(SEED, length) + 1):
        np.minimum(least, seeds[k : k + n], out=least)
    return starts, least[starts]


SEGMENT = "seed long, rep long, pos int, words array<long>"


def _segmenter(length: int, sent, single: bool):
    """Sequences to segments ``seed, rep, pos, words``, but for those of the seeds sent; ``single``: only these, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Members(sent.value)
        for batch in (p for b in batches for p in _pieces(b)):
            rep = batch.column(0).to_numpy()
            values, lengths = _flat(batch.column(1))
            starts, seed = _windows(values, lengths, length)
            if not len(starts):
                continue
            is_hot = np.zeros(len(seed), bool)
            is_hot[hot.where(seed)] = True
            offset = np.concatenate([[0], np.cumsum(lengths)])
            of = np.searchsorted(offset, starts, "right") - 1
            if single:
                first = np.flatnonzero(is_hot)
                a, b, key = starts[first], starts[first] + length, window_hashes(values, length)[starts[first]]
            else:
                new = np.ones(len(starts), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
                cold = ~is_hot[first]
                first, last = first[cold], last[cold]
                a, b, key = starts[first], starts[last] + length, seed[first]
            if not len(first):
                continue
            ends = np.cumsum(b - a)
            take = np.repeat(b - ends, b - a) + np.arange(ends[-1])
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep[of[first]]), pa.array((a - offset[of[first]]).astype(np.int32)), words], ["seed", "rep", "pos", "words"])

    return run


def _indexer(length: int):
    """Rows of a task, sorted by seed, to windows that stand in more than one place: ``shard, range, seed, rep, pos``.

    ``shard`` is the first seed of the shard, which no other has; ``range`` is where the suffix
    range of the window starts, which no other window of the shard has.
    """

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        values, lengths = _flat(rows["words"].chunk(0))
        index = FMIndex(values, lengths)
        offset = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(len(lengths)), lengths)
        at, lo, _ = index.matching(index.ids(values), np.arange(len(values)) - offset[of] + 1, length, 2)
        seed, rep = rows["seed"].chunk(0).to_numpy(), rows["rep"].chunk(0).to_numpy()
        pos = rows["pos"].chunk(0).to_numpy()[of[at]] + at - length + 1 - offset[of[at]]
        cols = [np.full(len(at), seed[0]), lo.astype(np.int64), seed[of[at]], rep[of[at]], pos.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shard", "range", "seed", "rep", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                held_seed = held[-1].column(0)[held[-1].num_rows - 1].as_py() if held else None
                seeds = batch.column(0).to_numpy()
                if size >= SHARD and seeds[0] != held_seed:
                    yield one(held)
                    held, size = [], 0
                    continue
                words = np.diff(batch.column(3).offsets.to_numpy())
                # Up to where the shard is full, and on to the end of that seed.
                full = int(np.searchsorted(np.cumsum(words) + size, SHARD))
                stop = batch.num_rows
                if size >= SHARD:
                    stop = int(np.argmax(seeds != held_seed)) if (seeds != held_seed).any() else batch.num_rows
                elif full < batch.num_rows:
                    beyond = np.flatnonzero(seeds[full:] != seeds[full])
                    stop = full + int(beyond[0]) if len(beyond) else batch.num_rows
                held.append(batch.slice(0, stop))
                size += int(words[:stop].sum())
                batch = batch.slice(stop)
        if held:
            yield one(held)

    return run


@dataclass
class SharedWindows:
    """``places``: ``shard, range, rep, pos``, windows by suffix range that stand in several distinct sequences;
    ``members``: ``rep, record_id``, the records of each distinct sequence."""

    places: DataFrame
    members: DataFrame
    length: int


GROUP = ["shard", "range"]


def _seeds_to_cut(sequences: DataFrame, length: int) -> np.ndarray:
    """Seeds that may fill a shard alone, from a sample of records: at most about MOST_CUT."""
    none = sequences.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64))
    look = sequences.where(F.pmod(F.xxhash64("rep"), F.lit(LOOK)) == 0).mapInArrow(_segmenter(length, none, False), SEGMENT)
    counts = look.groupBy("seed").agg(F.sum(F.size("words")).alias("w"))
    total = counts.agg(F.sum("w")).first()[0] or 0
    bound = max(SHARD / 4 / LOOK, total / MOST_CUT)
    return counts.where(F.col("w") > bound).select("seed").toArrow()["seed"].combine_chunks().to_numpy().view(np.uint64)


def shared_windows(records: DataFrame, length: int = 8) -> SharedWindows:
    """Find all windows of ``length`` words that stand in more than one record.

    ``records``: ``record_id`` (integer), ``words``; rows with the same id must hold the same
    words, and count once. Null ids are left out; null words, and records shorter than
    ``length``, share nothing.
    """
    spark = records.sparkSession
    hashed = records.where("record_id is not null").select("record_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    hashed = hashed.where(F.size("h") >= length)
    # Words are known by their 64-bit hashes from here on, sequences by 128 bits of hash. The rows
    # are parsed and hashed once; ids alone are read again below.
    keyed = cut(hashed.withColumn("key", F.struct(F.xxhash64("h").alias("a"), F.xxhash64(F.reverse("h"), F.lit(1)).alias("b"))))
    classes = cut(keyed.groupBy("key").agg(F.min("record_id").alias("rep"), F.first("h").alias("h")))
    ids = keyed.select("key", "record_id").distinct()
    members = classes.select("key", "rep").join(ids, "key").select("rep", "record_id")

    sequences = classes.select("rep", "h")
    hot = _seeds_to_cut(sequences, length)
    sent = spark.sparkContext.broadcast(hot)
    segments = sequences.mapInArrow(_segmenter(length, sent, False), SEGMENT)
    if len(hot):
        single = cut(sequences.mapInArrow(_segmenter(length, sent, True), SEGMENT))
        place = F.struct("rep", "pos", "words")
        ends = single.groupBy("seed").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x.rep <> y.rep")
        segments = segments.unionByName(ends.select("seed", F.explode(F.array("x", "y")).alias("p")).select("seed", "p.*"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = segments.repartition(n, "seed").sortWithinPartitions("seed")
    places = cut(routed.mapInArrow(_indexer(length), "shard long, range long, seed long, rep long, pos int"))
    if len(hot):
        # Windows routed one by one are keyed by themselves, and so joined to all of their places.
        alone = places.join(ends.select("seed"), "seed", "left_semi").select("seed", *GROUP).distinct()
        other = places.join(ends.select("seed"), "seed", "left_anti").select(*GROUP, "rep", "pos")
        places = cut(other.unionByName(single.select("seed", "rep", "pos").join(alone, "seed").select(*GROUP, "rep", "pos")))
    return SharedWindows(places, members, length)


def shared_pairs(found: SharedWindows) -> DataFrame:
    """Each pair of records with a window in common: ``record_a, record_b``, smaller id first.

    Its size is that of the answer; :func:`shared_links` with :func:`shared_classes` says the same
    without multiplying copies, and :func:`shared_shares` and :func:`shared_intervals` stay linear.
    """
    between = shared_links(found)
    # Copies: a record stands for its class only where the class has several members.
    several = found.members.where("rep <> record_id").select("rep").distinct()
    grouped = found.members.join(several, "rep")
    left = between.join(grouped.select(F.col("rep").alias("class_a"), F.col("record_id").alias("xs")), "class_a", "left")
    both = left.join(grouped.select(F.col("rep").alias("class_b"), F.col("record_id").alias("ys")), "class_b", "left")
    p, q = F.coalesce("xs", "class_a"), F.coalesce("ys", "class_b")
    spread = both.select(F.least(p, q).alias("record_a"), F.greatest(p, q).alias("record_b"))
    one, two = grouped.select("rep", F.col("record_id").alias("record_a")), grouped.select("rep", F.col("record_id").alias("record_b"))
    within = one.join(two, "rep").where("record_a < record_b").select("record_a", "record_b")
    return spread.unionByName(within)


def shared_links(found: SharedWindows) -> DataFrame:
    """Pairs of classes of copies with a window in common: ``class_a, class_b``, smaller first."""
    reps = found.places.select(*GROUP, "rep").distinct()
    a, b = reps.select(*GROUP, F.col("rep").alias("class_a")), reps.select(*GROUP, F.col("rep").alias("class_b"))
    return a.join(b, GROUP).where("class_a < class_b").select("class_a", "class_b").distinct()


def shared_classes(records: DataFrame, found: SharedWindows) -> DataFrame:
    """The class of copies of each record: ``record_id, class_id, copies``.

    ``class_id`` is the least id among the records with the same words, ``copies`` their number.
    A record shorter than ``length`` is a class of its own.
    """
    copies = found.members.groupBy("rep").agg(F.count("*").alias("copies"))
    known = found.members.join(copies, "rep").select("record_id", F.col("rep").alias("class_id"), "copies")
    every = records.where("record_id is not null").select("record_id").distinct().join(known, "record_id", "left")
    return every.select("record_id", F.coalesce("class_id", "record_id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def _real_windows(found: SharedWindows) -> DataFrame:
    """``rep, pos`` of windows that stand in other sequences too; a window twice in one sequence alone is no sharing."""
    lone = found.places.groupBy(*GROUP).agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x = y").select(*GROUP)
    return found.places.join(lone, GROUP, "left_anti").select("rep", "pos").distinct()


def shared_intervals(records: DataFrame, found: SharedWindows) -> DataFrame:
    """Maximal stretches of each record in which every window stands in another record: ``record_id, start, n_words``.

    ``start`` counts words from 0. A record with an exact copy is one interval from end to end.
    Two stretches that touch or overlap without a shared window between them stay apart.
    """
    order = Window.partitionBy("rep").orderBy("pos")
    runs = _real_windows(found).withColumn("_run", F.col("pos") - F.row_number().over(order)).groupBy("rep", "_run").agg(F.min("pos").alias("start"), (F.count("*") + found.length - 1).alias("n_words"))
    copied = found.members.where("rep <> record_id").select("rep").distinct()
    of_rest = found.members.join(runs.join(copied, "rep", "left_anti").drop("_run"), "rep").select("record_id", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))
    sizes = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.size("words")).cast("long").alias("n_words"))
    whole = found.members.join(copied, "rep", "left_semi").join(sizes, "record_id").select("record_id", F.lit(0).cast("long").alias("start"), "n_words")
    return of_rest.unionByName(whole)


def shared_shares(records: DataFrame, found: SharedWindows) -> DataFrame:
    """How much of each record stands elsewhere: ``record_id, n_words, shared_words, share``.

    Every record comes out once; without words, the share is null. Of a record that has an exact
    copy, all words are shared if it has at least ``length``.
    """
    length = found.length
    back = F.lag("pos").over(Window.partitionBy("rep").orderBy("pos"))
    covered = _real_windows(found).withColumn("new", F.least(F.lit(length), F.coalesce(F.col("pos") - back, F.lit(length)))).groupBy("rep").agg(F.sum("new").cast("long").alias("shared"))
    copied = found.members.where("rep <> record_id").select("rep").distinct().withColumn("copied", F.lit(True))
    by_record = found.members.join(covered, "rep", "left").join(copied, "rep", "left").select("record_id", "shared", "copied")
    sizes = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.coalesce(F.size("words"), F.lit(0))).cast("long").alias("n_words"))
    out = sizes.join(by_record, "record_id", "left")
    shared = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_words")
    return out.select("record_id", "n_words", shared).withColumn("share", F.try_divide(F.col("shared_words").cast("double"), F.col("n_words")))
