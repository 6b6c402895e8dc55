"""Ordered corpora: lines, words, positions and pairs, without a global sort.

A corpus is a table ``[*by,] line_no, grp, words``: lines in order (``line_no`` is dense from 0),
the group (quire) of each, and its words. ``by`` names extra keys (a replicate, a configuration);
every operator works within each of their values at once, in one plan. Key names of one letter, or with a
leading underscore, are taken by the operators themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.functions.grammar import line_words
from quirelab.functions.keys import normalize_quire
from quirelab.functions.times import clock_micros
from quirelab.session import cut

#: Rows of a block; prefix sums run over blocks first and within a block then.
BLOCK = 1 << 14


def prefix(df: DataFrame, by: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in the order of ``order``.

    ``order`` is an integer column without ties, or with ties that the columns ``ties`` break. Rows
    are summed per block of its range, the blocks' sums are added up (one row per block), then a
    window runs within each block. It must be dense enough that blocks are far fewer than rows;
    for other orders there is :func:`number_lines`.
    """
    keys = [*by, "_block"]
    rows = df.withColumn("_block", F.expr(f"floor({order} / {block})")).withColumn("_v", value)
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_s")
    sums = sums.select(*keys, before.alias("_b"))
    inner = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    # The window first: its exchange then serves the join on the same keys.
    rows = rows.withColumn("_in", F.sum("_v").over(inner)).drop("_v")
    total = F.col("_b") + F.coalesce(F.col("_in"), F.lit(0))
    return rows.join(sums, keys).withColumn(out, total).drop("_block", "_in", "_b")


def is_sparse(orders: DataFrame, order: str, block: int = BLOCK) -> bool:
    """Whether a column's values lie so far apart that blocks of its range are of no use: fewer than 64 rows in each, and many blocks."""
    row = orders.agg(F.count(order).alias("n"), F.approx_count_distinct(F.expr(f"floor({order} / {block})")).alias("b")).first()
    return row["b"] > 1024 and row["b"] * 64 > row["n"]


def number_lines(df: DataFrame, by: Sequence[str], order: str, block: int = BLOCK, sparse: bool | None = None) -> DataFrame:
    """Add the dense ``line_no`` in the order of an integer column without ties, whatever its gaps.

    Where the order is dense this is a blocked prefix count. A sparse order, which would make a
    block of nearly every row, is ranked by a range exchange instead (:func:`global_ranks`); the
    numbers are the same. ``sparse`` says which, where the caller knows it cheaper than by a look at
    the column. With ``by``, blocks are counted within each of its values.
    """
    if not by and (is_sparse(df.select(order), order, block) if sparse is None else sparse):
        return global_ranks(df, [order], "line_no")
    return prefix(df, by, order, F.lit(1), "line_no", block).withColumn("line_no", F.col("line_no").cast("long"))


def time_series(df: DataFrame, at: str, value: str, by: Sequence[str] = (), block_s: int = 21_600, ties: Sequence[str] = ()) -> DataFrame:
    """A numeric series ``[*by,] i, v`` in the order of a timestamp; rows without time or value are left out.

    Times are counted in blocks of ``block_s`` seconds. Equal times come in the order of the columns
    ``ties``, then of the values, so the series never depends on chance.
    """
    kept = [t for t in ties if t not in by]
    rows = df.where(f"{at} is not null and {value} is not null").select(*by, clock_micros(F.col(at)).alias("_t"), F.col(value).cast("double").alias("v"), *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(kept)))
    order = [*(f"_tie{i}" for i in range(len(kept))), "v"]
    return prefix(rows, by, "_t", F.lit(1), "i", block_s * 1_000_000, order).select(*by, F.col("i").cast("long").alias("i"), "v")


def line_bag(line_records: DataFrame) -> DataFrame:
    """line_records as lines without order: ``line_id, grp, words``; repeated deliveries count once. Null ids are left out."""
    # Deliveries of a line have one content. They are dropped before anything is parsed, and parsing
    # then spreads over the exchange's partitions, however few files there are. Of raw_text only what is parsed goes along.
    raw = F.when(F.coalesce(F.size("tokens"), F.lit(0)) <= 0, F.col("raw_text")).alias("raw_text")
    once = line_records.where("line_id is not null").select("line_id", "quire", "tokens", raw).dropDuplicates(["line_id"])
    return once.select("line_id", normalize_quire(F.col("quire")).alias("grp"), line_words().alias("words"))


def line_corpus(line_records: DataFrame) -> DataFrame:
    """The same as a corpus, ordered by line_id."""
    sparse = is_sparse(line_records.select("line_id"), "line_id")  # reads one column
    return number_lines(line_bag(line_records), [], "line_id", sparse=sparse).select("line_no", "grp", "words")


def document_corpus(documents: DataFrame) -> DataFrame:
    """Lines of documents as a corpus: split at line breaks and white space, grouped by source."""
    rows = documents.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("grp"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    ordered = rows.select((F.col("doc_id") * (1 << 20) + F.col("i")).alias("o"), "grp", words.alias("words"))
    return number_lines(ordered, [], "o").select("line_no", "grp", "words")


def words(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The word stream ``[*by,] pos, line_no, idx, grp, word``, ``pos`` dense from 0."""
    placed = prefix(lines, by, "line_no", F.coalesce(F.size("words"), F.lit(0)), "_start")
    flat = placed.select(*by, "line_no", "grp", "_start", F.posexplode("words").alias("idx", "word"))
    return flat.select(*by, (F.col("_start") + F.col("idx")).cast("long").alias("pos"), "line_no", "idx", "grp", "word")


def word_bag(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The words ``[*by,] grp, word`` without order, for statistics of counts: no exchange at all."""
    return lines.select(*dict.fromkeys([*by, "grp"]), F.explode("words").alias("word"))


def followers(df: DataFrame, by: Sequence[str], order: str, value: str, distances: Sequence[int], block: int = BLOCK) -> DataFrame:
    """Add ``nexts``: the array of the values at each distance ahead (null beyond the end).

    ``order`` is dense. Each block takes along a halo of the first rows of the next one, so a
    window within the block sees far enough: one exchange, however long the stream.
    """
    far = max(distances)
    home = F.expr(f"floor({order} / {block})")
    halo = F.expr(f"{order} % {block} < {far}")
    copies = df.withColumn("_block", F.explode(F.when(halo, F.array(home, home - 1)).otherwise(F.array(home)))).withColumn("_home", home == F.col("_block"))
    w = Window.partitionBy(*by, "_block").orderBy(order)
    nexts = F.array(*(F.lead(value, d).over(w) for d in distances))
    return copies.withColumn("nexts", nexts).where("_home").drop("_block", "_home")


def word_ids(flat: DataFrame, by: Sequence[str] = (), first: bool = True) -> DataFrame:
    """Dictionary-encode a word stream: ``[*by,] word, id``, dense from 0.

    ``first``: in order of first appearance, else in alphabetical order. The rank of first
    appearance is a blocked prefix count; the alphabetical one sorts the vocabulary by range.
    """
    vocab = flat.groupBy(*by, "word").agg(F.min("pos").alias("o"))
    if first:
        return prefix(vocab, by, "o", F.lit(1), "id").select(*by, "word", F.col("id").cast("long").alias("id"))
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("word")) - 1
        return vocab.select(*by, "word", rank.cast("long").alias("id"))
    return global_ranks(vocab.select("word"), ["word"], "id")


def global_ranks(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``, the rank from 0 in the order of some columns without ties.

    A range exchange and a local sort give increasing numbers with gaps between the partitions;
    their sizes, one row per partition, close these. The numbered rows are cut off from their
    source, so both uses see the same split points.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    marked = ranged.withColumn("_p", F.shiftright("_m", 33))
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    rank = F.col("_b") + F.col("_m") - F.shiftleft(F.col("_p"), 33)
    return marked.join(F.broadcast(before), "_p").withColumn(out, rank.cast("long")).drop("_m", "_p", "_b")


def rank_symbols(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """M9: add ``symbol``: rank r of n gets the largest i with floor(i n / size) <= r."""
    ranked = global_ranks(df, order, "_r")
    n = ranked.agg(F.count("*").alias("_n"))
    rows = ranked.crossJoin(F.broadcast(n))  # one row
    return rows.withColumn("symbol", F.expr(f"cast(((_r + 1) * {size} - 1) div _n as int)")).drop("_r", "_n")


def encoded(flat: DataFrame, by: Sequence[str] = (), first: bool = True) -> DataFrame:
    """The stream as a numeric series ``[*by,] i, v``."""
    ids = word_ids(flat, by, first)
    return flat.join(ids, [*by, "word"]).select(*by, F.col("pos").alias("i"), F.col("id").cast("double").alias("v"))
