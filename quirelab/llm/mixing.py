"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelab.functions.keys import plain_key
from quirelab.operators.resample import order_hash

#: Folder of tokenizer files; each worker must be able to read it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces of a source over which expected copies are summed up: 4,096 for each size class.
PIECES = 1 << 17
# Fixed value: the split pattern of this vocabulary, as published with its family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(path: str):
    """The byte-pair encoder of a vocabulary file, once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens``: the size of each whole text in tokens; null and empty texts have 0.

    ``source`` is the compared form, trimmed and lower-cased. Rows with a null id are left out.
    Only ids, sources and sizes go on from here; texts stay in the scan's tasks.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    docs = documents.where("doc_id is not null").select("doc_id", plain_key(F.col("source")).alias("source"), "text")
    return docs.mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Expected copies of each document of a source: ``source, target_share, max_repeats, size, wanted, rate, planned``.

    ``total``: wanted size of the whole mix in tokens. By default the largest at which every
    source that has text reaches its share within max_repeats. ``rate`` = wanted / size, at most
    max_repeats. A target without text has size 0 and gives nothing; its share is not handed on.
    Null targets or repeats count as 0; a source listed twice keeps its largest target.
    """
    wanted = targets.select(plain_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max_by("target_share", "target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    rows = wanted.join(have, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    able = F.when((F.col("size") > 0) & (F.col("target_share") > 0), F.col("size") * F.col("max_repeats") / F.col("target_share"))
    whole = F.lit(float(total)) if total is not None else F.coalesce(F.min(able).over(Window.partitionBy()), F.lit(0.0))
    rows = rows.withColumn("wanted", F.col("target_share") * whole)
    rate = F.least(F.col("max_repeats").cast("double"), F.coalesce(F.try_divide(F.col("wanted"), F.col("size")), F.lit(0.0)))
    return rows.withColumn("rate", rate).withColumn("planned", F.col("rate") * F.col("size"))


def draw(sizes: DataFrame, rates: DataFrame, seed: int = 11) -> DataFrame:
    """Systematic sample ``doc_id, source, n_tokens, copies`` of the documents drawn at least once.

    Within a source documents are lined up by size class, then in random order (MD5 of seed and id);
    each has ``rate`` expected copies. The running sum of these plus one random offset crosses an
    integer as often as the document is emitted: floor(rate) or ceil(rate) times, so never beyond a
    whole max_repeats, and each stretch of the line gives its share of the sample. Since the rate is
    the same within a source, the running sum is rank times rate. Ranks are made in two steps, over
    PIECES pieces of each source and within a piece, so a source with a third of all rows is
    spread over its pieces. ``rates`` has one row per target.
    """
    # Size classes in whole powers of two; texts of 0 tokens add nothing and are not drawn.
    rows = sizes.where("n_tokens > 0").join(rates.select("source", "rate").where("rate > 0"), "source")
    classes = PIECES // 32
    size_class = F.least(F.length(F.bin("n_tokens")) - 1, F.lit(31))
    rows = rows.withColumn("_h", order_hash(seed, F.col("doc_id")))
    rows = rows.withColumn("_piece", (size_class * classes + F.expr(f"floor(_h / {(1 << 60) // classes})")).cast("int"))
    counts = rows.groupBy("source", "_piece").agg(F.count("*").alias("_n"))  # at most PIECES per target
    before = counts.select("source", "_piece", (F.sum("_n").over(Window.partitionBy("source").orderBy("_piece")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("source", "_piece").orderBy("_h", "doc_id")) + F.col("_before")
    # One offset in [0, 1) for each source.
    offset = F.pmod(order_hash(seed + 1, F.col("source")), F.lit(1 << 30)) / (1 << 30)
    placed = rows.join(before, ["source", "_piece"]).withColumn("_rank", rank).withColumn("_u", offset)
    copies = F.floor(F.col("_rank") * F.col("rate") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("rate") + F.col("_u"))
    return placed.select("doc_id", "source", "n_tokens", copies.cast("long").alias("copies")).where("copies > 0")


def report(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """Shares reached: ``source, target_share, max_repeats, size, wanted, documents, drawn_tokens, actual_share``, for every target."""
    got = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"))
    rows = rates.select("source", "target_share", "max_repeats", "size", "wanted").join(got, "source", "left").na.fill(0, ["documents", "drawn_tokens"])
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn_tokens").cast("double"), all_tokens), F.lit(0.0)))
