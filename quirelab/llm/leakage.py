"""Evaluation texts leaking into a corpus: template windows, hash join, slot check.

Words get canonical forms in which numbers, names and units are typed placeholders, and windows of
``n`` canonical words of the evaluation items are hash-joined with those of the documents. There
are two streams of canonical words for each text:

* In the *lexical* stream a placeholder depends on nothing but the word: numbers, units, and the
  names that the items have. Equal windows have equal templates here, so no verbatim passage is
  lost: a window whose slots hold the same words is verbatim.
* In the *shaped* stream each text types its own names by their capitals, and a decimal is one
  number, so a question that comes back with names no item has is met too.

Windows whose slots differ, but map one to one over a run of aligned windows, are a
re-parameterised question.

The join is a Spark join of two tables of windows. Documents are read once and are not shuffled:
a bitmap of fixed size over the items' window hashes (``BITS``, whatever the number of items) lets
only those windows of a document through that may have a partner. Neither items nor documents
come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelab.llm.textvec import Members, Words, chunks, in_sentence, mix, span_hashes, window_hashes, word_hashes, words_of
from quirelab.session import cut

#: Bits of the bitmap over the items' windows, a power of two: 16 MB at any number of items.
BITS = 27
#: Bits of the bitmap over the items' names: 1 MB.
NAME_BITS = 23
# Units of measure, as they are written.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "ml", "l", "s", "min", "h", "percent", "folio", "folios", "leaf", "leaves", "page", "pages", "line", "lines", "inch", "inches", "foot", "feet", "mile", "miles", "hour", "hours", "day", "days", "year", "years", "euro", "euros", "dollar", "dollars"]
# Words that open sentences and are no names there.
OPENERS = ["a", "an", "the", "this", "that", "these", "those", "it", "he", "she", "we", "they", "you", "there", "here", "if", "when", "while", "after", "before", "because", "since", "although", "for", "from", "in", "on", "at", "to", "by", "with", "of", "and", "but", "or", "so", "as", "what", "which", "who", "where", "why", "how", "is", "are", "was", "were", "do", "does", "did", "can", "each", "every", "some", "another", "one", "our", "my", "his", "her", "their", "then", "no", "not"]
LEXICAL, SHAPED = 1, 2
LITERAL, NUMBER, NAME, UNIT = range(4)
_PLACE = mix(np.array([0, 101, 102, 103], np.uint64))
_SHOWN = ["", "\x01number", "\x01name", "\x01unit"]


class Bitmap:
    """A set of 64-bit hashes as two bits each in a bitmap of fixed size; it may hold strangers, but lacks none."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits = bits
        self.packed = np.zeros(1 << (bits - 3), np.uint8) if packed is None else packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes >> np.uint64(64 - self.bits), hashes & np.uint64((1 << self.bits) - 1)):
            found &= (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found

    @staticmethod
    def of(hashes: DataFrame, column: str, bits: int) -> Bitmap:
        """The bitmap of a column of longs: aggregated in pieces of 4 KB, of which at most 2^bits / 32768 come to the driver."""
        at = F.array(F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND(F.lit((1 << bits) - 1)))
        spots = hashes.where(F.col(column).isNotNull()).select(F.explode(at).alias("p"))
        parts = spots.groupBy(F.shiftright("p", 15).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("m"))
        out = Bitmap(bits)
        for r in parts.collect():
            out.packed[r["b"] << 12 : (r["b"] + 1) << 12] = np.frombuffer(r["m"], np.uint8)
        return out


def own_names(texts: list[str], w: Words) -> np.ndarray:
    """Whether each word is a name by the shape of its own text.

    A name is never written small in its text; it stands with a capital inside a sentence, or
    opens one without being a word that commonly does.
    """
    upper, opens = in_sentence(texts, w)
    with np.errstate(over="ignore"):
        key = mix(w.hash ^ ((w.text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    _, of = np.unique(key, return_inverse=True)
    small = np.bincount(of, ~upper)
    inside = np.bincount(of, upper & ~opens)
    common = np.zeros(len(w.hash), bool)
    common[Members(word_hashes(OPENERS)).where(w.hash)] = True
    return upper & (small[of] == 0) & ((inside[of] > 0) | ~common) & (w.end - w.start > 1)


def whole_numbers(w: Words) -> Words:
    """The same words with decimals, and numbers with grouped digits, as one word."""
    joined = np.zeros(len(w.start), bool)
    if len(w.start) > 1:
        gap = w.points[np.minimum(w.end[:-1], len(w.points) - 1)]
        joined[1:] = w.number[1:] & w.number[:-1] & (w.start[1:] - w.end[:-1] == 1) & ((gap == 46) | (gap == 44)) & (w.text[1:] == w.text[:-1])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(joined)) - 1
    start, end, hashes = w.start[first], w.end[last], w.hash[first].copy()
    several = first < last
    if several.any():
        hashes[several] = span_hashes(w.points.astype(np.uint64), start[several], end[several])
    return Words(w.points, start, end, w.text[first], hashes, w.number[first])


class Windows:
    """Windows of canonical words of a chunk of texts, in both streams."""

    def __init__(self, n: int, least_literals: int, names: Bitmap):
        self.n, self.least, self.names = n, least_literals, names
        self.units = Members(word_hashes(UNITS))

    def _typed(self, w: Words, is_name: np.ndarray) -> np.ndarray:
        kind = np.zeros(len(w.hash), np.uint8)
        kind[self.units.where(w.hash)] = UNIT
        kind[is_name] = NAME
        kind[w.number] = NUMBER
        return kind

    def streams(self, texts: list[str]) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
        """``stream, words, kinds, starts, keys`` of the windows that lie in one text.

        The key of a window is the hash of its template. One with fewer than ``least_literals``
        literal words says too little as a template: it is keyed by its own words, and only in the
        lexical stream.
        """
        w, n = words_of(texts), self.n
        if len(w.start) < n:
            return
        shape = own_names(texts, w)
        for stream in (LEXICAL, SHAPED):
            if stream == SHAPED:
                v = whole_numbers(w)
                shape = shape[np.searchsorted(w.start, v.start)]
            else:
                v = w
            kind = self._typed(v, shape if stream == SHAPED else self.names.has(v.hash))
            if len(v.start) < n:
                continue
            at = np.flatnonzero(v.text[: len(v.text) - n + 1] == v.text[n - 1 :])
            slots = np.concatenate([[0], np.cumsum(kind > 0)])
            filled = slots[at + n] - slots[at]
            rich = n - filled >= self.least
            key = window_hashes(np.where(kind > 0, _PLACE[kind], v.hash), n)[at]
            if stream == LEXICAL:
                key = np.where(rich, key, mix(key ^ window_hashes(v.hash, n)[at] + np.uint64(1)))
            else:
                keep = rich & (filled > 0)
                at, key = at[keep], mix(key[keep] + np.uint64(SHAPED))
            yield stream, v, kind, at, key

    def rows(self, ids: np.ndarray, texts: list[str], only: Bitmap | None) -> Iterator[pa.RecordBatch]:
        """The windows as rows of WINDOW; with ``only``, those that the bitmap may have."""
        for a, b in chunks(texts):
            for stream, w, kind, at, key in self.streams(texts[a:b]):
                if only is not None:
                    hit = only.has(key)
                    at, key = at[hit], key[hit]
                if not len(at):
                    continue
                first = np.searchsorted(w.text, w.text[at])  # the first word of each window's text
                words = {int(i): w.word(int(i)) for i in np.unique((at[:, None] + np.arange(self.n)).ravel())}
                template, slots = [], []
                for i in at.tolist():
                    template.append(" ".join(_SHOWN[kind[j]] or words[j] for j in range(i, i + self.n)))
                    slots.append([words[j] for j in range(i, i + self.n) if kind[j]])
                cols = [pa.array(key.view(np.int64)), pa.array(ids[a:b][w.text[at]], pa.int64()), pa.array(np.full(len(at), stream, np.int32)), pa.array((at - first).astype(np.int32)), pa.array((w.start[at] - w.start[first]).astype(np.int32)), pa.array(template), pa.array(slots, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, NAMES)


#: A window: key, record, stream, the place among its words and among its characters, template, words in its slots.
WINDOW = "key long, id long, stream int, at int, place int, template string, slots array<string>"
NAMES = [c.split()[0] for c in WINDOW.split(", ")]


def _item_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in chunks(texts):
            w = words_of(texts[a:b])
            upper, opens = in_sentence(texts[a:b], w)
            found = np.unique(w.hash[upper & ~opens & ~w.number & (w.end - w.start > 1)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])


def _windowing(spark: SparkSession, n: int, least: int, names: Bitmap, only: Bitmap | None):
    """A mapper of rows ``id, text`` to WINDOW; the bitmaps go out once to each machine."""
    sent = spark.sparkContext.broadcast((names.packed, None if only is None else only.packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        windows = Windows(n, least, Bitmap(NAME_BITS, known))
        for batch in batches:
            yield from windows.rows(batch.column(0).to_numpy(), batch.column(1).to_pylist(), None if wanted is None else Bitmap(BITS, wanted))

    return run


def _matches(documents: DataFrame, items: DataFrame, n: int, least_literals: int) -> DataFrame:
    """Pairs of equal templates: ``item_id, doc_id, stream, shift, at, place, mine, theirs``, the last two the words in the slots."""
    spark = items.sparkSession
    texts = items.where("item_id is not null and text <> ''").select(F.col("item_id").alias("id"), "text").distinct()
    names = Bitmap.of(texts.mapInArrow(_item_names, "h long"), "h", NAME_BITS)
    asked = cut(texts.mapInArrow(_windowing(spark, n, least_literals, names, None), WINDOW))
    only = Bitmap.of(asked.select("key").distinct(), "key", BITS)
    docs = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").alias("id"), "text")
    hits = cut(docs.mapInArrow(_windowing(spark, n, least_literals, names, only), WINDOW))
    a = asked.select("key", "stream", "template", F.col("id").alias("item_id"), F.col("at").alias("_i"), F.col("slots").alias("mine"))
    b = hits.select("key", "stream", "template", F.col("id").alias("doc_id"), "at", "place", F.col("slots").alias("theirs"))
    # A template that very many documents have is a hot key; AQE cuts it, and the items' side has few rows of it.
    return b.join(a, ["key", "stream", "template"]).select("item_id", "doc_id", "stream", (F.col("_i") - F.col("at")).alias("shift"), "at", "place", "mine", "theirs")


def leaked_passages(documents: DataFrame, items: DataFrame, n: int = 13, least_literals: int = 4) -> DataFrame:
    """Documents that hold a passage of an evaluation item: ``item_id, doc_id, kind, windows``.

    ``kind``: ``verbatim`` if at least ``n`` successive words are the same, else
    ``reparameterised`` if they are the same but for numbers, names and units that correspond one
    to one. Each window of a re-parameterised passage has at least ``least_literals`` words that
    are no placeholders; verbatim passages need none. ``windows``: in how many places of the
    document. Null and empty texts hold nothing; items shorter than ``n`` words are never found.
    Rows of either table with a null id are left out; repeated rows count once.
    """
    pairs = cut(_matches(documents, items, n, least_literals).distinct())
    who = ["item_id", "doc_id"]
    verbatim = pairs.where(f"stream = {LEXICAL} and mine = theirs").groupBy(who).agg(F.count_distinct("place").alias("windows"))
    others = pairs.where("size(mine) > 0").join(verbatim.select(who), who, "left_anti")
    # Runs of windows at one distance that touch each other are one passage.
    line = ["item_id", "doc_id", "stream", "shift"]
    order = Window.partitionBy(line).orderBy("at")
    cuts = others.withColumn("_new", (F.col("at") - F.lag("at", 1, -n - 1).over(order) > n).cast("int"))
    runs = cuts.withColumn("_run", F.sum("_new").over(order)).drop("_new")
    slots = runs.select(*line, "_run", F.explode(F.arrays_zip("mine", "theirs")).alias("s")).select(*line, "_run", "s.mine", "s.theirs").distinct()
    checked = slots.groupBy(*line, "_run").agg(F.count("*").alias("n"), F.count_distinct("mine").alias("x"), F.count_distinct("theirs").alias("y"), F.max((F.col("mine") != F.col("theirs")).cast("int")).alias("c"))
    good = checked.where("n = x and n = y and c = 1").select(*line, "_run")
    changed = runs.join(good, [*line, "_run"]).groupBy(who).agg(F.count_distinct("place").alias("windows"))
    kinds = [df.select(*who, F.lit(k).alias("kind"), "windows") for df, k in ((verbatim, "verbatim"), (changed, "reparameterised"))]
    return kinds[0].unionByName(kinds[1])


def found_pairs(leaks: DataFrame) -> DataFrame:
    """Item and document of verbatim passages, each pair once."""
    return leaks.where(F.col("kind") == "verbatim").select("item_id", "doc_id").distinct()
