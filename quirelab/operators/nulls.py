"""Null models of a corpus. Random choices are MD5 draws, so they repeat on any cluster and in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.operators.corpus import followers, prefix, word_ids, words
from quirelab.operators.resample import HASH_BLOCK, draw, order_hash
from quirelab.session import cut, whole_executor

CHUNK_LINES = 20


def word_shuffle(lines: DataFrame, seed: int = 42) -> DataFrame:
    """The words of each line in random order."""
    keyed = F.expr(f"array_sort(transform(words, (w, i) -> struct(md5(concat_ws(':', '{seed}', line_no, i)) as h, w as w)))")
    return lines.withColumn("words", F.transform(keyed, lambda p: p["w"]))


def _permute(lines: DataFrame, within: str, seed: int) -> DataFrame:
    """Lines in random order within each value of a column, each taking one of its slots."""
    slots = prefix(lines.select(*dict.fromkeys(["line_no", "grp", within])), [within], "line_no", F.lit(1), "k")
    content = prefix(lines.withColumn("_h", order_hash(seed, F.col("line_no"))).select(within, "_h", "words"), [within], "_h", F.lit(1), "k", HASH_BLOCK)
    joined = slots.join(content.select(within, "k", "words"), [within, "k"])
    return joined.select("line_no", "grp", "words")


def chunk_shuffle(lines: DataFrame, seed: int = 42, chunk: int = CHUNK_LINES) -> DataFrame:
    """Lines permuted within chunks of successive lines."""
    return _permute(lines.withColumn("_c", F.expr(f"line_no div {chunk}")), "_c", seed)


def group_shuffle(lines: DataFrame, seed: int = 42) -> DataFrame:
    """Lines permuted within their group; each group keeps its slots."""
    return _permute(lines, "grp", seed)


def frequency_matched(lines: DataFrame, seed: int = 42) -> DataFrame:
    """Each line replaced by one drawn, by frequency, from the lines of the same length.

    Drawing a type by its frequency is drawing any line uniformly, so lines are numbered per
    length, and each slot picks a number.
    """
    sized = lines.withColumn("k", F.coalesce(F.size("words"), F.lit(0)))
    pool = prefix(sized.select("k", "line_no", "words"), ["k"], "line_no", F.lit(1), "i").select("k", "i", "words")
    n = sized.groupBy("k").agg(F.count("*").alias("n"))
    picks = sized.select("line_no", "grp", "k").join(n, "k").withColumn("i", draw(F.col("n"), seed, F.col("line_no")))
    return picks.join(pool, ["k", "i"]).select("line_no", "grp", "words")


def block_bootstrap(lines: DataFrame, seed: int = 42, block: int = CHUNK_LINES) -> DataFrame:
    """Blocks of successive lines drawn with replacement, cut to the corpus' length; slots keep their groups.

    The last block may be short; where draws of it leave a gap, lines drawn at random fill up.
    """
    n = lines.count()
    blocks = -(-n // block)
    if not n:
        return lines
    slots = lines.select("line_no", "grp", F.expr(f"line_no div {block}").alias("b"), F.expr(f"line_no % {block}").alias("j"))
    source = draw(F.lit(blocks), seed, F.col("b")) * block + F.col("j")
    fallback = draw(F.lit(n), seed, "fill", F.col("line_no"))
    picks = slots.select("line_no", "grp", F.when(source < n, source).otherwise(fallback).alias("s"))
    return picks.join(lines.select(F.col("line_no").alias("s"), "words"), "s").select("line_no", "grp", "words")


def markov_transitions(lines: DataFrame, order: int = 2) -> DataFrame:
    """``state, next, c``: how often a word follows each run of ``order`` words, over the whole stream."""
    ahead = followers(words(lines), [], "pos", "word", list(range(1, order + 1)))
    state = F.concat(F.array("word"), F.slice("nexts", 1, order - 1)) if order > 1 else F.array("word")
    pairs = ahead.select(state.alias("state"), F.col("nexts")[order - 1].alias("next")).where("next is not null")
    return pairs.groupBy("state", "next").agg(F.count("*").alias("c"))


def hashed_runs(lines: DataFrame, order: int = 2) -> DataFrame:
    """``state, next`` of every place of the stream, uncounted, by 64-bit hashes; no longer check stands behind these."""
    coded = words(lines).select("pos", F.xxhash64("word").alias("x"))
    ahead = followers(coded, [], "pos", "x", list(range(1, order + 1)))
    return ahead.select(F.xxhash64("x", *(F.col("nexts")[i] for i in range(order - 1))).alias("state"), F.col("nexts")[order - 1].alias("next")).where("next is not null")


class _Walk:
    """A walk over the runs of ``order`` words of a stream ``x`` of word numbers below ``size``.

    To draw the next word by its count after a run is to go on from any place where the run stands.
    A run that stands once leaves no choice, so only places of repeated runs are listed: ``place`` of
    a run is the number of its list or -1.
    """

    def __init__(self, x: np.ndarray, order: int, size: int, rng: np.random.Generator):
        self.x, self.order, self.size, self.rng = x, order, size, rng
        self.last = len(x) - order  # the only run without a next word, unless it also stands elsewhere
        runs, sure = x, None
        for j in range(1, order):
            runs, places, bounds = _repeated(runs[: len(x) - j], x[j:], sure)
            sure = runs < 0
        if order == 1:
            runs, places, bounds = _repeated(np.zeros_like(x), x, None)
        self.runs, self.places, self.bounds = runs, places, bounds
        self.at = int(rng.integers(self.last))
        self.got = [x[self.at : self.at + order]]  # what was walked and is not yet given
        self.have = order

    def words(self, m: int) -> np.ndarray:
        """The next ``m`` words."""
        while self.have < m:
            part = self._go(min(m - self.have, 1 << 16)) if self.at >= 0 else self._search(m - self.have)
            self.got.append(part)
            self.have += len(part)
        flat = np.concatenate(self.got)
        self.got, self.have = [flat[m:]], len(flat) - m
        return flat[:m]

    def _go(self, m: int) -> np.ndarray:
        """At most ``m`` steps; fewer where a run without a next word is reached."""
        runs, places, bounds, last = memoryview(self.runs), memoryview(self.places), memoryview(self.bounds), self.last
        out, p, random = np.empty(m, np.int64), self.at, self.rng.random(m).tolist()
        end = runs[last]
        for i in range(m):
            c = runs[p]
            if c >= 0:
                lo = bounds[c]
                p = places[lo + int(random[i] * (bounds[c + 1] - lo - (c == end)))]  # the last place has no next word
            elif p == last:
                self.tail, self.at = self.x[p : p + self.order], -1
                return self.x[out[:i] + self.order - 1]
            p += 1
            out[i] = p
        self.at = p
        return self.x[out + self.order - 1]

    def _search(self, m: int) -> np.ndarray:
        """Random words until the last ones are a run of the stream with a next word, at most ``m``."""
        tail = self.tail
        drawn = self.rng.integers(self.size, size=min(m, 1 << 22)).astype(np.int32)
        text = np.concatenate([tail[1:], drawn])
        wanted = _run_hashes(text, self.order)
        sorted_ = np.sort(wanted)
        bits = max(10, min(26, len(wanted).bit_length() + 4))
        filled = np.zeros(1 << bits, bool)
        filled[wanted >> np.uint64(64 - bits)] = True
        found: dict[tuple, int] = {}
        for a in range(0, self.last, 1 << 22):  # runs with a next word start before the last
            h = _run_hashes(self.x[a : min(a + (1 << 22), self.last) + self.order - 1], self.order)
            near = np.flatnonzero(filled[h >> np.uint64(64 - bits)])
            hit = near[sorted_[np.minimum(np.searchsorted(sorted_, h[near]), len(sorted_) - 1)] == h[near]]
            for p in (hit + a).tolist():
                found.setdefault(tuple(self.x[p : p + self.order].tolist()), p)
        if found:
            known = np.isin(wanted, _run_hashes(np.concatenate([np.array(k, np.int32) for k in found]), self.order)[:: self.order])
            for i in np.flatnonzero(known).tolist():
                p = found.get(tuple(text[i : i + self.order].tolist()))
                if p is not None:
                    self.at = p
                    return drawn[: i + 1]
        self.tail = np.concatenate([tail, drawn])[-self.order :]
        return drawn


def _run_hashes(x: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the runs of ``order`` numbers; what they find is compared itself."""
    n = len(x) - order + 1
    h = np.zeros(n, np.uint64)
    for j in range(order):
        h = (h ^ x[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _repeated(a: np.ndarray, b: np.ndarray, sure: np.ndarray | None, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a[p], b[p]`` that stand twice or more, numbered: the number of each place or -1, and the places of each number.

    Where ``sure`` holds, a pair is known to stand once. Ranges of ``b`` are sorted one after
    another, so a copy of the whole is never needed.
    """
    n = len(b)
    number = np.full(n, -1, np.int32)
    ends = np.zeros(int(b.max()) + 1 if n else 0, np.int64)
    for i in range(0, n, block):  # a count takes 8 bytes a number
        own = np.bincount(b[i : i + block])
        ends[: len(own)] += own
    np.cumsum(ends, out=ends)
    cuts = np.unique(np.searchsorted(ends, np.arange(block, n, block)) + 1) if n > block else np.zeros(0, np.int64)
    # Filled from the front; memory is taken only as far as it is filled.
    places, bounds, known, base = np.empty(n, np.int32), np.zeros(n // 2 + 1, np.int32), 0, 0
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
        within = [np.flatnonzero((b[i : i + block] >= lo) & (b[i : i + block] < hi)).astype(np.int32) + np.int32(i) for i in range(0, n, block)]
        at = np.concatenate(within) if within else np.zeros(0, np.int32)
        del within
        if sure is not None:
            at = at[~sure[at]]
        key = a[at].astype(np.int64) << 32 | b[at]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        del by
        new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        del key
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        many = np.repeat(sizes > 1, sizes)
        at, sizes = at[many], sizes[sizes > 1]
        number[at] = np.repeat(np.arange(known, known + len(sizes), dtype=np.int32), sizes)
        places[base : base + len(at)] = at
        bounds[known + 1 : known + 1 + len(sizes)] = base + np.cumsum(sizes)
        known, base = known + len(sizes), base + len(at)
    return number, places[:base], bounds[: known + 1]


def markov_chain(lines: DataFrame, order: int = 2, seed: int = 42, replicates: int = 1) -> DataFrame:
    """``replicate, line_no, grp, words``: a walk over the transitions, cut into the corpus' line lengths.

    The walk starts at a run of words drawn by frequency, and each step draws the next word by its
    count after the run before; a run without a next word takes a random word. A walk is
    sequential, so a replicate is one task; it gets the words as numbers (8 to 16 bytes a word) and the
    lines' lengths, has an executor to itself, and yields whole lines. A stream of at most ``order`` words is copied.
    """
    flat = cut(words(lines).select("pos", "word"))
    n = flat.count()
    if n <= order:
        every = F.explode(F.expr(f"sequence(0L, {replicates - 1}L)")).alias("replicate")
        return lines.select(every, "line_no", "grp", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    ids = cut(word_ids(flat))
    frame = lines.select("line_no", "grp", F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).alias("k"))
    none = F.lit(None).cast("string")
    streams = [
        ids.select(F.lit(0).alias("kind"), F.col("id").alias("at"), F.lit(0).cast("long").alias("v"), "word"),
        flat.join(ids, "word").select(F.lit(1), "pos", "id", none), frame.select(F.lit(2), "line_no", F.col("k").cast("long"), none),
    ]
    one = reduce(DataFrame.union, streams).repartition(1)

    def walk(replicate: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, vocab, at, lengths = np.empty(n, np.int32), [], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
            for batch in batches:
                kind, i, v = (batch.column(c).to_numpy() for c in range(3))
                own = kind == 1
                x[i[own]] = v[own]
                if (kind == 0).any():
                    at.append(i[kind == 0].copy())
                    vocab.append(batch.column(3).filter(pa.array(kind == 0)))
                if (kind == 2).any():
                    lengths.append((i[kind == 2].copy(), v[kind == 2].astype(np.int32)))
            place = np.concatenate(at)
            back = np.empty(len(place), np.int64)
            back[place] = np.arange(len(place))
            named = pa.concat_arrays([c.cast(pa.large_string()) for c in vocab]).take(pa.array(back))
            numbers = np.concatenate([a for a, _ in lengths])
            by = np.argsort(numbers)
            numbers, sizes = numbers[by], np.concatenate([k for _, k in lengths])[by]
            del vocab, at, place, back, lengths, by
            steps = _Walk(x, order, len(named), np.random.default_rng([seed, replicate]))
            for a in range(0, len(sizes), 10_000):
                ends = np.concatenate([[0], np.cumsum(sizes[a : a + 10_000], dtype=np.int64)])
                text = named.take(pa.array(steps.words(int(ends[-1])))).cast(pa.string())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[a : a + 10_000]), lists], ["line_no", "words"])

        made = one.mapInArrow(run, "line_no long, words array<string>", profile=whole_executor(lines.sparkSession))
        return frame.select("line_no", "grp").join(made, "line_no").select(F.lit(replicate).cast("long").alias("replicate"), "line_no", "grp", "words")

    return reduce(DataFrame.unionByName, map(walk, range(replicates)))


def models(lines: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    """The six models by name."""
    return {
        "word_shuffle": word_shuffle(lines, seed), "chunk_shuffle": chunk_shuffle(lines, seed), "group_shuffle": group_shuffle(lines, seed),
        "frequency_matched": frequency_matched(lines, seed), "block_bootstrap": block_bootstrap(lines, seed), "markov_chain": markov_chain(lines, 2, seed).drop("replicate"),
    }


def all_models(lines: DataFrame, seed: int = 42) -> DataFrame:
    """The six models as one table keyed by ``model``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("model"), "line_no", "grp", "words") for m, df in models(lines, seed).items()])


def model_sizes(lines: DataFrame, seed: int = 42) -> DataFrame:
    """``model, lines, words``. One model is made after another, so that only one has its exchanges on disk."""
    rows = []
    for m, df in models(lines, seed).items():
        one = cut(df.agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))).first()
        rows += [(m, one["lines"], one["words"])] if one["lines"] else []
    return lines.sparkSession.createDataFrame(rows, "model string, lines long, words long")
