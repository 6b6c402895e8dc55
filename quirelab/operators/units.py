"""Sub-word units of a vocabulary by pair merging, and how stable they are over groups.

This is a statistic of the corpus (which units recur, and where); no text is tokenised with it.
Merging works on word types with their counts, which Spark aggregates first. Up to LOCAL types
one task merges them; a larger vocabulary stays a table, and each merge is one aggregation.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelab.operators.corpus import word_bag
from quirelab.operators.resample import bootstrap_draws
from quirelab.session import cut

#: Word types that one task merges.
LOCAL = 8_000_000
#: Word types from which passes over arrays are faster than going by words.
MANY = 20_000
VOCABULARY = 500
LEAST_WORDS = 100


def word_types(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[*by,] word, c``; empty words are left out."""
    return word_bag(lines, by).where("word <> ''").groupBy(*by, "word").agg(F.count("*").alias("c"))


def merges(types: dict[str, int], vocabulary: int = VOCABULARY) -> tuple[list[str], list[tuple[str, str]]]:
    """Units and merges of a vocabulary: single characters, then the most frequent pair again and again.

    Ties go to the pair first in order. Pair counts are kept up to date word by word; a heap holds
    every count a pair has had since it last grew or shrank, and stale ones are passed over.
    """
    parts = {w: list(w) for w in types}
    units = sorted({c for w in types for c in w})
    pairs: Counter = Counter()
    where: dict[tuple[str, str], set[str]] = defaultdict(set)
    for w, symbols in parts.items():
        for p in zip(symbols, symbols[1:]):
            pairs[p] += types[w]
            where[p].add(w)
    made: list[tuple[str, str]] = []
    known = set(units)
    heap = [(-n, p) for p, n in pairs.items() if n > 0]
    heapq.heapify(heap)
    while len(units) < vocabulary and heap:
        n, best = heapq.heappop(heap)
        if pairs.get(best) != -n:
            continue
        made.append(best)
        touched: set[tuple[str, str]] = set()
        joined = best[0] + best[1]
        if joined not in known:
            known.add(joined)
            units.append(joined)
        for w in list(where[best]):
            old = parts[w]
            for p in zip(old, old[1:]):
                pairs[p] -= types[w]
                if not pairs[p]:
                    del pairs[p]
                where[p].discard(w)
                touched.add(p)
            parts[w] = merge_once(old, best)
            for p in zip(parts[w], parts[w][1:]):
                pairs[p] += types[w]
                where[p].add(w)
                touched.add(p)
        for p in touched:
            if pairs.get(p, 0) > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return units, made


def merge_once(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Replace a pair, from the left, wherever it stands."""
    out: list[str] = []
    for s in symbols:
        if out and out[-1] == pair[0] and s == pair[1]:
            out[-1] += s
        else:
            out.append(s)
    return out


def merges_of_many(words: Iterable[Sequence[str]], counts: Iterable[np.ndarray], vocabulary: int = VOCABULARY) -> list[str]:
    """The units of :func:`merges` for word types that come in batches with their counts.

    All words stand in one array of symbols with gaps between them (10 bytes a character). A merge is a
    pass over it, and counts change only for the pairs beside a merged one.
    """
    codes, lengths, weights = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ws, cs in zip(words, counts):
        codes.append(np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32))
        lengths.append(np.fromiter(map(len, ws), np.int64, len(ws)))
        weights.append(np.asarray(cs, np.int64))
    flat, size, weight = map(np.concatenate, (codes, lengths, weights))
    del codes
    present = np.zeros(0x110000, bool)
    present[flat] = True
    names = [chr(c) for c in np.flatnonzero(present)]
    number = {u: i for i, u in enumerate(names)}
    units = list(names)
    s = np.full(len(flat) + len(size), -1, np.int16 if max(len(names), vocabulary) < 30_000 else np.int32)
    inside = np.ones(len(s), bool)
    inside[np.cumsum(size + 1) - 1] = False
    s[inside] = (np.cumsum(present) - 1)[flat]
    of = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    del flat, inside
    pairs: dict[tuple[int, int], int] = {}

    def add(at: np.ndarray, sign: int) -> None:
        at = at[(at >= 0) & (at + 1 < len(s))]
        at = at[(s[at] >= 0) & (s[at + 1] >= 0)]
        keys, which = np.unique(s[at].astype(np.int64) << 32 | s[at + 1], return_inverse=True)
        sums = np.bincount(which, weight[of[at]], len(keys)).astype(np.int64)
        for k, n in zip(keys.tolist(), sums.tolist()):
            p = (k >> 32, k & 0xFFFFFFFF)
            left = pairs.get(p, 0) + sign * n
            if left:
                pairs[p] = left
            else:
                pairs.pop(p, None)

    for a in range(0, len(s), 1 << 21):
        add(np.arange(a, min(a + (1 << 21), len(s))), 1)
    while len(units) < vocabulary and pairs:
        most = max(pairs.values())
        x, y = min((p for p, n in pairs.items() if n == most), key=lambda p: (names[p[0]], names[p[1]]))
        at = np.flatnonzero((s[:-1] == x) & (s[1:] == y))
        if x == y:  # from the left, every other of a run
            start = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        add(np.unique(np.concatenate([at - 1, at, at + 1])), -1)
        joined = names[x] + names[y]
        if joined not in number:
            number[joined] = len(names)
            names.append(joined)
            units.append(joined)
        s[at] = number[joined]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, of = s[keep], of[keep]
        at = at - np.arange(len(at))  # as many symbols fewer before it
        add(np.unique(np.concatenate([at - 1, at])), 1)
    return units


class Stock:
    """Word types whose counts vary: the units of each sample as :func:`merges` has them.

    What doesn't depend on the counts is made once: the symbols with gaps between words, and the places of each
    pair. A merge goes to the places of its pair alone, which stand in the list of the merge that made the later symbol.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, vocabulary: int = VOCABULARY):
        chars, number = np.unique(codes, return_inverse=True)
        self.names, self.vocabulary, self.cap = [chr(c) for c in chars.tolist()], vocabulary, len(chars) + max(vocabulary, 1)
        self.s = np.full(len(codes) + len(lengths) + 1, -1, np.int32)
        inside = np.ones(len(self.s), bool)
        inside[np.cumsum(lengths + 1) - 1] = inside[-1] = False
        self.s[inside] = number
        self.of = np.repeat(np.arange(len(lengths) + 1, dtype=np.int32), np.append(lengths + 1, 1))
        at = np.flatnonzero((self.s[:-1] >= 0) & (self.s[1:] >= 0)).astype(np.int32)
        keys = self.s[at].astype(np.int64) * self.cap + self.s[at + 1]
        by = np.argsort(keys, kind="stable")
        self.first = keys[by], at[by]

    def units(self, counts: np.ndarray) -> list[str]:
        s, cap, names, vocabulary = self.s.copy(), self.cap, list(self.names), self.vocabulary
        weight = np.append(counts, 0).astype(np.int64)[self.of]
        after = np.arange(1, len(s) + 1, dtype=np.int32)
        before = np.arange(-1, len(s) - 1, dtype=np.int32)
        pairs = np.zeros(cap * cap, np.int64)
        np.add.at(pairs, self.first[0], weight[self.first[1]])
        here = np.zeros(len(names), np.int64)
        np.add.at(here, s[s >= 0], weight[s >= 0])
        units = [u for u, n in zip(names, here.tolist()) if n > 0]
        number, lists = {u: i for i, u in enumerate(names)}, defaultdict(list)

        def standing(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places where a pair stands, once each, and the pairs."""
            heads = np.unique(heads)
            heads = heads[s[heads] >= 0]
            heads = heads[s[after[heads]] >= 0]
            return heads, s[heads].astype(np.int64) * cap + s[after[heads]]

        while len(units) < vocabulary:
            most = pairs.max(initial=0)
            if most <= 0:
                break
            x, y = min((divmod(k, cap) for k in np.flatnonzero(pairs == most).tolist()), key=lambda p: (names[p[0]], names[p[1]]))
            k, found = x * cap + y, []
            for keys, places in [self.first, *lists[x], *(lists[y] if y != x else [])]:
                lo, hi = np.searchsorted(keys, [k, k + 1])
                found.append(places[lo:hi])
            at = np.unique(np.concatenate(found))
            at = at[s[at] == x]
            at = at[s[after[at]] == y]
            if x == y:  # from the left, every other of a run
                start = np.concatenate([[True], after[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            second = after[at]
            heads, keys = standing(np.concatenate([before[at], at, second]))
            np.subtract.at(pairs, keys, weight[heads])
            joined = names[x] + names[y]
            if joined not in number:
                number[joined] = len(names)
                names.append(joined)
                units.append(joined)
            s[at], s[second] = number[joined], -2
            after[at] = after[second]
            before[after[at]] = at
            heads, keys = standing(np.concatenate([before[at], at]))
            np.add.at(pairs, keys, weight[heads])
            by = np.argsort(keys, kind="stable")
            lists[number[joined]].append((keys[by], heads[by]))
        return units


def _texts(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as code points one after another, and the length of each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def _store_types(types: DataFrame) -> str | None:
    """Write a table ``grp, word, c`` that :func:`session.cut` gave as numbers, in one task that holds distinct words; where they stand."""
    written = types.inputFiles()
    if not written:
        return None
    path = written[0].rsplit("/", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(kind: int, *parts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *(pa.array([p.astype(np.int32).tobytes()], pa.binary()) for p in parts)], ["kind", "a", "b", "c"])

        for _ in batches:
            fs, place = pa.fs.FileSystem.from_uri(path)
            number: tuple[dict, dict] = {}, {}
            for batch in pads.dataset(place, filesystem=fs, format="parquet").to_batches(columns=["grp", "word", "c"], batch_size=1 << 18):
                own = []
                for known, name in zip(number, ("grp", "word")):
                    coded = batch.column(name).dictionary_encode()
                    at = np.array([known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()], np.int32)
                    none = np.int32(-1)  # a group without a name is never drawn
                    own.append(np.append(at, none)[pc.fill_null(coded.indices, len(at)).to_numpy(zero_copy_only=False)])
                yield row(0, *own, batch.column("c").to_numpy())
            for kind, known in enumerate(number, 1):
                yield row(kind, *_texts(list(known)), np.zeros(0))

    return cut(types.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "kind int, a binary, b binary, c binary")).inputFiles()[0].rsplit("/", 1)[0]


def _sampled_units(times: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """``iter, unit`` of samples ``iter, grp, m`` of stored types, some samples a task: the counts are summed in one pass for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [r for b in batches for r in b.to_pylist()]
        if not samples:
            return
        fs, place = pa.fs.FileSystem.from_uri(path)
        data = pads.dataset(place, filesystem=fs, format="parquet")
        read = lambda value, kind=np.int32: np.frombuffer(value.as_py(), kind)
        texts = {r["kind"].as_py(): (read(r["a"], np.uint32), read(r["b"]).astype(np.int64)) for r in (dict(zip(t.column_names, (c[0] for c in t.columns))) for t in (data.to_table(filter=pc.field("kind") == k) for k in (1, 2)))}
        codes, ends = texts[1][0], np.cumsum(texts[1][1]).tolist()
        text = codes.tobytes().decode("utf-32-le")
        number = {text[a:b]: i for i, (a, b) in enumerate(zip([0, *ends], ends))}
        drawn = np.zeros((len(samples), len(number) + 1), np.int64)  # the last is no group
        for own, r in zip(drawn, samples):
            for g, m in zip(r["g"], r["m"]):
                if g in number:
                    own[number[g]] = m
        size = len(texts[2][1])
        counts = np.zeros((len(samples), size), np.int64)
        for batch in data.to_batches(columns=["a", "b", "c"], filter=pc.field("kind") == 0, batch_size=1):
            for a, b, c in zip(*batch.columns):
                g, w, c = read(a), read(b), read(c)
                for own, m in zip(counts, drawn):
                    own += np.bincount(w, c * m[g], size).astype(np.int64)
        stock = Stock(*texts[2], vocabulary)
        for own, r in zip(counts, samples):
            if own.sum() >= LEAST_WORDS:
                units = stock.units(own)
                yield pa.RecordBatch.from_arrays([pa.array([r["iter"]] * len(units), pa.int32()), pa.array(units, pa.string())], ["iter", "unit"])

    rows = times.where("grp is not null").groupBy("iter").agg(F.collect_list("grp").alias("g"), F.collect_list("m").alias("m"))
    return rows.repartition(24).mapInArrow(run, "iter int, unit string")


def _merge_table(types: DataFrame, vocabulary: int) -> list[str]:
    """The units of a vocabulary that stays distributed: one aggregation per merge."""
    rows = cut(types.select("c", F.filter(F.split("word", ""), lambda x: x != "").alias("s")))
    units = sorted(r["u"] for r in rows.select(F.explode("s").alias("u")).distinct().collect())
    known, k = set(units), 0
    while len(units) < vocabulary:
        pairs = rows.where("size(s) > 1").select("c", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(s[i - 1] as a, s[i] as b))")).alias("p"))
        top = pairs.groupBy("p.a", "p.b").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if top is None:
            break
        a, b = F.lit(top["a"]), F.lit(top["b"])
        step = lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == a) & (x == b), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(a, b)))).otherwise(F.concat(acc, F.array(x)))  # noqa: B023, E731
        rows = rows.withColumn("s", F.aggregate("s", F.array().cast("array<string>"), step))
        k += 1
        if k % 10 == 0:
            rows = cut(rows)
        if top["a"] + top["b"] not in known:
            known.add(top["a"] + top["b"])
            units.append(top["a"] + top["b"])
    return units


def unit_inventory(types: DataFrame, by: Sequence[str] = (), vocabulary: int = VOCABULARY, local: int = LOCAL) -> DataFrame:
    """``[*by,] rank, unit``: at most ``vocabulary`` units (more only if there are more characters)."""
    spark = types.sparkSession
    if not by:
        types = cut(types)  # counted, then merged
    if not by and types.count() > local:
        return spark.createDataFrame(list(enumerate(_merge_table(types, vocabulary))), "rank int, unit string")

    if not by:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            halves = [(b.column(0).to_pylist(), b.column(1).to_numpy()) for b in batches]
            units = merges_of_many((w for w, _ in halves), (c for _, c in halves), vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(units)), pa.int32()), pa.array(units, pa.string())], ["rank", "unit"])

        return types.select("word", "c").repartition(1).mapInArrow(whole, "rank int, unit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = batch.column("w")[i].as_py(), batch.column("c")[i].as_py()
                units = merges_of_many([words], [counts], vocabulary) if len(words) > MANY else merges(dict(zip(words, counts)), vocabulary)[0]
                at = pa.array(np.full(len(units), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in by), pa.array(range(len(units)), pa.int32()), pa.array(units, pa.string())], [*by, "rank", "unit"])

    # One row a group: groups are many and mostly small, and a call of Python for each would cost more than its merges.
    listed = types.groupBy(*by).agg(F.collect_list("word").alias("w"), F.collect_list("c").alias("c"))
    keys = "".join(f"{c} {types.schema[c].dataType.simpleString()}, " for c in by)
    return listed.mapInArrow(run, keys + "rank int, unit string")


def merge_list(types: DataFrame, vocabulary: int = VOCABULARY) -> list[tuple[str, str]]:
    """The merges of a vocabulary in order, for :func:`encode_words`: at most ``vocabulary`` pairs, made in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, made = merges(dict(zip(pdf["word"], pdf["c"].tolist())), vocabulary)
        return pd.DataFrame({"rank": range(len(made)), "a": [x for x, _ in made], "b": [x for _, x in made]})

    rows = types.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "rank int, a string, b string").orderBy("rank").collect()
    return [(r["a"], r["b"]) for r in rows]


def encode_words(words_df: DataFrame, made: list[tuple[str, str]]) -> DataFrame:
    """``word, units`` of each distinct word under a list of merges (a vocabulary's worth)."""

    @F.pandas_udf("array<string>")
    def units(s: pd.Series) -> pd.Series:
        def one(w: str) -> list[str]:
            out = list(w)
            for p in made:
                if len(out) < 2:
                    break
                out = merge_once(out, p)
            return out

        return s.map(one)

    return words_df.select("word").where("word is not null").distinct().select("word", units("word").alias("units"))


def jaccard(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[*by,] n_units, jaccard`` of inventories ``[*by,] unit`` against one ``unit``; 0 for two empty ones."""
    ref = b.select("unit").distinct().withColumn("_in", F.lit(1))
    size = ref.agg(F.count("*").alias("_n"))
    own = a.select(*by, "unit").distinct().join(ref, "unit", "left").groupBy(*by).agg(F.count("*").alias("n_units"), F.coalesce(F.sum("_in"), F.lit(0)).alias("_both"))
    return own.crossJoin(size).select(*by, "n_units", F.coalesce(F.try_divide("_both", F.col("n_units") + F.col("_n") - F.col("_both")), F.lit(0.0)).alias("jaccard"))  # a single row


def group_inventories(lines: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``grp, rank, unit`` of each group with at least LEAST_WORDS words."""
    types = word_bag(lines).where("word <> ''").groupBy("grp", "word").agg(F.count("*").alias("c"))
    big = types.groupBy("grp").agg(F.sum("c").alias("n")).where(F.col("n") >= LEAST_WORDS).select("grp")
    return unit_inventory(types.join(big, "grp"), ["grp"], vocabulary)


def group_coverage(lines: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``grp, n_units, jaccard`` of each group's units against those of the whole corpus."""
    return jaccard(group_inventories(lines, vocabulary), unit_inventory(word_types(lines), (), vocabulary), ["grp"])


def unit_presence(lines: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row ``n_groups, in_all, in_80pct, in_50pct, groups_above_half``: units of the corpus by how many groups' inventories have them."""
    groups, ref = cut(group_inventories(lines, vocabulary)), cut(unit_inventory(word_types(lines), (), vocabulary))
    n = groups.select("grp").distinct().agg(F.count("*").alias("n_groups"))
    per = ref.select("unit").join(groups.select("grp", "unit").distinct(), "unit", "left").groupBy("unit").agg(F.count("grp").alias("k"))
    rows = per.crossJoin(n)  # a single row
    sums = rows.groupBy().agg(F.max("n_groups").alias("n_groups"), F.count_if(F.expr("k = n_groups")).alias("in_all"), F.count_if(F.expr("k >= 0.8 * n_groups")).alias("in_80pct"), F.count_if(F.expr("k >= 0.5 * n_groups")).alias("in_50pct"))
    above = jaccard(groups, ref, ["grp"]).agg(F.count_if(F.col("jaccard") >= 0.5).alias("groups_above_half"))
    return sums.crossJoin(above)


def bootstrap_stability(lines: DataFrame, iterations: int = 100, vocabulary: int = VOCABULARY, seed: int = 42) -> DataFrame:
    """One row ``mean_jaccard, sd, ci_low, ci_high, iterations`` over bootstrap samples of groups.

    A sample is the groups' word counts times how often each was drawn, summed in the tasks from
    written numbers, so no sample is exchanged. Samples under LEAST_WORDS words are left out; the deviation is the sample
    one (0 for one sample). Under two groups there is no row.
    """
    types = cut(word_bag(lines).where("word <> ''").groupBy("grp", "word").agg(F.count("*").alias("c")))
    times = bootstrap_draws(lines, iterations, seed).groupBy("iter", "grp").agg(F.count("*").cast("int").alias("m"))
    path = _store_types(types)
    made = cut(_sampled_units(times, path, vocabulary)) if path else lines.sparkSession.createDataFrame([], "iter int, unit string")
    j = jaccard(made, unit_inventory(types.groupBy("word").agg(F.sum("c").alias("c")), (), vocabulary), ["iter"])
    out = j.groupBy().agg(F.avg("jaccard").alias("mean_jaccard"), F.coalesce(F.stddev_samp("jaccard"), F.lit(0.0)).alias("sd"), F.count("*").alias("iterations"))
    margin = 1.96 * F.col("sd") / F.sqrt("iterations")
    enough = lines.groupBy().agg(F.countDistinct("grp").alias("_g")).where("_g >= 2")
    out = out.crossJoin(enough).where("iterations > 0")  # single rows
    return out.select("mean_jaccard", "sd", F.greatest(F.lit(0.0), F.col("mean_jaccard") - margin).alias("ci_low"), F.least(F.lit(1.0), F.col("mean_jaccard") + margin).alias("ci_high"), "iterations")


def gate(units_in_groups: int) -> str:
    """Pass from 50 units that stand in at least 80 % of the groups, partial from 10, else fail."""
    return "pass" if units_in_groups >= 50 else "partial" if units_in_groups >= 10 else "fail"


def unit_alignment() -> dict:
    """Units cannot be aligned without coordinates of words on the page."""
    return {"status": "unavailable", "reason": "no coordinates"}


def unit_discovery(lines: DataFrame, iterations: int = 100, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row with unit counts, stability and the gate."""
    presence, stability = unit_presence(lines, vocabulary), bootstrap_stability(lines, iterations, vocabulary)
    out = presence.join(stability, F.lit(True), "left")  # single rows
    status = F.when(F.col("in_80pct") >= 50, "pass").when(F.col("in_80pct") >= 10, "partial").otherwise("fail")
    return out.withColumn("status", status)
