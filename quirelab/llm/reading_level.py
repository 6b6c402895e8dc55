"""Reading level of documents: boosted trees over distributions of text features.

Only running prose counts: quoted manuscript words, quoted lines, remarks in brackets, headings
and lines of dotted words are taken out first. Features describe the distributions, over the
sentences of a document, of length, vocabulary, syntax and cohesion. What is common, grammatical or
joins clauses is learned from the training texts (:class:`Vocabulary`), not listed. Labels are
combined per document, a model is trained on a sample of bounded size, predictions are
cross-validated with whole sources held out, and calibrated; the report calibrates each fold by
the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.functions.keys import plain_key
from quirelab.llm.textvec import Words, chunks, words_of
from quirelab.llm.trees import Boosted, isotonic
from quirelab.session import cut

#: Labelled documents used for training, at most; beyond that a hash sample. A documented bound.
MAX_TRAIN = 15_000
#: Sentences with fewer words are fragments or headings and carry no statistics.
SHORTEST = 3
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Words of the vocabulary, those in most training texts; the most frequent of them count as
#: grammatical, and of a wider circle those that often follow a comma as joining clauses.
VOCABULARY, GRAMMATICAL, CONNECTING = 20_000, 100, 600
#: Share of a word's places that follow a comma or the like, from which on it joins clauses.
AFTER_MARK = 0.2


def is_english(lang: Column) -> Column:
    """Whether a language field says English, in any spelling; null does not."""
    return F.coalesce(plain_key(lang).rlike(r"^(en|eng|english|anglais|englisch)([-_].*)?$"), F.lit(False))


def running_prose(text: Column) -> Column:
    """The running prose of a text: what is not layout, quotation, remark or heading.

    Taken out: lines that start with ``>`` or ``|``, lines of dotted words, lines without an end
    mark and with fewer than six words (headings), what stands in brackets, single quoted or
    underscored words, entities and marks of lists. What is quoted at more than 80 characters is
    text that is read as such, and stays. A line break before a capital ends a sentence.
    """
    t = F.regexp_replace(text, "﻿|&[a-z]+;", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*+[>|][^\n]*+$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*+[\p{L}*]++(?:[.,][\p{L}*]++)++[ \t]*+$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*+(?:[^\s.!?;]++[ \t]*+){1,5}$", "")
    t = F.regexp_replace(t, r"\([^()\n]*+\)|\[[^\[\]\n]*+\]|\{[^{}\n]*+\}|<[^<>\n]*+>", " ")
    t = F.regexp_replace(t, "\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|(?<![\\p{L}])'[^'\n]{1,80}'(?![\\p{L}])|_[^_\n]{1,80}_", " ")
    return F.regexp_replace(t, r"[ \t]*+\n[ \t]*+(?=\p{Lu})", " .\n")


def _names() -> list[str]:
    per = ["words", "letters", "long8", "long11", "vowels", "common", "rare", "grammar", "joins", "clauses", "clause", "overlap"]
    dist = [f"{p}_{s}" for p in per for s in ("mean", *(f"q{int(q * 100)}" for q in QUANTILES))]
    return dist + ["n_sentences", "n_words", "types", "letters_all", "letters_sd", "long_all", "commas"]


FEATURES = _names()
_COMMA = np.frombuffer(",;:()–—".encode("utf-32-le"), np.uint32)


def _after_mark(w: Words) -> np.ndarray:
    """Whether a comma or the like stands between a word and the one before it."""
    marks = np.zeros(len(w.points) + 1, np.int32)
    np.cumsum(np.isin(w.points, _COMMA), out=marks[1:])
    out = np.zeros(len(w.start), bool)
    out[1:] = (marks[w.start[1:]] > marks[w.end[:-1]]) & (w.text[1:] == w.text[:-1])
    return out


@dataclass
class Vocabulary:
    """Words by hash (sorted), with how common each is (0 to 1), whether it is grammatical, and whether it joins clauses."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grammar: np.ndarray = field(default_factory=lambda: np.zeros(0))
    joins: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``common, grammar, joins`` of each word; unknown words have zeros."""
        if not len(self.words):
            return np.zeros(len(hashes)), np.zeros(len(hashes)), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        return self.common[at] * known, self.grammar[at] * known, self.joins[at] * known

    @staticmethod
    def learn(prose: DataFrame) -> Vocabulary:
        """From a table ``prose`` of training texts: the VOCABULARY words in most of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(0).to_pylist()]
                for a, b in chunks(texts):
                    w = words_of(texts[a:b])
                    keep = ~w.number
                    words, of = np.unique(w.hash[keep], return_inverse=True)
                    after = np.bincount(of, _after_mark(w)[keep], len(words)).astype(np.int64)
                    pairs = np.unique(np.stack([w.text[keep], of]), axis=1)
                    texts_with = np.bincount(pairs[1], minlength=len(words))
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(of, minlength=len(words))), pa.array(after), pa.array(texts_with)], ["h", "n", "after", "texts"])

        counts = prose.mapInArrow(run, "h long, n long, after long, texts long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("after").alias("after"), F.sum("texts").alias("texts"))
        top = counts.orderBy(F.desc("texts"), F.desc("n"), "h").limit(VOCABULARY).collect()
        if not top:
            return Vocabulary()
        h, n, after, texts = (np.array(c) for c in zip(*((r["h"], r["n"], r["after"], r["texts"]) for r in top)))
        words, rank = h.astype(np.int64).view(np.uint64), np.arange(len(h))
        common = np.log1p(texts) / np.log1p(texts.max())
        order = np.argsort(words)
        joins = (rank < CONNECTING) & (after >= AFTER_MARK * n)
        return Vocabulary(words[order], common[order], (rank < GRAMMATICAL)[order].astype(float), joins[order].astype(float))


def features(texts: list[str], vocabulary: Vocabulary | None = None) -> np.ndarray:
    """One row of FEATURES for each text of prose; texts without sentences have zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in chunks(texts):
        out[a:b] = _features(texts[a:b], vocabulary or Vocabulary())
    return out


def _features(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    n = len(texts)
    w = words_of(texts)
    keep = ~w.number
    start, end, text, hashes = w.start[keep], w.end[keep], w.text[keep], w.hash[keep]
    if not len(start):
        return np.zeros((n, len(FEATURES)))
    # An end mark before white space, or an empty line, ends a sentence.
    p = w.points
    mark = np.zeros(len(p) + 1, np.int32)
    following = np.append(p[1:], 10)
    ends = (((p == 46) | (p == 33) | (p == 63) | (p == 59)) & ((following == 32) | (following == 10) | (following == 9))) | ((p == 10) & (following == 10))
    np.cumsum(ends, out=mark[1:])
    sentence = mark[start]
    new = np.ones(len(start), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sid = np.cumsum(new) - 1
    length = (end - start).astype(float)
    size = np.bincount(sid).astype(float)
    # Vowel groups stand for syllables.
    vowel = np.isin(p, np.frombuffer("aeiouyäöüàâéèêëîïôûù".encode("utf-32-le"), np.uint32))
    groups = np.zeros(len(p) + 1, np.int32)
    np.cumsum(vowel & ~np.concatenate([[False], vowel[:-1]]), out=groups[1:])
    syllables = (groups[end] - groups[start]).astype(float)
    common, grammar, joins = vocabulary.look_up(hashes)
    # Stretches between commas and the like stand for clauses.
    part = np.bincount(sid, _after_mark(w)[keep] & ~new) + 1.0
    # Cohesion: words of a sentence, function words apart, that the document has had before.
    order = np.lexsort((np.arange(len(hashes)), hashes, text))
    seen = np.zeros(len(hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    seen[order[1:][same]] = 1
    content = 1 - grammar
    mean = lambda v: np.bincount(sid, v) / size
    per = {
        "words": size, "letters": mean(length), "long8": mean(length >= 8), "long11": mean(length >= 11), "vowels": mean(syllables),
        "common": mean(common), "rare": mean(common == 0), "grammar": mean(grammar), "joins": np.bincount(sid, joins), "clauses": part, "clause": size / part,
        "overlap": np.bincount(sid, seen * content) / np.maximum(np.bincount(sid, content), 1),
    }
    of = text[first]
    full = size >= SHORTEST
    out = np.zeros((n, len(FEATURES)))
    count = np.bincount(of[full], minlength=n)
    has = count > 0
    begin = np.cumsum(count) - count
    col = 0
    for v in per.values():
        v, o = v[full], of[full]
        out[:, col] = np.bincount(o, v, n) / np.maximum(count, 1)
        ranked = v[np.lexsort((v, o))]
        for k, q in enumerate(QUANTILES):
            at = begin + np.floor(q * np.maximum(count - 1, 0) + 0.5).astype(int)
            out[has, col + 1 + k] = ranked[at[has]]
        col += 1 + len(QUANTILES)
    words = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(words, 1)
    average = np.bincount(text, length, n) / some
    commas = np.zeros(len(p) + 1, np.int32)
    np.cumsum(p == 44, out=commas[1:])
    low, high = np.full(n, 0), np.full(n, 0)
    low[text[::-1]], high[text] = start[::-1], end
    types = np.bincount(text, 1 - seen, n)
    out[:, col:] = np.stack([count, words, types / some, average, np.sqrt(np.maximum(np.bincount(text, length**2, n) / some - average**2, 0)), np.bincount(text, length >= 9, n) / some, (commas[high] - commas[low]) / some], 1)
    return out


@dataclass
class LevelModel:
    """A trained model, its calibration, and how it did on held-out sources."""

    trees: Boosted
    knots: np.ndarray
    levels: np.ndarray
    report: list[tuple[str, int, float, float, float]]  # source, documents, error, bias, agreement at the threshold
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    threshold: float = 3.5

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated level, from 1 to 5."""
        return np.interp(self.trees.predict(x), self.knots, self.levels)


def combined_labels(labels: DataFrame) -> DataFrame:
    """One level per document: ``doc_id, level, raters``; the median over raters, repeated rows once.

    A rater with several levels for a document counts with their mean. Nulls are no opinion.
    """
    rows = labels.where("doc_id is not null and reading_level between 1 and 5").groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("v"))
    return rows.groupBy("doc_id").agg(F.median("v").alias("level"), F.count("*").alias("raters"))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = 5, threshold: float = 3.5) -> LevelModel:
    """Train on labelled English documents, at most about ``max_train`` of them (a hash sample).

    Folds hold out whole sources; their predictions give the calibration (isotonic) and the
    report per source. The vocabulary is learned from the training texts, without their labels. Without any usable label every document gets level 0.
    """
    level = combined_labels(labels)
    n = level.count()
    if n > max_train:
        level = level.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # The sample is bounded, so it may go to every task; the corpus is then not shuffled.
    docs = documents.where(is_english(F.col("lang"))).select("doc_id", "text", plain_key(F.col("source")).alias("source"))
    rows = cut(docs.join(F.broadcast(level), "doc_id").select("doc_id", "source", "level", "raters", running_prose(F.col("text")).alias("prose")))
    vocabulary = Vocabulary.learn(rows.select("prose"))
    schema = "doc_id long, source string, level double, raters long, x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t or "" for t in b.column(4).to_pylist()], vocabulary)
            ok = x[:, FEATURES.index("n_sentences")] > 0
            keep = pa.array(ok)
            flat = pa.array(x[ok].astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(ok.sum() + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(keep) for i in range(4)), lists], ["doc_id", "source", "level", "raters", "x"])

    got = rows.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return LevelModel(Boosted(), np.array([0.0]), np.array([0.0]), [], vocabulary, threshold)
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1).astype(float)
    y, w = got["level"].to_numpy(), got["raters"].to_numpy().astype(float)
    sources = np.array([s or "" for s in got["source"].to_pylist()])
    # Whole sources to folds, the largest first, each to the emptiest fold.
    names, counts = np.unique(sources, return_counts=True)
    load, fold_of = np.zeros(folds), {}
    for i in np.argsort(-counts, kind="stable"):
        fold_of[names[i]] = int(load.argmin())
        load[fold_of[names[i]]] += counts[i]
    fold = np.array([fold_of[s] for s in sources])
    held = np.full(len(y), np.nan)
    for k in range(folds):
        if (fold != k).any() and (fold == k).any():
            held[fold == k] = Boosted().fit(x[fold != k], y[fold != k], w[fold != k]).predict(x[fold == k])
    tree = Boosted().fit(x, y, w)
    held = np.where(np.isnan(held), tree.predict(x), held)
    knots, levels = isotonic(held, y, w)
    # The report calibrates each fold by what the others gave, so that no label judges itself.
    calibrated = np.interp(held, knots, levels)
    for k in range(folds):
        if (fold != k).any() and (fold == k).any():
            calibrated[fold == k] = np.interp(held[fold == k], *isotonic(held[fold != k], y[fold != k], w[fold != k]))
    report = []
    for s in names:
        m = sources == s
        e = calibrated[m] - y[m]
        report.append((str(s), int(m.sum()), float(np.abs(e).mean()), float(e.mean()), float(((calibrated[m] >= threshold) == (y[m] >= threshold)).mean())))
    return LevelModel(tree, knots, levels, report, vocabulary, threshold)


def reading_levels(documents: DataFrame, model: LevelModel, least_words: int = 10) -> DataFrame:
    """Level of each English document with at least ``least_words`` words: ``doc_id, source, level, n_words, sentences``.

    Documents in other languages or without one, with fewer words, or without running prose are
    left out. Texts are taken whole; nothing is shuffled.
    """
    docs = documents.where(is_english(F.col("lang")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # Words of the whole text, counted only as far as the test needs.
    enough = F.col("text").rlike(r"^(?:[^\p{L}\p{Nd}]*+[\p{L}\p{Nd}]++){%d}" % least_words)
    rows = docs.where(enough).select("doc_id", plain_key(F.col("source")).alias("source"), running_prose(F.col("text")).alias("prose"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t or "" for t in b.column(2).to_pylist()], model.vocabulary)
            n = x[:, FEATURES.index("n_sentences")].astype(np.int64)
            keep = pa.array(n > 0)
            cols = [b.column(0), b.column(1), pa.array(model.predict(x.astype(np.float32).astype(float))), pa.array(x[:, FEATURES.index("n_words")].astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["doc_id", "source", "level", "n_words", "sentences"])

    return rows.mapInArrow(run, "doc_id long, source string, level double, n_words long, sentences long")
