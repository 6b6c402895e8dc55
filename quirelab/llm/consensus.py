"""Consensus of several annotators by minimax conditional entropy.

Annotator i gives item j the label x. With tilting parameters of annotators and items,
P(x | true label c) is proportional to exp(sigma_i(c, x) + tau_j(c, x)); the parameters maximise the
regularised dual by coordinate ascent (Newton steps), alternating with the posteriors of the true
labels. There are two forms:

* :func:`class_consensus`, for items that share one set of labels: a full matrix of tilts per
  annotator and item, so an annotator may be good at one class and bad at another, or give the
  same answer to everything.
* :func:`consensus`, for open texts. Each item has its own labels, so a matrix over them means
  nothing for another item; the tilts are tied to one number per annotator and item,
  (s_i + t_j) [x is the true label], with as many alternatives as there are annotators (at least 2).

Given the annotators' tilts, an item's tilts and posterior follow from its own labels alone, and
items labelled in the same way are equal. So the fit runs over distinct patterns of labels with
their counts: items are counted once, and a round is one sum over patterns. These are a table;
up to ``ON_DRIVER`` patterns are summed on the driver, more in one Spark job a round, with the same
arithmetic. The counts cover every item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelab.session import cut

#: So many patterns of labels are summed up on the driver; this changes where, not what.
ON_DRIVER = 50_000
#: Steps in which an item's tilts and posterior settle for given tilts of the annotators.
INNER = 12


@dataclass
class Fit:
    """The result: annotators' tilts and reliability, agreement of pairs, and how to get posteriors."""

    annotators: list[str]
    tilt: np.ndarray
    reliability: np.ndarray
    agreement: float
    iterations: int
    options: dict = field(default_factory=dict)

    def order(self) -> list[str]:
        """Annotators, the most reliable first; ties by name."""
        return [a for _, _, a in sorted((-t, i, a) for i, (t, a) in enumerate(zip(self.tilt, self.annotators)))]

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """For each pattern, the probability of each annotator's label class (classes are named by their first annotator)."""
        return _tied(_parse(patterns, len(self.annotators)), self.tilt, self.options.get("beta", 1.0))[0]


def label_pattern(labels: list[Column]) -> Column:
    """Which annotators gave the same label, as text: for each, the place of the first that did, or '-'."""
    first = [F.coalesce(*(F.when(labels[j] == labels[i], F.lit(str(j))) for j in range(i + 1)), F.lit("-")) for i in range(len(labels))]
    return F.concat_ws(",", *first)


def _parse(patterns: list[str], m: int) -> np.ndarray:
    return np.array([[(-1 if x == "-" else int(x)) for x in p.split(",")] for p in patterns], int).reshape(len(patterns), m)


def _tied(labels: np.ndarray, s: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior, expected agreement with the truth and its model, for patterns under given tilts."""
    there, m = labels >= 0, len(s)
    k = max(m, 2)
    gave = np.stack([labels == c for c in range(m)], 2) if len(labels) else np.zeros((0, m, m), bool)
    exists = gave.any(1)
    q = gave.sum(1) / np.maximum(there.sum(1, keepdims=True), 1)
    t = np.zeros(len(labels))
    for _ in range(INNER):
        agree = np.einsum("pic,pc->pi", gave, q)  # expected agreement with the true label
        p = 1 / (1 + (k - 1) * np.exp(-(s[None] + t[:, None])))
        t += np.clip(((there * (agree - p)).sum(1) - beta * t) / ((there * p * (1 - p)).sum(1) + beta), -2, 2)
        score = np.where(exists, np.einsum("pic,pi->pc", gave, s[None] + t[:, None]), -np.inf)
        q = np.exp(score - score.max(1, keepdims=True, initial=-1e300))
        q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    p = 1 / (1 + (k - 1) * np.exp(-(s[None] + t[:, None])))
    return q, np.einsum("pic,pc->pi", gave, q), p


def _tied_sums(labels: np.ndarray, n: np.ndarray, s: np.ndarray, beta: float) -> np.ndarray:
    """For each annotator: labels that the truth agrees with beyond the model, curvature, agreement, labels."""
    _, agree, p = _tied(labels, s, beta)
    w = n[:, None] * (labels >= 0)
    return np.stack([(w * (agree - p)).sum(0), (w * p * (1 - p)).sum(0), (w * agree).sum(0), w.sum(0)])


def _ascend(sums: Callable[[np.ndarray], np.ndarray], start: np.ndarray, total: float, alpha: float, rounds: int, tol: float) -> tuple[np.ndarray, int]:
    """Newton steps of the annotators' tilts; ``sums`` gives gradient and curvature over all patterns."""
    s, steps = start, 0
    for steps in range(1, rounds + 1):
        g, h = sums(s)[:2]
        step = np.clip((g / total - alpha * s) / (h / total + alpha), -1, 1)
        s = s + step
        if np.abs(step).max(initial=0) < tol:
            break
    return s, steps


def fit_patterns(counts: dict[str, int] | DataFrame, annotators: list[str], alpha: float = 0.01, beta: float = 1.0, rounds: int = 200, tol: float = 1e-7) -> Fit:
    """Fit the tied model to ``pattern -> number of items``, a dict or a table ``pattern, count``.

    ``alpha``, ``beta``: regularisation of annotators and items. Items with fewer than two labels say nothing.
    """
    m = len(annotators)
    if isinstance(counts, dict):
        names = list(counts)
        labels, n = _parse(names, m), np.array(list(counts.values()), float)
        labels, n = labels[(labels >= 0).sum(1) >= 2], n[(labels >= 0).sum(1) >= 2]
        over = lambda f, width: f(labels, n)
    else:
        table = cut(counts)

        def over(f, width):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    x = _parse(b["pattern"].tolist(), m)
                    ok = (x >= 0).sum(1) >= 2
                    yield pd.DataFrame({"at": np.arange(width), "v": f(x[ok], b["count"].to_numpy(float)[ok]).ravel()})

            rows = table.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
            return np.array([r["v"] for r in rows] or np.zeros(width))

    pairs = over(lambda x, w: _pair_sums(x, w), 3)
    total = max(pairs[2], 1.0)
    sums = lambda s: np.reshape(over(lambda x, w: _tied_sums(x, w, s, beta), 4 * m), (4, m))
    s, steps = _ascend(sums, np.ones(m), total, alpha, rounds, tol)
    end = sums(s)
    agreement = float(pairs[0] / pairs[1]) if pairs[1] else float("nan")
    return Fit(annotators, s, end[2] / np.maximum(end[3], 1e-12), agreement, steps, {"beta": beta})


def _pair_sums(labels: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairs of annotators that agree, pairs, and items."""
    m = labels.shape[1]
    same = np.zeros(len(labels))
    for c in range(m):
        v = (labels == c).sum(1)
        same += v * (v - 1) / 2
    given = (labels >= 0).sum(1)
    return np.array([(n * same).sum(), (n * given * (given - 1) / 2).sum(), n.sum()])


def consensus(items: DataFrame, item: str, labels: dict[str, Column], **fit_options) -> tuple[DataFrame, Fit]:
    """Consensus, agreement and reliability for items with one column per annotator.

    ``labels`` maps an annotator to a text column; null is no label. Returns a table ``item,
    pattern, n_labels, n_classes, consensus, posterior, likeliest, agreement`` and the fit.
    ``consensus`` is the label most annotators gave; of equally frequent ones, that of the most
    reliable annotator by the fit. ``likeliest`` is the label the model finds most probable,
    ``posterior`` its probability of the consensus, ``agreement`` the share of pairs of annotators
    who agree on the item (null with fewer than two labels). Items need one row each; items without
    labels come out with nulls. Any number of annotators will do.
    """
    if not labels:
        raise ValueError("no annotators")
    names, m = list(labels), len(labels)
    rows = items.select(F.col(item).alias("item"), *(c.alias(f"_{i}") for i, c in enumerate(labels.values())))
    cols = [F.col(f"_{i}") for i in range(m)]
    rows = rows.withColumn("pattern", label_pattern(cols))
    counts = rows.groupBy("pattern").count()
    few = counts.limit(ON_DRIVER + 1).collect()
    small = len(few) <= ON_DRIVER
    fit = fit_patterns({r["pattern"]: r["count"] for r in sorted(few)} if small else counts, names, **fit_options)
    rank = np.argsort([names.index(a) for a in fit.order()])

    def choose(patterns: list[str]) -> pd.DataFrame:
        x, q = _parse(patterns, m), fit.posterior(patterns)
        votes = np.stack([(x == c).sum(1) for c in range(m)], 1) if len(x) else np.zeros((0, m), int)
        given = votes.sum(1)
        # Of the labels given most often, that of the annotator who comes first in the order of the fit.
        tops = (votes == votes.max(1, keepdims=True, initial=0)) & (votes > 0)
        best = np.full((len(x), m), m)
        for i in range(m):
            has = x[:, i] >= 0
            best[has, x[has, i]] = np.minimum(best[has, x[has, i]], rank[i])
        pick = np.where(tops, best, m + 1).argmin(1)
        agree = (votes * (votes - 1)).sum(1) / np.maximum(given * (given - 1), 1)
        some = given > 0
        p = np.where(given > 1, q[np.arange(len(x)), pick], 1.0)
        out = pd.DataFrame({"pattern": patterns, "pick": pick, "top": q.argmax(1), "n_labels": given, "n_classes": (votes > 0).sum(1), "posterior": p, "agreement": np.where(given > 1, agree, np.nan)})
        out["agreement"] = out["agreement"].astype("Float64").where(given > 1, pd.NA)
        return out[some]

    schema = "pattern string, pick int, top int, n_labels int, n_classes int, posterior double, agreement double"
    if small:
        table = choose([r["pattern"] for r in few])
        # At most ON_DRIVER rows.
        table = F.broadcast(items.sparkSession.createDataFrame([tuple(None if v is pd.NA else v for v in r) for r in table.astype(object).itertuples(index=False)], schema))
    else:
        table = counts.select("pattern").mapInPandas(lambda bs: (choose(b["pattern"].tolist()) for b in bs), schema)
    out = rows.join(table, "pattern", "left")
    label, likeliest = (F.coalesce(*(F.when(F.col(by) == i, c) for i, c in enumerate(cols))) for by in ("pick", "top"))
    return out.select("item", "pattern", "n_labels", "n_classes", label.alias("consensus"), "posterior", likeliest.alias("likeliest"), "agreement"), fit


def alpha(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Krippendorff's alpha for nominal labels: one row ``items, labels, observed, expected, alpha``.

    ``votes``: one row per item and label given. Items with a single label, and null labels, do
    not count. ``observed`` and ``expected`` are shares of pairs that disagree; alpha is null
    without two labels of any item, or if all labels are the same.
    """
    rows = votes.where(F.col(item).isNotNull() & F.col(label).isNotNull()).select(F.xxhash64(item).alias("i"), F.xxhash64(label).alias("l"))
    within = rows.groupBy("i", "l").agg(F.count("*").alias("n"))
    unit = within.groupBy("i").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    some = unit.where("m > 1").agg(F.count("*").alias("items"), F.sum("m").alias("labels"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    # Totals of a label over items with several labels only.
    total = within.join(unit.where("m > 1").select("i"), "i", "left_semi").groupBy("l").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("sq"))
    row = some.crossJoin(total)  # one row each
    n = F.col("labels")
    expected = F.try_divide(n * n - F.col("sq"), n * (n - 1))
    observed = F.try_divide(F.col("d"), n)
    return row.select("items", F.coalesce("labels", F.lit(0)).cast("long").alias("labels"), observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))


# --- labels from one set of classes ---------------------------------------------------------------


@dataclass
class ClassFit:
    """Tilts ``sigma[annotator, true class, label]`` and the reliability of each annotator per true class."""

    annotators: list[str]
    classes: list[str]
    sigma: np.ndarray
    confusion: np.ndarray
    iterations: int


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _class_posterior(item: np.ndarray, ann: np.ndarray, lab: np.ndarray, items: int, sigma: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each item, and the model of each vote under each true class, for given tilts of the annotators."""
    k = sigma.shape[1]
    given = np.eye(k)[lab]
    votes = np.zeros((items, k))
    np.add.at(votes, item, given)
    q = (votes + 1e-3) / (votes + 1e-3).sum(1, keepdims=True)
    tau = np.zeros((items, k, k))
    for _ in range(INNER):
        p = _softmax(sigma[ann] + tau[item])
        score = np.zeros((items, k))
        np.add.at(score, item, np.log(np.maximum(p[np.arange(len(lab)), :, lab], 1e-300)))
        q = _softmax(score)
        g, h = -beta * tau, np.full_like(tau, beta)
        np.add.at(g, item, q[item][:, :, None] * (given[:, None, :] - p))
        np.add.at(h, item, q[item][:, :, None] * p * (1 - p))
        tau = tau + np.clip(g / h, -1, 1)
    return q, _softmax(sigma[ann] + tau[item])


def _class_sums(patterns: list[list[int]], n: np.ndarray, a: int, sigma: np.ndarray, beta: float) -> np.ndarray:
    """Gradient, curvature and expected votes ``[a, true class, label]`` over patterns with their counts."""
    k = sigma.shape[1]
    flat = np.array([v for p in patterns for v in p], int)
    item = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    ann, lab = flat // k, flat % k
    out = np.zeros((3, a, k, k))
    if len(flat):
        q, p = _class_posterior(item, ann, lab, len(patterns), sigma, beta)
        w = (n[item][:, None] * q[item])[:, :, None]
        given = np.eye(k)[lab][:, None, :]
        np.add.at(out[0], ann, w * (given - p))
        np.add.at(out[1], ann, w * p * (1 - p))
        np.add.at(out[2], ann, w * given)
    return out


def class_consensus(votes: DataFrame, item: str, annotator: str, label: str, strength: float = 0.01, beta: float = 4.0, rounds: int = 100, tol: float = 1e-5) -> tuple[DataFrame, ClassFit]:
    """Consensus of labels from one set of classes: ``item, n_labels, plurality, consensus, posterior`` and the fit.

    ``votes``: one row per item, annotator and label; nulls are no votes, and of several labels of
    an annotator for an item the least counts. ``consensus`` is the class of the highest posterior
    (ties: the least class). Annotators and classes are few (their distinct values come to the
    driver, as the size of the fit); items and patterns are not. ``strength``, ``beta``:
    regularisation of annotators and items.
    """
    rows = votes.where(F.col(item).isNotNull() & F.col(annotator).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(item).alias("item"), F.col(annotator).cast("string").alias("a"), F.col(label).cast("string").alias("l")).groupBy("item", "a").agg(F.min("l").alias("l"))
    names = sorted(r[0] for r in rows.select("a").distinct().collect())
    classes = sorted(r[0] for r in rows.select("l").distinct().collect())
    a, k = len(names), max(len(classes), 1)
    code = (F.array_position(F.lit(names) if names else F.array().cast("array<string>"), F.col("a")) - 1) * k + F.array_position(F.lit(classes) if classes else F.array().cast("array<string>"), F.col("l")) - 1
    patterns = cut(rows.groupBy("item").agg(F.array_sort(F.collect_list(code.cast("int"))).alias("p")))
    counts = cut(patterns.groupBy("p").count())
    few = counts.limit(ON_DRIVER + 1).collect()
    if len(few) <= ON_DRIVER:
        few = sorted(few)
        ps, n = [r["p"] for r in few], np.array([r["count"] for r in few], float)
        sums = lambda sigma: _class_sums(ps, n, a, sigma, beta)
    else:

        def sums(sigma):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    yield pd.DataFrame({"at": np.arange(3 * a * k * k), "v": _class_sums([list(p) for p in b["p"]], b["count"].to_numpy(float), a, sigma, beta).ravel()})

            got = counts.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
            return np.array([r["v"] for r in got]).reshape(3, a, k, k)

    total = float(counts.agg(F.sum("count")).first()[0] or 1)
    start = np.tile(np.eye(k), (a, 1, 1))
    sigma, steps = _ascend(sums, start, total, strength, rounds, tol) if a else (start, 0)
    expected = sums(sigma)[2] if a else np.zeros((0, k, k))
    fit = ClassFit(names, classes, sigma, expected / np.maximum(expected.sum(2, keepdims=True), 1e-12), steps)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps = [list(p) for p in b["p"]]
            flat = np.array([v for p in ps for v in p], int)
            of = np.repeat(np.arange(len(ps)), [len(p) for p in ps])
            q, _ = _class_posterior(of, flat // k, flat % k, len(ps), sigma, beta)
            votes = np.zeros((len(ps), k))
            np.add.at(votes, (of, flat % k), 1)
            name = np.array(classes, object)
            yield pd.DataFrame({"p": b["p"], "n_labels": votes.sum(1).astype(int), "plurality": name[votes.argmax(1)], "consensus": name[q.argmax(1)], "posterior": q.max(1)})

    chosen = counts.select("p").mapInPandas(choose, "p array<int>, n_labels int, plurality string, consensus string, posterior double")
    return patterns.join(chosen, "p").select("item", "n_labels", "plurality", "consensus", "posterior"), fit
