"""The joint signature of a corpus without each of its groups in turn, from what the group changes.

Groups stand one after another, so a group is a range of lines and of words, and without it the corpus
is the same but for what lies in the range, beside it, or (bins of places) moves. Counts are kept for
the whole corpus once and changed group by group: the work follows the corpus, not corpus times groups.
The fields are those of :func:`quirelab.operators.coded.signature` but the fractal ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.operators import coded
from quirelab.operators.coded import Numbers, _chains, _clog, _ranges, _steps

NEAREST, FARTHEST = 10, 50
#: Places of which pairs are counted at once; changes taken at once.
PLACES, CHANGES = 1 << 23, 1 << 21


def _log(c: np.ndarray) -> np.ndarray:
    """c log c of each count."""
    return c * np.log2(np.maximum(c, 1))


class Apart:
    """A corpus in order of its groups: where the lines and words of each begin, and how often it has each word."""

    def __init__(self, c: Numbers):
        by = np.argsort(c.groups, kind="stable")
        self.sizes = c.sizes[by]
        self.words = coded.gathered(c.words, (np.cumsum(c.sizes) - c.sizes)[by], self.sizes)
        self.n_groups = int(c.groups.max()) + 1 if len(c.groups) else 0
        self.size = max(c.size, 1)
        self.line = np.concatenate([[0], np.cumsum(np.bincount(c.groups, minlength=self.n_groups))]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.word = self.starts[self.line]
        self.counts = np.bincount(self.words, minlength=self.size)
        self.left = len(self.words) - np.diff(self.word)  # words without each group

    def own_counts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of some groups after another: group, word, how often."""
        for a, b in _spans(np.diff(self.word)):
            at = slice(self.word[a], self.word[b])
            key = np.repeat(np.arange(a, b), np.diff(self.word[a : b + 1])) * self.size + self.words[at]
            key, k = np.unique(key, return_counts=True)
            yield key // self.size, key % self.size, k

    def of(self, group: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often each of the groups, which come in order, has a word."""
        out = np.zeros(len(group), np.int64)
        for g, ws, ks in self.own_counts():
            own = slice(*np.searchsorted(group, [g[0], g[-1] + 1])) if len(g) else slice(0)
            key, wanted = g * self.size + ws, group[own] * self.size + word[own]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            out[own] = np.where(key[at] == wanted, ks[at], 0) if len(key) else 0
        return out


def _spans(sizes: np.ndarray, most: int = CHANGES) -> Iterator[tuple[int, int]]:
    """Ranges of groups with about so many changes in all."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _distinct(x: np.ndarray) -> np.ndarray:
    """Where the sorted values change."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def _changed(base: np.ndarray, gone: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], n_groups: int) -> tuple[float, np.ndarray]:
    """The sum of c log c over the values of ``base``, which is sorted here, and its change by each group's ``(group, value)`` gone and new.

    What stands once and goes changes nothing, so only values are looked at that stand twice, or come to what is there, or together.
    """
    base.sort()
    again = base[1:][base[1:] == base[:-1]]
    whole = _clog(coded._repeats(base))
    anew = np.sort(new[1])
    come = _distinct(anew)
    often = np.diff(np.append(come, len(anew)))
    anew = anew[come]
    anew = anew[(often > 1) | (base[np.minimum(np.searchsorted(base, anew), len(base) - 1)] == anew)] if len(base) else anew[often > 1]
    known = np.concatenate([again[_distinct(again)], anew])
    known.sort()
    known = known[_distinct(known)]
    if not len(known):
        return whole, np.zeros(n_groups)
    count = np.searchsorted(base, known, "right") - np.searchsorted(base, known)
    bits = np.uint64(min(26, max(12, len(known).bit_length() + 4)))
    hashed = lambda v: (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - bits)
    there = np.zeros(1 << int(bits), bool)
    there[hashed(known)] = True

    def placed(group: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Group and number of the value, for the values looked at."""
        near = np.flatnonzero(there[hashed(value)])
        near = near[np.argsort(value[near])]  # in order they are found faster
        value = value[near]
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = known[at] == value
        return group[near[hit]] * len(known) + at[hit]

    # Each change as its group, value and sign in one number.
    change = np.concatenate([placed(*gone) * 2, placed(*new) * 2 + 1])
    change.sort()
    first = _distinct(change >> 1)
    if not len(first):
        return whole, np.zeros(n_groups)
    which = change[first] >> 1
    c = count[which % len(known)]
    return whole, np.bincount(which // len(known), _log(c + np.add.reduceat((change & 1) * 2 - 1, first)) - _log(c), n_groups)


def pair_sums(c: Apart, d: int) -> np.ndarray:
    """The sum of c log c over the pairs ``d`` words apart, without each group."""
    x, n = c.words, len(c.words)
    if n <= d:
        return np.zeros(c.n_groups)
    begin, length = c.word[:-1], np.diff(c.word)
    # A new pair begins before the group and ends behind it.
    first = np.maximum(0, begin - d)
    sizes = np.maximum(0, np.minimum(begin, n - d - length) - first)
    group = np.repeat(np.arange(c.n_groups), sizes)
    start = _ranges(first, sizes)
    new = x[start] * np.int64(c.size) + x[start + d + length[group]]
    of = np.repeat(np.arange(c.n_groups, dtype=np.int32), length)
    out, whole = np.zeros(c.n_groups), 0.0
    ends = np.cumsum(c.counts)
    cuts = np.unique(np.searchsorted(ends, np.arange(PLACES, n, PLACES)) + 1) if n > PLACES else np.zeros(0, np.int64)
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), c.size]):
        at = np.arange(n - d) if not len(cuts) else np.flatnonzero((x[: n - d] >= lo) & (x[: n - d] < hi))
        key = x[at] * np.int64(c.size) + x[at + d]
        a, b = of[at], of[at + d]
        # A pair goes with the groups of both words and those between.
        apart = np.flatnonzero(a != b)
        more = (b[apart] - a[apart]).astype(np.int64)
        gone = np.concatenate([a, _ranges(a[apart].astype(np.int64) + 1, more)]), np.concatenate([key, np.repeat(key[apart], more)])
        own = slice(None) if not len(cuts) else (x[start] >= lo) & (x[start] < hi)
        w, change = _changed(key, gone, (group[own], new[own]), c.n_groups)
        whole, out = whole + w, out + change
    return whole + out


def _ends(c: Apart, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last ``k`` words without each group, the last one first; -1 where there are no more."""
    n, i = len(c.words), np.arange(k)
    if not n:
        return (np.full((c.n_groups, k), -1),) * 2
    begin, end = c.word[:-1, None], c.word[1:, None]
    head = np.where(i < begin, i, i + end - begin)
    tail = np.where(n - 1 - i >= end, n - 1 - i, n - 1 - i - (end - begin))
    put = lambda at, good: np.where(good, c.words[np.clip(at, 0, n - 1)].astype(np.int64), -1)
    there = i < c.left[:, None]
    return put(head, there), put(tail, there)


def _word_sums(c: Apart) -> np.ndarray:
    """The sum of c log c over the words, without each group."""
    out = np.full(c.n_groups, _clog(c.counts))
    for g, w, k in c.own_counts():
        out += np.bincount(g, _log(c.counts[w] - k) - _log(c.counts[w]), c.n_groups)
    return out


def _side_sums(c: Apart, words: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sums of c log c over the words without each group, less its first 1, 2, .. given ``words``."""
    out, own = np.empty(words.shape), c.of(np.repeat(np.arange(c.n_groups), words.shape[1]), words.ravel()).reshape(words.shape)
    for a in range(0, c.n_groups, 1 << 12):
        w = words[a : a + (1 << 12)]
        seen = np.stack([(w[:, :j] == w[:, j : j + 1]).sum(1) for j in range(w.shape[1])], 1)  # the same word before
        had = c.counts[w] - own[a : a + (1 << 12)] - seen
        out[a : a + (1 << 12)] = whole[a : a + (1 << 12), None] + np.cumsum(np.where(w >= 0, _log(had - 1) - _log(had), 0), 1)
    return out


def conditional_entropy(c: Apart) -> np.ndarray:
    n, m = c.left.astype(np.float64), np.maximum(c.left - 1.0, 1)
    last = _ends(c, 1)[1][:, 0]
    often = c.counts[last] - c.of(np.arange(c.n_groups), last)
    h = -(pair_sums(c, 1) - _word_sums(c) + np.log2(np.maximum(often, 1)) - m * np.log2(m) + m * np.log2(np.maximum(n, 1))) / m
    return np.where(n >= 2, h, np.nan)


def mutual_information(c: Apart, distances: Sequence[int]) -> dict[int, np.ndarray]:
    """The mutual information at each distance, without each group."""
    head, tail = _ends(c, FARTHEST)
    whole = _word_sums(c)
    before, behind = _side_sums(c, head, whole), _side_sums(c, tail, whole)
    out = {}
    for d in distances:
        m = np.maximum(c.left - d, 1).astype(np.float64)
        mi = np.log2(m) + (pair_sums(c, d) - behind[:, d - 1] - before[:, d - 1]) / m
        out[d] = np.where((c.left > FARTHEST) & (mi > 1e-9), mi, np.nan)
    return out


def line_fields(c: Apart) -> dict[str, np.ndarray]:
    """Lengths, first and last pairs of lines, and mutual information over line ends."""
    x, sizes = c.words, c.sizes
    of = np.repeat(np.arange(c.n_groups), np.diff(c.line))
    rest = lambda v: v.sum() - np.bincount(of, v, c.n_groups)
    n, s1, s2, s3 = (rest((sizes > 0) * sizes.astype(np.float64) ** i) for i in range(4))
    first, last = c.starts[:-1], c.starts[1:] - 1
    two = np.flatnonzero(sizes >= 2)
    same = lambda a, b: np.bincount(two, x[a[two]] == x[b[two]], len(sizes))
    with np.errstate(all="ignore"):
        mean, var = s1 / n, (n * s2 - s1 * s1) / (n * n)
        skew = np.where(n > 0, np.where(var > 0, (s3 / n - 3 * mean * s2 / n + 2 * mean**3) / var**1.5, 0), np.nan)
        onset, coda = (rest(v) / rest((sizes >= 2) * 1.0) for v in (same(first, first + 1), same(last, last - 1)))
        out = {"length_mean": mean, "length_variance": var, "length_skew": skew, "onset": onset, "coda": coda, "onset_coda_ratio": np.where(coda > 0, onset / coda, np.nan)}
    follow = np.flatnonzero((sizes[:-1] > 0) & (sizes[1:] > 0))
    a, b = x[last[follow]].astype(np.int64), x[first[follow + 1]].astype(np.int64)
    g1, g2 = of[follow], of[follow + 1]
    apart = np.flatnonzero(g1 != g2)
    # Every group has lines: two lines beside each other are of one group or of two that follow.
    gone = lambda v: (np.concatenate([g1, g2[apart]]), np.concatenate([v, v[apart]]))
    inner = np.flatnonzero((c.line[:-1] > 0) & (c.line[1:] < len(sizes)))
    inner = inner[(sizes[c.line[inner] - 1] > 0) & (sizes[c.line[inner + 1]] > 0)]
    na, nb = x[last[c.line[inner] - 1]].astype(np.int64), x[first[c.line[inner + 1]]].astype(np.int64)
    m = len(follow) - np.bincount(gone(a)[0], minlength=c.n_groups) + np.bincount(inner, minlength=c.n_groups)
    sums = [sum(_changed(v.copy(), gone(v), (inner, new), c.n_groups)) for v, new in ((a * c.size + b, na * c.size + nb), (a, na), (b, nb))]
    with np.errstate(all="ignore"):
        mi = np.log2(m) + (sums[0] - sums[1] - sums[2]) / m
    return out | {"edge_mi": np.where((m > 0) & (mi > 1e-12), mi, np.nan)}


def type_fields(c: Apart) -> dict[str, np.ndarray]:
    """The share of single words and the slope of ln count on ln rank."""
    changes = [(g, c.counts[w], c.counts[w] - k) for g, w, k in c.own_counts()]
    old_c, own = np.unique(c.counts[c.counts > 0], return_counts=True)
    values = np.unique(np.concatenate([old_c, *(new for _, _, new in changes)]))[::-1]
    values = values[values > 0]
    of = lambda v: len(values) - 1 - np.searchsorted(values[::-1], v)
    base = np.zeros(len(values), np.int64)
    base[of(old_c)] = own
    top = int(base.sum())
    logs = np.log(np.arange(1, top + 1))
    sums, squares = np.concatenate([[0], np.cumsum(logs)]), np.concatenate([[0], np.cumsum(logs * logs)])
    y = np.log(values)
    hapax, slope = np.full(c.n_groups, np.nan), np.full(c.n_groups, np.nan)
    for g, before, after in changes:
        step = max(1, (1 << 22) // max(len(values), 1))
        for lo in range(int(g[0]) if len(g) else 0, int(g[-1]) + 1 if len(g) else 0, step):
            here = slice(*np.searchsorted(g, [lo, lo + step]))
            k = min(lo + step, int(g[-1]) + 1) - lo
            flat = np.bincount((g[here] - lo) * len(values) + of(before[here]), minlength=k * len(values))
            left = after[here] > 0
            flat = np.bincount((g[here] - lo)[left] * len(values) + of(after[here][left]), minlength=k * len(values)) - flat
            m = base + flat.reshape(k, -1)
            ends = np.cumsum(m, 1)
            t = ends[:, -1]
            rolled = np.diff(sums[ends], axis=1, prepend=0)
            full = np.maximum(t, 1)
            sx, sy = sums[t], m @ y
            with np.errstate(all="ignore"):
                b = (rolled @ y - sx * sy / full) / (squares[t] - sx * sx / full)
            slope[lo : lo + k] = np.where(t > 1, b, np.where(t == 1, 0.0, np.nan))
            hapax[lo : lo + k] = np.where(t > 0, (m[:, -1] if len(values) and values[-1] == 1 else 0) / full, np.nan)
    for a in np.flatnonzero(np.diff(c.word) == 0).tolist():  # without words of its own a group changes nothing
        if top:
            hapax[a] = (c.counts == 1).sum() / top
            slope[a] = coded._zipf(c.counts[c.counts > 0])
    return {"hapax_ratio": hapax, "zipf_slope": slope}


def lz77_ratio(c: Apart, window: int = 4096, least: int = 3) -> np.ndarray:
    """The parse of the whole is kept up to the group, and again from where both parses come to the same place a window behind it."""
    x, n = c.words, len(c.words)
    reach = window + int(np.diff(c.word).max(initial=0))
    before = _chains(x, reach, least, max(1 << 16, reach))
    found = np.array(list(_steps(x, before, window, least, True)), np.int64).reshape(-1, 2)
    starts, ends = found[:, 0], found.sum(1)
    saved = np.concatenate([[0], np.cumsum(found[:, 1] - 2)])  # what matches cost less than literals
    out = np.full(c.n_groups, np.nan)
    for g in range(c.n_groups):
        s, e = int(c.word[g]), int(c.word[g + 1])
        if not n - (e - s):
            continue
        last = int(np.searchsorted(starts, s - least, "right")) - 1
        if last >= 0 and ends[last] >= s:
            begin, kept = int(starts[last]), last
        else:
            begin, kept = max(int(ends[last]) if last >= 0 else 0, s - least, 0), last + 1
        begin, ahead = min(begin, s), 2 * window
        while (tail := _around(x, before, starts, ends, saved, s, e, begin, ahead, window, least)) is None:
            ahead *= 4
        m = n - (e - s)
        out[g] = (m - saved[kept] - tail) / m
    return out


def _around(x: np.ndarray, before: np.ndarray, starts: np.ndarray, ends: np.ndarray, saved: np.ndarray, s: int, e: int, begin: int, ahead: int, window: int, least: int) -> int | None:
    """What the matches from ``begin`` on save without the words ``s`` to ``e``; None if it takes more words to know."""
    n, lo, hi = len(x), max(0, begin - window), min(len(x), e + ahead)
    text = np.concatenate([x[lo:s], x[e:hi]])
    cut_at = s - lo
    # Chains as they were, but over the gap; runs that reach into it are others now.
    chain = np.full(max(0, len(text) - least + 1), -1, np.int32)
    front = max(0, min(s - least + 1, len(before)) - lo)
    own = before[lo : lo + front]
    chain[:front] = np.where(own >= lo, own - lo, -1)
    back = before[e : min(hi - least + 1, len(before))].copy()
    while len(inner := np.flatnonzero((back > s - least) & (back < e) & (back >= 0))):
        back[inner] = before[back[inner]]
    back = np.where(back >= e, back - (e - s), back) - lo
    if len(back):
        chain[cut_at : cut_at + len(back)] = np.where(back >= 0, back, -1)
    for p in range(max(0, cut_at - least + 1), min(cut_at, len(chain))):
        same = text[: len(chain)] == text[p]
        for j in range(1, least):
            same &= text[j : j + len(chain)] == text[p + j]
        at = np.flatnonzero(same)
        chain[at[0]] = -1
        chain[at[1:]] = at[:-1]
    places = np.flatnonzero(chain >= 0)
    places = places[places >= begin - lo].astype(np.int32)
    have, was, far = 0, begin - lo, cut_at + window
    to_base = e - cut_at  # behind the gap
    for p, length in _steps(text, chain, window, least, True, places):
        if hi < n and p + length >= len(text):
            return None
        if p >= far and (at := _meets(starts, ends, max(was, far) + to_base, p + to_base)) is not None:
            return have + int(saved[-1] - saved[at])
        have, was = have + length - 2, p + length
    if hi == n:
        return have
    # Runs that end beyond these words could match, too.
    at = _meets(starts, ends, max(was, far) + to_base, hi - least)
    return None if at is None else have + int(saved[-1] - saved[at])


def _meets(starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> int | None:
    """The number of the whole's matches before the first place from ``lo`` to ``hi`` that none of them reaches over."""
    if lo > hi:
        return None
    k = int(np.searchsorted(starts, lo)) - 1  # the last that begins before
    if k >= 0 and ends[k] > hi:
        return None
    return k + 1


def group_stability(c: Apart, top: int = 100) -> np.ndarray:
    out = np.full(c.n_groups, np.nan)
    n = len(c.words)
    if c.n_groups < 2 or not n:
        return out
    by_count = np.sort(c.counts[c.counts > 0])[::-1]
    # The least count among the best, without the group, shows down to which count words can come in.
    best = np.argsort(-c.counts, kind="stable")[: min(top, len(by_count))]
    place = np.full(c.size, -1)
    place[best] = np.arange(len(best))
    least = np.full(c.n_groups, c.counts[best].min())
    for g, w, k in c.own_counts():
        own = place[w] >= 0
        np.minimum.at(least, g[own], c.counts[w[own]] - k[own])
    least = np.maximum(least, 1)
    names = np.flatnonzero(c.counts >= least.min())
    number = np.full(c.size, -1, np.int64)
    number[names] = np.arange(len(names))
    k, firsts = np.zeros(len(names), np.int64), np.full((2, len(names)), n)  # places in the first group with the word, and in the second
    per: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g, w, often in c.own_counts():
        a, b = int(g[0]) if len(g) else 0, int(g[-1]) + 1 if len(g) else 0
        lo = c.word[a]
        at = np.flatnonzero(number[c.words[lo : c.word[b]]] >= 0)
        if not len(at):
            continue
        of = np.searchsorted(c.word, at + lo, "right") - 1
        key, first = np.unique(number[c.words[at + lo]] * c.n_groups + of, return_index=True)
        w, p = key // c.n_groups, at[first] + lo
        k += np.bincount(w, minlength=len(names))
        start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        w, two = w[start], np.append(p, n)[np.minimum(start + 1, len(p))]
        two = np.where(np.diff(np.append(start, len(p))) > 1, two, n)
        known = firsts[0, w] < n
        firsts[1, w] = np.minimum(firsts[1, w], np.where(known, p[start], two))
        firsts[0, w] = np.minimum(firsts[0, w], p[start])
    order = np.lexsort((firsts[0], -c.counts[names]))
    names, k, firsts = names[order], k[order], firsts[:, order]
    counts = c.counts[names]
    number[names] = np.arange(len(names))
    for g, w, often in c.own_counts():
        own = np.flatnonzero(number[w] >= 0)
        g, w, often = g[own], number[w[own]], often[own]
        edges = np.searchsorted(g, np.arange(int(g[0]), int(g[-1]) + 2)) if len(g) else np.zeros(1, np.int64)
        for i in range(len(edges) - 1):
            a = int(g[0]) + i
            ws, ks = w[edges[i] : edges[i + 1]], often[edges[i] : edges[i + 1]]
            p = int(np.searchsorted(-counts, -least[a], "right"))
            ws, ks = ws[ws < p], ks[ws < p]
            left, groups, seen = counts[:p].copy(), k[:p].copy(), firsts[0, :p].copy()
            left[ws] -= ks
            groups[ws] -= 1
            moved = ws[seen[ws] >= c.word[a]]
            seen[moved] = firsts[1, moved]
            chosen = np.lexsort((seen, -left))[:top]
            chosen = chosen[left[chosen] > 0]
            out[a] = np.mean(groups[chosen] / (c.n_groups - 1)) if len(chosen) else np.nan
    quiet = np.flatnonzero(np.isnan(out) & (c.left > 0))
    if len(quiet):
        out[quiet] = np.mean(k[:top] / (c.n_groups - 1))
    return out


def positional_divergence(c: Apart, bins: int = 10) -> np.ndarray:
    edges = np.array([i * (1.0 / bins) for i in range(1, bins)])
    n = len(c.sizes)

    def bounds(lines: np.ndarray) -> np.ndarray:
        """The first line of each bin but the first, for corpora of so many lines."""
        last = np.maximum(1, lines - 1)[:, None]
        at = np.maximum(np.floor(edges * last).astype(np.int64) - 1, 0)
        for _ in range(3):
            at += at / last < edges
        return np.minimum(at, lines[:, None])

    def values(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = per.sum(1)
        good = (t >= 2) & ((per > 0).sum(1) > 1)
        own, t = per[good].astype(np.float64), t[good]
        v = np.zeros(len(per))
        v[good] = np.log2(t) - (own * np.log2(np.maximum(own, 1))).sum(1) / t
        return v, good

    if not n:
        return np.full(c.n_groups, np.nan)
    base = bounds(np.array([n]))[0]
    all_ends = c.starts[np.concatenate([[0], base, [n]])]
    per = np.stack([np.bincount(c.words[a:b], minlength=c.size) for a, b in zip(all_ends, all_ends[1:])], 1).astype(np.int32)
    v, good = values(per)
    begin, end = c.line[:-1, None], c.line[1:, None]
    new = bounds(n - np.diff(c.line))
    new = np.where(new < begin, new, new + end - begin)
    # Between these lines all lines go from one bin to another, or go, or stay.
    marks = np.sort(np.concatenate([np.broadcast_to(base, new.shape), new, begin, end, np.zeros_like(begin), np.full_like(end, n)], 1), 1)
    lo, hi = marks[:, :-1], marks[:, 1:]
    old_bin = (base[None, None] <= lo[:, :, None]).sum(2)
    new_bin = np.where((lo >= begin) & (lo < end), -1, (new[:, None] <= lo[:, :, None]).sum(2))
    g, i = np.nonzero((old_bin != new_bin) & (c.starts[hi] > c.starts[lo]))
    first, sizes = c.starts[lo[g, i]], c.starts[hi[g, i]] - c.starts[lo[g, i]]
    from_bin, to_bin = old_bin[g, i], new_bin[g, i]
    total, often = np.full(c.n_groups, v.sum()), np.full(c.n_groups, int(good.sum()))
    for a, b in _spans(np.bincount(g, sizes, c.n_groups).astype(np.int64)):
        own = slice(*np.searchsorted(g, [a, b]))
        of = np.repeat(np.arange(own.start, own.stop), sizes[own])
        w = c.words[_ranges(first[own], sizes[own])]
        key = g[of] * np.int64(c.size) + w
        key, which = np.unique(key, return_inverse=True)
        gone = np.bincount(which * bins + from_bin[of], minlength=len(key) * bins)
        come = to_bin[of] >= 0
        change = np.bincount((which * bins + to_bin[of])[come], minlength=len(key) * bins) - gone
        w = key % c.size
        then, there = values(per[w] + change.reshape(-1, bins))
        total += np.bincount(key // c.size, then - v[w], c.n_groups)
        often += np.bincount(key // c.size, there.astype(np.float64) - good[w], c.n_groups).astype(np.int64)
    return np.where(often > 0, total / np.maximum(often, 1), np.nan)


#: What one task takes: names of fields, and distances of the mutual information.
PARTS: list[str | list[int]] = [*([d for d in range(FARTHEST, NEAREST - 1, -1) if d % 5 == i] for i in range(5)), "positional_divergence", "lz77_ratio", "types", "group_stability", "conditional_entropy", "lines"]


def part(c: Apart, name: str | list[int]) -> dict[str, np.ndarray]:
    """Values of some fields without each group."""
    if isinstance(name, list):
        return {f"mi_plateau:{d}": v for d, v in mutual_information(c, name).items()}
    several = {"lines": line_fields, "types": type_fields}
    one = {"lz77_ratio": lz77_ratio, "group_stability": group_stability, "positional_divergence": positional_divergence, "conditional_entropy": conditional_entropy}
    return several[name](c) if name in several else {name: one[name](c)}


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """``g, field, value`` of a corpus that ``coded.store`` wrote, without each of its groups (numbered by first line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                c = Apart(coded.read(path))
                for field, values in (part(c, PARTS[i]) if c.n_groups else {}).items():
                    for a in range(0, c.n_groups, 1 << 16):
                        v = pa.array(values[a : a + (1 << 16)].astype(np.float64), from_pandas=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(v))), pa.array([field] * len(v)), v], ["g", "field", "value"])

    rows = spark.range(0, len(PARTS), 1, len(PARTS)).mapInArrow(run, "g long, field string, value double")
    # The plateau is the mean over the distances that have information.
    return rows.where("value is not null").groupBy("g", F.split("field", ":")[0].alias("field")).agg(F.avg("value").alias("value"))
