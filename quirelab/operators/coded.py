"""The joint signature of a corpus that is held as numbers, in one task: many replicates beside each other.

:mod:`quirelab.operators.signature` spreads one corpus over the tasks. Where a corpus is a resample of
another, or was generated in a task, its words need no exchange: each task puts its replicate together from
the written numbers (4 bytes a word) and takes all fields from them. The fields are the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from quirelab.operators.boxes import SAMPLE
from quirelab.operators.coding import huffman_bits
from quirelab.operators.series import log_scales
from quirelab.session import cut

#: Fields of a compression profile.
PROFILE = ["lz77_w64", "lz77_w256", "lz77_w1024", "huffman", "lz77_line"]
#: Numbers in a written piece of a corpus; windows' points taken at once.
PIECE, AT_ONCE = 1 << 20, 1 << 15


class Numbers:
    """A corpus ``words, sizes, groups``: numbers of words in alphabetical order, words of each line, and its group's number by first line."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, groups: np.ndarray, size: int):
        self.words, self.sizes, self.groups, self.size = words, sizes, groups, size

    def resampled(self, iteration: int, seed: int = 42) -> Numbers:
        """H4: as many groups as there are, drawn as by ``resample.bootstrap_draws``, their lines in order of the draws."""
        n = int(self.groups.max()) + 1 if len(self.groups) else 0
        drawn = np.array([int.from_bytes(hashlib.md5(f"{seed}:{iteration}:{j}".encode()).digest()[:4], "big") % n for j in range(n)], np.int64)
        by = np.argsort(self.groups, kind="stable")
        ends = np.cumsum(np.bincount(self.groups, minlength=n)) if n else np.zeros(0, np.int64)
        lines = by[_ranges(np.concatenate([[0], ends])[drawn], np.diff(ends, prepend=0)[drawn])]
        return Numbers(gathered(self.words, (np.cumsum(self.sizes) - self.sizes)[lines], self.sizes[lines]), self.sizes[lines], self.groups[lines], self.size)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def gathered(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of lines that start and are as long as given, one line after another."""
    out, at = np.empty(int(sizes.sum()), np.int32), 0
    for a in range(0, len(sizes), 1 << 17):
        own = words[_ranges(starts[a : a + (1 << 17)], sizes[a : a + (1 << 17)])]
        out[at : at + len(own)] = own
        at += len(own)
    return out


def _pieces(c: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some lines after another: their words, the line of each word, and its place in the corpus."""
    at = 0
    for a in range(0, len(c.sizes), 1 << 17):
        line = np.repeat(np.arange(a, min(a + (1 << 17), len(c.sizes))), c.sizes[a : a + (1 << 17)])
        yield c.words[at : at + len(line)], line, np.arange(at, at + len(line))
        at += len(line)


def _clog(c: np.ndarray) -> float:
    c = c[c > 1].astype(np.float64)
    return float((c * np.log2(c)).sum())


def _repeats(key: np.ndarray) -> np.ndarray:
    """How often each of the sorted values occurs that occur twice or more."""
    again = np.flatnonzero(key[1:] == key[:-1])
    if not len(again):
        return again
    first = np.concatenate([[0], np.flatnonzero(np.diff(again) != 1) + 1, [len(again)]])
    return np.diff(first) + 1


class _Pairs:
    """Counts of the pairs of words some way apart. Pairs are gone through by ranges of the first word,
    so small that a pair is a number of 32 bits."""

    def __init__(self, x: np.ndarray, size: int):
        self.x, size, n = x.view(np.uint32), max(size, 1), max(len(x), 1)
        # Ranges of some 2 million places at most, on the average.
        width = max(1, min((1 << 32) // size, size * (1 << 21) // n, (1 << 31) - 1))
        ends = np.cumsum(np.bincount(x // np.int32(width), minlength=-(-size // width)))
        at, fill = np.empty(len(x), np.int32), np.concatenate([[0], ends[:-1]])
        for a in range(0, len(x), PIECE):
            key = (x[a : a + PIECE] // np.int32(width)).astype(np.int64) << 32
            key |= np.arange(len(key))
            key.sort()
            c = np.bincount(key >> 32, minlength=len(ends))
            at[_ranges(fill, c)] = (key & 0xFFFFFFFF) + a
            fill = fill + c
        ends = ends.tolist()
        self.parts = [(a, b) for a, b in zip([0, *ends], ends) if b > a]
        self.at, self.size, self.width = at, size, width

    def clogs(self, distances: Sequence[int]) -> list[float]:
        """The sum of c log c over the pairs at each distance."""
        out, n = np.zeros(len(distances)), len(self.x)
        for a, b in self.parts:
            at = self.at[a:b].astype(np.int64)
            base = (self.x[at] % np.uint32(self.width)) * np.uint32(self.size)
            for i, d in enumerate(distances):
                m = int(np.searchsorted(at, n - d))
                key = np.take(self.x[d:], at[:m], mode="clip") if m else base[:0]
                key += base[:m]
                key.sort()
                out[i] += _clog(_repeats(key))
        return out.tolist()


def _slope(y: np.ndarray, x: np.ndarray) -> float | None:
    dx = x - x.mean()
    s = float(dx @ dx)
    return float(dx @ (y - y.mean())) / s if s > 0 else None


def _zipf(counts: np.ndarray) -> float | None:
    if not len(counts):
        return None
    c = np.sort(counts)[::-1]
    found = _slope(np.log(c), np.log(np.arange(1, len(c) + 1)))
    return 0.0 if found is None else found


def _mi_plateau(x: np.ndarray, pairs: _Pairs, counts: np.ndarray, nearest: int, farthest: int) -> float | None:
    ds = list(range(nearest, farthest + 1))
    n = len(x)
    if n < farthest + 1:
        return None
    whole, found = _clog(counts), []

    def side(gone: np.ndarray) -> float:
        """The same sum without some of the words."""
        w, t = np.unique(gone, return_counts=True)
        return whole + _clog(counts[w] - t) - _clog(counts[w])

    for d, xy in zip(ds, pairs.clogs(ds)):
        m = n - d
        mi = np.log2(m) + (xy - side(x[n - d :]) - side(x[:d])) / m
        if mi > 1e-9:
            found.append(mi)
    return float(np.mean(found)) if found else None


def _chains(x: np.ndarray, window: int, least: int, block: int = 1 << 16) -> np.ndarray:
    """For each place the last one within the window where ``least`` words have the same hash, or -1."""
    before = np.full(max(0, len(x) - least + 1), -1, np.int32)
    bits = np.int64((block + window).bit_length())
    for a in range(0, len(before), block):
        lo, hi = max(0, a - window), min(a + block, len(before))
        h = np.zeros(hi - lo, np.uint64)
        for j in range(least):
            h = (h ^ x[lo + j : hi + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        key = (h.view(np.int64) >> bits) << bits | np.arange(len(h))
        key.sort()
        at = key & ((1 << bits) - 1)
        same = np.flatnonzero((key[1:] >> bits) == (key[:-1] >> bits))
        at, old = at[same + 1] + lo, at[same] + lo
        own = (at >= a) & (at - old <= window)
        before[at[own]] = old[own]
    return before


def _steps(x: np.ndarray, before: np.ndarray, window: int, least: int, overlap: bool, places: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """The matches ``start, length`` of ``coding.longest_matches``; all else is literals. ``places``: the only ones where a match may start.

    Where the next words don't stand in the window nothing can match, so the parse goes from one place
    where they do to the next. Only places with one hash are compared, word by word.
    """
    n, i, k = len(x), 0, 0
    places = np.flatnonzero(before >= 0).astype(np.int32) if places is None else places
    last = len(places)
    chain, text, stops = memoryview(before), memoryview(np.ascontiguousarray(x)), memoryview(places)
    while True:
        while k < last and stops[k] < i:
            k += 1
        if k == last:
            return
        p = stops[k]
        best, j = 0, chain[p]
        while j >= 0 and p - j <= window:
            room = n - p if overlap else min(n - p, p - 1 - j)
            # A longer one has the same word where the best so far ends.
            if best < room and text[j + best] == text[p + best]:
                length = 0
                while length < room and text[j + length] == text[p + length]:
                    length += 1
                best = max(best, length)
                if p + best == n:
                    break
            j = chain[j]
        if best >= least:
            yield p, best
        i = p + (best if best >= least else 1)


def _parsed(steps: Iterator[tuple[int, int]], n: int) -> tuple[int, int]:
    """Matches and literals of a parse."""
    matches = covered = 0
    for _, length in steps:
        matches, covered = matches + 1, covered + length
    return matches, n - covered


def lz77_cost(x: np.ndarray, window: int = 4096, least: int = 3, block: int = 1 << 16) -> int:
    """The cost of ``coding.signature_cost`` (2 a match, 1 a literal), not divided by the length."""
    matches, literals = _parsed(_steps(x, _chains(x, window, least, block), window, least, True), len(x))
    return 2 * matches + literals


def lz77_triples(x: np.ndarray, windows: Sequence[int], least: int = 3) -> list[int]:
    """How many triples the parse without overlap has (``coding.triples``), for each window."""
    before = _chains(x, max(windows), least)
    return [sum(_parsed(_steps(x, before, w, least, False), len(x))) for w in windows]


def periodic_triples(text: np.ndarray, n: int, window: int, least: int = 3, last: int | None = None) -> int:
    """The same for ``n`` symbols of a text that is repeated, of which the last may be another.

    Beyond the first window a step depends on its place in the text alone, up to a window before the
    end. So when the parse comes to a place of the text again it goes round in a circle: the rounds
    in the middle are left out, and each counts as many triples as the first.
    """
    period = len(text)
    long = np.resize(text, 4 * window + (window + 3) * period).astype(np.int32)
    matches = covered = rounds = 0
    size = each = period  # where nothing matches any more, one triple a symbol
    seen: dict[int, tuple[int, int]] = {}
    for start, length in _steps(long, _chains(long, window, least), window, least, False):
        now = start, start - covered + matches  # and the triples before it
        matches, covered = matches + 1, covered + length
        if start < window + period or start + 2 * window > len(long):
            continue
        first = seen.setdefault(start % period, now)
        if first is not now:
            size, each = now[0] - first[0], now[1] - first[1]
            rounds = max(0, (n - first[0] - 3 * window - size) // size)
            break
    else:
        if not seen:
            rounds = max(0, (n - 2 * window - 3 * period) // period)
    short = np.resize(text, n - rounds * size).astype(np.int32)
    if last is not None and len(short):
        short[-1] = last
    return lz77_triples(short, [window], least)[0] + rounds * each


def _group_stability(c: Numbers, counts: np.ndarray, top: int = 100) -> float | None:
    n = len(c.words)
    if not n:
        return None
    labels, firsts = np.unique(c.groups, return_index=True)
    rank = np.empty(len(firsts), np.int64)
    rank[np.argsort(firsts)] = np.arange(len(firsts))
    present = int((counts > 0).sum())
    least = np.partition(counts, len(counts) - min(top, present))[len(counts) - min(top, present)]
    names = np.flatnonzero(counts >= max(least, 1))
    number = np.full(c.size, -1, np.int32)
    number[names] = np.arange(len(names))
    seen, kept = np.full(len(names), np.iinfo(np.int64).max), [np.zeros(0, np.int64)]
    for words, line, pos in _pieces(c):
        at = np.flatnonzero(number[words] >= 0)
        w, g = number[words[at]].astype(np.int64), rank[np.searchsorted(labels, c.groups[line[at]])]
        kept.append(np.unique(w * len(firsts) + g))
        order = np.argsort(g, kind="stable")  # read group by group
        own, first = np.unique(w[order], return_index=True)
        seen[own] = np.minimum(seen[own], g[order][first] * n + pos[at][order][first])
    k = np.bincount(np.unique(np.concatenate(kept)) // len(firsts), minlength=len(names))
    best = np.lexsort((seen, -counts[names]))[:top]
    return float(np.mean(k[best] / len(firsts)))


def _positional_divergence(c: Numbers, bins: int = 10) -> float | None:
    edges, last = [i * (1.0 / bins) for i in range(1, bins)], max(1, len(c.sizes) - 1)
    b = np.searchsorted(np.searchsorted(edges, np.arange(len(c.sizes)) / last, "right"), np.arange(bins + 1))
    ends = np.concatenate([[0], np.cumsum(c.sizes)])[b]  # the words of a bin stand together
    per = np.stack([np.bincount(c.words[ends[i] : ends[i + 1]], minlength=c.size) for i in range(bins)], 1)
    per = per[(per.sum(1) >= 2) & ((per > 0).sum(1) > 1)].astype(np.float64)
    if not len(per):
        return None
    total = per.sum(1)
    return float(np.mean(np.log2(total) - (per * np.log2(np.maximum(per, 1))).sum(1) / total))


def _residuals(z: np.ndarray, k: int) -> np.ndarray:
    """Residuals of the whole windows of ``k`` points that are more than rounding."""
    m = len(z) // k
    x = np.arange(k) - (k - 1) / 2
    out, have, sxx, step, far = np.empty(m), 0, float(x @ x), max(1, AT_ONCE // k), max(-float(z.min()), float(z.max()), 1.0)
    for a in range(0, m, step):
        rows = z[a * k : min(m, a + step) * k].reshape(-1, k)
        sxy = rows @ x
        own = rows - rows.mean(1, keepdims=True)
        syy = np.einsum("ij,ij->i", own, own)
        rest = syy - sxy * sxy / sxx
        # Where nearly all cancels, the residuals themselves are summed.
        thin = np.flatnonzero(rest <= 1e-6 * syy)
        if len(thin):
            rest[thin] = ((own[thin] - np.outer(sxy[thin] / sxx, x)) ** 2).sum(1)
        rms = np.sqrt(rest / k)
        near = np.flatnonzero(rms <= 1e-10 * far)
        if len(near):
            rms[near[rms[near] <= 1e-10 * np.maximum(np.abs(rows[near]).max(1), 1)]] = 0
        rms = rms[rms > 0]
        out[have : have + len(rms)] = rms
        have += len(rms)
    return out[:have]


def _exponents(z: np.ndarray) -> tuple[float | None, float | None]:
    """The DFA exponent of a series, which is overwritten, and the spread of the multifractal ones."""
    n = len(z)
    z -= z.mean()
    np.cumsum(z, out=z)
    points = []
    for k in log_scales(4, min(n // 4, 1000), 30):
        rms = _residuals(z, k)
        if n // k >= 4 and len(rms) >= 4:
            points.append((k, rms.mean()))
    hurst = None
    if len(points) >= 5:
        k, f = np.array(points).T
        hurst = min(1.0, max(0.0, _slope(np.log(f), np.log(k))))
    qs = [-5.0 + i * 0.5 for i in range(21)]
    spectrum: list[tuple[int, list[float]]] = []
    for k in log_scales(16, n // 4, 20):
        rms = _residuals(z, k)
        if n // k >= 2 and len(rms) >= 2:
            own = np.log(rms)
            g = own.mean()
            own -= g
            spectrum.append((k, [g + (np.log(np.mean(np.exp(q * own))) / q if q else 0.0) for q in qs]))
    if len(spectrum) < 4:
        return hurst, None
    k, f = np.log([k for k, _ in spectrum]), np.array([f for _, f in spectrum])
    h = [_slope(f[:, i], k) for i in range(len(qs))]
    return hurst, max(h) - min(h)


def _xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of doubles."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = turn((h + p5 + np.uint64(8)) ^ turn((c + 0.0).view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
            h = (h ^ h >> np.uint64(33)) * p2
            h = (h ^ h >> np.uint64(29)) * p3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _box_dimension(c: Numbers, counts: np.ndarray, n_scales: int = 30) -> float | None:
    rank, starts = np.cumsum(counts > 0) - 1, np.cumsum(c.sizes) - c.sizes
    n, longest = int(c.sizes[c.sizes >= 2].sum()), int(c.sizes.max(initial=0))
    if n < 100:
        return None
    used_words = np.zeros(c.size, bool)
    for words, line, _ in _pieces(c):
        used_words[words[c.sizes[line] >= 2]] = True
    ends = np.flatnonzero(used_words)[[0, -1]]
    lo, hi = rank[ends] / max(1, int((counts > 0).sum()) - 1)

    def points() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Points in the unit square, piece by piece; equal ones of a piece are one, with how often it stands. A line's places reach from 0 to 1."""
        for words, line, pos in _pieces(c):
            m = c.sizes[line]
            place, often = np.unique(((rank[words] * (longest + 1) + m) * longest + pos - starts[line])[m >= 2], return_counts=True)
            x = place % longest / np.maximum(1, place // longest % (longest + 1) - 1)
            y = place // longest // (longest + 1) / max(1, int((counts > 0).sum()) - 1)
            yield x, (y - lo) / (hi - lo if hi > lo else 1.0), often

    few = np.zeros((2, 0))
    hashes = np.zeros(0, np.int64)
    for x, y, often in points():
        h = _xxhash64(x, y)
        own = np.argpartition(h, SAMPLE)[: SAMPLE + 1] if len(h) > SAMPLE + 1 else np.arange(len(h))
        own = np.repeat(own, often[own])
        hashes, few = np.concatenate([hashes, h[own]]), np.concatenate([few, np.stack([x[own], y[own]])], 1)
        by = np.lexsort((few[1], few[0], hashes))[:SAMPLE]
        hashes, few = hashes[by], few[:, by]
    x, y = few[0], few[1]
    a, b = np.triu_indices(len(x), 1)
    gap = float(np.percentile(np.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2), 1))
    low = max(gap * 2, 1e-3)
    low = 0.05 if low >= 0.5 else low
    scales = [10.0 ** (np.log10(0.5) + j * (np.log10(low) - np.log10(0.5)) / (n_scales - 1)) for j in range(n_scales)]
    hit = {k: np.zeros(k * k, bool) for k in (int(np.ceil(1 / v)) for v in scales) if 2 <= k <= 1024}
    for x, y, _ in points():
        for k, boxes in hit.items():
            boxes[np.minimum((x * k).astype(np.int32), k - 1) * k + np.minimum((y * k).astype(np.int32), k - 1)] = True
    known = {k: int(boxes.sum()) for k, boxes in hit.items()}
    rows = [(1 / v, known[k]) for v in scales if (k := int(np.ceil(1 / v))) in known and known[k] > 1]
    if len(rows) < 6:
        return None
    inverse, boxes = np.array(rows).T
    good = (boxes < 0.9 * n) & (boxes > 4)
    used = good if good.sum() >= 4 else boxes < 0.95 * n
    return _slope(np.log(boxes[used]), np.log(inverse[used])) if used.sum() >= 4 else None


def _line_fields(c: Numbers) -> dict[str, float | None]:
    x, sizes = c.words, c.sizes
    out: dict[str, float | None] = {}
    k = sizes[sizes > 0].astype(np.float64)
    if len(k):
        k_mean = float(k.mean())
        k -= k_mean
        var = float(np.mean(k * k))
        out |= {"length_mean": k_mean, "length_variance": var, "length_skew": float(np.mean(k * k * k)) / var**1.5 if var > 0 else 0.0}
    starts = np.cumsum(sizes) - sizes
    two = np.flatnonzero(sizes >= 2)
    if len(two):
        first, last = starts[two], starts[two] + sizes[two] - 1
        onset, coda = float(np.mean(x[first] == x[first + 1])), float(np.mean(x[last] == x[last - 1]))
        out |= {"onset": onset, "coda": coda, "onset_coda_ratio": onset / coda if coda else None}
    follow = np.flatnonzero((sizes[:-1] > 0) & (sizes[1:] > 0))
    if len(follow):
        a, b = x[starts[follow] + sizes[follow] - 1], x[starts[follow + 1]]
        xy = _clog(_repeats(np.sort(a.astype(np.int64) * c.size + b)))
        mi = np.log2(len(a)) + (xy - _clog(np.bincount(a)) - _clog(np.bincount(b))) / len(a)
        out["edge_mi"] = float(mi) if mi > 1e-12 else None
    return out


def _stream_fields(c: Numbers, counts: np.ndarray) -> dict[str, float | None]:
    """The fields of the words one after another."""
    x, n, out = c.words, len(c.words), {}
    pairs = _Pairs(x, c.size)
    if n >= 2:
        m = n - 1
        out["conditional_entropy"] = -(pairs.clogs([1])[0] - _clog(counts) + np.log2(counts[x[-1]]) - m * np.log2(m) + m * np.log2(n)) / m
    out["mi_plateau"] = _mi_plateau(x, pairs, counts, 10, 50)
    del pairs
    out["lz77_ratio"] = lz77_cost(x) / n if n else None
    return out


def signature(c: Numbers, fractal: bool = True, beside: bool = False) -> dict[str, float | None]:
    """The fields of ``signature.joint_signature`` that are defined without scores of other sources.

    ``beside``: in two threads, where a task has two cores; NumPy's sorts and sums don't hold each other up.
    """
    x, n, counts = c.words, len(c.words), np.bincount(c.words, minlength=c.size)
    present = counts[counts > 0]
    out: dict[str, float | None] = {}
    with ThreadPoolExecutor(1) as other:
        stream = other.submit(_stream_fields, c, counts)
        if not beside:
            out |= stream.result()
        out |= _line_fields(c)
        out["zipf_slope"] = _zipf(present)
        out["hapax_ratio"] = float(np.mean(present == 1)) if n else None
        out["group_stability"] = _group_stability(c, counts)
        out["positional_divergence"] = _positional_divergence(c)
        if fractal and n >= 1000:
            at = np.full(c.size, n, np.int64)
            at[x[::-1]] = np.arange(n - 1, -1, -1)
            number = np.empty(c.size, np.float64)
            number[np.argsort(at, kind="stable")] = np.arange(c.size)
            out["hurst_dfa"], out["multifractal_delta_h"] = _exponents(number[x])
            out["box_dimension"] = _box_dimension(c, counts)
        out |= stream.result()
    return {f: None if v is None else float(v) for f, v in out.items()}


def compression(c: Numbers, whole: np.ndarray) -> dict[str, float]:
    """The fields of ``coding.compression_profile`` of a corpus; ``whole``: its lines with words, as one symbol each."""
    n = len(c.words)
    if n < 100:
        return dict.fromkeys(PROFILE, 0.0)
    ids = np.unique(whole, return_inverse=True)[1].astype(np.int32)
    counts = np.unique(np.bincount(c.words, minlength=1), return_counts=True)
    values = [3 * t / n for t in _triples(c.words, (64, 256, 1024))]
    return dict(zip(PROFILE, [*values, huffman_bits(list(zip(*map(np.ndarray.tolist, counts)))) / (8 * n), 3 * _triples(ids, (256,))[0] / len(ids)]))


def _triples(x: np.ndarray, windows: Sequence[int]) -> list[int]:
    """``lz77_triples``; a repeated text takes no longer than a short one. Its last symbol may be another."""
    head = x[:64]
    again = np.flatnonzero(x[: 1 << 16] == x[0]).tolist() if len(x) > 1 << 14 else []
    for p in again[1:]:
        if np.array_equal(x[p : p + 64], head) and np.array_equal(x[p:-1], x[: -1 - p]):
            return [periodic_triples(x[:p], len(x), w, last=int(x[-1])) for w in windows]
    return lz77_triples(x, windows)


# --- written corpora ----------------------------------------------------------------------------


def _encode(path: str, only: pc.Expression | None = None) -> Numbers:
    """A written corpus ``line_no, grp, words`` as numbers; of its text only distinct words are held at once."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    texts, sizes, labels, orders = [], [], [], []
    for batch in pads.dataset(place, filesystem=fs, format="parquet").to_batches(columns=["line_no", "grp", "words"], filter=only, batch_size=1 << 16):
        lists = batch.column("words")
        texts.append(lists.flatten().dictionary_encode())
        sizes.append(np.maximum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0).astype(np.int64))
        labels.append(pc.fill_null(batch.column("grp"), "").dictionary_encode())
        orders.append(batch.column("line_no").to_numpy())
    if not orders:
        return Numbers(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), 0)

    def joined(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
        """The common dictionary in order, and the numbers in it."""
        every = pa.chunked_array(parts).unify_dictionaries()
        own = every.chunk(0).dictionary
        by = pc.sort_indices(own).to_numpy()
        back = np.empty(len(by), np.int32)
        back[by] = np.arange(len(by), dtype=np.int32)
        return own, np.concatenate([back[p.indices.to_numpy()] if len(by) else np.zeros(0, np.int32) for p in every.chunks])

    vocab, words = joined(texts)
    del texts
    _, groups = joined(labels)
    order, sizes = np.argsort(np.concatenate(orders)), np.concatenate(sizes)
    starts = np.cumsum(sizes) - sizes
    words, sizes, groups = gathered(words, starts[order], sizes[order]), sizes[order], groups[order]
    _, first, own = np.unique(groups, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    return Numbers(words, sizes, rank[own], len(vocab))


def store(lines: DataFrame) -> str:
    """Write a corpus that :func:`session.cut` gave as numbers, made in one task; the path of what the tasks read."""
    spark, written = lines.sparkSession, lines.inputFiles()
    path = written[0].rsplit("/", 1)[0] if written else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            c = _encode(path) if path else Numbers(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), 0)
            for kind, a in enumerate((np.array([c.size], np.int32), c.words, c.sizes.astype(np.int32), c.groups.astype(np.int32))):
                for i in range(0, max(len(a), 1), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([i], pa.int64()), pa.array([a[i : i + PIECE].tobytes()], pa.binary())], ["kind", "at", "data"])

    return cut(spark.range(0, 1, 1, 1).mapInArrow(run, "kind int, at long, data binary")).inputFiles()[0].rsplit("/", 1)[0]


def read(path: str) -> Numbers:
    """What :func:`store` wrote."""
    fs, place = pa.fs.FileSystem.from_uri(path)
    rows = pads.dataset(place, filesystem=fs, format="parquet").to_table().sort_by([("kind", "ascending"), ("at", "ascending")])
    part = lambda kind: np.frombuffer(b"".join(rows.filter(pc.equal(rows["kind"], kind))["data"].to_pylist()), np.int32)
    return Numbers(part(1), part(2).astype(np.int64), part(3), int(part(0)[0]))


@lru_cache(maxsize=1)
def load(path: str) -> Numbers:
    return read(path)


def rows_of(fields: dict[str, float | None], wanted: Sequence[str], keys: dict[str, int]) -> pa.RecordBatch:
    """``*keys, field, value``, a row each; what is undefined is null."""
    n = len(wanted)
    return pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int32()) for k in keys.values()), pa.array(list(wanted)), pa.array([fields.get(f) for f in wanted], pa.float64())], [*keys, "field", "value"])


def signatures(spark: SparkSession, path: str, iterations: Sequence[int], wanted: Sequence[str], fractal: bool = True, seed: int = 42) -> DataFrame:
    """``iter, field, value`` of bootstrap replicates of a stored corpus, a task each; -1 is the corpus itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                c = load(path)
                yield rows_of(signature(c if iterations[i] < 0 else c.resampled(iterations[i], seed), fractal), wanted, {"iter": iterations[i]})

    return spark.range(0, len(iterations), 1, max(len(iterations), 1)).mapInArrow(run, "iter int, field string, value double")


def profile_of(path: str, key: dict) -> dict[str, float]:
    """The compression profile of one corpus among those written as ``*key, line_no, grp, words, h``, ``h`` a line's text hashed."""
    only = pc.scalar(True)
    for name, value in key.items():
        only = only & (pc.field(name).is_null() if value is None else pc.field(name) == pc.scalar(value))
    fs, place = pa.fs.FileSystem.from_uri(path)
    rows = pads.dataset(place, filesystem=fs, format="parquet").to_table(["line_no", "h"], filter=only & pc.field("h").is_valid())
    whole = rows["h"].to_numpy()[np.argsort(rows["line_no"].to_numpy())]
    return compression(_encode(path, only), whole)
