"""Words and sentences of many texts at once, as NumPy arrays.

A batch of texts becomes one array of code points; word bounds, hashes and classes are then array
operations. Texts are taken whole. Arrays are built for about ``CHUNK`` characters at a time, so
memory does not follow the batch; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

CHUNK = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, b in enumerate((_B, _B_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each span, that depends on nothing but these values."""
    pow_, inv = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pow_[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive values."""
    at = np.arange(max(len(values) - n + 1, 0))
    return span_hashes(values, at, at + n)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 1 letter, 2 digit, 0 neither; and a random number."""
    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = 1
        elif c.isdecimal():
            kind[i] = 2
    return kind, mix(np.arange(1, 0x110001, dtype=np.uint64))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of successive pieces of a list, of about CHUNK characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


@dataclass
class Words:
    """Words of a chunk of texts: bounds in the code points, text number, hash, whether all digits."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    number: np.ndarray

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def words_of(texts: list[str]) -> Words:
    """Unbroken runs of letters or digits, lower-cased; everything else separates."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, numbers = _classes()
    k = kind[points]
    inside = np.zeros(len(k) + 2, np.int8)
    inside[1:-1] = k > 0
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    firsts = np.zeros(len(lowered), np.int64)
    np.cumsum([len(t) + 1 for t in lowered[:-1]], out=firsts[1:])
    text = np.searchsorted(firsts, start, "right") - 1
    digits = np.zeros(len(k) + 1, np.int32)
    np.cumsum(k == 2, out=digits[1:])
    return Words(points, start, end, text, span_hashes(numbers[points], start, end), digits[end] - digits[start] == end - start)


def in_sentence(texts: list[str], w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``words_of(texts)``, whether it has a capital in front, and whether it opens a sentence."""
    # Lower-casing may make one letter two; such letters are taken as they are lowered, to keep places.
    kept = [t if len(t) == len(t.lower()) else "".join(c if len(c.lower()) == 1 else c.lower() for c in t) for t in texts]
    points = np.frombuffer("\n".join(kept).encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (points != w.points)[w.start]
    marks = np.zeros(len(points) + 1, np.int32)
    np.cumsum(np.isin(points, np.frombuffer(".!?:;\n>|…".encode("utf-32-le"), np.uint32)), out=marks[1:])
    opens = np.ones(len(w.start), bool)
    opens[1:] = (marks[w.start[1:]] > marks[w.end[:-1]]) | (w.text[1:] != w.text[:-1])
    return upper, opens


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single lower-cased words, as :func:`words_of` gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    w = words_of(words)
    assert len(w.hash) == len(words), "each entry must be one word"
    return w.hash


class Members:
    """A sorted set of 64-bit hashes with a bitmap in front, for fast membership over long arrays."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = max(12, min(24, int(np.ceil(np.log2(len(self.sorted) + 1))) + 5))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.sorted >> self.shift] = True

    def where(self, values: np.ndarray) -> np.ndarray:
        """Indexes of the values that are in the set."""
        maybe = np.flatnonzero(self.bitmap[values >> self.shift])
        if not len(self.sorted) or not len(maybe):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.sorted, values[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == values[maybe]]
