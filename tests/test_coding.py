import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelab.operators import coding


def naive_signature(seq, window=4096, least=3):
    i = cost = 0
    while i < len(seq):
        best = 0
        for j in range(max(0, i - window), i):
            k = 0
            while i + k < len(seq) and seq[j + k] == seq[i + k]:
                k += 1
            best = max(best, k)
        cost, i = (cost + 2, i + best) if best >= least else (cost + 1, i + 1)
    return cost / len(seq)


def naive_triples(seq, window, least):
    out, i = [], 0
    while i < len(seq):
        best, off = 0, 0
        for j in range(max(0, i - window), i):
            k = 0
            while i + k < len(seq) and j + k + 1 < i and seq[j + k] == seq[i + k]:
                k += 1
            if k > best:
                best, off = k, i - j
        if best >= least:
            out.append((off, best, None))
            i += best
        else:
            out.append((0, 0, seq[i]))
            i += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.integers(2, 20))
def test_parses(seq, window):
    assert coding.signature_cost(seq, window) == naive_signature(seq, window)
    code = coding.triples(seq, window)
    assert code == naive_triples(seq, window, 3)
    assert coding.restore(code) == seq


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=80))
def test_huffman_bits(seq):
    counts = Counter(seq)
    book = coding.code_book(dict(counts))
    bits = sum(len(book[s]) * c for s, c in counts.items())
    assert coding.huffman_bits(list(Counter(counts.values()).items())) == bits
    assert len(set(book.values())) == len(book)
    for a in book.values():
        assert len(book) == 1 or not any(b != a and b.startswith(a) for b in book.values())
    h = -sum(c / len(seq) * math.log2(c / len(seq)) for c in counts.values())
    assert h * len(seq) - 1e-9 <= bits or len(counts) == 1


def test_long_runs_are_fast():
    assert coding.signature_cost(["a"] * 200_000) == 3 / 200_000
    assert coding.signature_cost([]) is None
    assert coding.code_book({}) == {} and coding.code_book({"a": 3}) == {"a": ""}


def test_tables(spark):
    syms = spark.createDataFrame([("x", i, s) for i, s in enumerate("ab" * 100)] + [("y", i, s) for i, s in enumerate("abcdefgh")], "g string, i long, sym string")
    r = {x["g"]: x["lz77_ratio"] for x in coding.lz77_ratio(syms, ["g"]).collect()}
    assert r["x"] < r["y"] == 3.0
    back = coding.lz77_decode(coding.lz77_encode(syms, ["g"]), ["g"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, syms.collect()))
    none = syms.drop("g").limit(0)
    assert coding.lz77_ratio(none).first()[0] == 0 and coding.huffman_ratio(none).first()[0] == 0
    assert coding.huffman_codes(none).count() == 0
