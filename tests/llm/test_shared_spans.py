import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from quirelab.llm import shared_spans as sp
from quirelab.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

SCHEMA = "record_id long, words array<string>, rep long, h string, key int"


def table(spark, records):
    return spark.createDataFrame([(i, w, 0, "x", 1) for i, w in records], SCHEMA).repartition(3)


def brute(records, n):
    windows, lines = defaultdict(set), dict(records)
    for i, w in lines.items():
        for k in range(len(w or []) - n + 1):
            windows[tuple(w[k : k + n])].add(i)
    pairs = {p for s in windows.values() for p in combinations(sorted(s), 2)}
    shares = {}
    for i, w in lines.items():
        at = {k + j for k in range(len(w or []) - n + 1) if len(windows[tuple(w[k : k + n])]) > 1 for j in range(n)}
        shares[i] = (len(w or []), len(at))
    return sorted(pairs), shares


def brute_intervals(records, n):
    windows, lines = defaultdict(set), dict(records)
    for i, w in lines.items():
        for k in range(len(w or []) - n + 1):
            windows[tuple(w[k : k + n])].add(i)
    copies = defaultdict(set)
    for i, w in lines.items():
        copies[tuple(w or [])].add(i)
    out = []
    for i, w in lines.items():
        at = [k for k in range(len(w or []) - n + 1) if len(windows[tuple(w[k : k + n])]) > 1]
        if at and len(copies[tuple(w)]) > 1:
            out.append((i, 0, len(w)))
            continue
        for k in at:
            if k - 1 not in at:
                stop = k
                while stop + 1 in at:
                    stop += 1
                out.append((i, k, stop - k + n))
    classes = sorted((i, min(copies[tuple(w or [])]) if len(w or []) >= n else i, len(copies[tuple(w or [])]) if len(w or []) >= n else 1) for i, w in lines.items())
    return sorted(out), classes


def check(spark, records, n=8):
    df = table(spark, records)
    found = sp.shared_windows(df, n)
    real = [(i, w) for i, w in records if i is not None]
    pairs, shares = brute(real, n)
    assert sorted(tuple(r) for r in sp.shared_pairs(found).collect()) == pairs
    assert {r["record_id"]: (r["n_words"], r["shared_words"]) for r in sp.shared_shares(df, found).collect()} == shares
    if len(real) < 1000 and max((len(w or []) for _, w in real), default=0) < 1000:
        intervals, classes = brute_intervals(real, n)
        assert sorted((r["record_id"], r["start"], r["n_words"]) for r in sp.shared_intervals(df, found).collect()) == intervals
        assert sorted((r["record_id"], r["class_id"], r["copies"]) for r in sp.shared_classes(df, found).collect()) == classes
    return pairs


def corpus(rng, n, vocab=4):
    base = [[rng.choice("abcdefgh"[:vocab]) for _ in range(rng.randint(8, 30))] for _ in range(8)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            w += b[a : a + rng.randint(1, 20)]
        out.append((i, w + [f"u{i}"] * rng.randint(0, 2)))
    return out


def test_brute_force(spark):
    rng = random.Random(2)
    records = corpus(rng, 120)
    records += [(1000 + i, w) for i, (_, w) in enumerate(records[:15])]  # exact copies
    records += records[:10] + [(None, ["a"] * 20), (2000, None), (2001, []), (2002, ["a"] * 40)]
    assert len(check(spark, records)) > 20
    check(spark, records, 3)


def test_small_shards_and_hot_seeds(spark, monkeypatch):
    rng = random.Random(3)
    records = corpus(rng, 150, 3) + [(500 + i, ["boiler", "plate", "is", "in", "every", "third", "line", "here", "x", f"r{i}", f"q{i % 7}"]) for i in range(80)]
    monkeypatch.setattr(sp, "LOOK", 1)
    monkeypatch.setattr(sp, "SHARD", 1200)
    check(spark, records)  # some seeds fill a shard now
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "7")
    try:
        check(spark, records)
    finally:
        spark.conf.unset(batch)


def test_a_full_seed_is_spread(monkeypatch):
    """Windows of a seed that fills a shard have keys of their own, the others that of their seed."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(5)
    # A phrase whose hash is so small that it is the minimizer of all windows that hold it.
    low = next([k, 2, 3, 4] for k in range(10**6) if sp.window_hashes(np.array([k, 2, 3, 4], np.uint64), 4)[0] < 1 << 50)
    seqs = [[rng.randrange(10**6) for _ in range(6)] + low + [rng.randrange(10**6) for _ in range(6)] for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(seqs, pa.list_(pa.int64()))], ["rep", "h"])
    rows = lambda hot, single: [r for b in sp._segmenter(8, SimpleNamespace(value=np.array(hot, np.uint64)), single)(iter([batch])) for r in b.to_pylist()]
    by_seed = defaultdict(int)
    for r in rows([], False):
        by_seed[r["seed"]] += len(r["words"])
    top = max(by_seed, key=by_seed.get)
    full = np.array([top], np.int64).view(np.uint64)
    rest, single = rows(full, False), rows(full, True)
    assert top not in {r["seed"] for r in rest} and len(rest) == len(rows([], False)) - sum(r["seed"] == top for r in rows([], False))
    assert len({r["seed"] for r in single}) > 400 and all(len(r["words"]) == 8 for r in single)


def test_shards_end_between_seeds():
    import pyarrow as pa

    rng = random.Random(4)
    seqs = sorted((rng.randrange(12), i, 0, [rng.randrange(3) for _ in range(rng.randint(4, 12))]) for i in range(200))
    schema = pa.schema([("seed", pa.int64()), ("rep", pa.int64()), ("pos", pa.int32()), ("words", pa.list_(pa.int64()))])
    batches = pa.Table.from_pylist([dict(zip(schema.names, s)) for s in seqs], schema).to_batches(max_chunksize=9)
    whole = {(r["rep"], r["pos"]) for b in sp._indexer(4)(iter(batches)) for r in b.to_pylist()}
    old = sp.SHARD
    sp.SHARD = 60
    try:
        parts = [b.to_pylist() for b in sp._indexer(4)(iter(batches))]
    finally:
        sp.SHARD = old
    assert len(parts) > 5
    # Smaller shards only part sequences of different seeds.
    within = {(r["rep"], r["pos"]) for p in parts for r in p}
    assert within <= whole
    by_seed = defaultdict(lambda: defaultdict(list))
    for seed, rep, _, w in seqs:
        for k in range(len(w) - 3):
            by_seed[seed][tuple(w[k : k + 4])].append((rep, k))
    assert {x for s in by_seed.values() for v in s.values() if len(v) > 1 for x in v} <= within


def test_empty_and_long(spark):
    check(spark, [])
    check(spark, [(1, None), (2, ["a"])])
    long = [f"w{i}" for i in range(60_000)]
    assert check(spark, [(1, long), (2, ["z"] + long[100:50_000]), (3, ["same"] * 30_000)]) == [(1, 2)]


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(0, 4, rng.integers(1, 60))
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want
        tree = WaveletMatrix(text, 4)
        for c in range(4):
            i = np.arange(len(text) + 1)
            assert tree.rank(np.full(len(i), c), i).tolist() == [int((text[:k] == c).sum()) for k in i]
        lengths = rng.multinomial(len(text), [0.3, 0.3, 0.4])
        lengths = lengths[lengths > 0]
        index = FMIndex(text * 10 - 5, lengths)
        run = np.concatenate([np.arange(1, k + 1) for k in lengths])
        d = int(rng.integers(1, 5))
        at, lo, hi = index.matching(index.ids(text * 10 - 5), run, d, 2)
        grams = defaultdict(list)
        for o, k in zip(np.cumsum(lengths) - lengths, lengths):
            for j in range(k - d + 1):
                grams[tuple(text[o + j : o + j + d])].append(o + j + d - 1)
        assert dict(zip(at.tolist(), (hi - lo).tolist())) == {p: len(v) for v in grams.values() if len(v) > 1 for p in v}
        assert index.ids(np.array([3])).tolist() == [0]
