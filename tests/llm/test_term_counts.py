import random
from collections import Counter


from quirelab.llm.term_counts import TermCounts, changed, images, term_deltas

SCHEMA = "record_id long, words array<string>, term string"


def table(spark, records):
    return spark.createDataFrame([(i, w, "clash") for i, w in records.items()], SCHEMA)


def brute(records):
    occ, rec = Counter(), Counter()
    for w in records.values():
        w = [x for x in w or [] if x is not None]
        occ.update(w)
        rec.update(set(w))
    return sorted((t, occ[t], rec[t]) for t in occ)


def state(store):
    return sorted(tuple(r) for r in store.counts().collect())


def test_incremental_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: rng.choice(["then", "", "x y", 'a"b', *(f"w{i}" for i in range(40))])
    now = {i: [word() for _ in range(rng.randrange(6))] for i in range(60)}
    now |= {100: None, 101: [None, "then", "then"], 102: []}
    store = TermCounts(spark, f"file://{tmp_path}/s", 5).apply(images(None, table(spark, now)))
    assert state(store) == brute(now) and store.total() == len(now)
    for _ in range(3):
        new = dict(now)
        for i in rng.sample(sorted(new), 8):
            new[i] = [word() for _ in range(3)]
        for i in rng.sample(sorted(new), 5):
            del new[i]
        new |= {rng.randrange(1000, 2000): [word()] for _ in range(6)}
        before, after = changed(table(spark, now), table(spark, new))
        store.apply(images(before, after))
        now = new
        assert state(store) == brute(now) and store.total() == len(now)
    again = TermCounts(spark, f"file://{tmp_path}/s")
    assert state(again) == brute(now) and again.version == 4


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = TermCounts(spark, f"file://{tmp_path}/s", 16).apply(images(None, table(spark, {i: [f"w{i}"] for i in range(300)})))
    first = set(store.place.values())
    assert len(first) == 1
    store.apply(images(None, table(spark, {999: ["w1"]})))
    assert sum(v not in first for v in store.place.values()) <= 2  # the term's bucket and that of the record count
    unchanged = changed(table(spark, {1: ["a"], 2: None}), table(spark, {1: ["a"], 2: None}))
    assert unchanged[0].count() == unchanged[1].count() == 0


def test_marks(spark):
    records = {i: ["everywhere"] + (["three"] if i < 3 else []) + (["two", "two", "two"] if i < 2 else []) + (["five"] if i < 5 else []) + (["six"] if i < 6 else []) for i in range(80)}
    records |= {i: [] for i in range(80, 100)}
    got = {r["term"]: r["mark"] for r in TermCounts(spark).apply(images(None, table(spark, records))).marked().collect()}
    assert got == {"everywhere": "common", "three": None, "two": "rare", "five": None, "six": "common"}


def test_empty_and_long(spark):
    none = TermCounts(spark).apply(images(None, table(spark, {})))
    assert none.total() == 0 and none.marked().count() == 0
    long = table(spark, {1: ["a", "b"] * 300_000})
    assert sorted(tuple(r) for r in term_deltas(images(None, long)).collect() if r["term"]) == [("a", 300_000, 1), ("b", 300_000, 1)]
    deleted = TermCounts(spark).apply(images(None, table(spark, {1: ["a"]}))).apply(images(table(spark, {1: ["a"]}), None))
    assert deleted.total() == 0 and deleted.counts().count() == 0


def test_failed_attempts_leave_the_last_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    one, two = {1: ["a", "b"], 2: ["a"]}, {1: ["a", "b"], 2: ["c"], 3: ["c", "c"]}
    store = TermCounts(spark, path, 4).apply(images(None, table(spark, one)))
    change = images(*changed(table(spark, one), table(spark, two)))
    for step in ("_publish", "_write"):
        broken, real, calls = TermCounts(spark, path), getattr(TermCounts, step), []

        def fail(*args, step=step, real=real, calls=calls):
            calls.append(1)
            if step == "_publish" or len(calls) == 2:
                raise OSError("lost")
            return real(*args)

        with monkeypatch.context() as m:
            m.setattr(TermCounts, step, fail)
            try:
                broken.apply(change)
                raise AssertionError("should have failed")
            except OSError:
                pass
        assert state(TermCounts(spark, path)) == brute(one)
    again = TermCounts(spark, path).apply(change)
    assert state(again) == brute(two) == state(TermCounts(spark, path)) and again.version == 2
    again.vacuum()
    left = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v")]
    assert state(TermCounts(spark, path)) == brute(two) and set(left) <= set(again.place.values())
    assert store.version == 1
