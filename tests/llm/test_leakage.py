import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelab.llm import leakage as lk
from quirelab.llm.textvec import Members, chunks, word_hashes, words_of

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]


def brute(docs, items, n=13):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return sorted({(i, d) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ()) if i is not None})


def make(spark, docs, items):
    return spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, kind string"), spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")


def found(spark, docs, items):
    return sorted(tuple(r) for r in lk.found_pairs(lk.leaked_passages(*make(spark, docs, items))).collect())


def test_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice([*WORDS, "12", "Paris", "km"]) for _ in range(rng.randint(5, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(w))
            parts.append(rng.choice([", ", "\n", " - "]).join(w[a : a + rng.randint(8, 25)]))
            parts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))))
        text = rng.choice([str, str.upper, str.title])(" ".join(parts))
        docs.append((d, text))
    docs += docs[:5] + [(None, docs[0][1]), (900, None), (901, ""), (902, items[3][1]), (903, " ".join(w for _, w in items))]
    items += [(30, None), (31, ""), (None, items[0][1]), items[2]]
    assert found(spark, docs, items) == brute(docs, items)
    assert len(brute(docs, items)) > 60


def test_reparameterised(spark):
    question = "A train leaves Lyon at 9 and travels 120 km to reach Dijon before noon while Marie waits there"
    names = "She met Marie in Lyon, and then Dijon was quiet"
    changed = "a train leaves oslo at 7 and travels 455 km to reach bergen before noon while anna waits there"
    items = [(1, question), (2, names)]
    # Without capitals, other names are no placeholders unless the items know them, so the changed text uses known names.
    swapped = changed.replace("oslo", "dijon").replace("bergen", "lyon").replace("anna", "marie")
    inconsistent = swapped.replace("reach lyon", "reach dijon")
    out = lk.leaked_passages(*make(spark, [(7, swapped), (8, question), (9, inconsistent), (10, question.upper())], items)).collect()
    assert sorted((r["item_id"], r["doc_id"], r["kind"]) for r in out) == [(1, 7, "reparameterised"), (1, 8, "verbatim"), (1, 10, "verbatim")]
    assert found(spark, [(7, swapped)], items) == []


def test_empty_and_long(spark):
    assert found(spark, [], []) == [] and found(spark, [(1, "a b")], []) == []
    passage = " ".join(WORDS[:20])
    long = "x " * 700_000 + passage + " y" * 700_000
    assert found(spark, [(1, long), (2, "z")], [(5, passage)]) == [(5, 1)]
    assert found(spark, [(1, "7 " * 50_000)], [(5, "7 " * 13), (6, "8 " * 20)]) == [(5, 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_words(texts):
    w = words_of(texts)
    want = []
    for i, t in enumerate(texts):
        run = ""
        for c in t.lower() + " ":
            if c.isalpha() or c.isdecimal():
                run += c
            elif run:
                want.append((i, run))
                run = ""
    assert [(int(i), w.word(k)) for k, i in enumerate(w.text)] == want
    same = {}
    for h, (_, word) in zip(w.hash.tolist(), want):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)


def test_members_and_chunks():
    import numpy as np

    x = word_hashes(WORDS)
    assert Members(x[:10]).where(x).tolist() == list(range(10))
    assert Members(x[:0]).where(x).tolist() == []
    assert list(chunks([])) == [] and list(chunks(["a" * 2_000_000, "b", "c"])) == [(0, 1), (1, 3)]
    assert np.array_equal(word_hashes(["a"]), words_of(["b a"]).hash[1:])
