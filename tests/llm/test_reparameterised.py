import random

from quirelab.llm import leakage as lk

QUESTION = "A train leaves Lyon at 9 and travels 120 km to reach Dijon before noon while Marie waits there"
NAMES = "She met Marie in Lyon, and then Dijon was quiet"
RENAMED = "A train leaves Oslo at 7 and travels 455 km to reach Bergen before noon while Anna waits there"


def search(spark, text, items=(QUESTION, NAMES)):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"], r["kind"], r["windows"]) for r in lk.leaked_passages(docs, asked).collect())


def test_names_no_item_knows(spark):
    assert search(spark, RENAMED) == [(0, 1, "reparameterised", 7)]
    assert search(spark, RENAMED.replace("Bergen", "Oslo")) == []
    assert search(spark, QUESTION) == [(0, 1, "verbatim", 7)]


def test_variants_in_one_document(spark):
    """Two consistent variants with different values, and one that is not consistent beside a good one."""
    other = RENAMED.replace(" 7 ", " 8 ").replace("455", "300").replace("Oslo", "Bergen", 1).replace("reach Bergen", "reach Oslo")
    gap = " and so it went on for a long while and nothing else was said of it "
    assert search(spark, RENAMED + gap + other) == [(0, 1, "reparameterised", 14)]
    assert search(spark, RENAMED + gap + RENAMED.replace("Bergen", "Oslo")) == [(0, 1, "reparameterised", 7)]


def test_verbatim_for_one_item_only(spark):
    """A passage that one item has word for word is still a changed one of another item."""
    second = QUESTION.replace("9", "7").replace("120", "455")
    assert search(spark, second, [QUESTION, second, NAMES]) == [(0, 1, "reparameterised", 7), (0, 2, "verbatim", 7)]


def test_decimals_and_names_that_open_sentences(spark):
    asked = "Marie buys 3 loaves for 2.50 euros and Tom pays 1,200 pages of debt. Marie then leaves the small market with nothing"
    told = "Zofia buys 12 loaves for 7 euros and Piotr pays 45.75 pages of debt. Zofia then leaves the small market with nothing"
    assert [x[2] for x in search(spark, told, [asked])] == ["reparameterised"]
    assert search(spark, told.replace("Zofia then", "Piotr then"), [asked]) != search(spark, told, [asked])


NOUNS = "train boat cart parcel letter barrel wagon basket ladder bridge mill lamp clock garden window engine".split()
VERBS = "leaves reaches carries crosses passes loses finds follows meets keeps".split()
CITIES = "Lyon Dijon Oslo Bergen Porto Graz Brno Ghent Malmo Turin Basel Krakow Split Zagreb Riga".split()
PEOPLE = "Marie Anna Zofia Piotr Jonas Emma Lukas Clara Hugo Ines Pavel Rosa".split()


def planted(rng, i):
    """A question, and the frame with other names, numbers and units."""
    noun, other, verb = rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(VERBS)
    tail = " ".join(rng.sample(NOUNS, 4))
    code = chr(97 + i % 26) + chr(97 + i // 26)  # so that no two frames have a stretch of 13 words alike
    frame = "At {n} a " + noun + code + " " + verb + " {c} near the " + other + " and {p} counts {m} {u} of rope" + code + " before {q} returns to {c} with the " + tail + " of kind"

    def fill():
        c, (p, q) = rng.choice(CITIES), rng.sample(PEOPLE, 2)
        n, m = rng.sample(range(2, 900), 2)
        number = str(n) if rng.random() < 0.6 else f"{n}.{rng.randint(1, 9)}"
        return frame.format(n=number, c=c, p=p, q=q, m=m, u=rng.choice(["miles", "feet", "km"]))

    return fill


def test_recall_on_planted_questions(spark):
    """Questions asked again with other values are found, those with values mixed up are not."""
    rng = random.Random(8)
    items, docs, want, torn = [], [], set(), set()
    for i in range(120):
        fill = planted(rng, i)
        items.append((i, fill()))
        filler = lambda: " ".join(rng.choice(NOUNS + VERBS + ["the", "a", "and"]) for _ in range(rng.randint(5, 80)))
        again = [fill() for _ in range(rng.randint(1, 3))]
        docs.append((i, filler() + ". " + f". {filler()}. ".join(again) + ". " + filler()))
        want.add((i, i))
        # The city, asked for twice, is another one the second time.
        bad = fill()
        city = next(c for c in CITIES if c in bad)
        docs.append((1000 + i, filler() + ". " + bad.replace(f"to {city}", "to " + next(c for c in CITIES if c != city)) + ". " + filler()))
        torn.add((i, 1000 + i))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["item_id"], r["doc_id"]) for r in lk.leaked_passages(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got & torn) <= 0.05 * len(torn)
    assert not got - want - torn


def test_words_too_few_to_be_a_template(spark):
    """Tables of numbers are the same table only if their numbers are."""
    table = " ".join(str(i * 37) for i in range(20))
    assert search(spark, " ".join(str(i * 41) for i in range(20)), [table]) == []
    assert search(spark, "so " + table, [table]) == [(0, 1, "verbatim", 8)]
