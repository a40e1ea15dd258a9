"""Template windows against a brute-force window check, and items with other numbers, names and units."""

import random
import re

import pytest

from strataflow.llm import decontam

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
UNITS = set(decontam.UNITS.split("|"))


def brute_tokens(text):
    """(placeholder or word, plain word) in order."""
    t = re.sub(r"(?<=\d)(\s?)((?i:" + decontam.UNITS + r"))(?![^\W_])", r"\1 \2", text or "")
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W_]+", t)]
    out = []
    for k, (w, a, _) in enumerate(words):
        if w[0].isdigit():
            out.append(["<num>", w.lower(), w, a])
        elif w.lower() in UNITS and k and words[k - 1][0][0].isdigit() and re.fullmatch(r"\s*", t[words[k - 1][2] : a]):
            out.append(["<unit>", w.lower(), w, a])
        elif len(w) > 1 and w[0].isupper() and w[1].islower():
            if out and out[-1][0] == "<name>" and t[words[k - 1][2] : a] == " ":
                out[-1][1] += " " + w.lower()
            else:
                out.append(["<name>", w.lower(), w, a])
        else:
            out.append([w.lower(), w.lower(), w, a])
    return [(o[0], o[1]) for o in out]


def brute_holds(text, item, width=5, share=0.8):
    d = brute_tokens(text)
    for form in (0, 1):
        i = brute_tokens(item)
        if form:
            i = [p for t, w in i for p in ([(x, x) for x in w.split(" ")] if t == "<name>" else [(t, w)])]
        n = min(width, len(i))
        if not n:
            continue
        found = set()
        for diagonal in range(-len(i), len(d) + 1):
            hits = [k for k in range(len(i) - n + 1) if 0 <= k + diagonal and k + diagonal + n <= len(d) and [t for t, _ in i[k : k + n]] == [t for t, _ in d[k + diagonal : k + diagonal + n]]]
            # a window of placeholders alone has to be the same word for word
            hits = [k for k in hits if any(t[0] != "<" for t, _ in i[k : k + n]) or all(i[k + x][1] == d[k + diagonal + x][1] for x in range(n))]
            slots = {(i[k + x][1], d[k + diagonal + x][1]) for k in hits for x in range(n)}
            same = len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots})
            found |= {k for k in hits if same and n == width or all(i[k + x][1] == d[k + diagonal + x][1] for x in range(n))}
        if len(found) >= share * (len(i) - n + 1):
            return True
    return False


NAMES = ["Alice Miller", "Zed", "Mary Ann Jones", "Bob", "Chen Wei", "Omar", "Lena Novak"]
PLACES = ["Paris", "New York", "Oslo", "Rio de Janeiro"]
VERBS = ["buys", "sells", "carries", "counts", "paints"]
THINGS = ["apples", "pears", "stones", "bricks", "tiles", "ropes"]


def question(rng):
    a, b = rng.sample(NAMES, 2)
    n, m, unit, thing = rng.randint(2, 99), rng.randint(100, 999), rng.choice(["kg", "km", "litres", "hours"]), rng.choice(THINGS)
    place = rng.choice(PLACES[:3])
    text = "{a} {v} {n} {u} of {t} in {p} every day and {a} also gives {m} {u} to {b} who then {w} all of the {t} again before the evening comes. How many {u} of {t} does {b} hold if {a} keeps only {n} {u}?"
    fixed = dict(t=thing, v=rng.choice(VERBS), w=rng.choice(VERBS))
    item = text.format(a=a, b=b, n=n, m=m, u=unit, p=place, **fixed)
    c, d = rng.sample([x for x in NAMES if x not in (a, b)], 2)
    copy = text.format(a=c, b=d, n=n + 100, m=m + 1000, u=rng.choice(["miles", "grams", "days"]), p=rng.choice([x for x in PLACES[:3] if x != place]), **fixed)
    return item, copy


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    pairs = [question(rng) for _ in range(40)]
    filler = lambda n: " ".join(rng.choice(["so", "the", "of", "Then", "12", "kg", "word", "Oslo", "runs"]) + rng.choice(["", "", "."]) for _ in range(n))
    docs = [(k, f"{filler(30)}. {copy} {filler(40)}") for k, (_, copy) in enumerate(pairs)]
    docs += [(100 + k, filler(80)) for k in range(20)] + [(200 + k, item.lower()) for k, (item, _) in enumerate(pairs[:5])] + [(300, None), (301, ""), (None, pairs[0][0]), (None, "clean words only")]
    items = [(k, item) for k, (item, _) in enumerate(pairs)]
    return items, docs


def test_equal_to_brute_force(spark, case):
    items, docs = case
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(d, i) for d, t in docs for i, q in items if brute_holds(t, q)}


def test_equal_where_places_are_not_broadcast(spark, case, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_PLACES", 0)
    test_equal_to_brute_force(spark, case)


def test_recall_of_reparameterised_items(spark, case):
    items, docs = case
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert sum((k, k) in got for k in range(40)) >= 36
    assert not [d for d, _ in got if d is not None and 100 <= d < 200]


def test_tables_of_numbers_hold_no_item(spark):
    numbers = lambda a, n: " ".join(str(k) for k in range(a, a + n))
    item = "What is the sum of these numbers: " + numbers(500, 40)
    rows = [(k, numbers(1000 * (k + 1), 200)) for k in range(5)] + [(5, numbers(480, 200)), (6, f"So. {item}, they ask."), (7, "What is the sum of these numbers: " + numbers(1500, 40))]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, item)], ITEMS)
    got = {(r.doc_id, r.n_found) for r in decontam.contaminated(docs, items).collect()}
    # the fifth table has the item's own numbers in a row
    assert got == {(5, 36), (6, 43)} and all(brute_holds(t, item) == (k in (5, 6)) for k, t in rows)


def test_common_windows_make_no_pairs(spark):
    """Items and texts that share a preamble meet only where an item's own windows are."""
    rng = random.Random(8)
    own = lambda n: " ".join(f"v{rng.randrange(10**6)}x" for _ in range(n))
    preamble = "read the text below and answer the question that comes after it"
    items = [(k, f"{preamble} {own(60)}") for k in range(30)]
    docs = [(k, f"{preamble} {own(50)} {preamble} {own(9)}") for k in range(60)] + [(100 + k, f"{own(5)} {items[k][1]}") for k in range(30)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(100 + k, k) for k in range(30)}


def test_inconsistent_slots_are_no_copy(spark):
    item = "Alice buys 12 kg and then Alice sells 12 kg and Alice buys 12 kg more while Alice waits for 12 days"
    mixed = "Alice buys 13 kg and then Bob sells 14 kg and Zed buys 15 kg more while Omar waits for 16 days"
    even = item.replace("Alice", "Mary Ann").replace("12", "999")
    docs = spark.createDataFrame([(1, mixed), (2, even)], DOCS)
    assert [r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(7, item)], ITEMS)).collect()] == [2]


def test_short_items_and_row_keys(spark):
    items = spark.createDataFrame([(1, "tiny one more"), (2, "12 kg"), (3, "zap"), (4, None), (5, " . "), (None, "some words here")], ITEMS)
    halves = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = spark.createDataFrame([(9, " ".join(halves))], ITEMS).union(items)
    rows = [(1, "well, tiny one more of them"), (2, "it has 13 kg"), (3, "it has 12 kg"), (4, "a zap!"), (5, "tiny one"), (None, " ".join(halves[:7])), (None, " ".join(halves[5:])), (6, " ".join(halves[:7])), (6, " ".join(halves[5:])), (6, "x " + " ".join(halves))]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' as row", "1 as item")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, long).collect())
    assert got == [(1, 1), (3, 2), (4, 3), (6, 9)]
    left = decontam.clean_documents(docs, long)
    assert left.columns == docs.columns and sorted(map(str, (tuple(r)[:2] for r in left.collect()))) == sorted(map(str, (rows[k] for k in (1, 4, 5, 6, 7, 8))))
