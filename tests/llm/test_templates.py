"""Benchmark items with other names, clashing numbers or few windows."""

from tracegraph.llm.decontaminate import consistent, contaminated

ITEMS = [
    (1, "Tom has 5 apples and buys 7 more apples today. Tom then eats 3."),
    (2, "If Anna walks over the long bridge in the rain and then back again to the old town hall, how far does Anna go?"),
    (3, "A farmer sells 3 crates in spring, then 5 crates in the hot summer, and finally 7 crates late in the autumn, so how many crates did the farmer sell over the whole year?"),
    (4, "Add 12 13 14 15 16 17 18 19 20 now"),
    (5, "Name the longest river of Europe"),
    (6, "What rots?"),
    (7, "the shop packs 2 boxes of 2 kg and sends them over the sea to a small island where the people wait for them all day"),
]
TEXTS = [
    (1, "Quiz. Sara has 5 apples and buys 7 more apples today. Sara then eats 3.", 1),
    (2, "Quiz. If Mary Ann walks over the long bridge in the rain and then back again to the old town hall, how far does Mary Ann go?", 2),
    (3, ITEMS[2][1].replace("7 crates", "3 crates"), 3),
    (4, "Now go on: add 12 13 14 15 16 17 18 19 20 now, he said", 4),
    (5, "He said: name the longest river of Europe, please", 5),
    (6, "No idea. What rots? Wood.", 6),
    (7, ITEMS[6][1].replace("2 boxes of 2", "3 boxes of 5"), 7),
    (8, "add 12 13 14 15 16 17 18 19 21 now", None),
    (9, "this is what rots in the wood", None),
    (10, "Tom has an apple and buys 7 more pears today. Sara then eats 3.", None),
    (11, "Quiz. Sara has 5 apples and buys 7 more apples today. Sara then eats 3.\n" * 2, 1),
]


def test_found(spark):
    docs = spark.createDataFrame([t[:2] for t in TEXTS], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, item) for i, _, item in TEXTS if item]
    assert {r.doc_id: r.first_word for r in got}[1] == 1


def test_largest_consistent_part():
    w = lambda k, *pairs: (k, k, k, frozenset(pairs))
    found = [w(0, ("3", "3")), w(1, ("3", "3"), ("5", "5")), w(2, ("5", "5")), w(3, ("5", "5"), ("7", "3")), w(4, ("7", "3")), w(5)]
    assert [x[0] for x in consistent(found, 1)] == [0, 1, 2, 5] and consistent(found, 5) == []


FIRST, LAST = "Anna Bob Carla Dmitri Elena Farid Grace Hugo Ines Jonas".split(), "Stone Rivers Okafor Lindgren Castillo Meyer".split()
PLAIN_WORDS = "the old farmer sold some fresh apples to a small market near river while rain fell over wide green fields and children played beside long wooden bridge before dinner".split()
UNIT_WORDS = ["km", "kg", "hours", "minutes", "dollars", "meters", "liters", "days"]


def question(rng):
    """Words with places for a name, numbers and units; the name opens a sentence at times."""
    words = [rng.choice(PLAIN_WORDS) for _ in range(rng.randint(18, 45))]
    for _ in range(rng.randint(2, 4)):
        words.insert(rng.randrange(1, len(words)), "{number} {unit}" if rng.random() < 0.5 else "{number}")
    for _ in range(rng.randint(1, 3)):
        words.insert(rng.randrange(len(words)), "{name}")
    words.insert(len(words) // 2, ". Then {name}")
    return " ".join(words) + "?"


def filled(rng, form):
    """One value for every place of one kind, so that the places agree; numbers differ from place to place."""
    name = rng.choice(FIRST) + (" " + rng.choice(LAST) if rng.random() < 0.5 else "")
    unit, numbers = rng.choice(UNIT_WORDS), rng.sample(range(2, 900), 9)
    out = form.replace("{name}", name).replace("{unit}", unit)
    for n in numbers:
        out = out.replace("{number}", str(n), 1)
    return out


def test_recall_of_questions_with_new_parameters(spark):
    import random

    rng = random.Random(11)
    forms = [question(rng) for _ in range(120)]
    bench = [(i, filled(rng, f)) for i, f in enumerate(forms)]
    around = lambda: " ".join(rng.choice(PLAIN_WORDS) for _ in range(30))
    docs = [(i, f"{around()}. {filled(rng, f)} {around()}") for i, f in enumerate(forms)]
    clean = [(1000 + i, f"{around()}. {filled(rng, question(rng))} {around()}") for i in range(120)]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    recall = sum((i, i) in got for i in range(120)) / 120
    assert recall >= 0.9, recall
    assert not any(d != i for d, i in got)


def test_short_and_slot_dense_items_stand_word_for_word(spark):
    bench = [(1, "What is the capital city of Peru?"), (2, "Compute 17 + 25 * 3 - 4 and 9 / 3 then 12 - 7 and 8 + 1")]
    docs = [(1, f"Quiz time. {bench[0][1]} Lima."), (2, f"Now {bench[1][1]} please"), (3, "What is the capital city of Chile?"), (4, "Compute 17 + 25 * 3 - 4 and 9 / 3 then 12 - 7 and 8 + 2")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2)]


def agree(windows):
    to, back = {}, {}
    return all(to.setdefault(x, y) == y and back.setdefault(y, x) == x for w in windows for x, y in w[3])


def random_windows(rng, n, values, true=None, sure=0):
    out = []
    for i in range(n):
        pairs = {}
        for _ in range(rng.randrange(0 if true is None else 1, 4)):
            x = rng.randrange(values)
            y = true[x] if i < sure else rng.randrange(values)
            if x not in pairs and y not in pairs.values():
                pairs[x] = y
        out.append((i, i, i, frozenset(pairs.items())))
    return out


def test_the_most_that_agree_is_exact_on_small_sets():
    import itertools
    import random

    rng = random.Random(8)
    for _ in range(400):
        found = random_windows(rng, rng.randrange(1, 11), rng.choice([2, 3, 5]))
        most = max(len(c) for r in range(len(found) + 1) for c in itertools.combinations(found, r) if agree(c))
        for need in (1, 3, 6):
            got = consistent(found, need)
            assert agree(got) and len(got) == (most if most >= need else 0)


def test_no_set_with_enough_agreeing_windows_is_lost():
    """Six windows of one assignment among up to 200 of random ones: what is found agrees and is six at least."""
    import random

    rng = random.Random(2)
    for _ in range(150):
        values = rng.choice([4, 8, 12, 20])
        found = random_windows(rng, rng.choice([20, 40, 80, 200]), values, dict(zip(range(values), rng.sample(range(values), values))), 6)
        rng.shuffle(found)
        got = consistent(found, 6)
        assert len(got) >= 6 and agree(got)
