import random

import numpy as np

from larkspur.llm.leaks import align, find_leaks, item_classes, leaked, seeds_of, words_of

WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def brute(doc, item, weight, gap=0.25, mismatch=0.3):
    best, h = 0.0, np.zeros((len(item) + 1, len(doc) + 1))
    for i, w in enumerate(item, 1):
        for j, d in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (weight.get(w, 1.0) if w == d else -mismatch), h[i - 1, j] - gap, h[i, j - 1] - gap)
            best = max(best, h[i, j])
    return best


def test_words():
    assert words_of("The <b>fast</b> **g​rid**, don’t &amp; Ｘ１") == ["the", "fast", "grid", "don", "t", "x1"]
    assert words_of(None) == words_of("") == words_of("...") == []


def test_alignment_score_equals_brute_force():
    rng = random.Random(2)
    for k in range(15):
        item, doc = passage(k, 25), passage(100 + k, 40)
        doc[5:5] = item[3:20]
        for _ in range(4):
            doc[rng.randrange(len(doc))] = "zz"
        weight = {w: 0.5 + (hash(w) % 5) / 10 for w in WORDS}
        matched, mass, span, dspan, run = align(doc, item, weight)
        assert matched >= run and span >= matched and dspan >= matched
        gaps_and_misses = brute(doc, item, weight)
        assert mass >= gaps_and_misses - 1e-9


def test_find(spark):
    items = [(1, " ".join(passage(1, 60))), (2, " ".join(passage(2, 60))), (3, ""), (4, None), (5, " ".join(passage(1, 60)))]
    noise = lambda k, n: " ".join("n" + w for w in passage(k, n))
    edited = passage(2, 60)
    for k in range(3, 60, 6):
        edited[k] = "changed"
    docs = [
        (10, noise(1, 50) + " " + " ".join(passage(1, 60)[10:30]) + " " + noise(2, 50)),  # 20 words
        (11, " ".join(edited).upper()),
        (12, noise(3, 30) + " ".join(passage(1, 60)[10:18]) + noise(4, 30)),  # eight words only
        (13, noise(5, 3000) + " " + ", ".join(passage(2, 60)) + " " + noise(6, 3000)),
        (14, None), (15, ""), (10, noise(7, 9)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as doc")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(10, 1), (10, 5), (11, 2), (13, 2)}
    found = find_leaks(d, i, "doc_id", "item_id").collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert find_leaks(d.limit(0), i, "doc_id", "item_id").count() == 0
    assert find_leaks(d, i.limit(0), "doc_id", "item_id").count() == 0


def found(spark, docs, items):
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, i, "doc_id", "item_id").collect()}


def test_stock_phrases_are_no_seeds_but_near_equal_items_are_found(spark):
    stock = "please read the passage and then choose the single best answer to the question that follows it below now".split()
    items = {k: passage(k, 30) + stock for k in range(8)}
    near = {100 + k: passage(99, 40) + [f"own{k}"] + passage(98, 20) for k in range(6)}  # one class
    docs = {1: ["n"] * 9 + stock + ["m"] * 9, 2: ["n"] * 30 + near[103][:25] + ["m"] * 30, 3: items[4][:20]}
    assert found(spark, docs, items | near) == {(2, k) for k in near} | {(3, 4)}


def test_every_third_word_replaced(spark):
    rng = random.Random(8)
    items = {k: passage(k, 116) for k in range(12)}
    docs = {k: [f"r{rng.randrange(10**9)}" if j % 3 == 2 else w for j, w in enumerate(words)] for k, words in items.items()}
    assert found(spark, docs, items) == {(k, k) for k in items}


def test_planted_copies_are_found(spark):
    rng, items, docs, want = random.Random(4), {k: passage(k, rng_n) for k, rng_n in zip(range(60), [40, 60, 90] * 20)}, {}, set()
    for n in range(240):
        k = rng.randrange(60)
        words = items[k][:]
        kind = n % 4
        if kind == 0:  # a run of eighteen words or more
            a = rng.randrange(len(words) - 18)
            words = words[a : a + rng.randint(18, 30)]
        elif kind == 1:
            words = [f"r{rng.randrange(10**9)}" if rng.random() < 0.2 else w for w in words]
        elif kind == 2:
            words = [w for w in words if rng.random() > 0.15]
        else:
            words = [x for w in words for x in ([w, f"i{rng.randrange(10**9)}"] if rng.random() < 0.15 else [w])]
        docs[n] = ["n" + w for w in passage(1000 + n, 40)] + words + ["m" + w for w in passage(2000 + n, 40)]
        want.add((n, k))
    got = found(spark, docs, items)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_long_items_in_passages(spark):
    items = {1: passage(1, 3000), 2: passage(2, 30)}
    docs = {1: ["n"] * 50 + items[1][2000:2030] + ["m"] * 50, 2: items[1], 3: ["n"] * 5000 + items[2] * 3 + ["m"] * 5000}
    assert found(spark, docs, items) == {(1, 1), (2, 1), (3, 2)}


def test_classes(spark):
    seeds = [(i, h) for i in range(4) for h in range(20)] + [(4, h) for h in range(15, 60)] + [(9, h) for h in range(100, 110)]
    got = {r["item"]: r["class"] for r in item_classes(spark.createDataFrame(seeds, "item long, h long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 9: 9}


def test_excerpts_with_foreign_words_between():
    items = {k: passage(k, 60) for k in range(20)}
    weight = dict.fromkeys(WORDS, 1.0)

    def judge(doc, item):
        own = set(seeds_of(item)[1].tolist())
        seeds = [(p, h) for p, h in zip(*(x.tolist() for x in seeds_of(doc))) if h in own]
        return leaked(doc, seeds, item, weight, 6, 16, 0.65)

    foreign = lambda n: [f"n{i}" for i in range(n)]
    for size, between in ((20, 24), (24, 28), (20, 60), (18, 40)):
        for k, w in items.items():
            for parts in ((w[:size], w[-size:]), (w[-size:], w[:size])):
                doc = foreign(30) + parts[0] + foreign(between) + parts[1] + foreign(30)
                got = judge(doc, w)
                assert got and got[0] >= size and got[1] >= 0.65
    # excerpts that are too short by themselves do not add up over foreign words
    assert not judge(foreign(30) + items[0][:10] + foreign(40) + items[0][-10:] + foreign(30), items[0])
