import random
import re

import numpy as np

from obsq.llm.decontaminate import MASKS, best_stretch, decontaminated, leaks

DOCS = "doc_id long, text string, item_id string, words int"
BENCH = "item_id long, text string, doc_id string"


def words(t):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, bench, least=8, least_item=6, cover=0.3):
    """Every item against every document on every diagonal, without seeds."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, t in bench:
            b = words(t)
            if len(b) < least_item:
                continue
            for diagonal in range(-len(b) + 1, len(w)):
                lo, hi = max(0, -diagonal), min(len(b), len(w) - diagonal)
                s, e, n = best_stretch(np.array([w[k + diagonal] == b[k] for k in range(lo, hi)], bool))
                if n >= min(least, len(b)) and 5 * (e - s - n) <= e - s and n >= cover * len(b):
                    out.add((d, i))
    return out


def made(seed=4):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 20 + [f"w{i}é" for i in range(300)]
    bench = [(i, " ".join(r.choices(vocabulary, k=r.randint(6, 50)))) for i in range(30)]
    docs = []
    for d in range(120):
        w = r.choices(vocabulary, k=r.randint(0, 200))
        if d % 3 == 0:
            b = r.choice(bench)[1].split()
            if d % 2:  # one word in ten is another
                b = [x if r.random() > 0.1 else "other" for x in b]
            at = r.randint(0, len(w))
            w[at:at] = b
        docs.append((d, r.choice([" ", ", ", "\n"]).join(w).replace("w1", "W1")))
    return docs, bench


def test_equals_brute_force(spark):
    docs, bench = made()
    bench += [(77, bench[0][1].upper()), (5, None), (6, ""), (90, "too short")]
    docs += [(500, None), (501, ""), (502, bench[3][1] + " " + "x " * 5000 + bench[3][1])]
    got = leaks(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, "y") for r in bench], BENCH))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    want = {(d, i) for d, i in brute(docs, bench) if i != 77}
    # A diagonal on which no mask meets six equal words is not looked at.
    assert pairs <= want and len(want - pairs) <= len(want) // 50
    assert len(pairs) > 30 and (502, 3) in pairs


def test_decisions_and_odd_rows(spark):
    docs, bench = made()
    docs = docs[:9] + [docs[0], (None, docs[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
    tests = spark.createDataFrame([(*r, "y") for r in bench], BENCH)
    bad = {d for d, _ in brute(docs[:9], bench)}
    kept = decontaminated(df, tests)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert len([r for r in leaks(df, tests).collect() if r.doc_id == 0]) == 2 * len({i for d, i in brute(docs[:1], bench)})
    assert leaks(df.limit(0), tests).count() == 0 and leaks(df, tests.limit(0)).count() == 0


def test_a_swapped_word_leaves_a_hit():
    for swapped in range(12):
        same = [k != swapped for k in range(12)]
        assert any(all(same[a + k] for k, c in enumerate(m) if c == "1") for m in MASKS for a in range(12 - len(m) + 1)), swapped


def test_long_items_and_items_in_pieces(spark):
    w = [f"w{i}" for i in range(500)]
    x = [f"x{i}" for i in range(500)]
    quarters = [q for k in range(0, 40, 10) for q in [*x[k : k + 10], f"new{k}"]]
    docs = [
        (1, " ".join(["before", *w[200:340], "after"])),  # 140 words in a row of 500
        (2, " ".join(quarters)),  # four tenths of words, each on its own diagonal
        (3, " ".join([*x[:10], *(f"y{i}" for i in range(2000)), *x[20:30]])),  # two of them, far apart
        (4, " ".join([*x[:10], *(f"z{i}" for i in range(10)), *x[20:30]])),  # two on one diagonal
        (5, " ".join([*w[:12], "y", *w[50:62]])),  # neither long enough nor enough of the item
        (6, " ".join([*x[:10], *(f"y{i}" for i in range(300)), *x[:10]])),  # the same quarter twice is a quarter
    ]
    tests = [(1, " ".join(w)), (2, " ".join(x[:40]))]
    got = leaks(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS), spark.createDataFrame([(*r, "y") for r in tests], BENCH)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert [(r.start, r.end, r.n_equal, r.n_item) for r in got if r.doc_id == 1] == [(1, 141, 140, 500)]


def test_every_copy_of_an_item_has_its_row(spark):
    item, gap = [f"w{i}" for i in range(20)], [f"y{i}" for i in range(100)]
    docs = [(1, " ".join([*item, *gap, *item, *item, *gap * 3, *item]))]
    got = leaks(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS), spark.createDataFrame([(7, " ".join(item), "y")], BENCH)).collect()
    assert sorted((r.start, r.end, r.n_equal) for r in got) == [(k, k + 20, 20) for k in (0, 120, 140, 460)]


def test_short_items_are_found_whole(spark):
    items = [(1, "zebra"), (2, "green ideas sleep furiously"), (3, "one two three four five six seven eight nine")]
    docs = [(1, "A Zebra, and more text"), (2, "so green ideas sleep furiously, they say"), (3, "green ideas sleep soundly"), (4, "one two three four five six seven eight nine"), (5, "green ideas"), (6, None), (7, "zebra")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b, least_item=1).collect()}
    assert got == {(1, 1), (7, 1), (2, 2), (4, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks(d, b).collect()} == {(4, 3)}
